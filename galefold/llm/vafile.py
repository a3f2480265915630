"""Operator 13: centroid clustering over a VA-file.

Vectors of `dims` components become integers, floor(1024 * x). The VA-file holds a few bits
a component: the number of its cell, cut at quantiles of a bounded sample (SAMPLE vectors)
between the least and the greatest value of all vectors. For each centroid, lookup
tables give the least and the greatest squared distance of each cell in each dimension; their
sums are an interval for every vector and centroid. Where only one centroid's interval reaches
below the least upper end, the vector's nearest centroid is known from its cells alone; only
where intervals overlap is the full vector fetched and measured.

A round's centroids come from those of the round before by what has changed: sums and
counts lose and gain the vectors that moved, and only these are fetched, too. Each
round is one pass without a shuffle of vectors; a task adds up at most k * dims sums, and
k * dims sums reach the driver. Which vectors moved is found from the two last sets of
centroids again, so no assignment is kept between rounds and a lost task is simply run again.

Defined results: vectors with another number of components, with a null or non-finite one, or
with one of 2**62 or more after scaling (its square fits no long), aren't kept, nor is a null
vector; a null vec_id is clustered, but starts no centroid while others are left; equal ids are
ordered by their vectors; fewer vectors than k start as many centroids; a distance that no long
holds is null, and so are sums over it; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved

SCALE = 1024
#: Bits of a cell's number, and vectors of the sample that cuts the cells. Components below SMALL need no more than 64 bits for a distance.
BITS, SAMPLE, SMALL = 4, 10_000, 1 << 27
_CELLS = 1 << BITS


class Cells(NamedTuple):
    """Per dimension: the upper cuts (a cell has its cut and what is below), and the least and greatest value of each cell."""

    cuts: np.ndarray
    low: np.ndarray
    high: np.ndarray


def cells_of(sample: np.ndarray, least: np.ndarray, most: np.ndarray) -> Cells:
    """_CELLS cells a dimension at the sample's quantiles."""
    places = (np.arange(1, _CELLS) * len(sample)) // _CELLS
    cuts = np.sort(sample, axis=0)[places].T
    cuts = np.minimum(np.maximum(cuts, least[:, None]), most[:, None])
    low = np.concatenate([least[:, None], cuts + 1], axis=1)
    high = np.concatenate([cuts, most[:, None]], axis=1)
    return Cells(cuts, np.minimum(low, high), high)  # of a cell without any value both ends are the upper one


def encoded(x: np.ndarray, cells: Cells) -> np.ndarray:
    """(n, dims) cell numbers."""
    return np.stack([np.searchsorted(cells.cuts[d], x[:, d], side="left") for d in range(x.shape[1])], axis=1).astype(np.uint8)


def packed(codes: np.ndarray) -> np.ndarray:
    """Two cells a byte."""
    codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
    return codes[:, ::2] | codes[:, 1::2] << BITS


def unpacked(data: np.ndarray, dims: int) -> np.ndarray:
    return np.stack([data & (_CELLS - 1), data >> BITS], axis=2).reshape(len(data), -1)[:, :dims]


class Nearest:
    """Nearest centroids by cells first."""

    def __init__(self, centroids: np.ndarray, cells: Cells):
        self.centroids = centroids
        q = centroids.T[:, None, :]  # dims, 1, k
        low, high = cells.low[:, :, None], cells.high[:, :, None]
        self.least = np.maximum(np.maximum(low - q, q - high), 0) ** 2
        self.most = np.maximum(abs(q - low), abs(high - q)) ** 2

    def intervals(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind, shape = self.centroids.dtype, (len(codes), len(self.centroids))
        least, most = np.zeros(shape, kind), np.zeros(shape, kind)
        for d in range(codes.shape[1]):
            least += self.least[d][codes[:, d]]
            most += self.most[d][codes[:, d]]
        return least, most

    def candidates(self, codes: np.ndarray) -> np.ndarray:
        """(n, k): which centroids may be nearest."""
        least, most = self.intervals(codes)
        return least <= most.min(axis=1, keepdims=True)

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.stack([((x - c) ** 2).sum(axis=1) for c in self.centroids], axis=1)

    def of(self, codes: np.ndarray, fetch) -> np.ndarray:
        """The nearest centroid of each row, the smaller number of equals; fetch(rows) gives full vectors."""
        may = self.candidates(codes)
        out = may.argmax(axis=1)
        unclear = np.nonzero(may.sum(axis=1) > 1)[0]
        if len(unclear):
            out[unclear] = self.distances(fetch(unclear)).argmin(axis=1)
        return out


def _rows(batch: pa.RecordBatch, dims: int, kind) -> tuple[np.ndarray, object]:
    """The cells of a batch, and what fetches full vectors of some rows."""
    data = np.frombuffer(b"".join(batch["cells"].to_pylist()), np.uint8).reshape(batch.num_rows, (dims + 1) // 2)

    def fetch(rows: np.ndarray) -> np.ndarray:
        return batch["y"].take(pa.array(rows, pa.int64())).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(kind)

    return unpacked(data, dims), fetch


def _encode(cells: Cells, dims: int, kind):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            x = batch["y"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(kind)
            own = packed(encoded(x, cells))
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["y"], pa.array([r.tobytes() for r in own], pa.binary())], names=["vec_id", "y", "cells"])

    return run


def _moved(before: np.ndarray | None, now: np.ndarray, cells: Cells):
    """What the vectors that changed their centroid add to sums and counts (dim -1)."""
    dims, kind = now.shape[1], now.dtype

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old, new = (Nearest(before, cells) if before is not None else None), Nearest(now, cells)
        sums = np.zeros((len(now), dims + 1), object)
        for batch in rows:
            if not batch.num_rows:
                continue
            codes, fetch = _rows(batch, dims, kind)
            to = new.of(codes, fetch)
            was = old.of(codes, fetch) if old else np.full(len(to), -1)
            moved = np.nonzero(to != was)[0]
            if not len(moved):
                continue
            x = fetch(moved)
            for k in range(len(now)):
                for sign, own in ((1, to[moved] == k), (-1, was[moved] == k)):
                    if own.any():
                        sums[k, :dims] += sign * x[own].sum(axis=0).astype(object)
                        sums[k, dims] += sign * int(own.sum())
        k, d = np.nonzero(sums != 0)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(d, pa.int32()), pa.array([Decimal(int(sums[a, b])) for a, b in zip(k, d, strict=True)], pa.decimal128(38, 0))], names=["k", "d", "total"])

    return run


def _assigned(centroids: np.ndarray, cells: Cells):
    dims, kind = centroids.shape[1], centroids.dtype

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Nearest(centroids, cells)
        for batch in rows:
            codes, fetch = _rows(batch, dims, kind)
            own = nearest.of(codes, fetch)
            far = ((fetch(np.arange(len(own))) - centroids[own]) ** 2).sum(axis=1)
            far = [int(f) if f < 1 << 63 else None for f in far]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(own, pa.int32()), pa.array(far, pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


class Clustering(NamedTuple):
    """The VA-file (vec_id, y: scaled components, cells), its cells and the centroids of the last round."""

    file: DataFrame
    cells: Cells | None
    centroids: np.ndarray

    def candidates(self) -> DataFrame:
        """Per vector how many centroids' intervals overlap: vec_id, n_candidates (1: known by cells alone)."""
        centroids, cells = self.centroids, self.cells

        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nearest = Nearest(centroids, cells)
            for batch in rows:
                codes, _ = _rows(batch, centroids.shape[1], centroids.dtype)
                yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(nearest.candidates(codes).sum(axis=1), pa.int32())], names=["vec_id", "n_candidates"])

        return self.file.mapInArrow(run, "vec_id long, n_candidates int")


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3) -> Clustering:
    """k-means in integers over the `embedding` of each vec_id."""
    x = F.col("embedding").cast("array<double>")
    scaled = F.transform(x, lambda v: v * float(SCALE))
    whole = (F.size(x) == dims) & F.forall(scaled, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float(1 << 62)))
    kept = vectors.where(F.coalesce(whole, F.lit(False)))
    rows = saved(kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(scaled, lambda v: F.floor(v).cast("long")).alias("y")), "vectors")
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    sample = rows.select("y", mark.alias("mark")).orderBy(F.col("mark").asc_nulls_last(), "y").limit(max(SAMPLE, k)).select("y").toArrow()["y"].combine_chunks()  # SAMPLE vectors at most
    if not len(sample):
        return Clustering(rows, None, np.zeros((0, dims), np.int64))
    sample = sample.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    ends = rows.agg(*(f(F.get("y", F.lit(d))) for f in (F.min, F.max) for d in range(dims))).first()
    kind = np.int64 if max(map(abs, ends)) < SMALL else object
    least, most = (np.array(list(e), kind) for e in (ends[:dims], ends[dims:]))
    cells = cells_of(sample.astype(kind), least, most)
    file = saved(rows.mapInArrow(_encode(cells, dims, kind), "vec_id long, y array<long>, cells binary"), "va-file")
    now, before = sample[:k].astype(kind), None
    sums = np.zeros((len(now), dims + 1), object)
    for _ in range(rounds):
        for r in file.mapInArrow(_moved(before, now, cells), "k int, d int, total decimal(38,0)").groupBy("k", "d").agg(F.sum("total").alias("total")).collect():  # k * (dims + 1) numbers at most
            sums[r["k"], r["d"]] += int(r["total"])
        before = now
        now = np.array([s[:dims] // s[dims] if s[dims] else c for s, c in zip(sums, before.astype(object), strict=True)], object).astype(kind)
    return Clustering(file, cells, now)


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    found = cluster(vectors, k, rounds, dims, seed)
    if found.cells is None:
        return found.file.select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    own = saved(found.file.mapInArrow(_assigned(found.centroids, found.cells), "vec_id long, cluster int, distance long"), "clusters")
    total = {r["cluster"]: r["total"] for r in own.groupBy("cluster").agg(F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)"))).alias("total")).collect()}  # k rows at most
    fits = lambda n: int(n) if n is not None and n < 1 << 63 else None
    names = range(len(found.centroids))
    of = lambda values, kind: F.element_at(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("cluster") + 1)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()]
    everything = None if None in total.values() else fits(sum(total.values()))
    return own.select("vec_id", "cluster", "distance", of([fits(total.get(c)) for c in names], "long").alias("cluster_inertia"), F.lit(everything).cast("long").alias("inertia"), of(digest, "string").alias("centroid_sha256"))


def op13(spark: SparkSession, embeddings: DataFrame) -> DataFrame:
    return clusters(embeddings, k=8, rounds=10, dims=64, seed=3)
