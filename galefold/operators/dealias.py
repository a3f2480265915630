"""Region-based velocity dealiasing, tilt by tilt.

`dealias` labels, finds edges and merges in one grouped Arrow function, one tilt at a time;
`regions` gives the labels alone in the same way. `rounds.py` does such work by joins.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .grid import BY, SKIP, per_tilt, region_edges

BANDS = 3


def band_limits(low: float, high: float, nyquist: float, bands: int = BANDS) -> np.ndarray:
    """Limits of the velocity bands: `bands` over [-Vn, Vn], more of the same width where values lie outside.

    Values above Vn add bands below -Vn, and values below -Vn add bands above Vn.
    """
    width = 2 * nyquist / bands
    below = int(np.ceil((high - nyquist) / width)) if high > nyquist else 0
    above = int(np.ceil((-nyquist - low) / width)) if low < -nyquist else 0
    return np.linspace(-nyquist - below * width, nyquist + above * width, bands + below + above + 1)


def label_regions(ray: np.ndarray, gate: np.ndarray, v: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Labels from 1, 0 where no band holds the value: 4-connected cells of a band, numbered by band and then by first cell."""
    n_rays, n_gates = int(ray.max()) + 1, int(gate.max()) + 1
    band = np.full((n_rays, n_gates), -1, np.int32)
    own = np.searchsorted(limits, v, side="right") - 1
    band[ray, gate] = np.where((own >= 0) & (own < len(limits) - 1), own, -1)
    root = np.arange(n_rays * n_gates).reshape(n_rays, n_gates)
    pairs = []
    for a, b in (((slice(None), slice(None, -1)), (slice(None), slice(1, None))), ((slice(None, -1), slice(None)), (slice(1, None), slice(None)))):
        same = (band[a] == band[b]) & (band[a] >= 0)
        pairs.append(np.stack([root[a][same], root[b][same]]))
    x, y = np.concatenate(pairs, axis=1)
    root = root.ravel()
    while True:  # each cell's root falls to the least of its neighbours' roots, then paths are halved
        least = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], least)
        np.minimum.at(root, root[y], least)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(before, root):
            break
    cells = np.nonzero(band.ravel() >= 0)[0]
    firsts = np.unique(root[cells])
    order = firsts[np.lexsort((firsts, band.ravel()[firsts]))]
    number = np.zeros(n_rays * n_gates, np.int64)
    number[order] = np.arange(1, len(order) + 1)
    out = np.zeros(n_rays * n_gates, np.int64)
    out[cells] = number[root[cells]]
    return out.reshape(n_rays, n_gates)[ray, gate]


def _nearest_beyond(cells: np.ndarray, ring: bool, skip: int) -> tuple[np.ndarray, np.ndarray]:
    """Of label rows (n, m): flat places of each labelled cell and the next labelled one in its row."""
    r, c = np.nonzero(cells)
    if not len(r):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    last = np.append(r[1:] != r[:-1], True)
    to = np.append(np.arange(1, len(r)), 0)
    if ring:
        start = np.concatenate([[True], r[1:] != r[:-1]])
        to[last] = np.nonzero(start)[0]
    far = (c[to] - c) % cells.shape[1] if ring else c[to] - c
    ok = (far > 0) & (far <= skip + 1) & (np.ones(len(r), bool) if ring else ~last)
    flat = r * cells.shape[1] + c
    return flat[ok], flat[to[ok]]


def grid_edges(label: np.ndarray, v: np.ndarray, nyquist: float, skip: int = SKIP) -> list[tuple[int, int, float, int]]:
    """(node_a, node_b, sum_diff, weight), node_a > node_b, by (node_b, node_a), of dense label and velocity grids."""
    found = []
    for cells, values, ring in ((label, v, False), (label.T, v.T, True)):
        a, b = _nearest_beyond(np.ascontiguousarray(cells), ring, skip)
        la, lb, va, vb = cells.ravel()[a], cells.ravel()[b], values.ravel()[a], values.ravel()[b]
        other = la != lb
        found.append(np.stack([la[other], lb[other], va[other], vb[other]]))
    la, lb, va, vb = np.concatenate(found, axis=1)
    high, low = np.maximum(la, lb).astype(np.int64), np.minimum(la, lb).astype(np.int64)
    diff = np.where(la > lb, va - vb, vb - va) / (2 * nyquist)
    keys, at = np.unique(low * (1 << 32) + high, return_inverse=True)
    total, weight = np.bincount(at, 2 * diff, len(keys)), np.bincount(at, minlength=len(keys)) * 2
    return [(int(k & 0xFFFFFFFF), int(k >> 32), float(s), int(w)) for k, s, w in zip(keys, total, weight, strict=True)]


def merge_regions(size: dict[int, int], edges: list[tuple[int, int, float, int]]) -> dict[int, int]:
    """Folds of each region. The heaviest edge (ties: the first by (node_b, node_a)) is merged again and again.

    The smaller node takes round(mean difference) folds and joins the larger; on equal
    sizes the edge's first end is the larger.
    """
    ends, total, weight = [], [], []
    links: dict[int, dict[int, int]] = {n: {} for n in size}
    for a, b, s, w in sorted(edges, key=lambda e: (e[1], e[0])):
        links[a][b] = links[b][a] = len(ends)
        ends.append((a, b))
        total.append(s)
        weight.append(w)
    size, members, fold = dict(size), {n: [n] for n in size}, dict.fromkeys(size, 0)
    heap = [(-w, k) for k, w in enumerate(weight)]
    heapq.heapify(heap)

    def towards(k: int, first: int) -> None:
        if ends[k][0] != first:
            ends[k], total[k] = ends[k][::-1], -total[k]

    while heap:
        w, k = heapq.heappop(heap)
        if weight[k] != -w:
            continue
        a, b = ends[k]
        folds = int(np.floor(abs(total[k] / weight[k]) + 0.5)) * (1 if total[k] >= 0 else -1)
        keep, gone = (a, b) if size[a] >= size[b] else (b, a)
        if keep == b:
            folds = -folds
        for r in members[gone]:
            fold[r] += folds
        weight[k] = 0
        del links[keep][gone], links[gone][keep]
        for e in links[keep].values():
            towards(e, keep)
        for other, e in links.pop(gone).items():
            towards(e, gone)
            total[e] += weight[e] * folds
            ends[e] = (keep, other)
            del links[other][gone]
            if (twin := links[keep].get(other)) is not None:
                weight[twin] += weight[e]
                total[twin] += total[e]
                weight[e] = 0
                heapq.heappush(heap, (-weight[twin], twin))
            else:
                links[keep][other] = links[other][keep] = e
        members[keep] += members.pop(gone)
        size[keep] += size.pop(gone)
    return fold


def centred(fold: dict[int, int], size: dict[int, int]) -> dict[int, int]:
    """Folds less their mean over gates, rounded half away from zero."""
    mean = sum(fold[r] * size[r] for r in fold) / max(1, sum(size.values()))
    shift = int(np.floor(abs(mean) + 0.5)) * (1 if mean >= 0 else -1)
    return {r: f - shift for r, f in fold.items()}


def _by_tilt(gates: DataFrame, by: list[str], f, columns: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Run f(arrays of a tilt) -> dict of new columns, on each tilt's gates; a tilt is some hundred thousand gates at most. keep: other columns that stay."""
    names = [*by, "ray_idx", "gate_idx", "v", "nyquist_ms", *keep]
    kinds = {x.name: x.dataType.simpleString() for x in gates.schema.fields}

    def run(table: pa.Table) -> pa.Table:
        arrays = {c: table[c].to_numpy() for c in ("ray_idx", "gate_idx", "v", "nyquist_ms")}
        for name, values in f(**arrays).items():
            table = table.append_column(name, pa.array(values))
        return table

    return gates.select(*names).where("v is not null and v = v").groupBy(*by).applyInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + f", {columns}")


def _labels(ray_idx, gate_idx, v, nyquist_ms):
    nyquist = float(nyquist_ms[np.lexsort((gate_idx, ray_idx))[0]])
    if not np.isfinite(nyquist) or nyquist <= 0:
        return np.zeros(len(v), np.int64), nyquist
    return label_regions(ray_idx, gate_idx, v, band_limits(v.min(), v.max(), nyquist)), nyquist


@per_tilt
def regions(gates: DataFrame, by: list[str] = BY, keep: tuple[str, ...] = ()) -> DataFrame:
    """Gates with `region`, numbered from 1 in each tilt; 0 where a value lies in no band. keep: other columns that stay."""

    def f(**x):
        return {"region": _labels(**x)[0].astype(np.int64)}

    return _by_tilt(gates, by, f, "region long", keep)


@per_tilt
def dealias(gates: DataFrame, by: list[str] = BY) -> DataFrame:
    """Gates with `region`, `folds` and `corrected` = v + folds * 2 Vn.

    A tilt without a valid Nyquist velocity, with fewer than two regions or without edges
    keeps its values; so does a gate that lies in no band.
    """

    def f(ray_idx, gate_idx, v, nyquist_ms):
        label, nyquist = _labels(ray_idx, gate_idx, v, nyquist_ms)
        folds = np.zeros(len(v), np.int32)
        if label.max(initial=0) >= 2:
            shape = (int(ray_idx.max()) + 1, int(gate_idx.max()) + 1)
            cells, values = np.zeros(shape, np.int64), np.zeros(shape)
            cells[ray_idx, gate_idx], values[ray_idx, gate_idx] = label, v
            if edges := grid_edges(cells, values, nyquist):
                size = {k: int(n) for k, n in enumerate(np.bincount(label)) if k and n}
                fold = centred(merge_regions(size, edges), size)
                table = np.array([fold.get(k, 0) for k in range(int(label.max()) + 1)], np.int32)
                folds = table[label]
        return {"region": label, "folds": folds, "corrected": v + folds * (2 * nyquist if np.isfinite(nyquist) else 0.0)}

    return _by_tilt(gates, by, f, "region long, folds int, corrected double")


@per_tilt
def apply_folds(gates: DataFrame, folds: DataFrame, by: list[str] = BY) -> DataFrame:
    """Gates with a region joined with (by, region, folds)."""
    return gates.join(folds, [*by, "region"], "left").withColumn("corrected", F.col("v") + F.coalesce("folds", F.lit(0)) * 2 * F.col("nyquist_ms"))


@per_tilt
def region_sizes(labelled: DataFrame, by: list[str] = BY) -> DataFrame:
    return labelled.where("region > 0").groupBy(*by, "region").agg(F.count("*").alias("n_gates"))


@per_tilt
def fold_votes(labelled: DataFrame, by: list[str] = BY, skip: int = SKIP) -> DataFrame:
    """Per region the folds that most of its boundary pairs ask for, against the other side: weight of the winner and of all."""
    edges = region_edges(labelled, by, skip)
    k = F.round(F.col("sum_diff") / F.col("weight")).cast("int")
    votes = edges.select(*by, F.explode(F.array(F.struct(F.col("node_a").alias("region"), (-k).alias("k"), "weight"), F.struct(F.col("node_b").alias("region"), k.alias("k"), "weight"))).alias("x")).select(*by, "x.*")
    sums = votes.groupBy(*by, "region", "k").agg(F.sum("weight").alias("w"))
    return sums.groupBy(*by, "region").agg(F.max_by("k", F.struct("w", -F.abs("k"), "k")).alias("k"), F.max("w").alias("votes"), F.sum("w").alias("all_votes"))


@per_tilt
def fold_scores(labelled: DataFrame, by: list[str] = BY, most: int = 2, scale_share: float = 0.4) -> DataFrame:
    """Per region the fold in [-most, most] with the least mean Huber cost against neighbours across its boundary, the second best and the margin."""
    from .grid import next_with_data

    pairs = next_with_data(labelled, by).where("a.region <> b.region")
    sides = F.explode(F.array(F.struct(F.col("a.region").alias("region"), F.col("a.v").alias("v"), F.col("b.v").alias("other")), F.struct(F.col("b.region").alias("region"), F.col("b.v").alias("v"), F.col("a.v").alias("other"))))
    nyquist = labelled.groupBy(*by).agg(F.min_by("nyquist_ms", F.struct("ray_idx", "gate_idx")).alias("nyquist_ms"))
    tried = pairs.select(*by, sides.alias("x")).select(*by, "x.*").join(nyquist, by).withColumn("k", F.explode(F.sequence(F.lit(-most), F.lit(most))))
    cost = S.huber(F.col("other") - F.col("v") - F.col("k") * 2 * F.col("nyquist_ms"), scale_share * F.col("nyquist_ms"))
    costs = tried.groupBy(*by, "region", "k").agg(F.avg(cost).alias("cost"))
    ranked = costs.groupBy(*by, "region").agg(F.array_sort(F.collect_list(F.struct("cost", F.abs("k").alias("size"), "k"))).alias("c"))
    return ranked.select(*by, "region", F.col("c")[0]["k"].alias("best_k"), F.col("c")[0]["cost"].alias("best_cost"), F.col("c")[1]["cost"].alias("second_cost"), (F.col("c")[1]["cost"] - F.col("c")[0]["cost"]).alias("margin"))


def vertical_votes(labelled: DataFrame, neighbours: DataFrame, volume: list[str], most: int = 3, support: int = 6, share: float = 0.72, side_share: float = 0.65, residual: float = 0.45) -> DataFrame:
    """Per region the folds that the tilts below and above ask for, and whether they are accepted.

    Accepted: at least `support` matched gates, `share` of them for one k other than 0, both
    sides of three gates or more for the same k with `side_share`, and a shift that brings the
    summed difference to `residual` of what it was. All tilts vote on the values as given.
    """
    from . import align

    key = [*volume, "elevation_number", "region"]
    period = 2 * F.col("nyquist_ms")
    sides = [align.vertical_lookup(labelled, neighbours, volume, side).where("nearest is not null").select(*key, F.lit(side).alias("side"), "v", "nearest", "nyquist_ms") for side in ("below", "above")]
    rows = sides[0].unionByName(sides[1]).withColumn("k", F.round((F.col("nearest") - F.col("v")) / period).cast("int"))
    tried = rows.withColumn("t", F.explode(F.sequence(F.lit(-most), F.lit(most))))
    sums = tried.groupBy(*key, "t").agg(
        *(F.sum(((F.col("k") == F.col("t")) & cond).cast("long")).alias(n) for n, cond in (("votes", F.lit(True)), ("below", F.col("side") == "below"), ("above", F.col("side") == "above"))),
        F.sum(F.abs(F.col("v") + F.col("t") * period - F.col("nearest"))).alias("cost"),
    )
    best = lambda c: F.max_by("t", F.struct(c, -F.col("t")))
    out = sums.groupBy(*key).agg(
        best("votes").alias("k"), F.max("votes").alias("best_votes"), F.sum("votes").alias("n_votes"), best("below").alias("k_below"), F.max("below").alias("votes_below"), F.sum("below").alias("n_below"), best("above").alias("k_above"), F.max("above").alias("votes_above"), F.sum("above").alias("n_above"),
        F.max_by("cost", F.struct("votes", -F.col("t"))).alias("new_cost"), F.max(F.when(F.col("t") == 0, F.col("cost"))).alias("old_cost"),
    )
    agree = (F.col("n_below") < 3) | (F.col("n_above") < 3) | ((F.col("k_below") == F.col("k")) & (F.col("k_above") == F.col("k")) & (F.col("votes_below") >= side_share * F.col("n_below")) & (F.col("votes_above") >= side_share * F.col("n_above")))
    accepted = (F.col("n_votes") >= support) & (F.col("k") != 0) & (F.col("best_votes") >= share * F.col("n_votes")) & agree & (F.col("new_cost") <= residual * F.col("old_cost"))
    return out.withColumn("accepted", accepted)


def median_fold(gates: DataFrame, by: list[str], folds: str) -> DataFrame:
    """Per component the fold of its middle gate: the least one that more than half of the gates reach."""
    n = gates.groupBy(*by, folds).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    n = n.withColumns({"upto": F.sum("n").over(w.orderBy(folds)), "total": F.sum("n").over(w)})
    return n.where(F.col("upto") > F.floor(F.col("total") / 2)).groupBy(*by).agg(F.min(folds).alias("folds"))


@per_tilt
def tilt_anchor(gates: DataFrame, by: list[str] = BY, most: int = 3, least_gates: int = 40, better: float = 0.35, small: float = 0.30) -> DataFrame:
    """Per tilt the folds that bring its mean velocity nearest to zero, if that is clearly better (`better` of the mean before)
    and small (`small` Vn); 0 for tilts where it isn't, or of fewer than `least_gates` gates."""
    rows = gates.where("v is not null and v = v and nyquist_ms > 0").groupBy(*by).agg(F.count("*").alias("n"), F.avg("v").alias("mean_v"), F.avg("nyquist_ms").alias("vn"))
    at = lambda k: F.abs(F.col("mean_v") + k * 2 * F.col("vn"))
    best = F.array_min(F.array(*(F.struct(F.round(at(k), 9).alias("far"), F.lit(abs(k)).alias("size"), F.lit(k).alias("k")) for k in range(-most, most + 1))))["k"]
    rows = rows.withColumn("best_", best)
    good = (F.col("n") >= least_gates) & (at(F.col("best_")) < better * F.abs("mean_v")) & (at(F.col("best_")) < small * F.col("vn"))
    return rows.withColumn("shift", F.when(good, F.col("best_")).otherwise(0)).drop("best_")


@per_tilt
def largest_regions(labelled: DataFrame, by: list[str] = BY, most: int = 4) -> DataFrame:
    """The `most` largest regions of each tilt, largest first; the lower number of equals."""
    n = labelled.groupBy(*by, "region").agg(F.count("*").alias("n_gates"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("n_gates").desc(), "region"))
    return n.withColumn("rank", rank).where(F.col("rank") <= most)
