"""Operator 2: SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints are 64 bits; two link at `radius` or fewer differing bits. Equal
fingerprints collapse before any comparison. The index has these levels:

* Top nodes factor a shared masked pattern: the bits are cut into blocks, a mask keeps
  `kept` of them, and all fingerprints with the same bits under a mask form a node.
  With radius + kept blocks, two fingerprints within the radius agree on some mask.
* A node with more than NODE_LIMIT fingerprints is split the same way on the bits that
  its mask leaves free, again and again. Those that remain are small, whatever the
  data, since under n free bits there are at most 2**n different fingerprints.
* Within a node fingerprints stand in Gray order, where neighbours share most bits.
  Each FANOUT of them get a parent with the bits that all share, and so on upwards. A
  search goes down from the root, adds up differences with each node's own pattern and
  drops a whole group once they exceed the radius.

A node reports a tree of links for each set of fingerprints that it connects, never all
pairs; components come from joins over these. No step holds more than a node, and none
caps its size.

`keep_one` finds near copies at a given Jaccard similarity of word shingles through the same
index, with 1 + TABLES fingerprints a text, a table each. The first is the SimHash of its shingles. It loses
many pairs of similarity 0.8 (at that similarity it differs in ten bits on average), so each of the
others draws SAMPLES shingles by min-hash and takes SAMPLE_BITS of the hash of each: it
differs in 6.4 bits on average, whatever the kind of edit. Top nodes are the masks that keep
one of BLOCKS blocks; in a node, codes within NEAR bits form a group. A node with
more than NODE_LIMIT codes is dealt into tiles that cover all its pairs: near copies agree on most of their bits, so to
split them by free bits would hardly divide them. The texts of a
group are a bucket. Within a bucket texts are compared by their whole shingle sets, from one text to all that
no verified link has reached yet, so a link that fails costs no other pair its comparison.
A pair of similarity 0.8 is in no common group of the TABLES drawn ones with probability 0.0002, one of 0.86 with
0.000001. Buckets with the same members are
compared once; one with more than NODE_LIMIT members, or too many shingles for one task
(TILE_SHINGLES, TILE_WORK), is dealt into tiles as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, batches, drop, fresh, merge, parted, saved, sieve, whole_texts
from .components import connected_components
from .words import WordHashes, hashed, mixed, multipliers, run_hashes

BITS = 64
NODE_LIMIT = 4096
#: Of a tile of near-copy candidates: shingles (about 42 bytes each while it is searched) and shingles times members (about 15 s).
TILE_SHINGLES, TILE_WORK = 1 << 22, 1 << 31
FANOUT = 16
SHINGLE = 5
SIMILARITY = 0.8
#: Fingerprints of drawn shingles beside the SimHash, shingles that each draws and bits that it takes of one.
TABLES, SAMPLES, SAMPLE_BITS = 5, 16, 4
#: Blocks of a fingerprint, of which a mask keeps one, and bits in which near copies differ at most in a table that names them.
BLOCKS, NEAR = 4, 10


# -- fingerprints ------------------------------------------------------------------------------


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """Every run of `size` words joined by a blank; the whole sequence if there are fewer; none without words."""
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False)))


def fingerprint(features: list[bytes], seed: int = 42) -> int:
    """Bit i is 1 if it is set in over half of the features' XXH64; zero without features."""
    import xxhash

    if not features:
        return 0
    h = np.frombuffer(b"".join([xxhash.xxh64_digest(x, seed) for x in features]), np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at : at + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row. A-Z are lower-cased; a null text has no words."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            fps = [signed(fingerprint(shingles(t.encode().lower().split(), size), seed)) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return whole_texts(docs).mapInArrow(run, "doc_id long, fp long")


# -- index -------------------------------------------------------------------------------------


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each 64-bit code in the reflected Gray order."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def masks_of(free: int, parts: int, kept: int) -> list[int]:
    """The masks that keep `kept` of `parts` blocks of the bits in `free`."""
    bits = [b for b in range(BITS) if free >> b & 1]
    blocks = [sum(1 << int(b) for b in own) for own in np.array_split(bits, min(parts, len(bits)))]
    return [sum(x) for x in combinations(blocks, kept)]


class GrayTree:
    """The hierarchy over one node's fingerprints, which are distinct and in Gray order."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        masks, values = [np.full(len(codes), full)], [codes]
        while len(values[-1]) > 1:
            m, v = masks[-1], values[-1]
            starts = np.arange(0, len(v), FANOUT)
            first = np.repeat(v[starts], np.diff(np.append(starts, len(v))))
            masks.append(np.bitwise_and.reduceat(m & ~(v ^ first), starts))
            values.append(v[starts] & masks[-1])
        #: From the root down: values, and the masks without what the parent's mask has.
        self.levels = []
        for k in range(len(values) - 1, -1, -1):
            over = np.uint64(0) if k == len(values) - 1 else masks[k + 1][np.arange(len(values[k])) // FANOUT]
            self.levels.append((values[k], masks[k] & ~over))

    def search(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, code's place, differing bits) of all within the radius."""
        q, node, far = np.arange(len(queries)), np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
        for k, (values, own) in enumerate(self.levels):
            if k:
                child = node[:, None] * FANOUT + np.arange(FANOUT)
                fits = child < len(values)
                q, far, node = np.repeat(q, FANOUT)[fits.ravel()], np.repeat(far, FANOUT)[fits.ravel()], child[fits]
            far = far + np.bitwise_count((queries[q] ^ values[node]) & own[node])
            near = far <= radius
            q, node, far = q[near], node[near], far[near]
        return q, node, far


def forest(codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places within the radius that connect all codes of a node that links connect: a tree for each component, near pairs first."""
    n, out = len(codes), []
    root = np.arange(n)
    members = {k: [k] for k in range(n)}

    def add(a: np.ndarray, b: np.ndarray, far: np.ndarray) -> None:
        for d in range(radius + 1):
            at = np.nonzero(far == d)[0]
            for x, y in zip(a[at[root[a[at]] != root[b[at]]]].tolist(), b[at[root[a[at]] != root[b[at]]]].tolist(), strict=True):
                low, high = sorted((int(root[x]), int(root[y])), key=lambda r: -len(members[r]))
                if low != high:
                    root[members[high]] = low
                    members[low] += members.pop(high)
                    out.append((x, y))

    tree = GrayTree(codes)
    for at in range(0, n, 256):
        q, c, far = tree.search(codes[at : at + 256], radius)
        later = q + at < c
        add(q[later] + at, c[later], far[later])
    pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _search_nodes(radius: int):
    """Rows of a partition come sorted by node (table, mask, pattern); each node is searched once it is whole."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, key = np.zeros(0, np.uint64), None

        def out(nodes: list[np.ndarray], tables: list[int]) -> pa.RecordBatch:
            a, b, t = [], [], []
            for codes, table in zip(nodes, tables, strict=True):
                if len(codes) > 1:
                    codes = codes[np.argsort(gray_rank(codes))]
                    x, y = forest(codes, radius)
                    a.append(codes[x])
                    b.append(codes[y])
                    t.append(np.full(len(x), table, np.int32))
            join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
            return pa.RecordBatch.from_arrays([pa.array(join(t, np.int32)), pa.array(join(a, np.uint64).view(np.int64)), pa.array(join(b, np.uint64).view(np.int64))], names=["tab", "a", "b"])

        for batch in rows:
            if not batch.num_rows:
                continue
            tab, mask, pattern = (batch[c].to_numpy(zero_copy_only=False) for c in ("tab", "mask", "pattern"))
            codes = batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
            cuts = np.nonzero((tab[1:] != tab[:-1]) | (mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1]))[0] + 1
            nodes, firsts = np.split(codes, cuts), np.concatenate([[0], cuts])
            keys = [(int(tab[k]), int(mask[k]), int(pattern[k])) for k in firsts]
            if key == keys[0]:
                nodes[0] = np.concatenate([rest, nodes[0]])
            elif key is not None:
                nodes.insert(0, rest)
                keys.insert(0, key)
            rest, key = nodes.pop(), keys.pop()
            if nodes:
                yield out(nodes, [k[0] for k in keys])
        if key is not None:
            yield out([rest], [key[0]])

    return run


def fingerprint_links(codes: DataFrame, radius: int = 2, kept: int = 2, node_limit: int = NODE_LIMIT) -> DataFrame:
    """Links that connect all distinct codes (tab, fp) within the radius: (tab, a, b). tab tells separate fingerprint tables apart."""
    spark = codes.sparkSession
    full = (1 << BITS) - 1
    masks = [signed(m) for m in masks_of(full, radius + kept, kept)]
    level = codes.select("tab", "fp", F.explode(F.array(*map(F.lit, masks))).alias("mask"))
    found = None
    while True:
        level = level.withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask")))
        counts = level.groupBy("tab", "mask", "pattern").agg(F.count("*").alias("n")).where("n > 1")
        level = saved(level.join(counts, ["tab", "mask", "pattern"]), "nodes")
        small = level.where(F.col("n") <= node_limit).select("tab", "mask", "pattern", "fp")
        small = small.repartition("tab", "mask", "pattern").sortWithinPartitions("tab", "mask", "pattern")
        links = small.mapInArrow(_search_nodes(radius), "tab int, a long, b long")
        found = links if found is None else found.unionByName(links)
        large = level.where(F.col("n") > node_limit)
        split = [r["mask"] for r in large.select("mask").distinct().collect()]  # masks, not fingerprints: a few hundred at most
        if not split:
            return found.distinct()
        # One block more of the free bits is equal too, by the same count of blocks; no block is left once all bits are in the mask.
        finer = [(m, signed((m & full) | x)) for m in split for x in masks_of(full & ~(m & full), radius + 1, 1)]
        finer = F.broadcast(spark.createDataFrame(finer, "mask long, next long"))
        level = large.join(finer, "mask").select("tab", "fp", F.col("next").alias("mask")).distinct()


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """Per row of docs: doc_id, fp, component_id (the least doc_id reachable over links, itself included).

    Defined results: null, empty and blank texts have fingerprint zero and are linked like
    any other; repeated rows all stay; a null doc_id stays null and takes part in links, but
    is never the least unless a component has no other; other columns are ignored; an empty
    table gives no rows.
    """
    fps = saved(fingerprints(docs, size, seed), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = fingerprint_links(classes.select(F.lit(0).alias("tab"), "fp"), radius)
    roots = saved(connected_components(links.select("a", "b")), "roots")
    named = saved(classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "named")
    groups = saved(named.groupBy("root").agg(F.min("least").alias("component_id")), "groups")  # written, so that a giant component's rows may be split
    of_fp = named.join(groups, "root").select("fp", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", "fp", "component_id")


# -- near copies -------------------------------------------------------------------------------


def shingle_set(words: list[bytes], size: int, hashes: WordHashes) -> np.ndarray:
    """The different shingles of a text's words."""
    return shingle_hashes(hashes.of(words), size)


def shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """The different shingles of words with these hashes, as sorted 32-bit hashes."""
    size = min(size, len(h))
    return np.unique(run_hashes(h, list(range(size)), multipliers(SHINGLE + size, 300), size) >> np.uint64(32)).astype("<u4") if size else np.zeros(0, "<u4")


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    words = hashed(as_bytes(texts), lower=True)
    return (shingle_hashes(words.of(k), size) for k in range(len(texts)))


_FACTORS = multipliers(TABLES * SAMPLES, 400)


def near_codes(shingles: np.ndarray) -> np.ndarray:
    """A text's fingerprint in each table: the SimHash of its shingles (zero without any), then those of drawn shingles."""
    least, ones = np.full(TABLES * SAMPLES, np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(BITS, np.int64)
    h = mixed(shingles.astype(np.uint64) + np.uint64(1))
    for at in range(0, len(h), 2048):
        part = h[at : at + 2048]
        least = np.minimum(least, (part[:, None] * _FACTORS).min(axis=0))
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    own = np.packbits(2 * ones > len(h)).view(">u8").astype(np.uint64)
    drawn = (mixed(least) >> np.uint64(BITS - SAMPLE_BITS)).reshape(TABLES, SAMPLES) << np.arange(0, BITS, SAMPLE_BITS, dtype=np.uint64)
    return np.concatenate([own, np.bitwise_or.reduce(drawn, axis=1)])


def bands(shingles: np.ndarray) -> np.ndarray:
    """The masked patterns of a text's fingerprints, one for each table and mask; texts without shingles have the same."""
    return (near_codes(shingles)[:, None] & np.array(masks_of((1 << BITS) - 1, BLOCKS, 1), np.uint64)).ravel()


def near_sets(codes: np.ndarray, node: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of codes whose nodes stand together: the places of those with another one of their node within the radius, and the least place that such pairs connect each with.

    A node of at most FANOUT codes is a single leaf of the Gray-order tree; all leaves are compared at once.
    """
    starts = np.concatenate([[0], np.nonzero(node[1:] != node[:-1])[0] + 1]) if len(node) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(node)))
    leaf, a, b = np.repeat(sizes <= FANOUT, sizes), [], []
    for far in range(1, min(FANOUT, len(codes))):
        at = np.nonzero(leaf[:-far] & (node[far:] == node[:-far]))[0]
        at = at[np.bitwise_count(codes[at] ^ codes[at + far]) <= radius]
        a.append(at)
        b.append(at + far)
    for k in np.nonzero(sizes > FANOUT)[0]:
        own = np.arange(starts[k], starts[k] + sizes[k])
        own = own[np.argsort(gray_rank(codes[own]))]
        x, y = forest(codes[own], radius)
        a.append(own[x])
        b.append(own[y])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    root = np.arange(len(codes))
    while (root[a] != root[b]).any():
        low = np.minimum(root[a], root[b])
        for ends in (root[a], root[b], a, b):
            np.minimum.at(root, ends, low)
        root = root[root]
    places = np.unique(np.concatenate([a, b]))
    return places, root[places]


def _search_tiles(radius: int):
    """Rows of a partition come sorted by tile (band, low, high); each tile is searched once it is whole."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: pa.RecordBatch, tile: np.ndarray) -> pa.RecordBatch:
            codes = rows["fp"].to_numpy().view(np.uint64)
            places, roots = near_sets(codes, tile, radius)
            own = rows.take(pa.array(places))
            return pa.RecordBatch.from_arrays([*(own[c] for c in ("band", "low", "high", "tab", "fp")), rows["fp"].take(pa.array(roots))], names=["band", "low", "high", "tab", "fp", "root"])

        rest = None
        for batch in rows:
            whole = batch if rest is None else pa.concat_batches([rest, batch])
            if not whole.num_rows:
                continue
            keys = [whole[c].to_numpy() for c in ("band", "low", "high")]
            tile = np.cumsum(np.concatenate([[False], np.logical_or.reduce([x[1:] != x[:-1] for x in keys])]))
            last = int(np.searchsorted(tile, tile[-1]))
            if last:
                yield out(whole.slice(0, last), tile[:last])
            rest = whole.slice(last)
        if rest is not None:
            yield out(rest, np.zeros(rest.num_rows, np.int64))

    return run


def near_groups(codes: DataFrame, radius: int = NEAR, node_limit: int = NODE_LIMIT) -> DataFrame:
    """Groups (band, tab, fp) of distinct codes (tab, fp) that agree on a mask's block, within the radius: each such pair has a group in common."""
    masks = [signed(m) for m in masks_of((1 << BITS) - 1, BLOCKS, 1)]
    level = codes.select("tab", "fp", F.explode(F.array(*map(F.lit, masks))).alias("mask")).select("tab", "fp", F.xxhash64("tab", "mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("band"))
    counts = saved(level.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "nodes")
    members = level.join(merge(counts), "band").select(F.struct("tab", "fp").alias("key"), "band", "n", F.lit(0).alias("weight"))
    tiles = in_tiles(members, node_limit).select("key.tab", "key.fp", "band", "low", "high")
    tiles = tiles.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high")
    found = tiles.mapInArrow(_search_tiles(radius), "band long, low int, high int, tab int, fp long, root long")
    groups = saved(found.select(F.xxhash64("band", "low", "high", "root").alias("band"), "tab", "fp"), "groups")
    drop(counts)
    return groups


def verified_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs of places at this Jaccard similarity or more that connect all sets which such pairs connect: a tree for each component."""
    n, sizes = len(sets), np.array([len(x) for x in sets], np.int64)
    shingles, ids = np.unique(np.concatenate(sets), return_inverse=True)
    parts = np.split(ids, np.cumsum(sizes)[:-1])
    held, out = np.zeros(len(shingles), bool), []
    left = np.arange(n)
    while len(left):
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            own = reached.pop()
            size = sizes[own]
            fits = left[(sizes[left] >= similarity * size) & (size >= similarity * sizes[left])]
            if not len(fits):
                continue
            held[parts[own]] = True
            ends = np.cumsum(sizes[fits])
            seen = np.concatenate([[0], np.cumsum(held[np.concatenate([parts[k] for k in fits])])])
            both = seen[ends] - seen[ends - sizes[fits]]
            held[parts[own]] = False
            near = fits[both >= similarity * (size + sizes[fits] - both)]
            out += [(own, int(k)) for k in near]
            reached += near.tolist()
            left = left[~np.isin(left, near)]
    return out


def _search_buckets(similarity: float):
    """Rows of a partition come sorted by bucket (band, low, high); each bucket is searched once it is whole."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys: list[str], sets: list[bytes]) -> pa.RecordBatch:
            links = verified_links([np.frombuffer(x, "<u4") for x in sets], similarity) if len(keys) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([keys[k] for k, _ in links], pa.string()), pa.array([keys[k] for _, k in links], pa.string())], names=["a", "b"])

        bucket, keys, sets = None, [], []
        for batch in rows:
            columns = (batch[c].to_pylist() for c in ("band", "low", "high", "key", "set"))
            for *own, key, x in zip(*columns, strict=True):
                if own != bucket:
                    if len(keys) > 1:
                        yield out(keys, sets)
                    bucket, keys, sets = own, [], []
                keys.append(key)
                sets.append(x)
        yield out(keys, sets)

    return run


def in_tiles(members: DataFrame, node_limit: int = NODE_LIMIT, tile_shingles: int = TILE_SHINGLES, tile_work: int = TILE_WORK) -> DataFrame:
    """Members (key, band; n and weight: members and shingles of their bucket) as (key, band, low, high): a row for each tile to bear.

    Two members of a large bucket meet in the tile of their two parts. A tile has at most about node_limit members,
    tile_shingles shingles (memory) and tile_work shingles times members (time, where no member is like another).
    """
    n, weight = F.col("n"), F.col("weight").cast("double")
    whole = (n <= node_limit) & (weight <= tile_shingles) & (n * weight <= tile_work)
    tiles = F.ceil(F.greatest(F.lit(2.0), n / (node_limit / 2), weight / (tile_shingles / 2), 2 * F.sqrt(n * weight / tile_work))).cast("int")
    part = F.when(whole, 0).otherwise(F.pmod(F.xxhash64("key", F.lit(1)), tiles).cast("int"))
    other = F.when(whole, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), tiles - 1))
    dealt = members.select("key", "band", part.alias("part"), F.explode(other).alias("other"))
    return dealt.select("key", "band", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))


def similar_links(texts: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY, node_limit: int = NODE_LIMIT, tile_shingles: int = TILE_SHINGLES, tile_work: int = TILE_WORK) -> DataFrame:
    """Of texts (key, text), copies with the same key: verified links (a, b) that connect the keys whose shingles have at least this Jaccard similarity."""

    def prints(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            found = list(shingle_sets(batch["text"], size))
            own = [near_codes(x).view(np.int64) for x in found]
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(own, pa.list_(pa.int64())), pa.array([len(x) for x in found], pa.int64())], names=["key", "codes", "shingles"])

    def sets(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            own = [x.tobytes() for x in shingle_sets(batch["text"], size)]
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(own, pa.binary())], names=["key", "set"])

    codes = texts.mapInArrow(prints, "key string, codes array<long>, shingles long").groupBy("key").agg(F.first("codes").alias("codes"), F.first("shingles").alias("shingles"))
    codes = saved(codes, "codes")
    own_codes = codes.select("key", "shingles", F.posexplode("codes").alias("tab", "fp"))
    classes = saved(own_codes.groupBy("tab", "fp").agg(F.count("*").alias("n")), "classes")
    groups = near_groups(classes.select("tab", "fp"), NEAR, node_limit)
    # Texts with the same fingerprint are a group without a search.
    named = saved(groups.unionByName(classes.where("n > 1").select(F.xxhash64("tab", "fp").alias("band"), "tab", "fp")), "named")
    # Texts that share no group are sifted out before anything is shuffled.
    found = saved(own_codes.where(sieve(named, "tab", "fp")("tab", "fp")).join(merge(named), ["tab", "fp"]).select("key", "shingles", "band").distinct(), "found")
    drop(classes, groups, named)
    written = [codes, found]
    own = F.xxhash64("key")
    buckets = found.groupBy("band").agg(F.count("*").alias("n"), F.min(own).alias("least"), F.max(own).alias("most"), F.bit_xor(own).alias("all"), F.sum("shingles").alias("weight")).where("n > 1")
    # Near copies share many groups; buckets of the same members are one.
    buckets = saved(buckets.groupBy("n", "least", "most", "all").agg(F.min("band").alias("band"), F.max("weight").alias("weight")).select("band", "n", "weight"), "buckets")
    members = saved(found.join(merge(buckets), "band"), "members")
    ends = saved(members.select("key").distinct(), "ends")
    written += [buckets, members, ends]
    known = parted(texts, ends, "key")[1].mapInArrow(sets, "key string, set binary")
    known = saved(known.groupBy("key").agg(F.first("set").alias("set")).join(merge(ends), "key"), "shingles")
    written.append(known)
    dealt = in_tiles(members, node_limit, tile_shingles, tile_work)
    dealt = dealt.join(merge(known), "key").repartition("band", "low", "high").sortWithinPartitions("band", "low", "high")
    links = saved(dealt.mapInArrow(_search_buckets(similarity), "a string, b string").distinct(), "links")
    drop(*written)
    return links


def keep_one(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, with all their columns, but for near copies: of each group that links connect, the least doc_id stays.

    Equal texts are a group of their own. Null, empty and blank texts have equal (no)
    shingles and form one group. Of rows with the same doc_id and text one stays; a null
    doc_id stays only where its group has no other. Columns may have any names and values;
    an empty table stays empty.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key, own = fresh(docs, "key_"), fresh(docs, "id_")
    rows = docs.withColumns({key: F.md5(text), own: F.col("doc_id").cast("long")})
    ids = saved(rows.select(F.col(key).alias("key"), F.col(own).alias("id")), "ids")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key"))
    one = saved(ids.groupBy("key").agg(least.alias("first")).select("key", "first.id"), "first-rows")
    roots = connected_components(similar_links(rows.select(F.col(key).alias("key"), text.alias("text")), size, similarity))
    named = one.join(roots, one.key == roots.node, "left").select("key", "id", F.coalesce("root", "key").alias("root"))
    stay = saved(named.groupBy("root").agg(least.alias("first")).select("first.key", "first.id"), "stay")
    # Rows that go: all but the staying row of each group. Most rows stay and are not shuffled; only rows that go or are repeated meet a join.
    go = saved(ids.join(merge(stay.withColumn("stays", F.lit(True))), (ids.key == stay.key) & ids.id.eqNullSafe(stay.id), "left").where("stays is null").select(ids.key, ids.id).distinct(), "go")
    twice = ids.groupBy("key", "id").agg(F.count("*").alias("n")).where("n > 1").select("key", "id")
    mark = fresh(rows, "row_")
    marked = rows.withColumn(mark, F.xxhash64(key, own))
    free, rest = parted(marked, saved(go.unionByName(twice).select(F.xxhash64("key", "id").alias(mark)), "unclear"), mark)
    gone = go.select(F.col("key").alias(fresh(marked, "gone_key_")), F.col("id").alias(fresh(marked, "gone_id_")))
    rest = rest.join(gone, (rest[key] == gone[0]) & rest[own].eqNullSafe(gone[1]), "left_anti").dropDuplicates([key])
    return free.unionByName(rest).select(*(F.col(f"`{c}`") for c in docs.columns))


def op2(spark: SparkSession, docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs, size=3, radius=2, seed=42)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
