"""Operator 5: benchmark decontamination by spaced seeds.

Words (lower case, letters, digits and _) of a window of SPAN are dealt into four groups
by position; each of six fixed masks keeps two groups and ignores the others. Any two
substitutions in a window leave at least one mask untouched. With three and more, some
patterns (such as three words in a row of 15) touch all masks of all windows; two more
seeds, SPREAD, were chosen to be untouched by one of these each. So every gap-free overlap
of SPAN to 23 words with at least MIN_SIMILARITY equal words has a seed in common, which a
test enumerates, and so has every longer one: cut into pieces of SPAN to 23 words, it has
a piece with at least that share of equal words.
The different seeds of test items and of documents are joined on their hash, which names
pairs of a text and an item. Where a pair's common seeds stand says how the two may be
aligned; there the words themselves are compared, and the best stretch is reported if it is
long and similar enough. Items shorter than SPAN must occur word by word. Where seeds repeat
so often that their places would outgrow the two texts, all alignments are looked at instead,
in the order of their equal words and until none can be better; the result is the same.

The documents' seeds pass a Bloom filter of the items' seeds first. Its size follows the
benchmark's up to a bound; it only spares rows, and the join decides.

Defined results: null, empty and blank texts and items have no overlap; copies of a text
are compared once and each reported; repeated rows give repeated results; a null doc_id
or item_id is reported as null; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, bloom, drop, fresh, maybe, merge, parted, saved, table
from .words import MARKS, Words, hashed, mixed, multipliers, run_hashes

SPAN = 12
GROUPS = 4
MIN_SIMILARITY = 0.8
#: Bits of the Bloom filter for each seed of an item; a text tries some thousand seeds.
SEED_BITS = 64
#: Pairs of groups that each mask keeps.
MASKS = list(combinations(range(GROUPS), 2))
#: Words of the seeds for patterns of substitutions that touch every mask.
SPREAD = ((0, 1, 2, 7, 12, 13, 14), (0, 1, 2, 3, 8, 11, 12))
_MULTIPLIERS = multipliers(SPAN, 100)
_MASK_MARKS = multipliers(len(MASKS), 101)
_SPREAD_MULTIPLIERS = multipliers(max(map(max, SPREAD)) + 1, 102)
_SPREAD_MARKS = multipliers(len(SPREAD), 103)
_EXACT = multipliers(SPAN, 99)
#: Pairs of a seed's places that are followed, for each word of the two texts; beyond, all alignments are looked at.
PLACES = 16
#: Items of which a text may meet all in one row.
ITEMS = 256
_WORD = re.compile(r"\w+")
#: What isn't ASCII and no part of a word.
_GAP = re.compile(r"[^\x00-\x7F\w]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def word_hashes(texts: list[str]) -> Words:
    """Hashes of the words of texts."""
    plain = (t if t.isascii() or not _GAP.search(t) else _GAP.sub(" ", t) for t in map(str.lower, texts))
    return hashed([t.encode() for t in plain], MARKS)


def seeds(h: np.ndarray, short: set[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of all seeds of a document's word hashes; short: lengths of items under SPAN. Without it, of an item."""
    n = len(h) - SPAN + 1
    found, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    if n > 0:
        # A sum for each group of positions; a mask's hash is the sum of the two groups that it keeps.
        groups = [sum(h[p : p + n] * _MULTIPLIERS[p] for p in range(g, SPAN, GROUPS)) for g in range(GROUPS)]
        found += [groups[x] + groups[y] + mark for (x, y), mark in zip(MASKS, _MASK_MARKS, strict=True)]
        starts += [np.arange(n)] * len(MASKS)
    for places, mark in zip(SPREAD, _SPREAD_MARKS, strict=True):
        n = len(h) - places[-1]
        if n > 0:
            found.append(sum(h[p : p + n] * _SPREAD_MULTIPLIERS[p] for p in places) + mark)
            starts.append(np.arange(n))
    for n in short if short is not None else ({len(h)} if 0 < len(h) < SPAN else ()):
        found.append(mixed(run_hashes(h, list(range(n)), _EXACT, n) + np.uint64(n)))
        starts.append(np.arange(len(found[-1])))
    return np.concatenate(found), np.concatenate(starts)


def best_stretch(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """(start in the document, length, equal words) of the best aligned stretch, item word k standing at shift + k."""
    first, last = max(0, -shift), min(len(item), len(doc) - shift)
    if last <= first:
        return None
    same = doc[shift + first : shift + last] == item[first:last]
    # The longest stretch whose equal words reach the share: a pair of prefix sums of (5 * same - 4) that doesn't fall.
    total = np.concatenate([[0], np.cumsum(5 * same.astype(np.int64) - 4)]).tolist()
    starts: list[int] = []
    for k, v in enumerate(total):
        if not starts or v < total[starts[-1]]:
            starts.append(k)
    length, at = 0, 0
    for k in range(len(total) - 1, -1, -1):
        while starts and total[starts[-1]] <= total[k]:
            if k - starts[-1] >= length:
                length, at = k - starts[-1], starts[-1]
            starts.pop()
    equal = int(same[at : at + length].sum())
    if length < min(SPAN, len(item)) or (len(item) < SPAN and equal < len(item)):
        return None
    return shift + first + at, length, equal


def placed(h: np.ndarray, short: set[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The seeds in order, with their places."""
    found, places = seeds(h, short)
    order = np.argsort(found, kind="stable")
    return found[order], places[order]


def alignments(doc: np.ndarray, item: np.ndarray, doc_seeds: tuple[np.ndarray, np.ndarray], item_seeds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Where item word 0 may stand in the document, by the seeds that the two have in common."""
    (a, x), (b, y), common = doc_seeds, item_seeds, np.unique(item_seeds[0])
    x0, x1, y0, y1 = (np.searchsorted(s, common, side) for s in (a, b) for side in ("left", "right"))
    if int(((x1 - x0) * (y1 - y0)).sum()) > PLACES * (len(doc) + len(item)):
        return np.arange(1 - len(item), len(doc))
    met = np.nonzero(x1 > x0)[0]
    apart = [(x[x0[k] : x1[k], None] - y[None, y0[k] : y1[k]]).ravel() for k in met.tolist()]
    return np.unique(np.concatenate(apart)) if apart else np.zeros(0, np.int64)


def best_overlap(doc: np.ndarray, item: np.ndarray, at: np.ndarray) -> tuple[int, int, int] | None:
    """The best stretch over the alignments `at`: most equal words, then the earliest start, then the longest.

    No stretch has more equal words than its alignment, and none starts before it, so alignments in that order end the search early.
    """
    equal = np.fromiter((np.count_nonzero(doc[max(0, k) : k + len(item)] == item[max(0, -k) : len(doc) - k]) for k in at.tolist()), np.int64, len(at))
    start, best = np.maximum(at, 0), None
    for k in np.lexsort((at, start, -equal)).tolist():
        if best is not None and (-equal[k], start[k]) > (-best[2], best[0]):
            break
        found = best_stretch(doc, item, int(at[k]))
        if found and (best is None or (-found[2], found[0], -found[1]) < (-best[2], best[0], -best[1])):
            best = found
    return best


def item_seeds(benchmark: DataFrame) -> DataFrame:
    """The different seeds of each item, with the item's number of words."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            out_i, out_h, out_n = [], [np.zeros(0, np.uint64)], []
            own = word_hashes(batch["text"].to_pylist())
            for k, key in enumerate(batch["item"].to_pylist()):
                h = own.of(k)
                s = np.unique(seeds(h)[0])
                out_i += [key] * len(s)
                out_h.append(s)
                out_n += [len(h)] * len(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_h).view(np.int64), pa.int64()), pa.array(out_i, pa.string()), pa.array(out_n, pa.int64())], names=["seed", "item", "n"])

    return benchmark.mapInArrow(run, "seed long, item string, n long")


def keyed(rows: DataFrame, name: str) -> DataFrame:
    """The rows with the MD5 of their text, null counting as empty."""
    return rows.withColumn(name, F.md5(F.coalesce(F.col("text"), F.lit(""))))


def text_overlaps(texts: DataFrame, items: DataFrame) -> DataFrame:
    """Of texts (key, text) and items (item, text), both keyed by MD5: key, item and the best overlap's first_word, n_words, n_equal."""
    spark = texts.sparkSession
    items = saved(items.distinct(), "items")
    parts = -(-items.count() // ITEMS)
    keys = saved(item_seeds(items), "item-seeds")
    short = {r.n for r in keys.where(F.col("n") < SPAN).select("n").distinct().collect()}  # fewer than SPAN numbers
    sieve = spark.sparkContext.broadcast(bloom(keys, "seed", SEED_BITS))

    def probe(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts with a seed that may be an item's, and those seeds."""
        bits = sieve.value
        for batch in batches(rows):
            kept, own, found = [], [], word_hashes(batch["text"].to_pylist())
            for k in range(batch.num_rows):
                s, _ = seeds(found.of(k), short)
                hit = maybe(bits, s)
                if hit.any():
                    kept.append(k)
                    own.append(np.unique(s[hit]).view(np.int64))
            kept = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch["key"].take(kept), batch["text"].take(kept), pa.array(own, pa.list_(pa.int64()))], names=["key", "text", "hits"])

    # Only these texts go on; the others are neither shuffled nor read again.
    held = saved(texts.select("key", "text").mapInArrow(probe, "key string, text string, hits array<long>"), "hits")
    hits = saved(held.select("key", F.explode("hits").alias("seed")), "seeds")  # written, so that Spark knows its size
    pairs = hits.join(keys, "seed").select("key", "item").distinct().join(items.withColumnRenamed("text", "item_text"), "item")
    # A row holds the items that one text meets in one of these parts.
    pairs = pairs.groupBy("key", F.pmod(F.xxhash64("item"), F.lit(max(1, parts))).alias("part"))
    pairs = saved(pairs.agg(F.collect_list(F.struct("item", "item_text")).alias("pairs")), "pairs")

    def verify(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            out, docs = [], word_hashes(batch["text"].to_pylist())
            for k, (key, text, own) in enumerate(zip(batch["key"].to_pylist(), batch["text"].to_pylist(), batch["pairs"].to_pylist(), strict=True)):
                held = word_hashes([pair["item_text"] for pair in own])
                numbers: dict[str, int] = {}
                doc = np.array([numbers.setdefault(w, len(numbers)) for w in words(text)], np.int64)
                doc_seeds = placed(docs.of(k), {n for n in np.diff(held.first).tolist() if 0 < n < SPAN})
                for j, pair in enumerate(own):
                    item = np.array([numbers.get(w, -1) for w in words(pair["item_text"])], np.int64)
                    found = best_overlap(doc, item, alignments(doc, item, doc_seeds, placed(held.of(j))))
                    if found:
                        out.append((key, pair["item"], *found))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], names=["key", "item", "first_word", "n_words", "n_equal"])

    found = saved(held.select("key", "text").join(merge(pairs), "key").mapInArrow(verify, "key string, item string, first_word long, n_words long, n_equal long").distinct(), "overlaps")
    drop(keys, held, hits, pairs, items)
    return found


def _text(key: str) -> list:
    return [key, F.coalesce(F.col("text"), F.lit("")).alias("text")]


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each row of docs and item that overlap: doc_id, item_id and, of the overlap with most equal words, first_word, n_words, n_equal, similarity (words from 0)."""
    docs = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "key")
    items = keyed(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), "item")
    found = text_overlaps(docs.select(*_text("key")), items.select(*_text("item")))
    named = docs.select("doc_id", "key").join(found, "key").join(items.select("item_id", "item"), "item")
    return named.select("doc_id", "item_id", "first_word", "n_words", "n_equal", (F.col("n_equal") / F.col("n_words")).alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose text overlaps with no item. Null, empty and blank texts stay, and repeated rows stay or go together."""
    key, item = fresh(docs, "key_"), fresh(benchmark, "item")
    own = keyed(docs, key)
    items = keyed(benchmark, item).select(*_text(item)).toDF("item", "text")
    found = text_overlaps(own.select(F.col(key).alias("key"), F.coalesce(F.col("text"), F.lit("")).alias("text")), items)
    leaks = saved(found.select(F.col("key").alias(key)).distinct(), "leaks")
    free, rest = parted(own, leaks, key)
    return free.unionByName(rest.join(leaks, key, "left_anti").select(*own.columns)).select(*(F.col(f"`{c}`") for c in docs.columns))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
