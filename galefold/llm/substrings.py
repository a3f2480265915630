"""Operator 6: removal of repeated substrings with a log-structured fingerprint index.

A window is WINDOW consecutive words. Each window has an anchor, the least hash among
its runs of GRAM words, which depends on the window's words alone; consecutive windows
with the same anchor form a span, which stands for them all. The index is a log of
sorted immutable runs: of every different span (anchor hash, digest of the whole span) the
first place where it starts. A new batch is merged with the runs by these two:

1. A span that stands earlier as well has only repeated windows.
2. Where one anchor has several different spans, some windows may still be equal. The
   texts of these spans are fetched and their windows merged one by one, by their digests,
   with a second log of runs that holds such windows. A historical text is fetched only when
   one of its anchors meets a second span for the first time.
3. The merge writes the new spans or windows as a run; once there are `max_runs`, it
   writes the old runs' rows with them and so compacts the log.

The quick hashes of words only choose anchors. What makes two spans or windows equal is
a 128-bit BLAKE2b digest of their words' bytes, joined by one blank, so words that are
built to share a quick hash are still told apart.

Tasks settle repeats among their own documents before anything is shuffled, so that a
passage which stands in a third of all documents gives a row for each task and not for
each document. Words covered by a repeated window go; windows are judged on the input.

Batches must come in ascending order of doc_id. Defined results: a null text has no
words; documents under WINDOW words are kept whole; rows that repeat a doc_id, or have
none (they come first), are ordered by their text's MD5; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, batches, drop, forget, new_path, parted, saved, whole_texts
from .words import Words, hashed, mixed, multipliers, run_hashes

WINDOW = 20
GRAM = 5
#: Spans that a task settles among themselves at once.
BLOCK = 1_000_000
_GRAM = multipliers(GRAM, 200)

#: a: the anchor's hash, 0 for single windows; c, d: the digest.
SPANS = "kind int, a long, c long, d long, doc long, first int, last int"
#: Kinds of rows: a span that isn't known elsewhere yet, one whose windows are all repeated, the first of its kind.
OPEN, REPEATED, FIRST = 0, 1, 2


def digests(texts: list[bytes], text: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Two numbers for each stretch, the digest of a text's words from window first to window last; stretches come text by text."""
    out = []
    bounds = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
    for k, whole in enumerate(texts):
        if bounds[k] < bounds[k + 1]:
            words = whole.split()
            at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
            whole, own = b" ".join(words), slice(bounds[k], bounds[k + 1])
            out += [blake2b(whole[x:y], digest_size=16).digest() for x, y in zip(at[first[own]].tolist(), (at[last[own] + WINDOW] - 1).tolist(), strict=True)]
    return np.frombuffer(b"".join(out), "<u8").reshape(-1, 2)


def least_of(g: np.ndarray, width: int) -> np.ndarray:
    """Where the least of each `width` numbers in a row stands, the first of equal ones."""
    at, covered = np.arange(len(g)), 1
    while covered < width:
        step = min(covered, width - covered)
        later = g[step:] < g[:-step]
        g, at, covered = np.where(later, g[step:], g[:-step]), np.where(later, at[step:], at[:-step]), covered + step
    return at


def spans(words: Words) -> tuple[np.ndarray, ...]:
    """(text, anchor hash, first window, last window) of all spans; windows count from their text's start."""
    h, none = words.hashes, np.zeros(0, np.int64)
    if len(h) < WINDOW:
        return none, none.view(np.uint64), none, none
    g = run_hashes(h, list(range(GRAM)), _GRAM, GRAM)
    anchor = least_of(g, WINDOW - GRAM + 1)
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    inside = text[: len(anchor)] == text[WINDOW - 1 :]
    same = np.concatenate([[False], (anchor[1:] == anchor[:-1]) & inside[1:] & inside[:-1], [False]])
    first, last = np.nonzero(inside & ~same[:-1])[0], np.nonzero(inside & ~same[1:])[0]
    start = words.first[text[first]]
    return text[first], g[anchor[first]], first - start, last - start


def windows(words: Words, own: list[list[dict]]) -> tuple[np.ndarray, ...]:
    """(text, start) of each window in the spans that each text has."""
    edge = np.zeros(len(words.hashes) + 1, np.int64)
    for start, of_text in zip(words.first.tolist(), own, strict=False):
        for span in of_text:
            edge[start + span["first"]] += 1
            edge[start + span["last"] + 1] -= 1
    at = np.nonzero(np.cumsum(edge))[0]
    text = np.searchsorted(words.first, at, side="right") - 1
    return text, at - words.first[text]


def _batch(kind, a, c, d, doc, first, last) -> pa.RecordBatch:
    n = len(doc)
    return pa.RecordBatch.from_arrays([
        pa.array(np.broadcast_to(np.asarray(kind, np.int32), n)), pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), pa.array(d.view(np.int64)), pa.array(doc.astype(np.int64)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)),
    ], names=["kind", "a", "c", "d", "doc", "first", "last"])


class _Block:
    """Places with anchor and digest, settled among themselves: the first of equal ones stays open, the rest are repeated."""

    def __init__(self):
        self.parts, self.n = [], 0

    def add(self, doc: np.ndarray, a: np.ndarray, digest: np.ndarray, first: np.ndarray, last: np.ndarray) -> bool:
        self.parts.append((a, digest[:, 0], digest[:, 1], doc, first, last))
        self.n += len(a)
        return self.n >= BLOCK

    def settled(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            a, c, d, doc, first, last = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            if (doc[1:] < doc[:-1]).any():
                order = np.lexsort((first, doc))
                a, c, d, doc, first, last = (x[order] for x in (a, c, d, doc, first, last))
            # In the order of one number of both; where others share it, repeats may stay open for the merge.
            order = np.argsort(a ^ mixed(c), kind="stable")
            a, c, d, doc, first, last = (x[order] for x in (a, c, d, doc, first, last))
            again = np.concatenate([[False], (a[1:] == a[:-1]) & (c[1:] == c[:-1]) & (d[1:] == d[:-1])])
            for at in range(0, len(a), 100_000):
                s = slice(at, at + 100_000)
                yield _batch(np.where(again[s], REPEATED, OPEN), a[s], c[s], d[s], doc[s], first[s], last[s])
        self.parts, self.n = [], 0


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _find_spans(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = _Block()
    for batch in batches(rows):
        texts = as_bytes(batch["text"])
        text, a, first, last = spans(hashed(texts))
        if block.add(_numbers(batch["doc"])[text], a, digests(texts, text, first, last), first, last):
            yield from block.settled()
    yield from block.settled()


def _find_windows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = _Block()
    for batch in batches(rows):
        texts = as_bytes(batch["text"])
        text, at = windows(hashed(texts), batch["own"].to_pylist())
        if block.add(_numbers(batch["doc"])[text], np.zeros(len(at), np.uint64), digests(texts, text, at, at), at, at):
            yield from block.settled()
    yield from block.settled()


def _merge(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by digest and place: the first of equal ones is marked so, the others are repeated."""
    before = None
    for batch in rows:
        if batch.num_rows:
            a, c, d, doc, first, last = (batch[x].to_numpy(zero_copy_only=False) for x in ("a", "c", "d", "doc", "first", "last"))
            again = np.concatenate([[before == (a[0], c[0], d[0])], (a[1:] == a[:-1]) & (c[1:] == c[:-1]) & (d[1:] == d[:-1])])
            before = a[-1], c[-1], d[-1]
            yield _batch(np.where(again, REPEATED, FIRST), a, c, d, doc, first, last)


def merged(rows: DataFrame) -> DataFrame:
    return rows.select("a", "c", "d", "doc", "first", "last").repartition("a", "c").sortWithinPartitions("a", "c", "d", "doc", "first").mapInArrow(_merge, SPANS)


def _cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(rows):
        n, gone, kept = [], [], []
        for text, own in zip(as_bytes(batch["text"]), batch["own"].to_pylist(), strict=True):
            words = text.split()
            n.append(len(words))
            if own:
                edge = np.zeros(len(words) + 1, np.int64)
                for span in own:
                    edge[span["first"]] += 1
                    edge[span["last"] + WINDOW] -= 1
                stays = np.cumsum(edge[:-1]) == 0
                words = [w for w, y in zip(words, stays.tolist(), strict=True) if y]
            gone.append(n[-1] - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


class FingerprintIndex:
    """The log of runs: spans, and windows of the spans whose anchor has several. add() takes the next batch and gives the repeated windows in it."""

    def __init__(self, spark: SparkSession, max_runs: int = 4):
        self.spark, self.max_runs, self.upto = spark, max_runs, None
        self.runs, self.window_runs = [], []

    def _firsts(self, paths: list[str]) -> DataFrame:
        return _union([self.spark.read.schema(SPANS).parquet(p).where(F.col("kind") == FIRST) for p in paths])

    def _merge(self, found: DataFrame, runs: list[str], new, label: str) -> tuple[DataFrame, list[str]]:
        """Merge rows of a batch with the runs: (repeated places of the batch, the runs from now on)."""
        path = new_path(self.spark, label)
        found.write.parquet(path)
        rows, compact = self.spark.read.schema(SPANS).parquet(path), len(runs) >= self.max_runs
        together = merged(_union([rows.where(F.col("kind") == OPEN), *([self._firsts(runs)] if runs else [])]))
        run = new_path(self.spark, f"{label}-run")
        (together if compact else together.where(new)).write.parquet(run)
        both = rows.unionByName(self.spark.read.schema(SPANS).parquet(run))
        repeated = saved(both.where((F.col("kind") == REPEATED) & new).select("doc", "first", "last"), "repeated")
        for p in (path, *(runs if compact else ())):
            forget(self.spark, p)
        return repeated, [run] if compact else [*runs, run]

    def add(self, texts: DataFrame, everything: DataFrame) -> DataFrame:
        """texts: (doc_id, doc, text) of the batch; everything: of the history and the batch. Returns repeated windows: doc, first, last."""
        new = (F.col("doc") > self.upto) if self.upto is not None else F.lit(True)
        top = texts.agg(F.max("doc")).first()[0]
        repeated, self.runs = self._merge(texts.select("doc", "text").mapInArrow(_find_spans, SPANS), self.runs, new, "spans")
        # Anchors with several spans, one of them new. The windows of their new spans are compared, and those of a historical
        # span only once: when its anchor meets a second span for the first time.
        known = self._firsts(self.runs)
        counts = known.groupBy("a").agg(F.count("*").alias("n"), F.count_if(~new).alias("old"), F.max("doc").alias("doc"))
        shared = saved(counts.where((F.col("n") > 1) & new).select("a", "old"), "shared")  # a written table, so that Spark may split a common anchor's spans
        unclear = known.join(shared, "a").where(new | (F.col("old") == 1))
        unclear = saved(unclear.groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("own")), "unclear")
        fetched = parted(everything, unclear, "doc")[1].join(unclear, "doc").select("doc", "text", "own")
        one_by_one, self.window_runs = self._merge(fetched.mapInArrow(_find_windows, SPANS), self.window_runs, new, "windows")
        drop(shared, unclear)
        if top is not None:
            self.upto = top
        return repeated.unionByName(one_by_one)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def numbered(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, doc, text) and more columns: doc orders the rows; it is doc_id itself where that is unique and never null."""
    texts = whole_texts(docs, *more)
    others = texts.columns[2:]
    n, distinct, known = texts.agg(F.count("*"), F.countDistinct("doc_id"), F.count("doc_id")).first()
    if n == distinct == known:
        return texts.select("doc_id", F.col("doc_id").alias("doc"), "text", *others)
    tie = texts.withColumn("tie", F.md5("text"))
    tie = tie.repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    return saved(tie.select("doc_id", F.monotonically_increasing_id().alias("doc"), "text", *others), "numbered")


def remove_repeats(docs: DataFrame, n_batches: int = 2, max_runs: int = 1) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept (the words that stay, joined by a blank).

    The rows are taken as n_batches batches in ascending order of doc_id.
    """
    spark = docs.sparkSession
    rows = numbered(docs)
    texts = rows
    cuts = texts.agg(F.percentile_approx("doc", [k / n_batches for k in range(1, n_batches)], 10_000)).first()[0] if n_batches > 1 else []
    index, repeated, low = FingerprintIndex(spark, max_runs), [], None
    for high in [*sorted(set(cuts or [])), None]:
        part, upto = texts, texts
        if low is not None:
            part = part.where(F.col("doc") > low)
        if high is not None:
            part, upto = part.where(F.col("doc") <= high), texts.where(F.col("doc") <= high)
        repeated.append(index.add(part, upto))
        low = high
    cover = saved(_union(repeated).groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("own")), "cover")
    whole, covered = parted(rows, cover, "doc")
    whole = whole.withColumn("own", F.lit(None).cast(cover.schema["own"].dataType))
    return whole.unionByName(covered.join(cover, "doc", "left").select(*whole.columns)).select("doc_id", "text", "own").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept string")


def op6(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
