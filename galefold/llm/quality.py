"""Operator 10: document quality by Bradley-Terry ranking.

A document's raw score is linear in features of its text alone. The weights are learnt
from preference pairs, one document of label 1 and one of label 0, by logistic loss on
the difference of their features: P(i before j) = sigmoid(w . (x_i - x_j)). The cut is
the quantile of the raw scores at the share of label 0 among the learnt rows, and the
score is the sigmoid of the raw score, shifted so that the cut comes out at THRESHOLD.

Every row whose label may be learnt takes part. The rows are dealt into cells by a hash of
their doc_id; in a cell each row of label 1 is compared with each of label 0. Up to CELL rows
of the commoner label there is one cell, which has all pairs. Rows of a label too rare to be in every
cell are dealt into several. A step of Newton's method is one pass over the cells; sums
of 651 numbers a task come to the driver. Means, counts and the quantile are of all learnt rows
and exact.

Defined results: null and empty texts have all features zero and get a score like any
other; rows with a null doc_id are scored and never learnt from; a document whose labels
disagree is not learnt from; of rows that repeat a doc_id the one with the least features
is learnt from, once; without rows of both labels every score is 0.5; repeated rows get equal
scores; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import drop, merge, saved, short_batches, sieve, table

#: Rows of the commoner label in a cell, and of the rarer label at least (fewer only where there are fewer), on average.
CELL, CELL_LEAST = 512, 64
#: Cells in a task, and parts that a search for a quantile is cut into at a time.
TASK_CELLS, PARTS = 16, 1024
THRESHOLD = 0.3
FOLDS = 5

FEATURES = (
    "log_chars", "log_words", "word_length", "long_words", "short_words", "upper", "digits", "symbols", "marks_in_row", "exclamations", "bars", "full_stops", "commas",
    "distinct_words", "top_word", "word_repeats", "pair_repeats", "line_repeats", "log_line_words", "shouted_words", "root_symbols", "root_bars", "root_word_repeats", "root_upper", "nothing",
)
_UPPER, _LOWER, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
_MARKS = b"!#$%&()*+/<=>?@[\\]^`{|}~"
_ROW_OF_MARKS = re.compile(rb"[!-/:-@[-`{-~]{2,}")


def features(text: str) -> list[float]:
    words = text.split()
    if not words:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    chars, n = len(text), len(words)
    plain = text.encode("ascii", "ignore")
    count = lambda kind: len(plain) - len(plain.translate(None, kind))
    upper, digits, marks = count(_UPPER), count(_DIGITS), count(_MARKS)
    letters = upper + count(_LOWER) + chars - len(plain)
    bars, shouts = text.count("|"), text.count("!")
    seen = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines = [x for x in text.split("\n") if x.strip()]
    lengths = [len(w) for w in words]
    shares = {
        "upper": upper / max(1, letters), "symbols": marks / chars, "bars": bars / n, "word_repeats": repeats / n,
    }
    return [
        np.log1p(chars), np.log1p(n), min(30.0, sum(lengths) / n), sum(x > 12 for x in lengths) / n, sum(x < 4 for x in lengths) / n, shares["upper"], digits / chars, shares["symbols"],
        len(_ROW_OF_MARKS.findall(plain)) / n, shouts / n, shares["bars"], text.count(".") / n, text.count(",") / n,
        len(seen) / n, max(seen.values()) / n, shares["word_repeats"], 1 - pairs / max(1, n - 1) if n > 1 else 0.0, 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)),
        sum(w.isupper() and len(w) > 1 for w in words) / n, shares["symbols"] ** 0.5, shares["bars"] ** 0.5, shares["word_repeats"] ** 0.5, shares["upper"] ** 0.5, 0.0,
    ]


@F.arrow_udf(ArrayType(DoubleType()))
def _features(texts: pa.Array) -> pa.Array:
    return pa.array([features(t.as_py()) for t in texts], pa.list_(pa.float64()))


def text_features(docs: DataFrame) -> Column:
    """Array of FEATURES of a row's whole text; only the text goes to Python."""
    short_batches(docs.sparkSession)
    return _features(F.coalesce(F.col("text").cast("string"), F.lit("")))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


def pair_sums(good: np.ndarray, bad: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of all pairs of a good and a bad row: their number, then gradient and Hessian of the summed logistic loss at w."""
    wrong = 1 / (1 + np.exp(np.clip((good @ w)[:, None] - bad @ w, -30, 30)))
    gradient = wrong.sum(axis=0) @ bad - wrong.sum(axis=1) @ good
    wrong *= 1 - wrong
    cross = good.T @ (wrong @ bad)
    hessian = (good.T * wrong.sum(axis=1)) @ good + (bad.T * wrong.sum(axis=0)) @ bad - cross - cross.T
    return np.concatenate([[wrong.size], gradient, hessian.ravel()])


def dealt(rows: DataFrame, bad: int, good: int, cell: int = CELL, least: int = CELL_LEAST) -> DataFrame:
    """Learnt rows (doc_id, quality, x), `bad` of label 0 and `good` of label 1, as cells: a row each, with the features of its good and its bad rows."""
    rarer, cells = min(bad, good), -(-max(bad, good) // cell)
    copies = min(cells, max(1, -(-least * cells // rarer)))
    home = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(cells)).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda k: (k * F.lit(cells // copies) + home) % cells) if copies < cells else F.sequence(F.lit(0), F.lit(cells - 1))
    own = F.when(F.col("quality") == int(good >= bad), F.array(home)).otherwise(others)

    def packed(group: pa.Table) -> pa.Table:
        group = group.sort_by("doc_id")
        x, quality = group["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)), group["quality"].to_numpy()
        return pa.table({"good": pa.array([x[quality == 1].tobytes()], pa.binary()), "bad": pa.array([x[quality == 0].tobytes()], pa.binary())})

    return rows.select("doc_id", "quality", "x", F.explode(own).alias("cell")).groupBy("cell").applyInArrow(packed, "good binary, bad binary").repartition(-(-cells // TASK_CELLS))


def fit(cells: DataFrame, mean: np.ndarray, scale: np.ndarray, steps: int = 30, ridge: float = 1e-3) -> np.ndarray:
    """Weights by Newton's method on the mean logistic loss of all pairs of all cells. Rounded, since the order of sums differs from run to run."""
    width, live = len(FEATURES), scale > 1e-9
    w = np.zeros(width)
    for _ in range(steps):

        def run(rows, w=w):
            total = None
            for batch in rows:
                for pair in zip(batch["good"].to_pylist(), batch["bad"].to_pylist(), strict=True):
                    sums = pair_sums(*(np.where(live, (np.frombuffer(x).reshape(-1, width) - mean) / np.where(live, scale, 1.0), 0) for x in pair), w)
                    total = sums if total is None else total + sums
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["sums"])

        n, *sums = np.sum([r["sums"] for r in cells.mapInArrow(run, "sums array<double>").collect()], axis=0)
        gradient, hessian = np.array(sums[:width]) / n + ridge * w, np.array(sums[width:]).reshape(width, width) / n + ridge * np.eye(width)
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return np.array([float(f"{x:.9g}") for x in np.where(live, w / np.where(live, scale, 1.0), 0.0)])


def middle(values: DataFrame, below: int) -> float:
    """The middle between the value of a column of doubles that has `below` in order before it, and the value before that. Exact: the range that holds it is narrowed by counts."""
    v, first = F.col(values.columns[0]), below
    low, high = values.agg(F.min(v), F.max(v)).first()
    while low < high:
        part = F.floor((v - low) / (high - low) * PARTS)
        parts = values.where(v.between(low, high)).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min(v).alias("low"), F.max(v).alias("high")).collect()
        for _, n, low, high in sorted(parts):
            if first < n:
                break
            first -= n
    before, top = values.where(v < low).agg(F.count("*"), F.max(v)).first()
    return (low + (top if before == below else low)) / 2


def learnable(labels: DataFrame, held_out: bool = True) -> DataFrame:
    """doc_id, quality of documents whose label is known and undisputed; with held_out, not those whose fold is 0."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("top")).where("quality = top").drop("top")
    return known.where(fold(F.col("doc_id")) != 0) if held_out else known


def learn(found: DataFrame, known: DataFrame, cell: int = CELL, least: int = CELL_LEAST) -> tuple[np.ndarray, float]:
    """(weights, shift) so that a score is sigmoid(weights . x + shift), from all rows of found (doc_id, x) whose quality is known."""
    rows = saved(found.join(merge(known), "doc_id").groupBy("doc_id", "quality").agg(F.min("x").alias("x")), "learnt")
    x = [F.col("x")[k] for k in range(len(FEATURES))]
    n, good, *moments = rows.agg(F.count("*"), F.coalesce(F.sum("quality"), F.lit(0)), *map(F.avg, x), *map(F.stddev_pop, x)).first()
    if not 0 < good < n:
        drop(rows)
        return np.zeros(len(FEATURES)), 0.0
    cells = saved(dealt(rows, n - good, good, cell, least), "cells")
    weights = fit(cells, *np.array(moments).reshape(2, -1))
    scores = saved(rows.select(raw(F.col("x"), weights).alias("raw")), "raw")
    shift = float(np.log(THRESHOLD / (1 - THRESHOLD)) - middle(scores, n - good))
    drop(rows, cells, scores)
    return weights, shift


def raw(x: Column, weights: np.ndarray, start: float = 0.0) -> Column:
    return F.aggregate(F.zip_with(x, F.array(*(F.lit(float(w)) for w in weights)), lambda a, b: a * b), F.lit(start), lambda s, v: s + v)


def score(x: Column, model: tuple[np.ndarray, float]) -> Column:
    weights, shift = model
    if not np.any(weights):
        return F.lit(0.5)
    return 1 / (1 + F.exp(-raw(x, weights, shift)))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted."""
    doc_id = F.col("doc_id")
    found = saved(docs.select(doc_id.cast("long").alias("doc_id"), text_features(docs).alias("x")), "features")
    model = learn(found, learnable(labels))
    scored = found.select("doc_id", F.coalesce(fold(doc_id) == 0, F.lit(False)).alias("held_out"), score(F.col("x"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the threshold. Nulls, empty texts and repeated rows are scored like any other.

    A filter by the labels' ids spares other texts the first pass.
    """
    known = saved(learnable(labels), "known")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.where(sieve(known, "doc_id")("doc_id"))
    model = learn(texts.select("doc_id", text_features(texts).alias("x")), known)
    drop(known)
    return docs.where(score(text_features(docs), model) >= THRESHOLD)
