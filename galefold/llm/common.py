"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of an Arrow batch. Texts are long, and Spark's own 10,000 would fill a task's memory.
BATCH_ROWS = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def short_batches(spark: SparkSession) -> None:
    """Set BATCH_ROWS for the session unless its user has set a number."""
    if spark.conf.get(_ROWS, "10000") == "10000":
        spark.conf.set(_ROWS, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only in local mode, as in tests, a folder is made and set where that setting is absent.
    """
    short_batches(spark)
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-galefold-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/galefold/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    This cuts the lineage: what follows survives the loss of any executor.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def drop(*written: DataFrame) -> None:
    """Delete the tables of DataFrames that `saved` gave, once nothing reads them."""
    for df in written:
        forget(df.sparkSession, df.saved_at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) of every row; other columns only where asked for."""
    short_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def fresh(df: DataFrame, name: str) -> str:
    """The name with as many underscores as it takes to differ from every column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def batches(rows: Iterator[pa.RecordBatch], chars: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches of bounded size, so that a task holds few texts as Python objects."""
    for batch in rows:
        step = max(1, min(batch.num_rows or 1, int(batch.num_rows * chars / max(1, batch.nbytes))))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def as_bytes(texts: pa.Array) -> list[bytes]:
    return texts.cast(pa.binary()).to_pylist()


#: Bits that a Bloom filter sets for each key, bits that it has for each key, and log2 of the bits that it has at least and at most.
BLOOM_HASHES, BLOOM_KEY_BITS, BLOOM_LEAST, BLOOM_MOST = 6, 32, 20, 27


def bloom(keys: DataFrame, column: str, key_bits: int = BLOOM_KEY_BITS) -> np.ndarray:
    """A Bloom filter of a column of long hashes: of 40,000 others, 32 bits a key let one pass, 64 bits one of 2 million.

    Its size follows the number of keys up to 2**BLOOM_MOST bits (16 MB, for 4 million keys
    of 32 bits); beyond, it lets more and more pass. It only ever spares work: a join decides.
    """
    size = min(BLOOM_MOST, max(BLOOM_LEAST, (key_bits * keys.count()).bit_length()))
    low, high = F.col(column).bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(column, 32)
    bit = F.explode(F.array(*((low + k * high).bitwiseAND((1 << size) - 1) for k in range(BLOOM_HASHES))))
    rows = keys.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    found, out = rows.toArrow(), np.zeros(1 << (size - 6), np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint64)


def maybe(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Of unsigned 64-bit keys: False only for those that aren't in the filter."""
    top, out = np.uint64(64 * len(bits) - 1), np.ones(len(keys), bool)
    for k in range(BLOOM_HASHES):
        own = keys[out]
        at = ((own & np.uint64(0xFFFFFFFF)) + np.uint64(k) * (own >> np.uint64(32))) & top
        out[out] = (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0
    return out


def sieve(keys: DataFrame, *columns: str) -> Callable[..., Column]:
    """A function of as many columns: false only where their values aren't among keys. Only a hash goes to Python."""
    bits = keys.sparkSession.sparkContext.broadcast(bloom(keys.select(F.xxhash64(*columns).alias("key")), "key"))

    @F.arrow_udf("boolean")
    def among(hashes: pa.Array) -> pa.Array:
        return pa.array(maybe(bits.value, hashes.to_numpy(zero_copy_only=False).view(np.uint64)))

    return lambda *own: among(F.xxhash64(*own))


def merge(df: DataFrame) -> DataFrame:
    """df to be joined by sorting both sides, never by broadcast.

    For joins in which Spark sizes a side far too low: it takes rows to be as many after an explode as before, and a
    column of repeated values, which a file holds once, to be as small in memory.
    """
    return df.hint("merge")


def parted(df: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose `key` can't be among keys (a column of the same name), and the rest, which a join must settle."""
    among = sieve(keys, key)(F.col(key))
    return df.where(~among), df.where(among)


def forget(spark: SparkSession, path: str) -> None:
    """Delete what was written at this path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
