"""Operator 3: shards of near equal bytes by balanced label propagation. DataFrame functions only.

Documents with equal texts are linked; a group of them is one vertex set whose edges are
never written out. Linked documents start in the shard that their hash names. In each
round a group's bytes are counted per shard, the group prefers the shard that has most
of it and still has room, and its other documents move there as far as the quota goes:
small groups as a whole, groups larger than a part of a shard document by document.
Then documents without links, and what a shard has over its share, fill the shards up
to equal bytes, in the order of a hash, by a running sum in two levels.

Only the shards' totals, a row a shard, reach the driver. A group may hold any share of
the rows: it is only counted (with partial sums) and joined, never gathered.

Defined results: a null text has size 1 and is linked with empty texts; repeated rows are
placed each for itself; a null doc_id is placed like any other; an empty table gives no
rows; other columns are ignored. Shards differ by little more than the longest document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved

ROUNDS = 4
#: Groups over this share of a shard move document by document.
LARGE_GROUP = 0.01
#: Rows that a running sum orders in one task, about.
BUCKET_ROWS = 20_000


def _fraction(*columns: Column | str) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / float(1 << 30)


def _totals(rows: DataFrame, by: str = "shard") -> dict[int, int]:
    return {r[0]: r[1] for r in rows.groupBy(by).agg(F.sum("size")).collect()}


def _case(values: dict[int, float], column: str, otherwise: float) -> Column:
    """A number for each shard."""
    out = F.lit(float(otherwise))
    for k, v in values.items():
        out = F.when(F.col(column) == k, F.lit(float(v))).otherwise(out)
    return out


def running(rows: DataFrame, value: Column, within: list[str], buckets: int) -> DataFrame:
    """rows with `before`: the sum of `value` over all earlier rows, by `within`, in the order of bucket and h.

    Sums of the buckets come first; each task then orders one bucket of rows.
    """
    rows = rows.withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)))
    sums = rows.groupBy(*within, "bucket").agg(F.sum(value).alias("in_bucket"))
    order = Window.partitionBy(*within).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*within, "bucket", F.coalesce(F.sum("in_bucket").over(order), F.lit(0)).alias("start"))
    own = Window.partitionBy(*within, "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("own", F.coalesce(F.sum(value).over(own), F.lit(0))).join(starts, [*within, "bucket"]).withColumn("before", F.col("start") + F.col("own")).drop("bucket", "start", "own")


def propagate(state: DataFrame, shards: int, share: float, rounds: int = ROUNDS) -> DataFrame:
    """Rounds of label propagation over linked rows (key, size, h, shard, ...); share: bytes that a shard may hold."""
    for k in range(rounds):
        load = _totals(state)
        room = {s: max(0.0, share - load.get(s, 0)) for s in range(shards)}
        cells = state.groupBy("key", "shard").agg(F.sum("size").alias("bytes"))
        open_cells = F.when(_case(room, "shard", 0) > 0, F.struct("bytes", F.xxhash64("key", "shard", F.lit(k)), "shard"))
        wish = cells.groupBy("key").agg(F.max(open_cells)["shard"].alias("to"), F.sum("bytes").alias("group_bytes"))
        # A written table on this side, so that Spark may split a large group's rows on the other.
        asked = state.join(saved(wish, "wishes"), "key")
        wants = F.col("to").isNotNull() & (F.col("to") != F.col("shard"))
        demand = _totals(asked.where(wants), "to")
        if not demand:
            return state
        part = {s: min(1.0, room[s] / d) for s, d in demand.items()}
        ticket = F.when(F.col("group_bytes") > LARGE_GROUP * share, _fraction("h", F.lit(k))).otherwise(_fraction("key", F.lit(k)))
        moves = wants & (ticket < _case(part, "to", 0))
        state = saved(asked.withColumn("shard", F.when(moves, F.col("to")).otherwise(F.col("shard"))).drop("to", "group_bytes"), "labels")
    return state


def balanced_shards(docs: DataFrame, shards: int = 8, rounds: int = ROUNDS) -> DataFrame:
    """Per row of docs: doc_id, size, text_crc32, shard, slot (from 0, without gaps, in each shard)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("key"))
    rows = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id", "key"), 1))
    groups = saved(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "groups")
    rows = saved(rows.join(groups, "key", "left").withColumn("linked", F.col("n").isNotNull()).drop("n"), "sizes")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    share, buckets = total / shards, max(1, -(-n // BUCKET_ROWS))

    linked = rows.where("linked").drop("linked").withColumn("shard", F.pmod(F.col("h"), F.lit(shards)).cast("int"))
    linked = propagate(linked, shards, share, rounds)
    # What a shard of linked documents has over its share goes back to the pool.
    load = _totals(linked)
    over = {s: (b - share) / b for s, b in load.items() if b > share}
    linked = linked.withColumn("freed", _fraction("h", F.lit("freed")) < _case(over, "shard", 0))
    stay = saved(linked.where("not freed").drop("freed"), "stay")
    load = _totals(stay)
    pool = rows.where("not linked").drop("linked").unionByName(linked.where("freed").drop("freed", "shard"))

    # The pool's running sum of bytes, cut at what each shard lacks.
    lack = [max(0.0, share - load.get(s, 0)) for s in range(shards)]
    middle = F.col("before") + F.col("size") / 2
    open_shards = [s for s in range(shards) if lack[s]] or [0]
    shard = F.lit(open_shards[-1])
    for s in reversed(open_shards[:-1]):
        shard = F.when(middle < sum(lack[: s + 1]), F.lit(s)).otherwise(shard)
    filled = running(pool, F.col("size"), [], buckets).withColumn("shard", shard.cast("int")).drop("before")
    placed = saved(stay.unionByName(filled.select(*stay.columns)), "placed")
    return running(placed, F.lit(1), ["shard"], buckets).select("doc_id", "size", "text_crc32", "shard", F.col("before").cast("long").alias("slot"))


def op3(spark: SparkSession, docs: DataFrame) -> DataFrame:
    placed = balanced_shards(docs, shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
