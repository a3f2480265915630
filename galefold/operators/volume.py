"""Volumes from partial tilts: merging by elevation number, split cuts, tilt tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S

#: Moments that a Doppler cut and a surveillance cut of a pair give.
DOPPLER, SURVEILLANCE = ["VEL", "SW"], ["REF", "ZDR", "PHI", "RHO"]


def merge_partial_tilts(parts: DataFrame, volume: list[str]) -> DataFrame:
    """Partial tilts (elevation_number, n, elevation_deg, max_range_m, seq): one row a number, elevations weighed by n."""
    return parts.groupBy(*volume, "elevation_number").agg(
        F.min("seq").alias("first_seq"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("elevation_deg")) / F.sum("n")).alias("elevation_deg"), F.max("max_range_m").alias("max_range_m"), F.max_by("elevation_deg", "seq").alias("last_elevation_deg"),
    )


def split_cuts(cuts: DataFrame, volume: list[str], most: float = 0.1) -> DataFrame:
    """Cuts with `kept_number`: a cut joins the one before it if numbers follow, elevations are within `most` and no pair is open.

    In a run of three such cuts only the first two pair. Of a pair, the Doppler cut gives
    VEL and SW, the other one the rest; a cut that fits neither side stays alone.
    """
    w = Window.partitionBy(*volume).orderBy("elevation_number")
    near = (F.col("elevation_number") - F.lag("elevation_number").over(w) == 1) & (F.abs(F.col("elevation_deg") - F.lag("elevation_deg").over(w)) < most)
    doppler = F.array_contains(F.split("moments", ","), "VEL") & ~F.array_contains(F.split("moments", ","), "ZDR")
    rows = cuts.withColumns({"near": F.coalesce(near, F.lit(False)), "doppler": doppler})
    # Alternate within a run of near cuts: the odd places close a pair.
    rows = rows.withColumn("run", F.sum((~F.col("near")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy(*volume, "run").orderBy("elevation_number")) - 1
    rows = rows.withColumn("place", place).withColumn("paired", (F.col("place") % 2 == 1) & (F.col("doppler") != F.lag("doppler").over(w)))
    return rows.withColumn("kept_number", F.when(F.col("paired"), F.lag("elevation_number").over(w)).otherwise(F.col("elevation_number"))).drop("run", "place", "near")


def merged_cuts(cuts: DataFrame, volume: list[str]) -> DataFrame:
    """One row a kept cut: mean elevation, which cut each moment comes from, latest time, by elevation."""
    rows = split_cuts(cuts, volume)
    pair = Window.partitionBy(*volume, "kept_number")
    rows = rows.withColumn("size", F.count("*").over(pair))
    gives = F.when(F.col("size") == 1, F.lit(True)).when(F.col("doppler"), F.col("moment").isin(DOPPLER)).otherwise(F.col("moment").isin(SURVEILLANCE))
    owners = rows.withColumn("moment", F.explode(F.split("moments", ","))).where(gives)
    owners = owners.groupBy(*volume, "kept_number").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "moment", F.col("elevation_number").cast("string")))), ",").alias("owners"))
    heads = rows.groupBy(*volume, "kept_number").agg(F.avg("elevation_deg").alias("elevation_deg"), F.max("collect_ms").alias("collect_ms"), F.count("*").alias("n_cuts"))
    return heads.join(owners, [*volume, "kept_number"])


def tilt_summary(gates: DataFrame, by: list[str]) -> DataFrame:
    return gates.groupBy(*by).agg(F.count("*").alias("n_gates"), F.countDistinct("ray_idx").alias("n_rays"), F.max("range_m").alias("max_range_m"), F.min("range_m").alias("min_range_m"), F.avg("elevation_deg").alias("elevation_deg"), F.min_by("nyquist_ms", F.struct("ray_idx", "gate_idx")).alias("nyquist_ms"))


def biased_mean_elevation(radials: DataFrame, by: list[str]) -> DataFrame:
    """The decoder's running mean that counts each radial twice, for parity; `seq` orders the radials."""
    order = F.array_sort(F.collect_list(F.struct("seq", "elevation_deg")))
    start = F.struct(F.lit(0).alias("n"), S.number(0).alias("mean"))
    step = lambda s, x: F.struct((s["n"] + 2).alias("n"), ((s["mean"] * s["n"] + x["elevation_deg"]) / (s["n"] + 1)).alias("mean"))
    return radials.groupBy(*by).agg(F.aggregate(order, start, step)["mean"].alias("biased_elevation_deg"))


def closest_tilt(tilts: DataFrame, volume: list[str], wanted: float) -> DataFrame:
    """Per volume the tilt nearest to an elevation; the first of equals."""
    return tilts.groupBy(*volume).agg(F.min_by(F.struct("elevation_number", "elevation_deg"), F.struct(F.abs(F.col("elevation_deg") - wanted), "elevation_number")).alias("t")).select(*volume, "t.*")


def tilt_info(tilts: DataFrame, volume: list[str], days: int) -> DataFrame:
    """Tilts in order of angle with their time as text; day 1 is 1970-01-01."""
    w = Window.partitionBy(*volume).orderBy("elevation_deg", "elevation_number")
    return tilts.withColumns({"tilt_index": (F.row_number().over(w) - 1).cast("int"), "collected": S.tilt_time_label(S.collect_time(F.lit(days), "collect_ms"))})


def tilt_neighbours(tilts: DataFrame, volume: list[str]) -> DataFrame:
    """The tilt below and above each, by elevation."""
    w = Window.partitionBy(*volume).orderBy("elevation_deg")
    return tilts.withColumns({"below": F.lag("elevation_number").over(w), "above": F.lead("elevation_number").over(w)})


def by_time(tilts: DataFrame, volume: list[str]) -> DataFrame:
    """Tilts with their `place` by the time in their label; those without a time come last, by number."""
    order = Window.partitionBy(*volume).orderBy(S.parse_tilt_time("collected").asc_nulls_last(), "elevation_number")
    return tilts.withColumn("place", (F.row_number().over(order) - 1).cast("int"))


def usable_tilts(tilts: DataFrame) -> DataFrame:
    """Tilts with an angle (-1 stands for none) and with velocity among their moments."""
    return tilts.where((F.col("elevation_deg") != -1) & F.array_contains(F.split("moments", ","), "VEL"))
