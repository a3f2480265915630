"""The polar grid: neighbours, links, fold jumps, hard gates, rays. DataFrame operators over gates.

A gate row has keys `by` (the volume and its tilt), ray_idx, gate_idx, azimuth_deg, range_m, nyquist_ms
and a velocity column. Windows are partitioned by ray or by range ring. Most operators
first deal the gates out by tilt, once, and so have as many tasks as there are tilts.
"""

from __future__ import annotations

import inspect
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S

BY = ["volume_id", "elevation_number"]
JUMP_SHARE = 0.9
SKIP = 100


def per_tilt(f):
    """Where the caller names no keys, `by` is as much of BY as the rows have: rows without a volume_id are one volume."""
    signature = inspect.signature(f)

    @wraps(f)
    def run(*args, **more):
        call = signature.bind(*args, **more)
        call.apply_defaults()
        if call.arguments["by"] is BY:
            call.arguments["by"] = [c for c in BY if c in call.args[0].columns]
        return f(*call.args, **call.kwargs)

    return run


def every(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def decode_gates(codes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Coded moments, one row a gate and moment (moment, raw_code, scale, offset): valid gates with their value."""
    return codes.where(S.valid_code("moment", "raw_code")).withColumn("value", S.decode_value("raw_code", F.col("scale"), F.col("offset")))


def velocity_gates(gates: DataFrame) -> DataFrame:
    """Gates with `v` from their code of 8 bits."""
    return gates.withColumn("v", (F.col("vel_code") - 129) / S.number(2))


@per_tilt
def ray_counts(gates: DataFrame, by: list[str] = BY) -> DataFrame:
    return gates.groupBy(*by).agg((F.max("ray_idx") + 1).alias("n_rays"))


def counted(gates: DataFrame, by: list[str]) -> DataFrame:
    """Gates with the number of rays of their tilt.

    This deals the gates out by tilt, some hundred thousand at most each; windows by ray and
    by ring that follow need no other shuffle.
    """
    return gates.withColumn("n_rays", F.max("ray_idx").over(Window.partitionBy(*by)) + 1)


@per_tilt
def range_neighbours(gates: DataFrame, by: list[str] = BY, spacing: float = 250, most: float = 1) -> DataFrame:
    """Pairs along a ray: the next gate if it lies within `most` spacings (1 for adjacent, 3.05 to bridge two missing ones)."""
    w = Window.partitionBy(*by, "ray_idx").orderBy("gate_idx")
    out = gates.withColumns({"to_gate": F.lead("gate_idx").over(w), "to_v": F.lead("v").over(w), "dr": F.lead("range_m").over(w) - F.col("range_m")})
    return out.where((F.col("dr") <= most * spacing + 0.1) & (F.col("dr") > 0.5 * spacing))


@per_tilt
def azimuth_neighbours(gates: DataFrame, by: list[str] = BY, most_gap: float = 4.0) -> DataFrame:
    """Pairs across rays: the same range on the next ray, round the circle, if the rays are near enough."""
    ring = Window.partitionBy(*by, "gate_idx").orderBy("ray_idx")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cell = F.struct("ray_idx", "v", "azimuth_deg")
    own = counted(gates, by).withColumn("to_", F.coalesce(F.lead(cell).over(ring), F.first(cell).over(whole)))
    own = own.where(F.col("to_.ray_idx") == (F.col("ray_idx") + 1) % F.col("n_rays"))
    own = own.withColumns({"to_ray": F.col("to_.ray_idx"), "to_v": F.col("to_.v"), "to_azimuth": F.col("to_.azimuth_deg")}).drop("to_")
    return own.where(S.azimuth_distance("azimuth_deg", "to_azimuth") <= most_gap)


@per_tilt
def eight_neighbours(gates: DataFrame, by: list[str] = BY) -> DataFrame:
    """Per gate the number and mean of its eight neighbours; rays go round, range does not."""
    steps = F.array(*(F.struct(F.lit(a).alias("da"), F.lit(g).alias("dg")) for a in (-1, 0, 1) for g in (-1, 0, 1) if (a, g) != (0, 0)))
    # Each gate sends its value to its neighbours' cells; no neighbour is looked up more than once.
    sent = counted(gates, by).withColumn("s", F.explode(steps)).select(*by, F.pmod(F.col("ray_idx") + F.col("s.da"), F.col("n_rays")).cast("int").alias("ray_idx"), (F.col("gate_idx") + F.col("s.dg")).alias("gate_idx"), F.col("v").alias("sent"))
    got = sent.groupBy(*by, "ray_idx", "gate_idx").agg(F.count("*").alias("n_neighbours"), F.avg("sent").alias("mean_v"))
    return gates.join(got, [*by, "ray_idx", "gate_idx"], "left").withColumn("n_neighbours", F.coalesce("n_neighbours", F.lit(0).cast("long")))


@per_tilt
def next_with_data(gates: DataFrame, by: list[str] = BY, skip: int = SKIP) -> DataFrame:
    """Pairs of each gate with the first gate that has data, outwards along the ray and onwards round the ring, at most `skip` cells between."""
    out = Window.partitionBy(*by, "ray_idx").orderBy("gate_idx")
    ring = Window.partitionBy(*by, "gate_idx").orderBy("ray_idx")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cell = F.struct("ray_idx", "gate_idx", "v", *([F.col("region")] if "region" in gates.columns else []))
    rows = counted(gates, by).withColumns({"along": F.lead(cell).over(out), "around": F.coalesce(F.lead(cell).over(ring), F.first(cell).over(whole))})
    along = rows.where(F.col("along.gate_idx") - F.col("gate_idx") <= skip + 1).select(*by, cell.alias("a"), F.col("along").alias("b"), F.lit("range").alias("way"))
    step = F.pmod(F.col("around.ray_idx") - F.col("ray_idx"), F.col("n_rays"))
    around = rows.where((step <= skip + 1) & (step > 0)).select(*by, cell.alias("a"), F.col("around").alias("b"), F.lit("azimuth").alias("way"))
    return along.unionByName(around)


@per_tilt
def region_edges(labelled: DataFrame, by: list[str] = BY, skip: int = SKIP) -> DataFrame:
    """Edges of the region graph (node_a > node_b): sum_diff in units of 2 Vn and weight. Each pair of cells counts from both sides."""
    nyquist = labelled.groupBy(*by).agg(F.min_by("nyquist_ms", F.struct("ray_idx", "gate_idx")).alias("nyquist_ms"))
    pairs = next_with_data(labelled, by, skip).where("a.region <> b.region").join(nyquist, by)
    high, low = (F.when((F.col("a.region") > F.col("b.region")) == yes, F.col("a")).otherwise(F.col("b")) for yes in (True, False))
    diff = (high["v"] - low["v"]) / (2 * F.col("nyquist_ms"))
    return pairs.groupBy(*by, high["region"].alias("node_a"), low["region"].alias("node_b")).agg((2 * F.sum(diff)).alias("sum_diff"), (2 * F.count("*")).alias("weight"))


@per_tilt
def fold_jumps(gates: DataFrame, by: list[str] = BY, value: str = "v") -> DataFrame:
    """Per tilt: jumps between neighbours of at least 0.9 * 2 Vn, along range and round the circle; lower is better."""
    g = gates.withColumn("v", F.col(value))
    jump = F.abs(F.col("to_v") - F.col("v")) >= JUMP_SHARE * 2 * F.col("nyquist_ms")
    a = range_neighbours(g, by).groupBy(*by).agg(F.sum(jump.cast("long")).alias("range_jumps"))
    b = azimuth_neighbours(g, by).groupBy(*by).agg(F.sum(jump.cast("long")).alias("azimuth_jumps"))
    n = g.groupBy(*by).agg(F.count("*").alias("n_gates"))
    return n.join(a, by, "left").join(b, by, "left").na.fill(0, ["range_jumps", "azimuth_jumps"]).withColumn("jumps", F.col("range_jumps") + F.col("azimuth_jumps"))


@per_tilt
def neighbour_distance(gates: DataFrame, by: list[str] = BY) -> DataFrame:
    """Per gate the greatest velocity distance to its four neighbours, in units of Vn (null without any)."""
    ray, ring = Window.partitionBy(*by, "ray_idx").orderBy("gate_idx"), Window.partitionBy(*by, "gate_idx").orderBy("ray_idx")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cell = F.struct("ray_idx", "v", "range_m", "azimuth_deg", "nyquist_ms")
    rows = counted(gates, by).withColumns({"own_": cell, "out_": F.lead(cell).over(ray), "in_": F.lag(cell).over(ray), "on_": F.coalesce(F.lead(cell).over(ring), F.first(cell).over(whole)), "back_": F.coalesce(F.lag(cell).over(ring), F.last(cell).over(whole))})
    own, out, into, on, back = (F.col(c) for c in ("own_", "out_", "in_", "on_", "back_"))
    distance = lambda a, b: S.velocity_distance(a["v"], b["v"], a["nyquist_ms"]) / a["nyquist_ms"]
    step = lambda a, b: (b["range_m"] - a["range_m"]).between(S.number(125) + S.number(1e-9), S.number(250.1))
    turn = lambda a, b: (b["ray_idx"] == (a["ray_idx"] + 1) % F.col("n_rays")) & (S.azimuth_distance(a["azimuth_deg"], b["azimuth_deg"]) <= 4)
    sides = [F.when(near(a, b), distance(a, b)) for near, a, b in ((step, own, out), (step, into, own), (turn, own, on), (turn, back, own))]
    return rows.withColumn("far", F.greatest(*sides)).drop("own_", "out_", "in_", "on_", "back_", "n_rays")


@per_tilt
def hard_gates(gates: DataFrame, by: list[str] = BY, share: float = 0.5, dilate_below: float = 0.10, least_dbz: float = 25) -> DataFrame:
    """Gates with `hard`: a neighbour is half of Vn or more away. A tilt with few such gates has them dilated by a cell.

    Where reflectivity is known, it must reach least_dbz.
    """
    ray, ring = Window.partitionBy(*by, "ray_idx").orderBy("gate_idx"), Window.partitionBy(*by, "gate_idx").orderBy("ray_idx")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seeds = counted(neighbour_distance(gates, by), by).withColumn("seed", F.coalesce((F.col("far") >= share), F.lit(False)))
    seeds = seeds.withColumn("seed_share", F.avg(F.col("seed").cast("int")).over(Window.partitionBy(*by)))
    cell = F.struct("ray_idx", "gate_idx", "seed")
    near = {"out_": F.lead(cell).over(ray), "in_": F.lag(cell).over(ray), "on_": F.coalesce(F.lead(cell).over(ring), F.first(cell).over(whole)), "back_": F.coalesce(F.lag(cell).over(ring), F.last(cell).over(whole))}
    out = seeds.withColumns(near)
    aside = lambda c, to: F.col(f"{c}.seed") & (F.col(f"{c}.ray_idx") == F.pmod(F.col("ray_idx") + to, F.col("n_rays")))
    along = lambda c, to: F.col(f"{c}.seed") & (F.col(f"{c}.gate_idx") == F.col("gate_idx") + to)
    grown = reduce(lambda a, b: a | F.coalesce(b, F.lit(False)), [along("out_", 1), along("in_", -1), aside("on_", 1), aside("back_", -1)], F.col("seed"))
    hard = F.when(F.col("seed_share") <= dilate_below, grown).otherwise(F.col("seed"))
    if "dbz" in gates.columns:
        hard = hard & (F.col("dbz").isNull() | (F.col("dbz") >= least_dbz))
    return out.withColumn("hard", hard).drop(*near, "n_rays")


@per_tilt
def dilate(cells: DataFrame, gates: DataFrame, by: list[str] = BY, hops: int = 1) -> DataFrame:
    """The gates within `hops` steps of marked cells (by, ray_idx, gate_idx); rays go round."""
    key, rays = [*by, "ray_idx", "gate_idx"], ray_counts(gates, by)
    steps = F.array(*(F.struct(F.lit(a).alias("da"), F.lit(g).alias("dg")) for a in range(-hops, hops + 1) for g in range(-hops, hops + 1) if abs(a) + abs(g) <= hops))
    cells = cells.select(*key).join(rays, by).withColumn("s", F.explode(steps)).select(*by, F.pmod(F.col("ray_idx") + F.col("s.da"), F.col("n_rays")).cast("int").alias("ray_idx"), (F.col("gate_idx") + F.col("s.dg")).alias("gate_idx")).distinct()
    return gates.join(cells, key, "left_semi")


@per_tilt
def azimuth_gaps(gates: DataFrame, by: list[str] = BY, most: float = 5.0) -> DataFrame:
    """Per ray the gap to the next ray, round the circle; and per tilt the mean and median of gaps up to `most`."""
    rays = gates.groupBy(*by, "ray_idx").agg(F.min("azimuth_deg").alias("azimuth_deg"))
    w = Window.partitionBy(*by).orderBy("ray_idx")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gap = F.pmod(F.coalesce(F.lead("azimuth_deg").over(w), F.first("azimuth_deg").over(whole)) - F.col("azimuth_deg"), S.number(360))
    gaps = rays.withColumn("gap", gap)
    return gaps.groupBy(*by).agg(F.count("*").alias("n_rays"), F.avg(F.when(F.col("gap") <= most, F.col("gap"))).alias("mean_gap"), F.median(F.when(F.col("gap") <= most, F.col("gap"))).alias("median_gap"), F.max("gap").alias("widest_gap"))


@per_tilt
def ray_segments(gates: DataFrame, by: list[str] = BY, order: tuple[str, ...] = ("ray_idx", "gate_idx"), step: float = 0.01) -> DataFrame:
    """Gates in file order get segment numbers: a new ray begins where azimuth moves or range does not rise."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = F.coalesce((F.abs(F.col("azimuth_deg") - F.lag("azimuth_deg").over(w)) > step) | (F.col("range_m") <= F.lag("range_m").over(w)), F.lit(True))
    return gates.withColumn("new_", new.cast("int")).withColumn("segment", (F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int")).drop("new_")


@per_tilt
def valid_rays(gates: DataFrame, by: list[str] = BY) -> DataFrame:
    """Per ray: azimuth in [0, 360), range strictly rising, spacing positive."""
    w = Window.partitionBy(*by, "ray_idx").orderBy("gate_idx")
    rising = F.coalesce(F.col("range_m") > F.lag("range_m").over(w), F.lit(True))
    return gates.withColumn("rising_", rising).groupBy(*by, "ray_idx").agg(F.every(F.col("rising_") & (F.col("azimuth_deg") >= 0) & (F.col("azimuth_deg") < 360)).alias("valid"), F.count("*").alias("n_gates"))


@per_tilt
def median_filter(gates: DataFrame, by: list[str] = BY, reach: int = 2) -> DataFrame:
    """Median of the gates with data from `reach` before to `reach` after, along the ray."""
    w = Window.partitionBy(*by, "ray_idx").orderBy("gate_idx").rangeBetween(-reach, reach)
    near = F.sort_array(F.collect_list("v").over(w))
    at = F.floor((F.size(near) - 1) / 2).cast("int")
    return gates.withColumn("smooth_v", (F.get(near, at) + F.get(near, F.size(near) - 1 - at)) / 2)


@per_tilt
def directional_prediction(gates: DataFrame, by: list[str] = BY) -> DataFrame:
    """Median of the linear extrapolations from two gates before and two after, along the ray, where both are adjacent."""
    w = Window.partitionBy(*by, "ray_idx").orderBy("gate_idx")

    def extrapolated(near, far, way):
        ok = (F.abs(near["gate_idx"] - F.col("gate_idx")) == 1) & (F.abs(far["gate_idx"] - F.col("gate_idx")) == 2)
        return F.when(ok, 2 * near["v"] - far["v"])

    cell = F.struct("gate_idx", "v")
    a, b = extrapolated(F.lag(cell, 1).over(w), F.lag(cell, 2).over(w), -1), extrapolated(F.lead(cell, 1).over(w), F.lead(cell, 2).over(w), 1)
    return gates.withColumns({"from_before": a, "from_after": b}).withColumn("predicted", F.coalesce((F.col("from_before") + F.col("from_after")) / 2, "from_before", "from_after"))


def in_window(azimuths: tuple[float, float], ranges: tuple[float, float]) -> Column:
    """Gates within bounds of azimuth and range, both included."""
    return F.col("azimuth_deg").between(*map(S.number, azimuths)) & F.col("range_m").between(*map(S.number, ranges))


def in_core(centre: tuple[float, float], half: tuple[float, float]) -> Column:
    """Gates within a box of metres east and north of the radar."""
    east, north = F.col("range_m") * F.sin(F.radians("azimuth_deg")), F.col("range_m") * F.cos(F.radians("azimuth_deg"))
    return (F.abs(east - S.number(centre[0])) <= half[0]) & (F.abs(north - S.number(centre[1])) <= half[1])


@per_tilt
def tolerant_neighbours(gates: DataFrame, by: list[str] = BY, spacing: float = 250, share: float = 0.75, least_rays: int = 8) -> DataFrame:
    """Pairs of each gate with the gate of the next ray that is nearest in range, within `share` of the spacing.

    The circle is closed only in tilts of `least_rays` rays or more. Ranges go to buckets
    of the spacing, so that the join is on keys; the nearer gate of equals is the lower one.
    """
    bucket, key = lambda r: F.floor(r / spacing), [*by, "ray_idx", "gate_idx"]
    to = gates.select(*by, F.col("ray_idx").alias("to_ray"), F.col("gate_idx").alias("to_gate"), F.col("range_m").alias("to_range"), F.explode(F.array(*(bucket(F.col("range_m")) + k for k in (-1, 0, 1)))).alias("bucket_"))
    own = counted(gates, by).where((F.col("n_rays") >= least_rays) | (F.col("ray_idx") + 1 < F.col("n_rays")))
    own = own.withColumns({"to_ray": (F.col("ray_idx") + 1) % F.col("n_rays"), "bucket_": bucket(F.col("range_m"))})
    far = F.abs(F.col("range_m") - F.col("to_range"))
    pairs = own.join(to, [*by, "to_ray", "bucket_"]).where(far <= share * spacing)
    best = pairs.groupBy(*key).agg(F.min_by(F.struct("to_ray", "to_gate"), F.struct(far, "to_range")).alias("to_"))
    return gates.join(best, key).select(*gates.columns, "to_.to_ray", "to_.to_gate")


@per_tilt
def cross_prediction(gates: DataFrame, by: list[str] = BY) -> DataFrame:
    """Median of what up to four directions foretell: the neighbour's value, and half the step to it from the gate beyond, where that is there."""
    ray, ring = Window.partitionBy(*by, "ray_idx").orderBy("gate_idx"), Window.partitionBy(*by, "gate_idx").orderBy("ray_idx")
    whole, last = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), Window.partitionBy(*by, "gate_idx").orderBy(F.col("ray_idx").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cell = F.struct("ray_idx", "gate_idx", "v")
    first = lambda k, w: F.nth_value(cell, k).over(w)
    # Round the ring, what lies beyond its end is counted from its start.
    on1, back1 = F.coalesce(F.lead(cell).over(ring), first(1, whole)), F.coalesce(F.lag(cell).over(ring), first(1, last))
    on2 = F.coalesce(F.lead(cell, 2).over(ring), F.when(F.lead(cell).over(ring).isNull(), first(2, whole)).otherwise(first(1, whole)))
    back2 = F.coalesce(F.lag(cell, 2).over(ring), F.when(F.lag(cell).over(ring).isNull(), first(2, last)).otherwise(first(1, last)))
    columns = {"in1": F.lag(cell).over(ray), "in2": F.lag(cell, 2).over(ray), "out1": F.lead(cell).over(ray), "out2": F.lead(cell, 2).over(ray), "on1": on1, "on2": on2, "back1": back1, "back2": back2}
    rows = counted(gates, by).withColumns({f"{k}_": c for k, c in columns.items()})

    def foretold(name: str, way: int, across: bool) -> Column:
        near, far = F.col(f"{name}1_"), F.col(f"{name}2_")
        at = lambda c, k: c["ray_idx"] == F.pmod(F.col("ray_idx") + k * way, F.col("n_rays")) if across else c["gate_idx"] == F.col("gate_idx") + k * way
        return F.when(at(near, 1), near["v"] + F.coalesce(F.when(at(far, 2), (near["v"] - far["v"]) / 2), S.number(0)))

    all_ = F.sort_array(F.filter(F.array(foretold("in", -1, False), foretold("out", 1, False), foretold("on", 1, True), foretold("back", -1, True)), lambda x: x.isNotNull()))
    n = F.size("foretold_")
    rows = rows.withColumn("foretold_", all_).withColumns({"predicted": (F.get("foretold_", F.floor((n - 1) / 2).cast("int")) + F.get("foretold_", F.floor(n / 2).cast("int"))) / 2, "n_directions": n})
    return rows.drop("foretold_", "n_rays", *(f"{k}_" for k in columns))


@per_tilt
def gradient_reference(gates: DataFrame, by: list[str] = BY, steep: float = 0.5, uneven: float = 0.2) -> DataFrame:
    """Gates with `reference`, what the gates before it on the ray lead to: the last one's value, and its step once more where
    three of them in a row step evenly (within `uneven` Vn) and not steeply (within `steep` Vn). Null without a gate right before."""
    w = Window.partitionBy(*by, "ray_idx").orderBy("gate_idx")
    before = [F.lag(F.struct("gate_idx", "v"), k).over(w) for k in (1, 2, 3)]
    rows = gates.withColumns({f"before{k}_": c for k, c in enumerate(before, 1)})
    a, b, c = (F.col(f"before{k}_") for k in (1, 2, 3))
    there = lambda x, k: F.coalesce(F.col("gate_idx") - x["gate_idx"] == k, F.lit(False))
    step, earlier = a["v"] - b["v"], b["v"] - c["v"]
    even = there(b, 2) & there(c, 3) & (F.abs(step) <= steep * F.col("nyquist_ms")) & (F.abs(step - earlier) <= uneven * F.col("nyquist_ms"))
    return rows.withColumn("reference", F.when(there(a, 1), F.when(even, a["v"] + step).otherwise(a["v"]))).drop("before1_", "before2_", "before3_")


def median_and_mad(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per group the median of a value and the median absolute deviation from it."""
    centre = rows.groupBy(*by).agg(F.median(value).alias("median_v"))
    return rows.join(centre, by).groupBy(*by).agg(F.first("median_v").alias("median_v"), F.median(F.abs(F.col(value) - F.col("median_v"))).alias("mad"))


@per_tilt
def jump_bits(gates: DataFrame, by: list[str] = BY, share: float = 0.5, spacing: float = 250, most_gap: float = 4.0) -> DataFrame:
    """Gates with `bits`: the directions (out, in, on, back) whose neighbour differs by `share` Vn or more."""
    ray, ring = Window.partitionBy(*by, "ray_idx").orderBy("gate_idx"), Window.partitionBy(*by, "gate_idx").orderBy("ray_idx")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cell = F.struct("ray_idx", "v", "range_m", "azimuth_deg", "nyquist_ms")
    near = {"out_": F.lead(cell).over(ray), "in_": F.lag(cell).over(ray), "on_": F.coalesce(F.lead(cell).over(ring), F.first(cell).over(whole)), "back_": F.coalesce(F.lag(cell).over(ring), F.last(cell).over(whole))}
    rows = counted(gates, by).withColumns({"own_": cell, **near})
    step = lambda a, b: ((b["range_m"] - a["range_m"]) > spacing / 2) & ((b["range_m"] - a["range_m"]) <= spacing + 0.1)
    turn = lambda a, b: (b["ray_idx"] == (a["ray_idx"] + 1) % F.col("n_rays")) & (S.azimuth_distance(a["azimuth_deg"], b["azimuth_deg"]) <= most_gap)
    jump = lambda a, b: F.abs(a["v"] - b["v"]) >= share * a["nyquist_ms"]
    own, out, into, on, back = (F.col(c) for c in ("own_", *near))
    pairs = [(step, own, out), (step, into, own), (turn, own, on), (turn, back, own)]
    held = [F.coalesce(joined(a, b) & jump(a, b), F.lit(False)) for joined, a, b in pairs]
    return rows.withColumn("bits", S.direction_bits(*held)).drop("own_", *near, "n_rays")
