"""Graph work in rounds of joins: connected components, the region solve, seeded growth.

All tilts of all volumes take part in a round at once. Only a growth's rounds, which are many, run
tilt by tilt in a function of arrays; all others are joins, and no tilt is one Python call. What a
round gives is written to a table in the folder that driver and executors share
(`spark.checkpoint.dir`), so that plans stay short and a lost executor costs one round. The
driver meets one count a round.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .grid import BY, counted, per_tilt

#: A cell's number within its tilt is ray_idx * CELL + gate_idx.
CELL = 1 << 20
#: Metres from gate to gate, and how many of them a link along a ray may be long.
SPACING, BRIDGE = 250, 3.05
#: What each step of a growth costs at least, in millionths of Vn.
STEP = 1000


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only in local mode, where it is unset, a new temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-rounds-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: what follows starts from there."""
    path = f"{shared_folder(df.sparkSession)}/rounds/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cell(ray: Column | str = "ray_idx", gate: Column | str = "gate_idx") -> Column:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return (col(ray).cast("long") * CELL + col(gate)).alias("cell")


def _jumped(parents: DataFrame, by: list[str]) -> DataFrame:
    """Of parents (by, x, y, k; a root has itself and 0) the root of every x and the sum of k on the way: paths halve in each round."""
    p = written(parents.withColumn("done", F.col("x") == F.col("y")))
    while True:
        onward = p.select(*by, F.col("x").alias("y"), F.col("y").alias("y2"), F.col("k").alias("k2"), F.col("done").alias("done2"))
        p = written(p.join(onward, [*by, "y"]).select(*by, "x", F.col("y2").alias("y"), (F.col("k") + F.col("k2")).alias("k"), F.col("done2").alias("done")))
        if p.where(~F.col("done")).isEmpty():
            return p.select(*by, "x", "y", "k")


def components(edges: DataFrame, by: list[str]) -> DataFrame:
    """Connected components of edges (by, a, b): by, node, root, where root is the least node that it reaches. Null ends and loops are left out.

    In each round every root hooks on to its least neighbouring root, chains contract by
    pointer jumping, and the edges move on to the roots, so that fewer are left.
    """
    e = written(edges.where("a is not null and b is not null and a <> b").select(*by, "a", "b").distinct())
    out = None
    while not e.isEmpty():
        both = e.unionByName(e.select(*by, F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = both.groupBy(*by, F.col("a").alias("x")).agg(F.min("b").alias("y")).select(*by, "x", F.least("x", "y").alias("y"), F.lit(0).alias("k"))
        roots = _jumped(hooked, by).select(*by, "x", "y")
        if out is None:
            out = roots.select(*by, F.col("x").alias("node"), F.col("y").alias("root"))
        else:
            moved = roots.select(*by, F.col("x").alias("root"), F.col("y").alias("to_"))
            out = written(out.join(moved, [*by, "root"], "left").select(*by, "node", F.coalesce("to_", "root").alias("root")))
        for end in ("a", "b"):
            e = e.join(roots.withColumnRenamed("x", end), [*by, end]).drop(end).withColumnRenamed("y", end)
        e = written(e.where("a <> b").select(*by, "a", "b").distinct())
    return out if out is not None else e.select(*by, F.col("a").alias("node"), F.col("b").alias("root"))


# -- links and segments ------------------------------------------------------------------------


def in_reach(step: Column, spacing: float = SPACING, bridge: float = BRIDGE) -> Column:
    """Whether the next gate along a ray lies near enough to be linked."""
    return (step > 0.5 * spacing) & (step <= bridge * spacing)


@per_tilt
def links(gates: DataFrame, by: list[str] = BY, spacing: float = SPACING, bridge: float = BRIDGE, most_gap: float = 4.0) -> DataFrame:
    """Links of each gate: outwards along its ray, bridging two missing gates, and on to the next ray at the same range.

    Per link: by, a and b (struct: cell, v, nyquist_ms and, where gates have them, hard, width, region), way.
    """
    more = [c for c in ("hard", "width", "region") if c in gates.columns]
    ray, ring = Window.partitionBy(*by, "ray_idx").orderBy("gate_idx"), Window.partitionBy(*by, "gate_idx").orderBy("ray_idx")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.struct(cell(), "ray_idx", "gate_idx", "v", "nyquist_ms", "range_m", "azimuth_deg", *more)
    rows = counted(gates, by).select(*by, "n_rays", own.alias("a"), F.lead(own).over(ray).alias("out_"), F.coalesce(F.lead(own).over(ring), F.first(own).over(whole)).alias("on_"))
    along = rows.where(in_reach(F.col("out_.range_m") - F.col("a.range_m"), spacing, bridge)).select(*by, "a", F.col("out_").alias("b"), F.lit("range").alias("way"))
    turn = (F.col("on_.ray_idx") == (F.col("a.ray_idx") + 1) % F.col("n_rays")) & (F.col("on_.ray_idx") != F.col("a.ray_idx")) & (S.azimuth_distance(F.col("a.azimuth_deg"), F.col("on_.azimuth_deg")) <= most_gap)
    return along.unionByName(rows.where(turn).select(*by, "a", F.col("on_").alias("b"), F.lit("azimuth").alias("way")))


@per_tilt
def segments(gates: DataFrame, by: list[str] = BY, share: float = 0.2) -> DataFrame:
    """Gates that aren't hard (column `hard`), with `region`: the least cell that links of at most `share` Vn lead to. Hard gates link nothing and go."""
    return _with_segments(gates, by, share).where("not hard")


def _with_segments(gates: DataFrame, by: list[str], share: float = 0.2) -> DataFrame:
    """All gates with `region`, as from segments; null for hard ones."""
    ray = Window.partitionBy(*by, "ray_idx").orderBy("gate_idx")
    alike = lambda x, y: F.abs(F.col(x + "v") - F.col(y + "v")) <= share * F.least(x + "nyquist_ms", y + "nyquist_ms")
    rows = counted(gates, by).withColumns({"cell": cell(), "before_": F.lag(F.struct("v", "nyquist_ms", "range_m", "hard")).over(ray)})
    follows = ~F.col("before_.hard") & in_reach(F.col("range_m") - F.col("before_.range_m")) & alike("", "before_.")
    # Gates of a ray that links join each to the next are a run; joins then meet runs, which are fewer.
    start = F.when(~F.col("hard") & ~F.coalesce(follows, F.lit(False)), F.col("cell"))
    rows = rows.withColumn("region", F.when(~F.col("hard"), F.last(start, ignorenulls=True).over(ray))).drop("before_", "n_rays")
    across = links(rows, by).where("way = 'azimuth' and not a.hard and not b.hard").where(alike("a.", "b."))
    roots = components(across.select(*by, F.col("a.region").alias("a"), F.col("b.region").alias("b")), by)
    return rows.join(roots.withColumnRenamed("node", "region"), [*by, "region"], "left").withColumn("region", F.coalesce("root", "region")).drop("root")


# -- the region solve --------------------------------------------------------------------------


@per_tilt
def fold_evidence(labelled: DataFrame, by: list[str] = BY) -> DataFrame:
    """Votes between regions whose gates are linked (a < b); gates without a region, which must not be left out, only keep others apart. k folds on a's side bring it to b's, with weight w (confidence of both widths, where known)."""
    return _votes(_across(labelled, by), by)


def _across(labelled: DataFrame, by: list[str]) -> DataFrame:
    """Links between gates of two regions: by, a and b (the regions), va, vb, na, nb (velocities and Nyquist velocities) and w."""
    w = S.width_confidence("a.width") * S.width_confidence("b.width") if "width" in labelled.columns else S.number(1)
    sides = [F.col(f"{x}.{c}").alias(n) for x in ("a", "b") for c, n in (("region", x), ("v", f"v{x}"), ("nyquist_ms", f"n{x}"))]
    return links(labelled, by).where("a.region <> b.region").select(*by, *sides, w.alias("w"))


def _votes(across: DataFrame, by: list[str]) -> DataFrame:
    k = F.round((F.col("vb") - F.col("va")) / (2 * F.least("na", "nb"))).cast("int")
    turned = F.col("a") > F.col("b")
    votes = across.select(*by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(turned, -k).otherwise(k).alias("k"), "w")
    return votes.groupBy(*by, "a", "b", "k").agg(F.sum("w").alias("w"))


def solve_in_rounds(sizes: DataFrame, votes: DataFrame, by: list[str], most: int = 6) -> DataFrame:
    """Folds of regions by rounds of merging, all tilts at once: by, region, component, folds.

    sizes: by, region, n_gates. votes: by, a, b, k, w as from fold_evidence. In a round each
    region takes its heaviest neighbour (by all votes between the two; of equals the pair of
    the lowest numbers), with the k that has most votes (of equals the one nearest to 0, then
    the lower); of two that take each other the larger stays, of equals the lower. Chains
    contract by pointer jumping, and the votes of what has merged are added up, moved by its
    folds. Each round leaves at most half of the regions that have a neighbour. Votes for more than
    `most` folds don't count when a pair is judged. In each component the largest region has 0.
    """
    found = written(sizes.select(*by, "region", F.col("region").alias("component"), F.lit(0).alias("folds"), "n_gates"))
    e = written(votes.select(*by, "a", "b", "k", "w"))
    while True:
        judged = e.where(F.abs("k") <= most)
        pairs = judged.groupBy(*by, "a", "b").agg(F.sum("w").alias("total"), F.min(F.struct((-F.col("w")).alias("w"), F.abs("k").alias("far"), "k")).alias("best"))
        pairs = pairs.select(*by, "a", "b", "total", F.col("best.k").alias("k"))
        sides = F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y"), "k"), F.struct(F.col("b").alias("x"), F.col("a").alias("y"), (-F.col("k")).alias("k")))
        both = pairs.select(*by, "a", "b", "total", F.explode(sides).alias("s")).select(*by, "a", "b", "total", "s.*")
        taken = both.groupBy(*by, "x").agg(F.min(F.struct((-F.col("total")).alias("w"), "a", "b", "y", "k")).alias("took_")).select(*by, "x", "took_.y", "took_.k")
        taken = written(taken)
        if taken.isEmpty():
            break
        n = found.groupBy(*by, F.col("component").alias("x")).agg(F.sum("n_gates").alias("n"))
        sized = taken.join(n, [*by, "x"])
        back = sized.select(*by, F.col("x").alias("y"), F.col("y").alias("back"), F.col("n").alias("n2"))
        mutual = F.col("back") == F.col("x")
        stays = mutual & ((F.col("n") > F.col("n2")) | ((F.col("n") == F.col("n2")) & (F.col("x") < F.col("y"))))
        parents = sized.join(back, [*by, "y"]).select(*by, "x", F.when(stays, F.col("x")).otherwise(F.col("y")).alias("y"), F.when(stays, 0).otherwise(F.col("k")).alias("k"))
        roots = _jumped(parents, by)
        moved = roots.select(*by, F.col("x").alias("component"), F.col("y").alias("to_"), F.col("k").alias("k_"))
        found = written(found.join(moved, [*by, "component"], "left").select(*by, "region", F.coalesce("to_", "component").alias("component"), (F.col("folds") + F.coalesce("k_", F.lit(0))).alias("folds"), "n_gates"))
        for end, sign in (("a", -1), ("b", 1)):
            to = roots.select(*by, F.col("x").alias(end), F.col("y").alias("to_"), F.col("k").alias("k_"))
            e = e.join(to, [*by, end], "left").withColumns({end: F.coalesce("to_", end), "k": F.col("k") + sign * F.coalesce("k_", F.lit(0))}).drop("to_", "k_")
        turned = F.col("a") > F.col("b")
        e = e.where("a <> b").select(*by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(turned, -F.col("k")).otherwise(F.col("k")).alias("k"), "w")
        e = written(e.groupBy(*by, "a", "b", "k").agg(F.sum("w").alias("w")))
    first = F.first("folds").over(Window.partitionBy(*by, "component").orderBy(F.col("n_gates").desc(), "region").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return found.withColumn("folds", F.col("folds") - first).select(*by, "region", "component", "folds")


@per_tilt
def repairs(solved: DataFrame, by: list[str] = BY, better: float = 0.75, share: float = 0.8, least: int = 2) -> DataFrame:
    """Regions that one fold more or less fits better on their boundary: by, region, shift.

    solved: all gates, with region (null for hard gates) and corrected. Two boundary pairs at least must fall to
    `better` of their difference and the sum to `share`. Regions are judged on the values as
    given; of two neighbours that both ask for a shift only the one that gains more moves, of
    equals the lower, so that they can't swap.
    """
    return _shifts(_across(solved.withColumn("v", F.col("corrected")), by), by, better, share, least)


def _shifts(across: DataFrame, by: list[str], better: float = 0.75, share: float = 0.8, least: int = 2) -> DataFrame:
    """The repairs that links between regions, with corrected velocities, ask for."""
    side = lambda x, y: F.struct(F.col(x).alias("region"), F.col(y).alias("other"), (F.col(f"v{x}") - F.col(f"v{y}")).alias("d"), (2 * F.col(f"n{x}")).alias("period"))
    pairs = written(across.select(*by, F.explode(F.array(side("a", "b"), side("b", "a"))).alias("s")).select(*by, "s.*"))
    down, up, now = F.abs(F.col("d") - F.col("period")), F.abs(F.col("d") + F.col("period")), F.abs("d")
    sums = pairs.groupBy(*by, "region").agg(F.count("*").alias("n"), F.sum(now).alias("e0"), F.sum(down).alias("em"), F.sum(up).alias("ep"), F.count_if(down < better * now).alias("sm"), F.count_if(up < better * now).alias("sp"))
    wants = lambda s, e, other: (F.col(s) >= least) & (F.col(e) < share * F.col("e0")) & (F.col(e) < F.col(other))
    shift = F.when(wants("sm", "em", "ep"), -1).when(wants("sp", "ep", "em"), 1)
    asks = written(sums.where(F.col("n") >= least).withColumn("shift", shift).where("shift is not null").select(*by, "region", "shift", F.round(F.col("e0") - F.least("em", "ep"), 6).alias("gain")))
    rival = asks.select(*by, F.col("region").alias("other"), F.col("gain").alias("gain2"))
    beaten = pairs.select(*by, "region", "other").distinct().join(asks, [*by, "region"]).join(rival, [*by, "other"])
    beaten = beaten.where((F.col("gain2") > F.col("gain")) | ((F.col("gain2") == F.col("gain")) & (F.col("other") < F.col("region")))).select(*by, "region").distinct()
    return asks.join(beaten, [*by, "region"], "left_anti").select(*by, "region", "shift")


@per_tilt
def stage_a(gates: DataFrame, by: list[str] = BY) -> DataFrame:
    """Gates that aren't hard (column `hard`, see grid.hard_gates) with region, component, folds and corrected: segments, votes, rounds of merging, one repair.

    A segment without a linked neighbour is a component of its own. Rows without a valid
    velocity or Nyquist velocity go; rows of one cell must not repeat.
    """
    usable = written(gates.where("v is not null and v = v and nyquist_ms > 0"))
    whole = written(_with_segments(usable, by))
    sizes = whole.where("region is not null").groupBy(*by, "region").agg(F.count("*").alias("n_gates"))
    across = written(_across(whole, by))  # for the votes and, with their folds, for the repair
    folds = written(solve_in_rounds(sizes, _votes(across, by), by))
    turned = across
    for end in ("a", "b"):
        turned = turned.join(folds.select(*by, F.col("region").alias(end), F.col("folds").alias(f"f{end}")), [*by, end]).withColumn(f"v{end}", F.col(f"v{end}") + F.col(f"f{end}") * 2 * F.col(f"n{end}")).drop(f"f{end}")
    shifts = _shifts(turned, by)
    final = folds.join(shifts, [*by, "region"], "left").withColumn("folds", F.col("folds") + F.coalesce("shift", F.lit(0))).drop("shift")
    return whole.where("region is not null").join(final, [*by, "region"]).withColumn("corrected", F.col("v") + F.col("folds") * 2 * F.col("nyquist_ms"))


@per_tilt
def groups_through_hard(gates: DataFrame, solved: DataFrame, by: list[str] = BY) -> DataFrame:
    """Components that touch through hard gates, as groups: by, component, group (the least component that it reaches so).

    gates: all gates of a tilt with `hard`; solved: those of stage_a. Hard gates that are linked
    hang together, and every component that one of them is linked with belongs to the group.
    """
    home = solved.select(*by, "ray_idx", "gate_idx", F.col("component").alias("region"))
    rows = gates.join(home, [*by, "ray_idx", "gate_idx"], "left").where("v is not null and v = v and nyquist_ms > 0")
    # A component's node is its number twice and 0, a hard gate's its cell twice and 1.
    node = lambda s: F.when(F.col(f"{s}.hard"), F.col(f"{s}.cell") * 2 + 1).otherwise(F.col(f"{s}.region") * 2)
    touching = links(rows, by).where("a.hard or b.hard").select(*by, node("a").alias("a"), node("b").alias("b"))
    joined = components(touching, by).where("node % 2 = 0")
    least = joined.groupBy(*by, "root").agg(F.min("node").alias("group"))
    named = joined.join(least, [*by, "root"]).select(*by, F.expr("node div 2").alias("component"), F.expr("`group` div 2").alias("group"))
    return solved.select(*by, "component").distinct().join(named, [*by, "component"], "left").withColumn("group", F.coalesce("group", "component"))


# -- seeded growth -----------------------------------------------------------------------------


def _frontier_rounds(a, b, step, ab, ba, seed, seed_folds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a tilt's steps between cells a and b (of `ab` folds one way and `ba` the other): cells that a seed reaches, their cost and folds."""
    cells, at = np.unique(np.concatenate([a, b, seed]), return_inverse=True)
    n, ends = len(a), at[2 * len(a) :]
    x, y, step, k = np.concatenate([at[:n], at[n : 2 * n]]), np.concatenate([at[n : 2 * n], at[:n]]), np.tile(step, 2), np.concatenate([ab, ba])
    order = np.argsort(x, kind="stable")
    starts = np.searchsorted(x[order], np.arange(len(cells) + 1))
    cost, via, folds = np.full(len(cells), np.iinfo(np.int64).max), np.zeros(len(cells), np.int64), np.zeros(len(cells), np.int32)
    cost[ends], via[ends], folds[ends] = 0, -1, seed_folds
    frontier = ends
    while len(frontier):
        n_steps = starts[frontier + 1] - starts[frontier]
        told = order[np.repeat(starts[frontier] - np.cumsum(n_steps) + n_steps, n_steps) + np.arange(n_steps.sum())]
        to, own, offer = y[told], x[told], cost[x[told]] + step[told]
        turned = folds[own] + k[told]
        told = np.lexsort((turned, own, offer, to))
        told = told[np.append(True, to[told][1:] != to[told][:-1])[: len(told)]]  # the best offer to each
        to, own, offer, turned = to[told], own[told], offer[told], turned[told]
        same = (offer == cost[to]) & (via[to] >= 0)
        cheaper = (offer < cost[to]) | (same & ((own < via[to]) | ((own == via[to]) & (turned != folds[to]))))
        frontier = to[cheaper]
        cost[frontier], via[frontier], folds[frontier] = offer[cheaper], own[cheaper], turned[cheaper]
    reached = cost < np.iinfo(np.int64).max
    return cells[reached], cost[reached], folds[reached]


@per_tilt
def grow(gates: DataFrame, by: list[str] = BY, most_cost: float = 0.6, most_gap: float = 4.0) -> DataFrame:
    """Gates with cost, folds and corrected, grown from seeds (`seed`: true, with their own `folds`) over links.

    A step costs the circular distance of the two velocities, at most `most_cost` Vn, in
    millionths of Vn, and STEP more, so that no way is free; a gate takes the cheapest way from any seed, of equal ways that over the lower
    cell, and on it the alias nearest to the gate before. A round moves the frontier alone: the
    gates whose way has become cheaper tell their neighbours. Ways are as long as a tilt is wide, so a tilt's rounds
    run in one task, on its steps. Gates that no seed reaches have no cost and keep their value.
    """
    near = links(gates, by, most_gap=most_gap)
    share = S.velocity_distance("a.v", "b.v", F.least("a.nyquist_ms", "b.nyquist_ms")) / F.least("a.nyquist_ms", "b.nyquist_ms")
    k = lambda x, y: F.round((F.col(f"{x}.v") - F.col(f"{y}.v")) / (2 * F.col(f"{y}.nyquist_ms"))).cast("int")
    steps = near.where(share <= most_cost).select(*by, F.col("a.cell").alias("a"), F.col("b.cell").alias("b"), (F.floor(share * 1_000_000 + 0.5) + STEP).cast("long").alias("step"), k("a", "b").alias("ab"), k("b", "a").alias("ba"))
    seeds = written(gates.where("seed").select(*by, cell(), F.coalesce(F.col("folds").cast("int"), F.lit(0)).alias("folds")))
    kinds = {f.name: f.dataType.simpleString() for f in seeds.schema.fields}

    def run(key: tuple, steps: pa.Table, seeds: pa.Table) -> pa.Table:
        cells, cost, folds = _frontier_rounds(*(t[c].to_numpy() for t, names in ((steps, ("a", "b", "step", "ab", "ba")), (seeds, ("cell", "folds"))) for c in names))
        return pa.table({**{c: pa.array([x.as_py()] * len(cells), seeds.schema.field(c).type) for c, x in zip(by, key, strict=True)}, "cell": cells, "cost": cost, "folds": folds})

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", cell long, cost long, folds int"
    known = steps.groupBy(*by).cogroup(seeds.groupBy(*by)).applyInArrow(run, schema)
    out = gates.drop("folds").withColumn("cell", cell()).join(known.select(*by, "cell", "cost", "folds"), [*by, "cell"], "left").drop("cell")
    return out.withColumn("corrected", F.col("v") + F.coalesce("folds", F.lit(0)) * 2 * F.col("nyquist_ms"))
