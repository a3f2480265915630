"""Wind fits and region statistics over gates with velocity `v`."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .grid import BY, next_with_data, per_tilt
from .rounds import written


def height_bin(width: float = 500) -> Column:
    return F.floor(S.beam_height("range_m", "elevation_deg") / width).cast("int")


@per_tilt
def sector_balance(gates: DataFrame, by: list[str] = BY, sectors: int = 36, least_gates: int = 30, least_pairs: int = 3) -> DataFrame:
    """Per tilt the mean over opposite sectors, which a uniform wind brings to zero, and the folds that it asks for."""
    half = sectors // 2
    means = gates.withColumn("sector", F.floor(F.col("azimuth_deg") / (360 / sectors)).cast("int")).groupBy(*by, "sector").agg(F.avg("v").alias("m"), F.count("*").alias("n"), F.max("nyquist_ms").alias("nyquist_ms")).where(F.col("n") >= least_gates)
    # Opposite sectors share a number modulo half the circle.
    pairs = means.groupBy(*by, (F.col("sector") % half).alias("pair")).agg(F.count("*").alias("sides"), F.avg("m").alias("m"), F.max("nyquist_ms").alias("nyquist_ms")).where("sides = 2")
    out = pairs.groupBy(*by).agg(F.count("*").alias("n_pairs"), F.avg("m").alias("offset_ms"), F.max("nyquist_ms").alias("nyquist_ms")).where(F.col("n_pairs") >= least_pairs)
    return out.withColumn("folds", F.round(-F.col("offset_ms") / (2 * F.col("nyquist_ms"))).cast("int"))


def vad(gates: DataFrame, by: list[str], passes: int = 3, ridge: float = 1e-3, reject: float = 0.6, width: float = 500) -> DataFrame:
    """Least-squares wind (u, w) per height bin; each pass after the first leaves out residuals over `reject` Vn.

    Also the number of gates, the determinant's ratio (1: well spread) and the sectors of 30 degrees with six gates or more, as bits.
    """
    rows = gates.withColumns({"bin": height_bin(width), "x1": F.sin(F.radians("azimuth_deg")) * F.cos(F.radians("elevation_deg")), "x2": F.cos(F.radians("azimuth_deg")) * F.cos(F.radians("elevation_deg"))})
    key, fit = [*by, "bin"], None
    used = rows = written(rows.select(*key, "azimuth_deg", "nyquist_ms", "x1", "x2", "v"))  # each pass reads them again
    for _ in range(passes):
        used = rows if fit is None else rows.join(fit.select(*key, "u", "w"), key).where(F.abs(F.col("v") - F.col("u") * F.col("x1") - F.col("w") * F.col("x2")) <= reject * F.col("nyquist_ms")).drop("u", "w")
        s = used.groupBy(*key).agg(F.count("*").alias("n"), F.sum(F.col("x1") * F.col("x1")).alias("a"), F.sum(F.col("x1") * F.col("x2")).alias("b"), F.sum(F.col("x2") * F.col("x2")).alias("c"), F.sum(F.col("x1") * F.col("v")).alias("p"), F.sum(F.col("x2") * F.col("v")).alias("q"))
        s = s.withColumns({"a": F.col("a") + ridge * F.col("n"), "c": F.col("c") + ridge * F.col("n")}).withColumn("det", F.col("a") * F.col("c") - F.col("b") * F.col("b"))
        fit = s.select(*key, "n", ((F.col("c") * F.col("p") - F.col("b") * F.col("q")) / F.col("det")).alias("u"), ((F.col("a") * F.col("q") - F.col("b") * F.col("p")) / F.col("det")).alias("w"), (4 * F.col("det") / ((F.col("a") + F.col("c")) * (F.col("a") + F.col("c")))).alias("spread"))
        fit = written(fit)
    sectors = used.groupBy(*key, F.floor(F.col("azimuth_deg") / 30).cast("int").alias("s")).agg(F.count("*").alias("m")).where("m >= 6").groupBy(*key).agg(F.bit_or(F.expr("shiftleft(1, s)")).alias("sectors"))
    return fit.join(sectors, key, "left").na.fill(0, ["sectors"])


def alias_scores(gates: DataFrame, by: list[str], limit: float = 80, step: float = 10, width: float = 500) -> DataFrame:
    """Alias-robust score of winds on a grid, per height bin: the mean of cos(pi (v - model) / Vn). Gates with equal values count once, weighed."""
    rows = gates.withColumn("bin", height_bin(width)).groupBy(*by, "bin", "azimuth_deg", "elevation_deg", "nyquist_ms", "v").agg(F.count("*").alias("n"))
    axis = F.sequence(F.lit(-round(limit / step)), F.lit(round(limit / step)))
    tried = rows.withColumn("iu", F.explode(axis)).withColumn("iw", F.explode(axis))
    u, w = F.col("iu") * S.number(step), F.col("iw") * S.number(step)
    model = (u * F.sin(F.radians("azimuth_deg")) + w * F.cos(F.radians("azimuth_deg"))) * F.cos(F.radians("elevation_deg"))
    score = F.cos(F.lit(3.141592653589793) * (F.col("v") - model) / F.col("nyquist_ms"))
    return tried.groupBy(*by, "bin", "iu", "iw").agg((F.sum(score * F.col("n")) / F.sum("n")).alias("score"), F.sum("n").alias("n"))


def best_alias_wind(scores: DataFrame, by: list[str]) -> DataFrame:
    return scores.groupBy(*by, "bin").agg(F.max_by(F.struct("iu", "iw"), F.struct(F.round("score", 9), -F.col("iu"), -F.col("iw"))).alias("x"), F.max("score").alias("score"), F.max("n").alias("n")).select(*by, "bin", "x.*", "score", "n")


def component_anchor(labelled: DataFrame, winds: DataFrame, by: list[str], most: int = 2, width: float = 500) -> DataFrame:
    """Per region the fold whose alias agrees most with the bin's wind: sum of max(0, 1 - |d - 2 k Vn| / Vn), its share and margin."""
    rows = labelled.withColumn("bin", height_bin(width)).join(winds.select(*[c for c in by if c in winds.columns], "bin", "u", "w"), [*[c for c in by if c in winds.columns], "bin"])
    d = (F.col("u") * F.sin(F.radians("azimuth_deg")) + F.col("w") * F.cos(F.radians("azimuth_deg"))) * F.cos(F.radians("elevation_deg")) - F.col("v")
    tried = rows.withColumn("d", d).withColumn("k", F.explode(F.sequence(F.lit(-most), F.lit(most))))
    fit = F.greatest(S.number(0), 1 - F.abs(F.col("d") - 2 * F.col("k") * F.col("nyquist_ms")) / F.col("nyquist_ms"))
    sums = tried.groupBy(*by, "region", "k").agg(F.sum(fit).alias("fit"), F.count("*").alias("n"))
    ranked = sums.groupBy(*by, "region").agg(F.array_sort(F.collect_list(F.struct((-F.round("fit", 9)).alias("cost"), F.abs("k").alias("size"), "k"))).alias("c"), F.max("n").alias("n"))
    return ranked.select(*by, "region", "n", F.col("c")[0]["k"].alias("k"), (-F.col("c")[0]["cost"] / F.col("n")).alias("share"), ((F.col("c")[1]["cost"] - F.col("c")[0]["cost"]) / F.col("n")).alias("margin"))


@per_tilt
def region_stats(labelled: DataFrame, by: list[str] = BY) -> DataFrame:
    """Size, rays, mean velocity and reflectivity of each region; `dbz` counts above 5 only."""
    return labelled.where("region > 0").groupBy(*by, "region").agg(
        F.count("*").alias("n_gates"), F.countDistinct("ray_idx").alias("n_rays"), F.avg("v").alias("mean_v"), F.stddev_pop("v").alias("sd_v"), F.avg(F.when(F.col("dbz") > 5, F.col("dbz"))).alias("mean_dbz"), F.avg((F.col("dbz") > 5).cast("int")).alias("dbz_share"),
    )


@per_tilt
def shear_stats(labelled: DataFrame, by: list[str] = BY) -> DataFrame:
    """Per region over its boundary pairs: the share with a step of half Vn or more, and with opposite signs of 0.3 Vn or more on both sides."""
    nyquist = labelled.groupBy(*by).agg(F.min_by("nyquist_ms", F.struct("ray_idx", "gate_idx")).alias("vn"))
    pairs = next_with_data(labelled, by).where("a.region <> b.region").join(nyquist, by)
    strong = F.abs(F.col("a.v") - F.col("b.v")) >= 0.5 * F.col("vn")
    opposite = (F.col("a.v") * F.col("b.v") < 0) & (F.abs("a.v") >= 0.3 * F.col("vn")) & (F.abs("b.v") >= 0.3 * F.col("vn"))
    sides = pairs.select(*by, strong.alias("strong"), opposite.alias("opposite"), F.explode(F.array("a.region", "b.region")).alias("region"))
    return sides.groupBy(*by, "region").agg(F.count("*").alias("n_pairs"), F.avg(F.col("strong").cast("int")).alias("strong_share"), F.avg(F.col("opposite").cast("int")).alias("opposite_share"))


def resultant_length(rows: DataFrame, by: list[str], phase: Column) -> DataFrame:
    """|sum of exp(i phase)| / n: 1 where all phases agree."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), (F.sqrt(F.pow(F.sum(F.cos(phase)), 2) + F.pow(F.sum(F.sin(phase)), 2)) / F.count("*")).alias("resultant"))


def compare_methods(gates: DataFrame, by: list[str], raw: str, a: str, b: str) -> DataFrame:
    """Per tilt: gates that each method changed, agreements and disagreements, and fold errors of a against b."""
    changed = lambda c: F.abs(F.col(c) - F.col(raw)) > 0.01
    same = F.abs(F.col(a) - F.col(b)) <= 0.01
    n = lambda c: F.sum(c.cast("long"))
    return gates.groupBy(*by).agg(
        F.count("*").alias("n_gates"), n(changed(a)).alias("changed_a"), n(changed(b)).alias("changed_b"), n(same).alias("agree"), n(changed(a) & ~changed(b)).alias("false_positive"), n(~changed(a) & changed(b)).alias("missed"), n(changed(a) & changed(b) & ~same).alias("wrong_fold"),
    )


def fill_single_gaps(winds: DataFrame, by: list[str]) -> DataFrame:
    """Winds per height bin, with a bin that is missing between two others given their mean."""
    w = Window.partitionBy(*by).orderBy("bin")
    nxt = {c: F.lead(c).over(w) for c in ("bin", "u", "w")}
    gaps = winds.select(*by, F.col("bin"), "u", "w", nxt["bin"].alias("b2"), nxt["u"].alias("u2"), nxt["w"].alias("w2")).where("b2 - bin = 2")
    filled = gaps.select(*by, (F.col("bin") + 1).alias("bin"), ((F.col("u") + F.col("u2")) / 2).alias("u"), ((F.col("w") + F.col("w2")) / 2).alias("w"), F.lit(True).alias("filled"))
    return winds.select(*by, "bin", "u", "w", F.lit(False).alias("filled")).unionByName(filled)


def every_nth(gates: DataFrame, by: list[str], order: list[str], stride: int) -> DataFrame:
    """Every stride-th gate of a tilt, from the first one on."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return gates.withColumn("n_", n).where(F.col("n_") % stride == 0).drop("n_")


def robust_vad(gates: DataFrame, by: list[str], passes: int = 2, least_gates: int = 4) -> DataFrame:
    """Wind with an offset, a0 + a1 cos + a2 sin, over each ray's median velocity; Huber weights in the later passes."""
    rays = gates.where(F.abs("v") <= 0.85 * F.col("nyquist_ms")).groupBy(*by, "ray_idx").agg(F.min("azimuth_deg").alias("az"), F.median("v").alias("m"), F.count("*").alias("n"), F.min("nyquist_ms").alias("vn")).where(F.col("n") >= least_gates)
    rays = rays.withColumns({"c": F.cos(F.radians("az")), "s": F.sin(F.radians("az"))})
    fit = None
    for _ in range(passes):
        weight = F.least(S.number(1), F.col("n") / 12)
        rows = rays
        if fit is not None:
            rows = rays.join(fit, by)
            r = F.abs(F.col("m") - F.col("a0") - F.col("a1") * F.col("c") - F.col("a2") * F.col("s"))
            scale = F.greatest(S.number(1.5), 0.25 * F.col("vn"))
            weight = weight * F.when(r <= scale, S.number(1)).otherwise(scale / r)
            rows = rows.withColumn("k", weight).drop("a0", "a1", "a2")
        else:
            rows = rows.withColumn("k", weight)
        total = lambda e: F.sum(F.col("k") * e)
        c, s, m = F.col("c"), F.col("s"), F.col("m")
        sums = rows.groupBy(*by).agg(total(F.lit(1.0)).alias("p00"), total(c).alias("p01"), total(s).alias("p02"), total(c * c).alias("p11"), total(c * s).alias("p12"), total(s * s).alias("p22"), total(m).alias("q0"), total(m * c).alias("q1"), total(m * s).alias("q2"))
        p = {(i, j): F.col(f"p{min(i, j)}{max(i, j)}") for i in range(3) for j in range(3)}
        q = [F.col(f"q{i}") for i in range(3)]

        def determinant(column: int | None) -> Column:
            a = [[q[i] if j == column else p[i, j] for j in range(3)] for i in range(3)]
            return a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0]) + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])

        fit = sums.select(*by, *((determinant(k) / F.nullif(determinant(None), F.lit(0.0))).alias(f"a{k}") for k in range(3)))
    return fit


def top_candidates(scores: DataFrame, by: list[str], most: int = 8, step: float = 10) -> DataFrame:
    """Per height bin the best local maxima of the score on the (iu, iw) grid: no neighbour of eight is higher."""
    key = [*by, "bin"]
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)))
    around = scores.withColumn("s", F.explode(steps)).select(*key, (F.col("iu") + F.col("s.a")).alias("iu"), (F.col("iw") + F.col("s.b")).alias("iw"), F.col("score").alias("near")).groupBy(*key, "iu", "iw").agg(F.max("near").alias("near"))
    peaks = scores.join(around, [*key, "iu", "iw"], "left").where(F.col("near").isNull() | (F.col("score") >= F.col("near")))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.round("score", 9).desc(), "iu", "iw"))
    return peaks.withColumn("rank", rank).where(F.col("rank") <= most).select(*key, (F.col("iu") * S.number(step)).alias("u"), (F.col("iw") * S.number(step)).alias("w"), "score", "rank")


def wind_track(candidates: DataFrame, by: list[str], start: float = 0.05, own: float = 20.0, move: float = 0.5) -> DataFrame:
    """One candidate per height bin, so that scores and changes with height cost least over the whole volume.

    A volume has some dozen bins of a few candidates; it is one group of a grouped function.
    """

    def run(t: pa.Table) -> pa.Table:
        rows = t.sort_by([("bin", "ascending"), ("rank", "ascending")]).to_pylist()
        bins: dict[int, list[dict]] = {}
        for r in rows:
            bins.setdefault(r["bin"], []).append(r)
        cost, back, before = {}, {}, None
        for b, own_rows in bins.items():
            best = max(r["score"] for r in own_rows)
            for j, r in enumerate(own_rows):
                base = own * (best - r["score"])
                if before is None:
                    cost[b, j], back[b, j] = base + start * float(np.hypot(r["u"], r["w"])), None
                else:
                    ways = [cost[before, q] + move * float(np.hypot(r["u"] - x["u"], r["w"] - x["w"])) / max(1, b - before) for q, x in enumerate(bins[before])]
                    back[b, j] = int(np.argmin(ways))
                    cost[b, j] = base + ways[back[b, j]]
            before = b
        chosen, b, order = [], before, list(bins)
        j = min(range(len(bins[b])), key=lambda k: cost[b, k]) if b is not None else None
        for b in reversed(order):
            chosen.append(bins[b][j])
            j = back[b, j]
        return pa.Table.from_pylist(chosen[::-1], schema=t.schema)

    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema.fields}
    columns = [*by, "bin", "u", "w", "score", "rank"]
    return candidates.select(columns).groupBy(*by).applyInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in columns))
