"""Beams bent by the air: refractivity falls off with height, and rays are followed in fixed steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalar import number

EARTH_M, N0, SCALE_M = 6_371_000.0, 315.0, 8500.0


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def _slope(s: Column) -> Column:
    """What a metre along the ray adds to place (x, y from the earth's centre) and direction times index (px, py)."""
    r = F.sqrt(s["x"] * s["x"] + s["y"] * s["y"])

    def at(place: Column) -> Column:
        refractivity = N0 * F.exp(-F.greatest(place - EARTH_M, number(0)) / SCALE_M) / 1e6
        return _let(refractivity, lambda n: F.struct((s["px"] / (1 + n)).alias("x"), (s["py"] / (1 + n)).alias("y"), (-n / SCALE_M * s["x"] / place).alias("px"), (-n / SCALE_M * s["y"] / place).alias("py")))

    return _let(r, at)


def _moved(s: Column, k: Column, by: float) -> Column:
    return F.struct(*((s[c] + k[c] * by).alias(c) for c in ("x", "y", "px", "py")))


def _step(s: Column, metres: float) -> Column:
    """One step of the classical fourth-order rule."""
    mean = lambda a, b, c, d: F.struct(*((s[n] + metres / 6 * (a[n] + 2 * b[n] + 2 * c[n] + d[n])).alias(n) for n in ("x", "y", "px", "py")))
    last = lambda a, b, c: _let(_slope(_moved(s, c, metres)), lambda d: mean(a, b, c, d))
    third = lambda a, b: _let(_slope(_moved(s, b, metres / 2)), lambda c: last(a, b, c))
    second = lambda a: _let(_slope(_moved(s, a, metres / 2)), lambda b: third(a, b))
    return _let(_slope(s), second)


def ray_tables(tilts: DataFrame, by: list[str], most_m: float = 400_000, step_m: float = 100, station_m: float = 0) -> DataFrame:
    """Per tilt (by, elevation_deg) the ray in steps: by, step, height_m above the earth, arc_rad along it. A ray that meets the ground ends there.

    One row a tilt is folded over its steps, so the steps of a ray stay in one task; rays of all
    tilts are followed side by side.
    """
    start = _let(F.radians("elevation_deg"), lambda e: F.struct(number(0).alias("x"), number(EARTH_M + station_m).alias("y"), *((f(e) * (1 + N0 * F.exp(number(-station_m / SCALE_M)) / 1e6)).alias(n) for n, f in (("px", F.cos), ("py", F.sin)))))
    point = lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))
    n = int(-(-most_m // step_m))
    first = F.struct(start.alias("s"), F.array(point(start)).alias("path"), F.lit(False).alias("down"))

    def onward(state: Column, _: Column) -> Column:
        grown = lambda s: F.struct(s.alias("s"), F.concat(state["path"], F.array(point(s))).alias("path"), (F.sqrt(s["x"] * s["x"] + s["y"] * s["y"]) <= EARTH_M).alias("down"))
        return F.when(state["down"], state).otherwise(_let(_step(state["s"], step_m), grown))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(n)), first, onward)["path"]
    rows = tilts.select(*by, "elevation_deg", F.posexplode(path).alias("step", "p"))
    return rows.select(*by, "step", (F.sqrt(F.col("p.x") * F.col("p.x") + F.col("p.y") * F.col("p.y")) - EARTH_M).alias("height_m"), F.atan2("p.x", "p.y").alias("arc_rad"))


def with_refraction(gates: DataFrame, tables: DataFrame, by: list[str], step_m: float = 100) -> DataFrame:
    """Gates with height_m and arc_rad, between the steps of their tilt's ray by the straight line; null beyond its end."""
    after = tables.select(*by, (F.col("step") - 1).alias("step"), F.struct("height_m", "arc_rad").alias("to_"))
    both = tables.select(*by, "step", F.struct("height_m", "arc_rad").alias("from_")).join(after, [*by, "step"])
    share = F.col("range_m") / step_m - F.col("step")
    rows = gates.withColumn("step", F.floor(F.col("range_m") / step_m).cast("int")).join(both, [*by, "step"], "left")
    between = lambda c: F.col(f"from_.{c}") + share * (F.col(f"to_.{c}") - F.col(f"from_.{c}"))
    return rows.withColumns({c: between(c) for c in ("height_m", "arc_rad")}).drop("step", "from_", "to_")
