"""Rasters, voxels, triangles and colours as tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S

#: Own control points: value, red, green, blue, alpha.
CONTROL_POINTS = [(-10, 0, 0, 0, 0), (10, 20, 40, 200, 255), (30, 0, 200, 0, 255), (50, 250, 200, 0, 255), (70, 255, 0, 255, 255)]


#: Own step palettes, one for each kind of value: least value, red, green, blue.
STEP_PALETTES = {
    "reflectivity": [(5, 60, 90, 150), (15, 40, 160, 200), (25, 30, 170, 60), (35, 240, 220, 60), (45, 235, 130, 40), (55, 210, 40, 40), (65, 190, 60, 190)],
    "velocity": [(-40, 20, 60, 160), (-20, 40, 150, 90), (-5, 120, 190, 140), (0, 190, 170, 160), (5, 220, 130, 120), (20, 200, 50, 50), (40, 250, 190, 60)],
    "width": [(0, 70, 70, 70), (2, 60, 110, 160), (4, 70, 160, 100), (6, 220, 190, 60), (10, 210, 90, 50)],
    "correlation": [(0.2, 60, 60, 110), (0.5, 60, 120, 170), (0.8, 80, 170, 90), (0.9, 225, 200, 70), (0.97, 205, 70, 60)],
    "decibel": [(-4, 80, 60, 120), (-1, 70, 120, 170), (0, 170, 170, 170), (1, 90, 170, 90), (3, 225, 190, 70), (5, 205, 70, 60)],
}


def step_colour(value: Column, points: list[tuple]) -> Column:
    """Colour, as red * 65536 + green * 256 + blue, of the last step that is not above the value; null below all."""
    out = F.lit(None).cast("int")
    for low, r, g, b in sorted(points):
        out = F.when(value >= S.number(low), F.lit(r << 16 | g << 8 | b)).otherwise(out)
    return out


def pixels(gates: DataFrame, by: list[str], value: str, size: int = 1000, metres: float = 800, beam_deg: float = 1.0, gate_m: float = 250, least_r: float = 1000, least_value: float = 0.01) -> DataFrame:
    """Mean value of each pixel whose centre lies in some gate's sector; pixels near the radar and faint values are left out.

    A gate meets the pixels of its bounding box alone; y points down and row 0 is north.
    """
    a, half = F.radians("azimuth_deg"), F.radians(S.number(beam_deg / 2))
    r0, r1 = F.col("range_m") - gate_m / 2, F.col("range_m") + gate_m / 2
    # Half the sector's width and depth, with slack for the arc.
    cx, cy = F.col("range_m") * F.sin(a), F.col("range_m") * F.cos(a)
    reach = r1 * F.sin(half) + S.number(gate_m / 2 + 1)
    index = lambda x: F.floor(x / metres + size / 2).cast("int")
    span = lambda c: F.sequence(F.greatest(F.lit(0), index(c - reach)), F.least(F.lit(size - 1), index(c + reach) + 1))
    inside = lambda c: (index(c + reach) + 1 >= 0) & (index(c - reach) <= size - 1)
    rows = gates.where((F.abs(F.col(value)) >= least_value) & inside(cx) & inside(-cy)).withColumn("px", F.explode(span(cx))).withColumn("py", F.explode(span(-cy)))
    x, y = (F.col("px") - size / 2) * S.number(metres), -(F.col("py") - size / 2) * S.number(metres)
    rr = F.sqrt(x * x + y * y)
    hit = (rr > least_r) & (rr >= r0) & (rr < r1) & (S.azimuth_distance(F.degrees(F.atan2(x, y)), "azimuth_deg") <= beam_deg / 2)
    return rows.where(hit).groupBy(*by, "px", "py").agg(F.avg(value).alias("value"), F.count("*").alias("n_gates"))


def voxel_counts(north: float, south: float, east: float, west: float, most: int) -> tuple[int, int, int]:
    """Voxels along latitude, longitude and height by the box's aspect ratio; height has all."""
    lat, lon = abs(north - south), abs(east - west) * math.cos(math.radians((north + south) / 2))
    widest = max(lat, lon)
    return max(1, int(most * lat / widest)), max(1, int(most * lon / widest)), most


def nearest_pixels(gates: DataFrame, by: list[str], value: str, size: int = 1000, metres: float = 800, least_r: float = 1000) -> DataFrame:
    """Mean value of the gates whose centre lies in each pixel; pixels without one are holes for evaluate.fill_holes. Gates within least_r are left out."""
    a, half = F.radians("azimuth_deg"), size / 2
    px = F.floor(F.col("range_m") * F.sin(a) / metres + half).cast("int")
    py = F.floor(half - F.col("range_m") * F.cos(a) / metres).cast("int")
    rows = gates.where(F.col("range_m") > least_r).withColumns({"px": px, "py": py})
    return rows.where(F.col("px").between(0, size - 1) & F.col("py").between(0, size - 1)).groupBy(*by, "px", "py").agg(F.avg(value).alias("value"), F.count("*").alias("n_gates"))


def moved_side(wanted: Column, opposite: Column, upper: bool, least_span: float = 0.001) -> Column:
    """Where a side of a box (upper: north or east) comes to lie when it is dragged: at least a span from the opposite one."""
    return F.greatest(wanted, opposite + S.number(least_span)) if upper else F.least(wanted, opposite - S.number(least_span))


def polar_box(lat0: float, lon0: float, box: tuple[float, float, float, float]) -> tuple[float, float, float, float]:
    """(least range, most range, first azimuth, width in degrees) of a box (north, south, east, west) seen from a radar.

    A radar within the box sees it all round. Otherwise the azimuths are those of its corners
    and of the points nearest to the radar, on the shorter way round, so a box due north
    begins before 360 degrees and goes on after 0.
    """
    north, south, east, west = box
    scale = math.cos(math.radians(lat0))
    metres = lambda lat, lon: (math.radians(lat - lat0) * S.EARTH_RADIUS_M, math.radians(lon - lon0) * scale * S.EARTH_RADIUS_M)
    y, x = metres(min(max(lat0, south), north), min(max(lon0, west), east))
    corners = [metres(a, o) for a in (north, south) for o in (east, west)]
    least, most = math.hypot(x, y), max(math.hypot(*c) for c in corners)
    if not least:
        return 0.0, most, 0.0, 360.0
    turns = sorted(math.degrees(math.atan2(x, y)) % 360 for y, x in corners)
    gaps = [(b - a) % 360 for a, b in zip(turns, [*turns[1:], turns[0]], strict=True)]
    widest = max(range(4), key=gaps.__getitem__)
    return least, most, turns[(widest + 1) % 4], 360 - gaps[widest]


def in_polar_box(lat0: float, lon0: float, box: tuple[float, float, float, float], slack: float = 0.02) -> Column:
    """Gates that may lie over a box, by azimuth and range alone; slack: of the ranges, and 360 times as many degrees."""
    least, most, first, width = polar_box(lat0, lon0, box)
    ground = F.col("range_m") * F.cos(F.radians("elevation_deg"))
    near = (F.col("range_m") >= S.number(least * (1 - slack))) & (ground <= S.number(most * (1 + slack)))
    turn = F.pmod(F.col("azimuth_deg") - S.number(first - 360 * slack / 2), S.number(360)) <= S.number(min(360, width + 360 * slack))
    return near if width >= 360 else near & turn


def voxels(gates: DataFrame, by: list[str], value: str, lat0: float, lon0: float, box: tuple[float, float, float, float], most: int = 96, sharpness: float = 50, base_km: float = 0.70, growth: float = 0.065, radius_cap: int = 64) -> DataFrame:
    """Weighted mean of gates around each voxel of a box (north, south, east, west): ix, iy, iz, value, weight.

    Weights are exp(-s d^2 / L^2) along each axis, d whole voxels, L = hypot(base, growth * range).
    They are a product of the three axes' weights, so cells of equal L are spread along one
    axis after the other and summed in between: 3 (2 r + 1) rows a cell and not (2 r + 1)^3.
    """
    north, south, east, west = box
    n = voxel_counts(north, south, east, west, most)
    size_km = ((north - south) / n[0] * S.METRES_PER_DEGREE / 1000, (east - west) / n[1] * S.METRES_PER_DEGREE / 1000 * math.cos(math.radians((north + south) / 2)), S.VOLUME_TOP_M / 1000 / n[2])
    place = S.gate_position("range_m", "azimuth_deg", "elevation_deg", S.number(lat0), S.number(lon0))
    rows = gates.where(in_polar_box(lat0, lon0, box) & F.col(value).isNotNull()).withColumns(place)
    rows = rows.where((F.col("latitude") >= south) & (F.col("latitude") < north) & (F.col("longitude") >= west) & (F.col("longitude") < east) & (F.col("height_m") >= 0) & (F.col("height_m") < S.VOLUME_TOP_M))
    rows = rows.select(
        *by, F.floor((north - F.col("latitude")) / ((north - south) / n[0])).cast("int").alias("ix"), F.floor((east - F.col("longitude")) / ((east - west) / n[1])).cast("int").alias("iy"), F.floor(F.col("height_m") / (S.VOLUME_TOP_M / n[2])).cast("int").alias("iz"),
        S.kernel_width_km(F.col("range_m") / 1000, base_km, growth).alias("width"), F.col(value).cast("double").alias("value"),
    )
    cells = rows.groupBy(*by, "ix", "iy", "iz", "width").agg(F.count("*").cast("double").alias("weight"), F.sum("value").alias("value"))
    for name, km, count in (("iz", size_km[2], n[2]), ("iy", size_km[1], n[1]), ("ix", size_km[0], n[0])):
        reach = F.least(F.lit(min(count - 1, radius_cap)), F.ceil(3 * F.col("width") / (math.sqrt(sharpness) * km)).cast("int"))
        spread = cells.withColumn("step", F.explode(F.sequence(F.greatest(-reach, -F.col(name)), F.least(reach, count - 1 - F.col(name)))))
        w = F.exp(-sharpness * S.number(km * km) * F.col("step") * F.col("step") / (F.col("width") * F.col("width")))
        spread = spread.withColumns({name: F.col(name) + F.col("step"), "weight": F.col("weight") * w, "value": F.col("value") * w})
        cells = spread.groupBy(*by, "ix", "iy", "iz", *(["width"] if name != "ix" else [])).agg(F.sum("weight").alias("weight"), F.sum("value").alias("value"))
    return cells.select(*by, "ix", "iy", "iz", (F.col("value") / F.col("weight")).alias("value"), "weight")


def triangles(gates: DataFrame, key: list[str], value: str, lat0: float, lon0: float, beam_deg: float = 1.0, gate_m: float = 250) -> DataFrame:
    """Three triangles a gate, nine numbers each; the third one repeats a corner and is degenerate."""
    corner = lambda dr, da: S.gate_position(F.col("range_m") + dr * gate_m / 2, F.col("azimuth_deg") + da * beam_deg / 2, "elevation_deg", S.number(lat0), S.number(lon0))
    c = [corner(dr, da) for dr, da in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
    faces = [(0, 1, 2), (0, 2, 3), (2, 3, 3)]
    face = lambda k, f: F.struct(F.lit(k).alias("triangle"), *(x for j, at in enumerate(f, 1) for x in (c[at]["longitude"].alias(f"lon{j}"), c[at]["latitude"].alias(f"lat{j}"))))
    return gates.select(*key, F.col(value).alias("value"), F.explode(F.array(*(face(k, f) for k, f in enumerate(faces)))).alias("t")).select(*key, "value", "t.*")


def palette(points: list[tuple] = CONTROL_POINTS, size: int = 256) -> list[tuple[float, int, int, int, int]]:
    """Entries (value, r, g, b, a) at equal steps, linear between control points."""
    points = sorted(points)
    low, high = points[0][0], points[-1][0]
    out = []
    for i in range(size):
        v = low + (high - low) * i / (size - 1)
        k = max(j for j, p in enumerate(points[:-1]) if p[0] <= v)
        t = (v - points[k][0]) / (points[k + 1][0] - points[k][0])
        out.append((v, *(math.floor(points[k][c] + (points[k + 1][c] - points[k][c]) * t + 0.5) for c in range(1, 5))))
    return out


def colour(value: Column, points: list[tuple] = CONTROL_POINTS, size: int = 256) -> Column:
    """Struct (r, g, b, a) of the palette entry nearest to a value; the ends are clamped, null gives null."""
    low, high = points[0][0], points[-1][0]
    at = F.least(F.lit(size - 1), F.greatest(F.lit(0), F.floor((value - low) / (high - low) * (size - 1) + 0.5).cast("int")))
    table = F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip("rgba", e[1:], strict=True))) for e in palette(points, size)))
    return F.when(value.isNotNull(), F.element_at(table, at + 1))


def colour_steps(value: Column, points: list[tuple] = CONTROL_POINTS) -> Column:
    """Value of the last control point that is not above the value; null below all."""
    out = F.lit(None).cast("int")
    for p in sorted(points):
        out = F.when(value >= p[0], F.lit(p[0])).otherwise(out)
    return out


def site_clusters(sites: DataFrame, zoom: float) -> DataFrame:
    """Sites per grid cell: 12, 6 or 3 degrees by zoom; at zoom 7 and more each stands alone."""
    if zoom >= 7:
        return sites.select(F.lit(1).cast("long").alias("n_sites"), "latitude", "longitude")
    cell = 12 if zoom < 4 else 6 if zoom < 5.5 else 3
    key = [F.floor(F.col(c) / cell).cast("int").alias(n) for c, n in (("latitude", "cell_lat"), ("longitude", "cell_lon"))]
    return sites.groupBy(*key).agg(F.count("*").alias("n_sites"), F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"))


def quads(gates: DataFrame, key: list[str], value: str, lat0: float, lon0: float, gate_m: float = 250, beam_deg: float = 1.0) -> DataFrame:
    """Six Mercator vertices a gate, two triangles that make up its quad."""
    corners = [(-1, -1), (1, -1), (-1, 1), (1, -1), (1, 1), (-1, 1)]  # range, azimuth

    def vertex(k: int, dr: int, da: int) -> Column:
        p = S.gate_position(F.col("range_m") + dr * gate_m / 2, F.col("azimuth_deg") + da * beam_deg / 2, "elevation_deg", S.number(lat0), S.number(lon0))
        m = S.mercator(p["latitude"], p["longitude"])
        return F.struct(F.lit(k).alias("vertex"), m["x"].alias("x"), m["y"].alias("y"))

    return gates.select(*key, F.col(value).alias("value"), F.explode(F.array(*(vertex(k, *c) for k, c in enumerate(corners)))).alias("p")).select(*key, "value", "p.*")
