"""Registered queries over the radar views, each with its SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import align, dealias, grid, raster, volume, wind
from ..operators.rounds import written
from ..sources import catalog
from ..sources.tables import CUTS_A_VOLUME, view, with_views
from ..streaming import alerts

BY, KEY = grid.BY, [*grid.BY, "ray_idx", "gate_idx"]
LAT0, LON0 = 36.98, -77.01
BOX = (37.10, 36.86, -76.86, -77.16)
VOXELS = 24
CUTOFF, NOW = "2024-01-15 00:00:00", "2024-01-20 00:00:00"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, keep: bool = False):
    """Register a function (spark, sf_dir) under its name; sql: what DuckDB runs; keep: the result has a volume_id of its own."""

    def add(f):
        # A tilt's number is unique in the archive, so that results need no volume_id beside it.
        QUERIES[f.__name__] = f if keep else lambda spark, sf_dir: f(spark, sf_dir).drop("volume_id")
        if sql is not None:
            ORACLE[f.__name__] = with_views(sql.strip())
        return f

    return add


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.velocity_gates(view(spark, sf_dir, "v_gates")).withColumn("dbz", (F.col("ref_code") - 66) / S.number(2))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates with the least id of their region as `region`; for SQL, which can't number regions in order of discovery."""
    g = gates(spark, sf_dir)
    ident = F.col("elevation_number") * 100_000 + F.col("ray_idx") * 100 + F.col("gate_idx")
    named = dealias.regions(g, keep=("azimuth_deg", "range_m", "elevation_deg", "dbz")).where("region > 0")
    return named.withColumn("region", F.min(ident).over(Window.partitionBy(*BY, "region"))).withColumn("id", ident)


def rounded(c: Column | str, name: str, digits: int = 6) -> Column:
    # Adding zero turns a negative zero into zero.
    return (F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)).alias(name)


G = "WITH g AS (SELECT *, (vel_code - 129) / 2.0::DOUBLE AS v, (ref_code - 66) / 2.0::DOUBLE AS dbz FROM v_gates)"
RAYS = f"{G}, rays AS (SELECT elevation_number, max(ray_idx) + 1 AS n_rays FROM g GROUP BY 1)"
AZ = f"""{RAYS}, az AS (SELECT a.*, b.ray_idx AS to_ray, b.v AS to_v, b.azimuth_deg AS to_azimuth FROM (SELECT g.*, n_rays FROM g JOIN rays USING (elevation_number)) a
  JOIN g b ON a.elevation_number = b.elevation_number AND b.ray_idx = (a.ray_idx + 1) % a.n_rays AND a.gate_idx = b.gate_idx
  WHERE least(abs(a.azimuth_deg - b.azimuth_deg) % 360, 360 - abs(a.azimuth_deg - b.azimuth_deg) % 360) <= 4),
rg AS (SELECT * FROM (SELECT *, lead(gate_idx) OVER w AS to_gate, lead(v) OVER w AS to_v, lead(range_m) OVER w - range_m AS dr FROM g WINDOW w AS (PARTITION BY elevation_number, ray_idx ORDER BY gate_idx)) WHERE dr > 125 AND dr <= 250.1)"""
LABELS = f"""WITH RECURSIVE g AS MATERIALIZED (SELECT *, (vel_code - 129) / 2.0::DOUBLE AS v, (ref_code - 66) / 2.0::DOUBLE AS dbz FROM v_gates),
n AS MATERIALIZED (SELECT elevation_number * 100000 + ray_idx * 100 + gate_idx AS id, *, CAST(floor((v + nyquist_ms) / (2 * nyquist_ms / 3)) AS INT) AS b FROM g WHERE v < nyquist_ms),
ed AS MATERIALIZED (SELECT a.id AS x, c.id AS y FROM n a JOIN n c ON a.elevation_number = c.elevation_number AND a.b = c.b AND
  ((a.ray_idx = c.ray_idx AND abs(a.gate_idx - c.gate_idx) = 1) OR (a.gate_idx = c.gate_idx AND abs(a.ray_idx - c.ray_idx) = 1))),
lab(id, l) USING KEY (id) AS (SELECT id, id FROM n UNION SELECT ed.y, min(lab.l) FROM lab JOIN ed ON ed.x = lab.id JOIN recurring.lab AS cur ON cur.id = ed.y WHERE lab.l < cur.l GROUP BY ed.y),
r AS (SELECT n.*, l AS region FROM n JOIN lab USING (id))"""
CELLS = """, rays AS (SELECT elevation_number, max(ray_idx) + 1 AS n_rays FROM {0} GROUP BY 1),
nx AS (SELECT {0}.*, n_rays, lead(gate_idx) OVER w AS g2, lead(v) OVER w AS gv, {1} coalesce(lead(ray_idx) OVER r, first_value(ray_idx) OVER q) AS r2, coalesce(lead(v) OVER r, first_value(v) OVER q) AS rv
  FROM {0} JOIN rays USING (elevation_number) WINDOW w AS (PARTITION BY elevation_number, ray_idx ORDER BY gate_idx), r AS (PARTITION BY elevation_number, gate_idx ORDER BY ray_idx),
  q AS (PARTITION BY elevation_number, gate_idx ORDER BY ray_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""
PAIRS = LABELS + CELLS.format("r", "lead(region) OVER w AS gr, coalesce(lead(region) OVER r, first_value(region) OVER q) AS rr,") + """,
vn AS (SELECT elevation_number, arg_min(nyquist_ms, ray_idx * 1000 + gate_idx) AS vn FROM r GROUP BY 1),
pr AS (SELECT elevation_number, region AS ra, gr AS rb, v AS va, gv AS vb FROM nx WHERE g2 - gate_idx <= 101 AND region <> gr
  UNION ALL SELECT elevation_number, region, rr, v, rv FROM nx WHERE (r2 - ray_idx + n_rays) % n_rays BETWEEN 1 AND 101 AND region <> rr),
eg AS (SELECT elevation_number, greatest(ra, rb) AS node_a, least(ra, rb) AS node_b, 2 * sum((CASE WHEN ra > rb THEN va - vb ELSE vb - va END) / (2 * vn)) AS sum_diff, 2 * count(*) AS weight FROM pr JOIN vn USING (elevation_number) GROUP BY 1, 2, 3)"""

# -- codes and scalars -------------------------------------------------------------------------


@query("""SELECT elevation_number, ray_idx, gate_idx, 'VEL' AS moment, vel_code AS raw_code, (vel_code - 129) / 2.0::DOUBLE AS value FROM v_gates WHERE vel_code NOT IN (0, 1)
UNION ALL SELECT elevation_number, ray_idx, gate_idx, 'REF', ref_code, (ref_code - 66) / 2.0::DOUBLE FROM v_gates WHERE ref_code <> 0""")
def q_decode_codes(spark, sf_dir):
    coded = view(spark, sf_dir, "v_gates").select(*KEY, F.explode(F.array(*(F.struct(F.lit(m).alias("moment"), F.col(c).alias("raw_code"), S.number(2).alias("scale"), S.number(o).alias("offset")) for m, c, o in (("VEL", "vel_code", 129), ("REF", "ref_code", 66))))).alias("m")).select(*KEY, "m.*")
    return grid.decode_gates(coded).select(*KEY, "moment", "raw_code", F.col("value").cast("double").alias("value"))


def _true(spark, sf_dir):
    return gates(spark, sf_dir).withColumn("t", (F.col("true_code") - 129) / S.number(2))


T = "WITH t AS (SELECT *, (true_code - 129) / 2.0::DOUBLE AS t, (vel_code - 129) / 2.0::DOUBLE AS v FROM v_gates)"


@query(f"{T} SELECT elevation_number, ray_idx, gate_idx, (t + nyquist_ms) - 2 * nyquist_ms * floor((t + nyquist_ms) / (2 * nyquist_ms)) - nyquist_ms AS folded FROM t")
def q_fold(spark, sf_dir):
    return _true(spark, sf_dir).select(*KEY, S.fold_velocity("t", "nyquist_ms").alias("folded"))


@query(f"{T} SELECT elevation_number, ray_idx, gate_idx, t - 2 * nyquist_ms * floor((t + nyquist_ms) / (2 * nyquist_ms)) AS principal, CAST(round((t - v) / (2 * nyquist_ms)) AS INT) AS folds FROM t")
def q_principal(spark, sf_dir):
    return _true(spark, sf_dir).select(*KEY, S.principal("t", "nyquist_ms").alias("principal"), S.folds_between("v", "t", "nyquist_ms").alias("folds"))


@query(f"{T}, d AS (SELECT *, abs(t - v) % (2 * nyquist_ms) AS d FROM t) SELECT elevation_number, ray_idx, gate_idx, CASE WHEN d > nyquist_ms THEN 2 * nyquist_ms - d ELSE d END AS distance FROM d")
def q_circular_dist(spark, sf_dir):
    return _true(spark, sf_dir).select(*KEY, S.velocity_distance("t", "v", "nyquist_ms").alias("distance"))


@query("SELECT elevation_number, ray_idx, gate_idx, least(abs(azimuth_deg - 350) % 360, 360 - abs(azimuth_deg - 350) % 360) AS to_350, (azimuth_deg + 20) % 360 AS turned FROM v_gates")
def q_az_distance(spark, sf_dir):
    return gates(spark, sf_dir).select(*KEY, S.azimuth_distance("azimuth_deg", S.number(350)).alias("to_350"), S.wrap360(F.col("azimuth_deg") + 20).alias("turned"))


@query(f"{T} SELECT elevation_number, ray_idx, gate_idx, round(CASE WHEN abs(t - v) <= 0.4::DOUBLE * nyquist_ms THEN (t - v) * (t - v) / (2 * (0.4::DOUBLE * nyquist_ms)) ELSE abs(t - v) - 0.4::DOUBLE * nyquist_ms / 2 END, 6) AS cost FROM t")
def q_huber(spark, sf_dir):
    return _true(spark, sf_dir).select(*KEY, rounded(S.huber(F.col("t") - F.col("v"), S.number(0.4) * F.col("nyquist_ms")), "cost"))


@query(f"{T} SELECT elevation_number, ray_idx, gate_idx, round(1 - greatest(0, least(1, (abs(v) - 2) / 6)) * 0.85::DOUBLE, 6) AS confidence FROM t")
def q_sw_conf(spark, sf_dir):
    # The view has no spectrum width; the size of the velocity stands in for it.
    return _true(spark, sf_dir).select(*KEY, rounded(S.width_confidence(F.abs("v")), "confidence"))


@query(f"{T}, k AS (SELECT *, CAST(round((4 * t - v) / (2 * nyquist_ms)) AS INT) AS k FROM t) SELECT elevation_number, ray_idx, gate_idx, CASE WHEN abs(k) <= 3 THEN v + k * 2 * nyquist_ms END AS nearest FROM k")
def q_alias_nearest(spark, sf_dir):
    # Four times the true velocity as reference, so that some lie more than three folds away.
    return _true(spark, sf_dir).withColumn("far", 4 * F.col("t")).select(*KEY, S.alias_nearest("v", "far", "nyquist_ms").alias("nearest"))


_H = "sqrt(range_m * range_m + {R} * {R} + 2 * range_m * {R} * sin(radians(elevation_deg))) - {R}"
_R = "8494666.666666666::DOUBLE"


@query(f"""WITH p AS (SELECT *, {_H.format(R=_R)} AS h FROM v_gates), q AS (SELECT *, {_R} * asin(range_m * cos(radians(elevation_deg)) / ({_R} + h)) AS arc FROM p)
SELECT elevation_number, ray_idx, gate_idx, round({LAT0} + degrees(arc * cos(radians(azimuth_deg)) / 6371000), 6) AS latitude,
round({LON0} + degrees(arc * sin(radians(azimuth_deg)) / (6371000 * cos(radians({LAT0})))), 6) AS longitude, round(h, 3) AS height_m FROM q""")
def q_gate_latlon(spark, sf_dir):
    p = S.gate_position("range_m", "azimuth_deg", "elevation_deg", S.number(LAT0), S.number(LON0))
    return gates(spark, sf_dir).select(*KEY, rounded(p["latitude"], "latitude"), rounded(p["longitude"], "longitude"), rounded(p["height_m"], "height_m", 3))


@query("SELECT elevation_number, ray_idx, gate_idx, round(range_m, 3) AS range_m, round(azimuth_deg, 6) AS azimuth_deg FROM v_gates")
def q_latlon_to_bin(spark, sf_dir):
    # There and back: a gate's place gives the gate again.
    p = S.gate_position("range_m", "azimuth_deg", "elevation_deg", S.number(LAT0), S.number(LON0))
    there = gates(spark, sf_dir).select(*KEY, "elevation_deg", p["latitude"].alias("latitude"), p["longitude"].alias("longitude"))
    back = S.position_gate("latitude", "longitude", "elevation_deg", S.number(LAT0), S.number(LON0))
    return there.select(*KEY, rounded(back["range_m"], "range_m", 3), rounded(back["azimuth_deg"], "azimuth_deg"))


@query(f"""SELECT elevation_number, ray_idx, gate_idx, round({_H.format(R='8490000.0::DOUBLE')}, 3) AS height_m, round({_R} * asin(range_m * cos(radians(elevation_deg)) / ({_R} + {_H.format(R=_R)})), 3) AS ground_m FROM v_gates""")
def q_beam_height(spark, sf_dir):
    return gates(spark, sf_dir).select(*KEY, rounded(S.beam_height("range_m", "elevation_deg"), "height_m", 3), rounded(S.ground_range("range_m", "elevation_deg"), "ground_m", 3))


@query("SELECT icao, round((longitude + 180) / 360, 6) AS x, round((1 - ln(tan(radians(greatest(-85.05112878, least(85.05112878, latitude))) / 2 + pi() / 4)) / pi()) / 2, 6) AS y FROM v_sites")
def q_mercator(spark, sf_dir):
    m = S.mercator("latitude", "longitude")
    return view(spark, sf_dir, "v_sites").select("icao", rounded(m["x"], "x"), rounded(m["y"], "y"))


@query("SELECT elevation_number, ray_idx, gate_idx, CAST(1 + floor(greatest(0, least(1, ((ref_code - 66) / 2.0::DOUBLE + 10) / 80)) * 254 + 0.5) AS INT) AS q FROM v_gates")
def q_quantize(spark, sf_dir):
    return gates(spark, sf_dir).select(*KEY, S.quantize("dbz", -10, 70).alias("q"))


# -- catalogue ---------------------------------------------------------------------------------

SC = """WITH s AS (SELECT regexp_extract(path, '([^/]*)$', 1) AS name, path FROM v_scans), c AS (SELECT substr(name, 1, 4) AS icao, substr(name, 5, 4) AS year, substr(name, 9, 2) AS month, substr(name, 11, 2) AS day, substr(name, 14, 6) AS "time",
strptime(substr(name, 5, 8) || substr(name, 14, 6), '%Y%m%d%H%M%S') AS scan_ts, path FROM s WHERE regexp_full_match(name, '[A-Z0-9]{4}[0-9]{8}_[0-9]{6}_V06'))"""


def scans(spark, sf_dir):
    return catalog.parse_scans(view(spark, sf_dir, "v_scans"))


@query(f"{SC} SELECT icao, year, month, day, \"time\", scan_ts, path FROM c")
def q_scans(spark, sf_dir):
    return scans(spark, sf_dir)


@query(f"{SC} SELECT DISTINCT year FROM c")
def q_list_years(spark, sf_dir):
    return catalog.years(scans(spark, sf_dir))


@query(f"{SC} SELECT DISTINCT month FROM c WHERE year = '2024'")
def q_list_months(spark, sf_dir):
    return catalog.months(scans(spark, sf_dir), "2024")


@query(f"{SC} SELECT DISTINCT day FROM c WHERE icao = 'KBHD' AND year = '2024' AND month = '01'")
def q_list_days(spark, sf_dir):
    return catalog.days(scans(spark, sf_dir), "KBHD", "2024", "01")


@query(f"{SC} SELECT DISTINCT \"time\" FROM c WHERE icao = 'KBHD' AND year = '2024' AND month = '01' AND day = (SELECT min(day) FROM c WHERE icao = 'KBHD')")
def q_list_times(spark, sf_dir):
    s = scans(spark, sf_dir)
    first = s.where("icao = 'KBHD'").agg(F.min("day").alias("day"))
    return s.where("icao = 'KBHD' and year = '2024' and month = '01'").join(first, "day").select("time").distinct()


@query(f"{SC}, w AS (SELECT max(path) AS p FROM c WHERE icao = 'KBHD') SELECT path FROM c WHERE path = (SELECT p FROM w) LIMIT 1")
def q_find_scan(spark, sf_dir):
    s = scans(spark, sf_dir)
    wanted = s.where("icao = 'KBHD'").agg(F.max_by(F.struct("icao", "year", "month", "day", "time"), "path").alias("w")).select("w.*").first()
    return catalog.find_scan(s, *(wanted or [""] * 6)[:6]).select("path") if wanted and wanted[0] else s.select("path").limit(0)


@query(f"{SC} SELECT icao, max(path) AS path, max(scan_ts) AS scan_ts FROM c WHERE CAST(scan_ts AS DATE) BETWEEN DATE '2024-01-18' AND DATE '2024-01-20' GROUP BY icao")
def q_latest_scan(spark, sf_dir):
    return catalog.latest_scans(scans(spark, sf_dir), F.lit(NOW).cast("timestamp"))


@query(f"{SC} SELECT 'https://archive.example.org/' || path AS url, icao, lower(icao) AS key FROM c")
def q_scan_urls(spark, sf_dir):
    s = scans(spark, sf_dir)
    return s.select(catalog.https_url(F.concat(F.lit("s3://archive/"), "path"), "archive", "archive.example.org").alias("url"), "icao", F.lower("icao").alias("key"))


@query("""WITH s AS (SELECT event_id, CAST(event_id % 50 AS BIGINT) * 131072 + 1 AS size FROM events), n AS (SELECT *, CASE WHEN size >= 2097152 THEN 6 ELSE 1 END AS n FROM s), m AS (SELECT *, CAST(ceil(size / n) AS BIGINT) AS step FROM n)
SELECT event_id, size, k * step AS first, least((k + 1) * step, size) - 1 AS last FROM m, range(0, 6) t(k) WHERE k < n""")
def q_download_ranges(spark, sf_dir):
    sizes = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", ((F.col("event_id") % 50).cast("long") * 131072 + 1).alias("size"))
    return sizes.select("event_id", "size", F.explode(catalog.download_ranges(F.col("size"))).alias("x")).select("event_id", "size", "x.*")


# -- volumes -----------------------------------------------------------------------------------


@query("SELECT elevation_number, count(*) AS n_gates, count(DISTINCT ray_idx) AS n_rays, max(range_m) AS max_range_m, min(range_m) AS min_range_m, round(avg(elevation_deg), 6) AS elevation_deg, arg_min(nyquist_ms, ray_idx * 1000 + gate_idx) AS nyquist_ms FROM v_gates GROUP BY 1")
def q_tilt_summary(spark, sf_dir):
    s = volume.tilt_summary(gates(spark, sf_dir), BY)
    return s.withColumn("elevation_deg", F.round("elevation_deg", 6))


@query("""WITH p AS (SELECT elevation_number, ray_idx // 30 AS seq, count(*) AS n, avg(elevation_deg + (ray_idx // 30) * 0.01::DOUBLE) AS e, max(range_m) AS m FROM v_gates GROUP BY 1, 2)
SELECT elevation_number, CAST(min(seq) AS INT) AS first_seq, CAST(sum(n) AS BIGINT) AS n, round(sum(n * e) / sum(n), 6) AS elevation_deg, max(m) AS max_range_m, round(arg_max(e, seq), 6) AS last_elevation_deg FROM p GROUP BY 1""")
def q_merge_tilts(spark, sf_dir):
    g = gates(spark, sf_dir).withColumn("seq", F.floor(F.col("ray_idx") / 30).cast("int"))
    parts = g.groupBy(*BY, "seq").agg(F.count("*").alias("n"), F.avg(F.col("elevation_deg") + F.col("seq") * S.number(0.01)).alias("elevation_deg"), F.max("range_m").alias("max_range_m"))
    return volume.merge_partial_tilts(parts, ["volume_id"]).withColumns({"elevation_deg": F.round("elevation_deg", 6), "last_elevation_deg": F.round("last_elevation_deg", 6)})


def cuts(spark, sf_dir):
    """The cut headers of all volumes."""
    return view(spark, sf_dir, "v_cuts")


@query("""WITH c AS (SELECT v_cuts.* FROM v_cuts),
p AS (SELECT a.elevation_number AS a, b.elevation_number AS b FROM c a JOIN c b ON b.elevation_number - a.elevation_number = 1 AND abs(a.elevation_deg - b.elevation_deg) < 0.1),
k AS (SELECT c.*, coalesce((SELECT p.a FROM p WHERE p.b = c.elevation_number), c.elevation_number) AS kept, elevation_number IN (SELECT a FROM p UNION ALL SELECT b FROM p) AS paired FROM c),
m AS (SELECT kept, elevation_number, unnest(string_split(moments, ',')) AS moment, contains(moments, 'VEL') AND NOT contains(moments, 'ZDR') AS doppler, paired FROM k),
o AS (SELECT kept, string_agg(moment || ':' || elevation_number, ',' ORDER BY moment || ':' || elevation_number) AS owners FROM m WHERE NOT paired OR (doppler AND moment IN ('VEL', 'SW')) OR (NOT doppler AND moment NOT IN ('VEL', 'SW')) GROUP BY 1)
SELECT kept AS kept_number, round(avg(elevation_deg), 6) AS elevation_deg, max(collect_ms) AS collect_ms, count(*) AS n_cuts, any_value(owners) AS owners FROM k JOIN o USING (kept) GROUP BY 1""")
def q_split_cut(spark, sf_dir):
    return volume.merged_cuts(cuts(spark, sf_dir), ["volume_id"]).select("kept_number", F.round("elevation_deg", 6).alias("elevation_deg"), "collect_ms", "n_cuts", "owners")


@query("SELECT elevation_number, round(elevation_deg, 6) AS elevation_deg FROM (SELECT *, row_number() OVER (PARTITION BY volume_id ORDER BY abs(elevation_deg - 2.0), elevation_number) AS n FROM (SELECT DISTINCT volume_id, elevation_number, elevation_deg FROM v_gates)) WHERE n = 1")
def q_closest_tilt(spark, sf_dir):
    tilts = volume.tilt_summary(gates(spark, sf_dir), BY)
    return volume.closest_tilt(tilts, ["volume_id"], 2.0).select("elevation_number", F.round("elevation_deg", 6).alias("elevation_deg"))


@query("""SELECT elevation_number, elevation_deg, CAST(row_number() OVER (PARTITION BY volume_id ORDER BY elevation_deg, elevation_number) - 1 AS INT) AS tilt_index, strftime(TIMESTAMP '1970-01-01' + INTERVAL 18971 DAY + to_milliseconds(collect_ms), '%Y-%m-%d %H-%M-%S') AS collected
FROM v_cuts""")
def q_tilt_info(spark, sf_dir):
    return volume.tilt_info(cuts(spark, sf_dir), ["volume_id"], 18972).select("elevation_number", "elevation_deg", "tilt_index", "collected")


@query("SELECT elevation_number, elevation_deg, lag(elevation_number) OVER w AS below, lead(elevation_number) OVER w AS above FROM v_cuts WINDOW w AS (PARTITION BY volume_id ORDER BY elevation_deg)")
def q_tilt_neighbors(spark, sf_dir):
    return volume.tilt_neighbours(cuts(spark, sf_dir), ["volume_id"]).select("elevation_number", "elevation_deg", "below", "above")


# -- rays and neighbours -----------------------------------------------------------------------


@query(f"""{G}, s AS (SELECT *, CASE WHEN lag(azimuth_deg) OVER w IS NULL OR abs(azimuth_deg - lag(azimuth_deg) OVER w) > 0.01 OR range_m <= lag(range_m) OVER w THEN 1 ELSE 0 END AS f FROM g WINDOW w AS (PARTITION BY elevation_number ORDER BY ray_idx, gate_idx))
SELECT elevation_number, ray_idx, gate_idx, CAST(sum(f) OVER (PARTITION BY elevation_number ORDER BY ray_idx, gate_idx) - 1 AS INT) AS segment FROM s""")
def q_ray_segments(spark, sf_dir):
    return grid.ray_segments(gates(spark, sf_dir)).select(*KEY, "segment")


@query(f"""{G}, r AS (SELECT elevation_number, ray_idx, min(azimuth_deg) AS a FROM g GROUP BY 1, 2),
d AS (SELECT elevation_number, (coalesce(lead(a) OVER w, first_value(a) OVER w) - a + 360) % 360 AS gap FROM r WINDOW w AS (PARTITION BY elevation_number ORDER BY ray_idx))
SELECT elevation_number, count(*) AS n_rays, round(avg(CASE WHEN gap <= 5 THEN gap END), 6) AS mean_gap, round(median(CASE WHEN gap <= 5 THEN gap END), 6) AS median_gap, max(gap) AS widest_gap FROM d GROUP BY 1""")
def q_az_gaps(spark, sf_dir):
    return grid.azimuth_gaps(gates(spark, sf_dir)).withColumns({"mean_gap": F.round("mean_gap", 6), "median_gap": F.round("median_gap", 6)})


@query(f"""{G}, b AS (SELECT elevation_number, ray_idx, gate_idx, azimuth_deg + CASE WHEN ray_idx % 7 = 3 THEN 360 ELSE 0 END AS a, range_m - CASE WHEN ray_idx % 5 = 0 AND gate_idx % 11 = 0 THEN 600 ELSE 0 END AS r FROM g),
l AS (SELECT *, coalesce(r > lag(r) OVER (PARTITION BY elevation_number, ray_idx ORDER BY gate_idx), true) AS up FROM b) SELECT elevation_number, ray_idx, bool_and(up AND a >= 0 AND a < 360) AS valid, count(*) AS n_gates FROM l GROUP BY 1, 2""")
def q_ray_validity(spark, sf_dir):
    # Some rays are given an azimuth beyond the circle or ranges that fall, so that not all are valid.
    g = gates(spark, sf_dir).withColumns({"azimuth_deg": F.col("azimuth_deg") + F.when(F.col("ray_idx") % 7 == 3, 360).otherwise(0), "range_m": F.col("range_m") - F.when((F.col("ray_idx") % 5 == 0) & (F.col("gate_idx") % 11 == 0), 600).otherwise(0)})
    return grid.valid_rays(g)


@query(f"{AZ} SELECT elevation_number, ray_idx, gate_idx, to_gate, v, to_v FROM rg")
def q_range_neighbors(spark, sf_dir):
    return grid.range_neighbours(gates(spark, sf_dir)).select(*KEY, "to_gate", "v", "to_v")


@query(f"{G} SELECT * FROM (SELECT elevation_number, ray_idx, gate_idx, lead(gate_idx) OVER w AS to_gate, lead(range_m) OVER w - range_m AS dr FROM g WINDOW w AS (PARTITION BY elevation_number, ray_idx ORDER BY gate_idx)) WHERE dr > 125 AND dr <= 762.6")
def q_bridged_neighbors(spark, sf_dir):
    return grid.range_neighbours(gates(spark, sf_dir), most=3.05).select(*KEY, "to_gate", "dr")


@query(f"{AZ} SELECT elevation_number, ray_idx, gate_idx, to_ray, v, to_v FROM az")
def q_az_neighbors(spark, sf_dir):
    return grid.azimuth_neighbours(gates(spark, sf_dir)).select(*KEY, "to_ray", "v", "to_v")


@query(f"""{RAYS}, s AS (SELECT elevation_number, CAST((ray_idx + da + n_rays) % n_rays AS INT) AS ray_idx, gate_idx + dg AS gate_idx, v AS sent FROM g JOIN rays USING (elevation_number), (VALUES (-1), (0), (1)) a(da), (VALUES (-1), (0), (1)) b(dg) WHERE da <> 0 OR dg <> 0),
m AS (SELECT elevation_number, ray_idx, gate_idx, count(*) AS n, avg(sent) AS m FROM s GROUP BY 1, 2, 3)
SELECT g.elevation_number, g.ray_idx, g.gate_idx, coalesce(n, 0) AS n_neighbours, round(m, 6) AS mean_v FROM g LEFT JOIN m USING (elevation_number, ray_idx, gate_idx)""")
def q_neighbors8(spark, sf_dir):
    return grid.eight_neighbours(gates(spark, sf_dir)).select(*KEY, "n_neighbours", rounded("mean_v", "mean_v"))


@query(G + CELLS.format("g", "") + """ SELECT elevation_number, 'range' AS way, ray_idx, gate_idx, ray_idx AS to_ray, g2 AS to_gate FROM nx WHERE g2 - gate_idx <= 101
UNION ALL SELECT elevation_number, 'azimuth', ray_idx, gate_idx, r2, gate_idx FROM nx WHERE (r2 - ray_idx + n_rays) % n_rays BETWEEN 1 AND 101""")
def q_skip_neighbors(spark, sf_dir):
    return grid.next_with_data(gates(spark, sf_dir)).select(*BY, "way", "a.ray_idx", "a.gate_idx", F.col("b.ray_idx").alias("to_ray"), F.col("b.gate_idx").alias("to_gate"))


@query(f"{G} SELECT elevation_number, ray_idx, gate_idx, median(v) OVER (PARTITION BY elevation_number, ray_idx ORDER BY gate_idx RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth_v FROM g")
def q_gate_median(spark, sf_dir):
    return grid.median_filter(gates(spark, sf_dir)).select(*KEY, "smooth_v")


@query(f"""{G}, p AS (SELECT *, lag(gate_idx) OVER w AS a1, lag(gate_idx, 2) OVER w AS a2, lag(v) OVER w AS p1, lag(v, 2) OVER w AS p2, lead(gate_idx) OVER w AS b1, lead(gate_idx, 2) OVER w AS b2, lead(v) OVER w AS q1, lead(v, 2) OVER w AS q2 FROM g WINDOW w AS (PARTITION BY elevation_number, ray_idx ORDER BY gate_idx)),
e AS (SELECT *, CASE WHEN gate_idx - a1 = 1 AND gate_idx - a2 = 2 THEN 2 * p1 - p2 END AS x, CASE WHEN b1 - gate_idx = 1 AND b2 - gate_idx = 2 THEN 2 * q1 - q2 END AS y FROM p)
SELECT elevation_number, ray_idx, gate_idx, coalesce((x + y) / 2, x, y) AS predicted FROM e""")
def q_prediction(spark, sf_dir):
    return grid.directional_prediction(gates(spark, sf_dir)).select(*KEY, "predicted")


# -- regions -----------------------------------------------------------------------------------


@query(f"{LABELS} SELECT id, l AS region FROM lab")
def q_region_labels(spark, sf_dir):
    return labelled(spark, sf_dir).select("id", "region")


@query(f"{LABELS} SELECT elevation_number, region, count(*) AS n_gates FROM r GROUP BY 1, 2")
def q_region_sizes(spark, sf_dir):
    return dealias.region_sizes(labelled(spark, sf_dir).withColumn("region", F.col("region") + 1)).withColumn("region", F.col("region") - 1)


@query(f"{PAIRS} SELECT elevation_number, node_a, node_b, round(sum_diff, 6) + 0.0 AS sum_diff, weight FROM eg")
def q_region_edges(spark, sf_dir):
    return grid.region_edges(labelled(spark, sf_dir)).select(*BY, "node_a", "node_b", rounded("sum_diff", "sum_diff"), "weight")


@query(None)
def q_dealias_region(spark, sf_dir):
    return dealias.dealias(gates(spark, sf_dir)).select(*KEY, "v", "region", "folds", "corrected")


JUMPS = f"""{AZ}, a AS (SELECT elevation_number, CAST(sum(CASE WHEN abs(to_v - v) >= 0.9::DOUBLE * 2 * nyquist_ms THEN 1 ELSE 0 END) AS BIGINT) AS j FROM rg GROUP BY 1), b AS (SELECT elevation_number, CAST(sum(CASE WHEN abs(to_v - v) >= 0.9::DOUBLE * 2 * nyquist_ms THEN 1 ELSE 0 END) AS BIGINT) AS j FROM az GROUP BY 1)"""


@query(f"{JUMPS} SELECT elevation_number, count(*) AS n_gates, any_value(coalesce(a.j, 0)) AS range_jumps, any_value(coalesce(b.j, 0)) AS azimuth_jumps, any_value(coalesce(a.j, 0) + coalesce(b.j, 0)) AS jumps FROM g LEFT JOIN a USING (elevation_number) LEFT JOIN b USING (elevation_number) GROUP BY 1")
def q_fold_jumps(spark, sf_dir):
    return grid.fold_jumps(gates(spark, sf_dir))


@query(None)
def q_fold_jumps_after(spark, sf_dir):
    """Jumps before and after the region dealiasing."""
    g = gates(spark, sf_dir)
    fixed = dealias.dealias(g).select(*KEY, "corrected").join(g, KEY)
    before, after = grid.fold_jumps(g).select(*BY, F.col("jumps").alias("jumps_before")), grid.fold_jumps(fixed, value="corrected").select(*BY, F.col("jumps").alias("jumps_after"))
    return before.join(after, BY)


@query(f"""{T}, m AS (SELECT *, CASE WHEN abs(round((t - v) / (2 * nyquist_ms))) <= 1 THEN v + round((t - v) / (2 * nyquist_ms)) * 2 * nyquist_ms ELSE v END AS a FROM t)
SELECT elevation_number, count(*) AS n_gates, count(*) FILTER (abs(a - v) > 0.01) AS changed_a, count(*) FILTER (abs(t - v) > 0.01) AS changed_b, count(*) FILTER (abs(a - t) <= 0.01) AS agree, count(*) FILTER (abs(a - v) > 0.01 AND abs(t - v) <= 0.01) AS false_positive,
count(*) FILTER (abs(a - v) <= 0.01 AND abs(t - v) > 0.01) AS missed, count(*) FILTER (abs(a - v) > 0.01 AND abs(t - v) > 0.01 AND abs(a - t) > 0.01) AS wrong_fold FROM m GROUP BY 1""")
def q_method_compare(spark, sf_dir):
    g = _true(spark, sf_dir)
    a = F.coalesce(S.alias_nearest("v", "t", "nyquist_ms", 1), F.col("v"))
    return wind.compare_methods(g.withColumn("a", a), BY, "v", "a", "t")


FAR = f"""{AZ}, d AS (SELECT elevation_number, ray_idx, gate_idx, to_gate, ray_idx AS to_ray, abs(v - to_v) % (2 * nyquist_ms) AS d, nyquist_ms FROM rg UNION ALL SELECT elevation_number, ray_idx, gate_idx, gate_idx, to_ray, abs(v - to_v) % (2 * nyquist_ms), nyquist_ms FROM az),
e AS (SELECT *, (CASE WHEN d > nyquist_ms THEN 2 * nyquist_ms - d ELSE d END) / nyquist_ms AS f FROM d), f AS (SELECT elevation_number, ray_idx, gate_idx, max(f) AS far FROM (SELECT elevation_number, ray_idx, gate_idx, f FROM e UNION ALL SELECT elevation_number, to_ray, to_gate, f FROM e) GROUP BY 1, 2, 3),
sd AS (SELECT g.*, coalesce(far >= 0.5, false) AS seed FROM g LEFT JOIN f USING (elevation_number, ray_idx, gate_idx)), ts AS (SELECT elevation_number, avg(CASE WHEN seed THEN 1 ELSE 0 END) AS share FROM sd GROUP BY 1),
gr AS (SELECT DISTINCT elevation_number, (ray_idx + da + n_rays) % n_rays AS ray_idx, gate_idx + dg AS gate_idx FROM sd JOIN rays USING (elevation_number), (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) s(da, dg) WHERE seed)"""


@query(f"{FAR} SELECT sd.elevation_number, sd.ray_idx, sd.gate_idx, seed, (CASE WHEN share <= 0.1 THEN gr.ray_idx IS NOT NULL ELSE seed END) AND dbz >= 25 AS hard FROM sd JOIN ts USING (elevation_number) LEFT JOIN gr ON sd.elevation_number = gr.elevation_number AND sd.ray_idx = gr.ray_idx AND sd.gate_idx = gr.gate_idx")
def q_hard_gates(spark, sf_dir):
    return grid.hard_gates(gates(spark, sf_dir)).select(*KEY, "seed", "hard")


@query(f"{FAR.replace('far >= 0.5', 'far >= 0.1')} SELECT g.elevation_number, g.ray_idx, g.gate_idx FROM g JOIN gr ON g.elevation_number = gr.elevation_number AND g.ray_idx = gr.ray_idx AND g.gate_idx = gr.gate_idx")
def q_dilate(spark, sf_dir):
    g = gates(spark, sf_dir)
    seeds = grid.neighbour_distance(g).where("far >= 0.1")
    return grid.dilate(seeds, g).select(*KEY)


@query(f"""{PAIRS}, vt AS (SELECT elevation_number, node_a AS region, CAST(-round(sum_diff / weight) AS INT) AS k, weight FROM eg UNION ALL SELECT elevation_number, node_b, CAST(round(sum_diff / weight) AS INT), weight FROM eg),
s AS (SELECT elevation_number, region, k, CAST(sum(weight) AS BIGINT) AS w FROM vt GROUP BY 1, 2, 3)
SELECT elevation_number, region, arg_max(k, w * 1000 - abs(k) * 10 + CASE WHEN k > 0 THEN 1 ELSE 0 END) AS k, max(w) AS votes, CAST(sum(w) AS BIGINT) AS all_votes FROM s GROUP BY 1, 2""")
def q_fold_votes(spark, sf_dir):
    return dealias.fold_votes(labelled(spark, sf_dir))


@query(f"""{PAIRS}, sd AS (SELECT elevation_number, ra AS region, va AS v, vb AS o FROM pr UNION ALL SELECT elevation_number, rb, vb, va FROM pr), tk AS (SELECT sd.*, vn, k, abs(o - v - k * 2 * vn) AS x FROM sd JOIN vn USING (elevation_number), range(-2, 3) t(k)),
c AS (SELECT elevation_number, region, k, round(avg(CASE WHEN x <= 0.4::DOUBLE * vn THEN x * x / (2 * (0.4::DOUBLE * vn)) ELSE x - 0.4::DOUBLE * vn / 2 END) + 1e-9, 6) AS cost FROM tk GROUP BY 1, 2, 3), o AS (SELECT *, row_number() OVER (PARTITION BY elevation_number, region ORDER BY cost) AS n FROM c)
SELECT elevation_number, region, max(cost) FILTER (n = 1) AS best_cost, max(cost) FILTER (n = 2) AS second_cost FROM o GROUP BY 1, 2""")
def q_fold_scores(spark, sf_dir):
    return dealias.fold_scores(labelled(spark, sf_dir)).select(*BY, "region", rounded(F.col("best_cost") + 1e-9, "best_cost"), rounded(F.col("second_cost") + 1e-9, "second_cost"))


@query(f"{LABELS} SELECT elevation_number, region, count(*) AS n_gates, count(DISTINCT ray_idx) AS n_rays, round(avg(v), 6) + 0.0 AS mean_v, round(stddev_pop(v), 4) AS sd_v, round(avg(CASE WHEN dbz > 5 THEN dbz END), 6) AS mean_dbz, round(avg(CASE WHEN dbz > 5 THEN 1 ELSE 0 END), 6) AS dbz_share FROM r GROUP BY 1, 2")
def q_region_stats(spark, sf_dir):
    s = wind.region_stats(labelled(spark, sf_dir).withColumn("region", F.col("region") + 1)).withColumn("region", F.col("region") - 1)
    return s.select(*BY, "region", "n_gates", "n_rays", rounded("mean_v", "mean_v"), rounded("sd_v", "sd_v", 4), rounded("mean_dbz", "mean_dbz"), rounded("dbz_share", "dbz_share"))


@query(f"""{PAIRS}, s AS (SELECT elevation_number, unnest([ra, rb]) AS region, abs(va - vb) >= 0.5 * vn AS a, va * vb < 0 AND abs(va) >= 0.3::DOUBLE * vn AND abs(vb) >= 0.3::DOUBLE * vn AS b FROM pr JOIN vn USING (elevation_number))
SELECT elevation_number, region, count(*) AS n_pairs, round(avg(CASE WHEN a THEN 1 ELSE 0 END), 6) AS strong_share, round(avg(CASE WHEN b THEN 1 ELSE 0 END), 6) AS opposite_share FROM s GROUP BY 1, 2""")
def q_shear_stats(spark, sf_dir):
    return wind.shear_stats(labelled(spark, sf_dir)).select(*BY, "region", "n_pairs", rounded("strong_share", "strong_share"), rounded("opposite_share", "opposite_share"))


# -- alignment and winds -----------------------------------------------------------------------

_NEAR = """{0}, c AS (SELECT a.elevation_number, a.ray_idx, a.gate_idx, b.{1} AS x, round(least(abs(a.azimuth_deg - b.azimuth_deg) % 360, 360 - abs(a.azimuth_deg - b.azimuth_deg) % 360), 6) AS da, round(abs(a.range_m - b.range_m), 6) AS dr, b.azimuth_deg AS az2, b.range_m AS r2 FROM {2}),
w AS (SELECT *, row_number() OVER (PARTITION BY elevation_number, ray_idx, gate_idx ORDER BY da, dr, az2, r2) AS n FROM c WHERE da <= 1.5 AND dr <= 750)"""


@query(_NEAR.format(f"{G}, k AS (SELECT * FROM g WHERE gate_idx % 3 = 1)", "dbz", "g a JOIN k b ON a.elevation_number = b.elevation_number AND a.ray_idx = b.ray_idx") + " SELECT g.elevation_number, g.ray_idx, g.gate_idx, x AS aligned_dbz FROM g LEFT JOIN (SELECT * FROM w WHERE n = 1) q USING (elevation_number, ray_idx, gate_idx)")
def q_align_moment(spark, sf_dir):
    # The reflectivity moment is taken as sampled at every third gate.
    g = gates(spark, sf_dir)
    return align.nearest_polar(g, g.where("gate_idx % 3 = 1"), BY, value="dbz").select(*KEY, F.col("nearest").alias("aligned_dbz"))


@query(_NEAR.format(f"{G}, e AS (SELECT elevation_number, avg(elevation_deg) AS d FROM g GROUP BY 1), l AS (SELECT g.* EXCLUDE (range_m), range_m * cos(radians(elevation_deg)) / cos(radians(e.d)) AS range_m FROM g JOIN e ON e.elevation_number = g.elevation_number + 1)", "v", "l a JOIN g b ON b.elevation_number = a.elevation_number + 1 AND a.ray_idx = b.ray_idx") + " SELECT l.elevation_number, l.ray_idx, l.gate_idx, x AS above_v FROM l LEFT JOIN (SELECT * FROM w WHERE n = 1) q USING (elevation_number, ray_idx, gate_idx)")
def q_vertical_lookup(spark, sf_dir):
    g = written(gates(spark, sf_dir))  # read five times
    tilts = volume.tilt_neighbours(volume.tilt_summary(g, BY), ["volume_id"])
    return align.vertical_lookup(g, tilts, ["volume_id"]).select(*KEY, F.col("nearest").alias("above_v"))


@query("""WITH c AS (SELECT * FROM v_cuts) SELECT a.elevation_number, arg_min(b.elevation_number, round(abs(a.elevation_deg - b.elevation_deg), 6) * 1000 + b.elevation_number % 32) AS sibling FROM c a LEFT JOIN c b ON a.volume_id = b.volume_id AND a.elevation_number <> b.elevation_number AND abs(a.elevation_deg - b.elevation_deg) < 0.1
AND abs(a.collect_ms - b.collect_ms) < 30000 AND (contains(b.moments, 'RHO') OR contains(b.moments, 'ZDR')) WHERE contains(a.moments, 'VEL') GROUP BY 1""")
def q_sibling(spark, sf_dir):
    return align.siblings(cuts(spark, sf_dir), ["volume_id"]).select("elevation_number", "sibling")


@query(f"""{G}, s AS (SELECT elevation_number, CAST(floor(azimuth_deg / 10) AS INT) AS s, avg(v) AS m, max(nyquist_ms) AS n FROM g GROUP BY 1, 2 HAVING count(*) >= 30), p AS (SELECT elevation_number, s % 18 AS p, avg(m) AS m, max(n) AS n FROM s GROUP BY 1, 2 HAVING count(*) = 2)
SELECT elevation_number, count(*) AS n_pairs, round(avg(m), 6) + 0.0 AS offset_ms, max(n) AS nyquist_ms, CAST(round(-avg(m) / (2 * max(n))) AS INT) AS folds FROM p GROUP BY 1 HAVING count(*) >= 3""")
def q_sector_balance(spark, sf_dir):
    return wind.sector_balance(gates(spark, sf_dir)).select(*BY, "n_pairs", rounded("offset_ms", "offset_ms"), "nyquist_ms", "folds")


def _bin() -> Column:
    return (F.col("volume_id") * 1000 + F.col("bin")).alias("bin")


def _vad_sql(k: int) -> str:
    source = "x0" if k == 1 else f"(SELECT x0.* FROM x0 JOIN f{k - 1} USING (bin) WHERE abs(v - u * x1 - w * x2) <= 0.6::DOUBLE * nyquist_ms)"
    return f"""s{k} AS (SELECT bin, count(*) AS n, sum(x1 * x1) + 0.001::DOUBLE * count(*) AS a, sum(x1 * x2) AS b, sum(x2 * x2) + 0.001::DOUBLE * count(*) AS c, sum(x1 * v) AS p, sum(x2 * v) AS q FROM {source} GROUP BY 1),
f{k} AS (SELECT bin, n, (c * p - b * q) / (a * c - b * b) AS u, (a * q - b * p) / (a * c - b * b) AS w, 4 * (a * c - b * b) / ((a + c) * (a + c)) AS spread FROM s{k})"""


X0 = f"""{G.replace('vel_code', 'true_code')}, x0 AS (SELECT *, volume_id * 1000 + CAST(floor(({_H.format(R='8490000.0::DOUBLE')}) / 500) AS INT) AS bin, sin(radians(azimuth_deg)) * cos(radians(elevation_deg)) AS x1, cos(radians(azimuth_deg)) * cos(radians(elevation_deg)) AS x2 FROM g)"""


@query(f"{X0}, {_vad_sql(1)}, {_vad_sql(2)}, {_vad_sql(3)} SELECT bin, n, round(u, 4) AS u, round(w, 4) AS w, round(spread, 4) AS spread FROM f3")
def q_vad_ls(spark, sf_dir):
    g = _true(spark, sf_dir).withColumn("v", F.col("t"))
    return wind.vad(g, ["volume_id"]).select(_bin(), "n", rounded("u", "u", 4), rounded("w", "w", 4), rounded("spread", "spread", 4))


@query(f"""{X0.replace('true_code', 'vel_code')}, t AS (SELECT bin, iu, iw, cos(pi() * (v - (iu * 20 * sin(radians(azimuth_deg)) + iw * 20 * cos(radians(azimuth_deg))) * cos(radians(elevation_deg))) / nyquist_ms) AS s FROM x0, range(-2, 3) a(iu), range(-2, 3) b(iw))
SELECT bin, CAST(iu AS INT) AS iu, CAST(iw AS INT) AS iw, round(avg(s), 6) + 0.0 AS score, count(*) AS n FROM t GROUP BY 1, 2, 3""")
def q_ar_vad_score(spark, sf_dir):
    g = gates(spark, sf_dir)
    return wind.alias_scores(g, ["volume_id"], limit=40, step=20).select(_bin(), "iu", "iw", rounded("score", "score"), "n")


@query(f"{G} SELECT elevation_number, count(*) AS n, round(sqrt(sum(cos(pi() * v / nyquist_ms)) ** 2 + sum(sin(pi() * v / nyquist_ms)) ** 2) / count(*), 6) AS resultant FROM g GROUP BY 1")
def q_resultant(spark, sf_dir):
    phase = F.lit(3.141592653589793) * F.col("v") / F.col("nyquist_ms")
    return wind.resultant_length(gates(spark, sf_dir), BY, phase).select(*BY, "n", rounded("resultant", "resultant"))


_TRUE_X0 = X0.split(", x0 AS ", 1)[1].replace("FROM g)", "FROM (SELECT * REPLACE ((true_code - 129) / 2.0::DOUBLE AS v) FROM g))")


@query(f"""{LABELS}, x0 AS {_TRUE_X0}, {_vad_sql(1)}, {_vad_sql(2)}, {_vad_sql(3)},
rb AS (SELECT *, volume_id * 1000 + CAST(floor(({_H.format(R='8490000.0::DOUBLE')}) / 500) AS INT) AS bin FROM r), an AS (SELECT elevation_number, region, nyquist_ms, (u * sin(radians(azimuth_deg)) + w * cos(radians(azimuth_deg))) * cos(radians(elevation_deg)) - v AS d FROM rb JOIN f3 USING (bin)),
ft AS (SELECT elevation_number, region, CAST(k AS INT) AS k, round(sum(greatest(0, 1 - abs(d - 2 * k * nyquist_ms) / nyquist_ms)), 9) AS fit, count(*) AS n FROM an, range(-2, 3) t(k) GROUP BY 1, 2, 3), rk AS (SELECT *, row_number() OVER (PARTITION BY elevation_number, region ORDER BY fit DESC, abs(k), k) AS i FROM ft)
SELECT elevation_number, region, max(n) AS n, max(k) FILTER (i = 1) AS k, round(max(fit) FILTER (i = 1) / max(n), 6) + 0.0 AS share, round((max(fit) FILTER (i = 1) - max(fit) FILTER (i = 2)) / max(n), 6) + 0.0 AS margin FROM rk GROUP BY 1, 2""")
def q_component_anchor(spark, sf_dir):
    g = _true(spark, sf_dir)
    winds = wind.vad(g.withColumn("v", F.col("t")), ["volume_id"]).select("volume_id", "bin", "u", "w")
    return wind.component_anchor(labelled(spark, sf_dir), winds, BY).select(*BY, "region", "n", "k", rounded("share", "share"), rounded("margin", "margin"))


# -- rasters, voxels, colours ------------------------------------------------------------------


@query(f"""WITH g AS (SELECT *, (vel_code - 129) / 2.0::DOUBLE AS v, (range_m * sin(radians(azimuth_deg))) AS cx, -(range_m * cos(radians(azimuth_deg))) AS cy, (range_m + 125) * sin(radians(1.5::DOUBLE)) + 126 AS reach FROM v_gates),
b AS (SELECT *, greatest(0, CAST(floor((cx - reach) / 1000 + 32) AS INT)) AS x0, least(63, CAST(floor((cx + reach) / 1000 + 32) AS INT) + 1) AS x1, greatest(0, CAST(floor((cy - reach) / 1000 + 32) AS INT)) AS y0, least(63, CAST(floor((cy + reach) / 1000 + 32) AS INT) + 1) AS y1 FROM g WHERE abs(v) >= 0.01),
p AS (SELECT *, unnest(range(x0, x1 + 1)) AS px FROM b WHERE x0 <= x1), q AS (SELECT *, unnest(range(y0, y1 + 1)) AS py FROM p WHERE y0 <= y1), h AS (SELECT *, (px - 32) * 1000.0::DOUBLE AS x, -(py - 32) * 1000.0::DOUBLE AS y FROM q),
i AS (SELECT *, sqrt(x * x + y * y) AS rr, abs(degrees(atan2(x, y)) - azimuth_deg) % 360 AS d FROM h)
SELECT elevation_number, CAST(px AS INT) AS px, CAST(py AS INT) AS py, round(avg(v), 6) + 0.0 AS value, count(*) AS n_gates FROM i WHERE rr > 1000 AND rr >= range_m - 125 AND rr < range_m + 125 AND least(d, 360 - d) <= 1.5 GROUP BY 1, 2, 3""")
def q_pixel_mean(spark, sf_dir):
    return raster.pixels(gates(spark, sf_dir), BY, "v", size=64, metres=1000, beam_deg=3.0).select(*BY, "px", "py", rounded("value", "value"), "n_gates")


@query(f"""WITH p AS (SELECT *, {_H.format(R=_R)} AS h FROM v_gates), q AS (SELECT *, {_R} * asin(range_m * cos(radians(elevation_deg)) / ({_R} + h)) AS arc FROM p),
l AS (SELECT *, {LAT0} + degrees(arc * cos(radians(azimuth_deg)) / 6371000) AS la, {LON0} + degrees(arc * sin(radians(azimuth_deg)) / (6371000 * cos(radians({LAT0})))) AS lo FROM q)
SELECT elevation_number, ray_idx, gate_idx FROM l WHERE la >= {BOX[1]} AND la < {BOX[0]} AND lo >= {BOX[3]} AND lo < {BOX[2]} AND h >= 0 AND h < 20668""")
def q_voxel_box(spark, sf_dir):
    g = gates(spark, sf_dir).withColumns(S.gate_position("range_m", "azimuth_deg", "elevation_deg", S.number(LAT0), S.number(LON0)))
    north, south, east, west = BOX
    return g.where((F.col("latitude") >= south) & (F.col("latitude") < north) & (F.col("longitude") >= west) & (F.col("longitude") < east) & (F.col("height_m") >= 0) & (F.col("height_m") < S.VOLUME_TOP_M)).select(*KEY)


def _voxel_sql() -> str:
    import math

    north, south, east, west = BOX
    n = raster.voxel_counts(*BOX, VOXELS)
    km = ((north - south) / n[0] * 111.32, (east - west) / n[1] * 111.32 * math.cos(math.radians((north + south) / 2)), 20.668 / n[2])
    axis = lambda name, c, k, m: f"{name} AS (SELECT *, unnest(range(greatest(0, {c} - least({min(m - 1, 64)}, CAST(ceil(3 * wd / (sqrt(50.0::DOUBLE) * {k!r}::DOUBLE)) AS INT))), least({m - 1}, {c} + least({min(m - 1, 64)}, CAST(ceil(3 * wd / (sqrt(50.0::DOUBLE) * {k!r}::DOUBLE)) AS INT))) + 1)) AS i{c} FROM "
    weight = lambda c, k: f"exp(-50.0::DOUBLE * ((i{c} - {c}) * {k!r}::DOUBLE) ** 2 / (wd * wd))"
    return f"""WITH p AS (SELECT *, (ref_code - 66) / 2.0::DOUBLE AS dbz, {_H.format(R=_R)} AS h FROM v_gates), q AS (SELECT *, {_R} * asin(range_m * cos(radians(elevation_deg)) / ({_R} + h)) AS arc FROM p),
l AS (SELECT *, {LAT0} + degrees(arc * cos(radians(azimuth_deg)) / 6371000) AS la, {LON0} + degrees(arc * sin(radians(azimuth_deg)) / (6371000 * cos(radians({LAT0})))) AS lo FROM q),
c AS (SELECT *, CAST(floor(({north} - la) / ({(north - south) / n[0]!r}::DOUBLE)) AS INT) AS cx, CAST(floor(({east} - lo) / ({(east - west) / n[1]!r}::DOUBLE)) AS INT) AS cy, CAST(floor(h / ({20668.0 / n[2]!r}::DOUBLE)) AS INT) AS cz, sqrt(0.7::DOUBLE ** 2 + (0.065::DOUBLE * (range_m / 1000)) ** 2) AS wd
  FROM l WHERE la >= {south} AND la < {north} AND lo >= {west} AND lo < {east} AND h >= 0 AND h < 20668),
{axis('ax', 'cx', km[0], n[0])} c), {axis('ay', 'cy', km[1], n[1])} ax), {axis('az', 'cz', km[2], n[2])} ay), w AS (SELECT *, {weight('cx', km[0])} * {weight('cy', km[1])} * {weight('cz', km[2])} AS wt FROM az)
SELECT volume_id AS volume, CAST(icx AS INT) AS ix, CAST(icy AS INT) AS iy, CAST(icz AS INT) AS iz, round(sum(wt * dbz) / sum(wt), 3) + 0.0 AS value, round(sum(wt), 3) AS weight FROM w GROUP BY 1, 2, 3, 4"""


@query(_voxel_sql())
def q_voxel_mean(spark, sf_dir):
    v = raster.voxels(gates(spark, sf_dir), ["volume_id"], "dbz", LAT0, LON0, BOX, most=VOXELS)
    return v.select(F.col("volume_id").alias("volume"), "ix", "iy", "iz", rounded("value", "value", 3), rounded("weight", "weight", 3))


@query("SELECT elevation_number, step, count(*) AS n FROM (SELECT elevation_number, CASE WHEN d >= 70 THEN 70 WHEN d >= 50 THEN 50 WHEN d >= 30 THEN 30 WHEN d >= 10 THEN 10 WHEN d >= -10 THEN -10 END AS step FROM (SELECT elevation_number, (ref_code - 66) / 2.0::DOUBLE AS d FROM v_gates)) GROUP BY 1, 2")
def q_color_ref(spark, sf_dir):
    return gates(spark, sf_dir).withColumn("step", raster.colour_steps(F.col("dbz"))).groupBy(*BY, "step").agg(F.count("*").alias("n"))


@query("""WITH p(lo, hi, r0, g0, b0, a0, r1, g1, b1, a1) AS (VALUES (-10, 10, 0, 0, 0, 0, 20, 40, 200, 255), (10, 30, 20, 40, 200, 255, 0, 200, 0, 255), (30, 50, 0, 200, 0, 255, 250, 200, 0, 255), (50, 70, 250, 200, 0, 255, 255, 0, 255, 255)),
e AS (SELECT i, -10 + 80 * i / 255.0::DOUBLE AS v FROM range(0, 256) t(i)), c AS (SELECT e.i, e.v, p.*, (v - lo) / (hi - lo) AS t, row_number() OVER (PARTITION BY e.i ORDER BY lo DESC) AS n FROM e JOIN p ON lo <= v),
t AS (SELECT i, CAST(floor(r0 + (r1 - r0) * t + 0.5) AS INT) AS r, CAST(floor(g0 + (g1 - g0) * t + 0.5) AS INT) AS g, CAST(floor(b0 + (b1 - b0) * t + 0.5) AS INT) AS b, CAST(floor(a0 + (a1 - a0) * t + 0.5) AS INT) AS a FROM c WHERE n = 1),
x AS (SELECT elevation_number, least(255, greatest(0, CAST(floor(((ref_code - 66) / 2.0::DOUBLE + 10) / 80 * 255 + 0.5) AS INT))) AS i FROM v_gates)
SELECT elevation_number, r, g, b, a, count(*) AS n FROM x JOIN t USING (i) GROUP BY 1, 2, 3, 4, 5""")
def q_palette_dense(spark, sf_dir):
    return gates(spark, sf_dir).select(*BY, raster.colour(F.col("dbz")).alias("c")).groupBy(*BY, "c.r", "c.g", "c.b", "c.a").agg(F.count("*").alias("n"))


def _corner(dr: int, da: int, k: int) -> str:
    r, h = f"(range_m + {dr * 125})", f"(sqrt((range_m + {dr * 125}) ** 2 + {_R} * {_R} + 2 * (range_m + {dr * 125}) * {_R} * sin(radians(elevation_deg))) - {_R})"
    arc, a = f"({_R} * asin({r} * cos(radians(elevation_deg)) / ({_R} + {h})))", f"radians(azimuth_deg + {da} * 0.5::DOUBLE)"
    return f"round({LON0} + degrees({arc} * sin({a}) / (6371000 * cos(radians({LAT0})))), 6) AS lon{k}_, round({LAT0} + degrees({arc} * cos({a}) / 6371000), 6) AS lat{k}_"


@query(f"""WITH c AS (SELECT elevation_number, ray_idx, gate_idx, (vel_code - 129) / 2.0::DOUBLE AS value, {_corner(-1, -1, 0)}, {_corner(1, -1, 1)}, {_corner(1, 1, 2)}, {_corner(-1, 1, 3)} FROM v_gates)
SELECT elevation_number, ray_idx, gate_idx, value, 0 AS triangle, lon0_ AS lon1, lat0_ AS lat1, lon1_ AS lon2, lat1_ AS lat2, lon2_ AS lon3, lat2_ AS lat3 FROM c UNION ALL SELECT elevation_number, ray_idx, gate_idx, value, 1, lon0_, lat0_, lon2_, lat2_, lon3_, lat3_ FROM c
UNION ALL SELECT elevation_number, ray_idx, gate_idx, value, 2, lon2_, lat2_, lon3_, lat3_, lon3_, lat3_ FROM c""")
def q_triangles(spark, sf_dir):
    t = raster.triangles(gates(spark, sf_dir), KEY, "v", LAT0, LON0)
    return t.select(*KEY, "value", "triangle", *(rounded(c, c) for k in (1, 2, 3) for c in (f"lon{k}", f"lat{k}")))


@query("SELECT CAST(floor(latitude / 6) AS INT) AS cell_lat, CAST(floor(longitude / 6) AS INT) AS cell_lon, count(*) AS n_sites, round(avg(latitude), 6) AS latitude, round(avg(longitude), 6) AS longitude FROM v_sites GROUP BY 1, 2")
def q_site_clusters(spark, sf_dir):
    return raster.site_clusters(view(spark, sf_dir, "v_sites"), 5).select("cell_lat", "cell_lon", "n_sites", rounded("latitude", "latitude"), rounded("longitude", "longitude"))


# -- alerts ------------------------------------------------------------------------------------

FEED = f"WITH f AS (SELECT * FROM v_alert_feed WHERE nws_id IS NOT NULL AND effective IS NOT NULL), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nws_id ORDER BY feed_seq) AS n FROM f WHERE effective < TIMESTAMP '{CUTOFF}') WHERE n = 1)"


def feed(spark, sf_dir):
    return view(spark, sf_dir, "v_alert_feed")


def known(spark, sf_dir):
    return alerts.first_of_each(alerts.usable(feed(spark, sf_dir)).where(F.col("effective") < F.lit(CUTOFF).cast("timestamp_ntz")), "feed_seq")


@query(f"{FEED} SELECT feed_seq, nws_id, event, effective, expires FROM (SELECT *, row_number() OVER (PARTITION BY nws_id ORDER BY feed_seq) AS n FROM f WHERE nws_id NOT IN (SELECT nws_id FROM k)) WHERE n = 1")
def q_alerts_new(spark, sf_dir):
    return alerts.new_alerts(feed(spark, sf_dir), known(spark, sf_dir), "feed_seq").select("feed_seq", "nws_id", "event", "effective", "expires")


@query(f"{FEED} SELECT nws_id, event, effective, expires FROM k WHERE expires IS NOT NULL AND expires < TIMESTAMP '{NOW}'")
def q_alerts_expired(spark, sf_dir):
    return alerts.expired(known(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz")).select("nws_id", "event", "effective", "expires")


@query(f"""{FEED}, e AS (SELECT nws_id, event, effective, expires, geojson FROM k WHERE expires IS NULL OR expires >= TIMESTAMP '{NOW}'), a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nws_id ORDER BY feed_seq) AS n FROM f WHERE nws_id NOT IN (SELECT nws_id FROM e)) WHERE n = 1)
SELECT * FROM e UNION ALL SELECT nws_id, event, effective, expires, geojson FROM a""")
def q_alerts_sync(spark, sf_dir):
    return alerts.synced(known(spark, sf_dir), feed(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"), "feed_seq")


@query(f"{FEED}, s AS (SELECT DISTINCT nws_id FROM k), n AS (SELECT DISTINCT nws_id FROM v_alert_feed WHERE nws_id IS NOT NULL AND effective >= TIMESTAMP '{CUTOFF}') SELECT nws_id, CASE WHEN s.nws_id IS NULL THEN 'add' WHEN n.nws_id IS NULL THEN 'remove' ELSE 'keep' END AS action FROM s FULL JOIN n USING (nws_id)")
def q_alerts_diff(spark, sf_dir):
    return alerts.shown_diff(known(spark, sf_dir), feed(spark, sf_dir).where(F.col("effective") >= F.lit(CUTOFF).cast("timestamp_ntz")))


_COLOUR_SQL = " ".join(f"WHEN '{e}' THEN '{c}'" for e, c in alerts.EVENT_COLOURS.items())


@query(f"""SELECT event, CASE event {_COLOUR_SQL} ELSE '#999999' END AS colour,
CASE WHEN feed_seq % 4 = 0 THEN 0.38::DOUBLE WHEN feed_seq % 4 = 1 THEN 0.3::DOUBLE WHEN feed_seq % 4 = 2 THEN 0.22::DOUBLE ELSE 0.15::DOUBLE END AS opacity, count(*) AS n FROM v_alert_feed GROUP BY 1, 2, 3""")
def q_alert_style(spark, sf_dir):
    severity = F.element_at(F.array(*map(F.lit, ("Extreme", "Severe", "Moderate", "Minor"))), (F.col("feed_seq") % 4 + 1).cast("int"))
    f = feed(spark, sf_dir)
    return f.select("event", *(c.alias(n) for n, c in alerts.style(F.col("event"), severity).items())).groupBy("event", "colour", "opacity").agg(F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL 1 DAY, effective) AS window_start, event, count(*) AS n FROM v_alert_feed WHERE nws_id IS NOT NULL AND effective IS NOT NULL GROUP BY 1, 2")
def q_alert_windows(spark, sf_dir):
    f = feed(spark, sf_dir)
    return alerts.windowed_counts(f.withColumn("effective", F.col("effective").cast("timestamp"))).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


# -- binary volumes ----------------------------------------------------------------------------


def encoded_volumes(g: DataFrame) -> DataFrame:
    """Gates as one Level II file a volume: (path, content)."""
    import numpy as np
    import pyarrow as pa

    from ..sources.level2 import encode_volume

    def run(t: pa.Table) -> pa.Table:
        number = int(t["volume_id"][0].as_py())
        cut, ray, gate, vel, ref = (t[c].to_numpy() for c in ("elevation_number", "ray_idx", "gate_idx", "vel_code", "ref_code"))
        codes = np.zeros((CUTS_A_VOLUME, 120, 2, 100), np.int32)
        codes[cut % CUTS_A_VOLUME, ray, 0, gate], codes[cut % CUTS_A_VOLUME, ray, 1, gate] = vel, ref
        tilt = {int(c): (e, n) for c, e, n in zip(cut % CUTS_A_VOLUME, t["elevation_deg"].to_numpy(), t["nyquist_ms"].to_numpy(), strict=True)}
        moment = lambda name, offset, c: {"name": name, "gate_count": 100, "first_gate": 2125, "gate_spacing": 250, "word_size": 8, "scale": 2.0, "offset": offset, "codes": c}
        radials = [
            {"azimuth_deg": r * 3 + 1.5, "elevation_deg": tilt[c][0], "elevation_number": c, "collect_ms": c * 20_000 + r * 100, "nyquist_ms": tilt[c][1], "moments": [moment("VEL", 129.0, codes[c, r, 0]), moment("REF", 66.0, codes[c, r, 1])]}
            for c, r in sorted(set(zip((cut % CUTS_A_VOLUME).tolist(), ray.tolist(), strict=True)))
        ]
        return pa.table({"path": [f"KXYZ20240115_{number:06d}_V06"], "content": pa.array([encode_volume("KXYZ", 19_738, radials, per_block=30)], pa.binary())})

    return g.groupBy("volume_id").applyInArrow(run, "path string, content binary")


@query("""WITH x AS (SELECT volume_id, elevation_number % 32 AS elevation_number, elevation_deg, nyquist_ms, dense_rank() OVER (PARTITION BY elevation_number ORDER BY ray_idx) - 1 AS ray, azimuth_deg, gate_idx, range_m, vel_code, ref_code FROM v_gates)
SELECT 'KXYZ20240115_' || lpad(CAST(volume_id AS VARCHAR), 6, '0') || '_V06' AS volume_id, CAST(elevation_number AS INT) AS elevation_number, CAST(ray AS INT) AS ray_idx, azimuth_deg, moment, gate_idx, range_m, raw_code, value
FROM (SELECT *, 'VEL' AS moment, vel_code AS raw_code, (vel_code - 129) / 2.0::DOUBLE AS value FROM x UNION ALL SELECT *, 'REF', ref_code, (ref_code - 66) / 2.0::DOUBLE FROM x)""", keep=True)
def q_decode_binary(spark, sf_dir):
    from ..sources.level2 import decode_blocks, radial_gates, volume_blocks

    decoded = radial_gates(decode_blocks(volume_blocks(encoded_volumes(view(spark, sf_dir, "v_gates")))))
    return decoded.select("volume_id", "elevation_number", "ray_idx", F.col("azimuth_deg").cast("double").alias("azimuth_deg"), "moment", "gate_idx", F.col("range_m").cast("double").alias("range_m"), "raw_code", F.col("value").cast("double").alias("value"))


# -- palettes, evaluation, legacy geometry -----------------------------------------------------

_LINES = """WITH l AS (SELECT p_partkey, 'M' || (p_partkey % 3) AS moment, 'p' || (p_partkey % 40) AS name, CASE p_partkey % 5 WHEN 0 THEN 'Step: ' || (p_partkey % 7) || '  x ; note' WHEN 1 THEN 'color4:  ' || p_partkey || ' 1 2 3 ' || (p_partkey % 256) WHEN 2 THEN 'Color: ' || p_partkey || '	10 20 30 ' || (p_partkey % 256) || ' 5 6' WHEN 3 THEN '; nothing' ELSE 'color ' || p_partkey || ' 7 8 9' END AS line FROM part)"""


def palette_lines(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/part.parquet").createOrReplaceTempView("given_part")
    return spark.sql(_LINES.replace("FROM part", "FROM given_part") + " SELECT moment, name, line FROM l")


@query(f"""{_LINES}, c AS (SELECT moment, name, CAST(p_partkey AS DOUBLE) AS value, p_partkey % 5 AS k, CASE p_partkey % 5 WHEN 1 THEN 1 WHEN 2 THEN 10 ELSE 7 END AS r, CASE p_partkey % 5 WHEN 1 THEN 2 WHEN 2 THEN 20 ELSE 8 END AS g, CASE p_partkey % 5 WHEN 1 THEN 3 WHEN 2 THEN 30 ELSE 9 END AS b,
CASE WHEN p_partkey % 5 = 1 THEN CAST(p_partkey % 256 AS INT) ELSE 255 END AS a, CAST(p_partkey % 256 AS INT) AS r2, lead(CAST(p_partkey AS DOUBLE)) OVER (PARTITION BY moment, name ORDER BY p_partkey) AS nx FROM l WHERE p_partkey % 5 IN (1, 2, 4))
SELECT moment, name, value, r, g, b, a FROM c UNION ALL SELECT moment, name, (value + nx) / 2, r2, 5, 6, a FROM c WHERE k = 2 AND nx IS NOT NULL""")
def q_palette_points(spark, sf_dir):
    from ..sources import palettes

    return palettes.control_points(palette_lines(spark, sf_dir))


@query(f"{_LINES} SELECT moment, name, 'step' AS key, (p_partkey % 7) || ' x' AS value FROM l WHERE p_partkey % 5 = 0")
def q_palette_meta(spark, sf_dir):
    from ..sources import palettes

    return palettes.metadata(palette_lines(spark, sf_dir))


@query("""WITH RECURSIVE n AS MATERIALIZED (SELECT elevation_number * 100000 + ray_idx * 100 + gate_idx AS id, * FROM v_gates WHERE vel_code <> true_code),
ed AS MATERIALIZED (SELECT a.id AS x, c.id AS y FROM n a JOIN n c ON a.elevation_number = c.elevation_number AND abs(a.ray_idx - c.ray_idx) <= 1 AND abs(a.gate_idx - c.gate_idx) <= 1 AND a.id <> c.id),
lab(id, l) USING KEY (id) AS (SELECT id, id FROM n UNION SELECT ed.y, min(lab.l) FROM lab JOIN ed ON ed.x = lab.id JOIN recurring.lab AS cur ON cur.id = ed.y WHERE lab.l < cur.l GROUP BY ed.y),
c AS (SELECT elevation_number, l, count(*) AS n, max(ray_idx) - min(ray_idx) AS rays, max(gate_idx) - min(gate_idx) AS depth FROM lab JOIN n USING (id) GROUP BY 1, 2)
SELECT elevation_number, count(*) AS n_components, max(n) AS largest, count(*) FILTER (n <= 2) AS isolated, count(*) FILTER (n >= 10 AND rays <= 2 AND depth >= 20) AS spokes FROM c GROUP BY 1""")
def q_changed_components(spark, sf_dir):
    from ..operators import evaluate

    return evaluate.changed_components(gates(spark, sf_dir).withColumn("changed", F.col("vel_code") != F.col("true_code")))


@query(f"""{T}, m AS (SELECT *, CASE WHEN abs(round((t - v) / (2 * nyquist_ms))) <= 1 THEN v + round((t - v) / (2 * nyquist_ms)) * 2 * nyquist_ms ELSE v END AS b, CASE WHEN gate_idx % 7 = 0 THEN v ELSE t END AS o FROM t)
SELECT elevation_number, count(*) FILTER (abs(t - b) < 0.01) AS consensus, count(*) FILTER (abs(t - b) < 0.01 AND abs(t - v) <= 0.01 AND abs(o - v) > 0.01) AS false_positive, count(*) FILTER (abs(t - b) < 0.01 AND abs(t - v) > 0.01 AND abs(o - v) <= 0.01) AS missed,
count(*) FILTER (abs(t - b) < 0.01 AND abs(t - v) > 0.01 AND abs(o - v) > 0.01 AND abs(o - t) > 0.01) AS wrong_fold FROM m GROUP BY 1""")
def q_consensus(spark, sf_dir):
    from ..operators import evaluate

    g = _true(spark, sf_dir)
    g = g.withColumns({"b": F.coalesce(S.alias_nearest("v", "t", "nyquist_ms", 1), F.col("v")), "ours": F.when(F.col("gate_idx") % 7 == 0, F.col("v")).otherwise(F.col("t"))})
    return evaluate.consensus(g, BY, "v", "t", "b", "ours")


@query("""WITH e AS (SELECT event_id, user_id, event_type, epoch_ms(ts) // 1000 AS s FROM events), p AS (SELECT a.event_id, b.event_id AS m, b.s AS t2, abs(a.s - b.s) AS d FROM e a JOIN e b USING (user_id) WHERE a.event_type = 'error' AND b.event_type = 'click' AND abs(a.s - b.s) <= 7200),
w AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d, t2, m) AS n FROM p) SELECT e.event_id, w.m AS matched, w.t2 AS matched_time FROM e LEFT JOIN (SELECT * FROM w WHERE n = 1) w USING (event_id) WHERE event_type = 'error'""")
def q_nearest_in_time(spark, sf_dir):
    from ..operators import evaluate

    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", S.epoch_seconds("ts").alias("s"))
    return evaluate.nearest_in_time(e.where("event_type = 'error'"), e.where("event_type = 'click'"), ["user_id"], "s", "event_id", 7200, ["event_id"]).select("event_id", "matched", "matched_time")


@query("SELECT elevation_number, ray_idx, gate_idx, CAST(round_even((range_m + 125 * (gate_idx % 2) - 2125) / 250, 0) AS INT) AS rounded_gate FROM v_gates")
def q_round_gate(spark, sf_dir):
    from ..operators import evaluate

    return gates(spark, sf_dir).select(*KEY, evaluate.gate_of_range(F.col("range_m") + 125 * (F.col("gate_idx") % 2), 2125, 250).alias("rounded_gate"))


_FILL = ", ".join(f"""m{k} AS (SELECT elevation_number, px + a AS px, py + b AS py, avg(value) AS value FROM f{k - 1}, (VALUES (-1), (0), (1)) x(a), (VALUES (-1), (0), (1)) y(b) WHERE a <> 0 OR b <> 0 GROUP BY 1, 2, 3 HAVING count(*) >= 5),
f{k} AS (SELECT * FROM f{k - 1} UNION ALL SELECT m{k}.* FROM m{k} ANTI JOIN f{k - 1} USING (elevation_number, px, py))""" for k in (1, 2))


@query(f"WITH f0 AS (SELECT elevation_number, ray_idx AS px, gate_idx AS py, CAST((vel_code - 129) AS DOUBLE) AS value FROM v_gates), {_FILL} SELECT elevation_number, CAST(px AS INT) AS px, CAST(py AS INT) AS py, round(value + 1e-9, 6) + 0.0 AS value FROM f2")
def q_hole_fill(spark, sf_dir):
    from ..operators import evaluate

    cells = gates(spark, sf_dir).select(*BY, F.col("ray_idx").alias("px"), F.col("gate_idx").alias("py"), (2 * F.col("v")).alias("value"))
    return evaluate.fill_holes(cells, BY, passes=2).select(*BY, "px", "py", rounded(F.col("value") + 1e-9, "value"))


@query("""WITH r AS (SELECT DISTINCT volume_id, elevation_number, elevation_deg FROM v_gates), s AS (SELECT *, CASE WHEN abs(elevation_deg - lag(elevation_deg) OVER (PARTITION BY volume_id ORDER BY elevation_number)) >= 0.3 THEN 1 ELSE 0 END AS f FROM r) SELECT elevation_number, CAST(sum(f) OVER (PARTITION BY volume_id ORDER BY elevation_number) AS INT) AS tilt FROM s""")
def q_elevation_segments(spark, sf_dir):
    from ..operators import evaluate

    rows = gates(spark, sf_dir).select(*BY, "elevation_deg").distinct().withColumns({"seq": F.col("elevation_number")})
    return evaluate.elevation_segments(rows, ["volume_id"]).select("elevation_number", "tilt")


@query("""WITH b AS (SELECT *, radians(latitude) AS la, 400000 * sqrt(2::DOUBLE) / 6371000 AS d, radians(bearing) AS be FROM v_sites, (VALUES (45), (135), (225), (315)) t(bearing)), p AS (SELECT *, asin(sin(la) * cos(d) + cos(la) * sin(d) * cos(be)) AS t2 FROM b)
SELECT icao, bearing, round(degrees(t2), 6) AS latitude, round(longitude + degrees(atan2(sin(be) * sin(d) * cos(la), cos(d) - sin(la) * sin(t2))), 6) AS longitude FROM p""")
def q_raster_corners(spark, sf_dir):
    from ..operators import evaluate

    p = evaluate.box_points(view(spark, sf_dir, "v_sites"), ["icao"], 400_000)
    return p.select("icao", "bearing", rounded("latitude", "latitude"), rounded("longitude", "longitude"))


@query(f"{G}, n AS (SELECT *, row_number() OVER (PARTITION BY elevation_number ORDER BY ray_idx, gate_idx) - 1 AS n FROM g) SELECT elevation_number, ray_idx, gate_idx FROM n WHERE n % 5 = 0")
def q_stride_sample(spark, sf_dir):
    return wind.every_nth(gates(spark, sf_dir), BY, ["ray_idx", "gate_idx"], 5).select(*KEY)


@query(f"""WITH v AS ({_voxel_sql().replace('round(sum(wt * dbz) / sum(wt), 3) + 0.0 AS value', 'sum(wt * dbz) / sum(wt) AS value')}) SELECT volume, ix, iy, round(max(value), 3) + 0.0 AS value FROM v GROUP BY 1, 2, 3""")
def q_max_projection(spark, sf_dir):
    v = raster.voxels(gates(spark, sf_dir), ["volume_id"], "dbz", LAT0, LON0, BOX, most=VOXELS)
    return v.groupBy("volume_id", "ix", "iy").agg(F.max("value").alias("value")).select(F.col("volume_id").alias("volume"), "ix", "iy", rounded("value", "value", 3))


def _fit_sql(k: int, rows: str) -> str:
    """Sums of the weighted normal equations of a0 + a1 c + a2 s, and their solution by determinants."""
    p = [["p00", "p01", "p02"], ["p01", "p11", "p12"], ["p02", "p12", "p22"]]

    def determinant(column: int | None) -> str:
        a = [[f"q{i}" if j == column else p[i][j] for j in range(3)] for i in range(3)]
        return f"({a[0][0]} * ({a[1][1]} * {a[2][2]} - {a[1][2]} * {a[2][1]}) - {a[0][1]} * ({a[1][0]} * {a[2][2]} - {a[1][2]} * {a[2][0]}) + {a[0][2]} * ({a[1][0]} * {a[2][1]} - {a[1][1]} * {a[2][0]}))"

    sums = ", ".join(f"sum(k * {e}) AS {n}" for n, e in (("p00", "1.0::DOUBLE"), ("p01", "c"), ("p02", "s"), ("p11", "c * c"), ("p12", "c * s"), ("p22", "s * s"), ("q0", "m"), ("q1", "m * c"), ("q2", "m * s")))
    return f"s{k} AS (SELECT elevation_number, {sums} FROM {rows} GROUP BY 1), f{k} AS (SELECT elevation_number, {', '.join(f'{determinant(j)} / nullif({determinant(None)}, 0) AS a{j}' for j in range(3))} FROM s{k})"


@query(f"""{T}, ry AS (SELECT elevation_number, ray_idx, radians(min(azimuth_deg)) AS az, median(t) AS m, count(*) AS n FROM t WHERE abs(t) <= 51 GROUP BY 1, 2 HAVING count(*) >= 4), rc AS (SELECT *, cos(az) AS c, sin(az) AS s, least(1, n / 12.0::DOUBLE) AS k FROM ry), {_fit_sql(1, 'rc')},
w2 AS (SELECT rc.* EXCLUDE (k), k * CASE WHEN abs(m - a0 - a1 * c - a2 * s) <= 15 THEN 1 ELSE 15 / abs(m - a0 - a1 * c - a2 * s) END AS k FROM rc JOIN f1 USING (elevation_number)), {_fit_sql(2, 'w2')} SELECT elevation_number, round(a0, 5) + 0.0 AS a0, round(a1, 5) + 0.0 AS a1, round(a2, 5) + 0.0 AS a2 FROM f2""")
def q_robust_vad(spark, sf_dir):
    fit = wind.robust_vad(_true(spark, sf_dir).withColumns({"v": F.col("t"), "nyquist_ms": S.number(60)}), BY)
    return fit.select(*BY, *(rounded(c, c, 5) for c in ("a0", "a1", "a2")))


@query(None)
def q_wind_track(spark, sf_dir):
    g = gates(spark, sf_dir)
    return wind.wind_track(wind.top_candidates(wind.alias_scores(g, ["volume_id"], 40, 10), ["volume_id"]), ["volume_id"]).withColumn("bin", F.col("volume_id") * 1000 + F.col("bin"))


@query(None)
def q_png(spark, sf_dir):
    from ..sources import exports

    p = raster.pixels(gates(spark, sf_dir), BY, "dbz", size=64, metres=1000, beam_deg=3.0).select(*BY, "px", "py", raster.colour(F.col("value")).alias("c")).select(*BY, "px", "py", "c.*")
    return exports.png_tilts(p, BY, 64).select(*BY, F.length("png").alias("n_bytes"), F.sha2("png", 256).alias("sha256"))


# -- costs, weights, quads, vertical votes -----------------------------------------------------


@query(f"{T} SELECT elevation_number, ray_idx, gate_idx, round(greatest(1.5::DOUBLE, 0.12::DOUBLE * nyquist_ms, 0.5::DOUBLE * abs(v)), 6) AS same_tilt, round(greatest(2::DOUBLE, 0.0025::DOUBLE * range_m, 0.15::DOUBLE * nyquist_ms, 0.35::DOUBLE * abs(v)), 6) AS vertical FROM t")
def q_residual_scales(spark, sf_dir):
    # The size of the velocity stands in for the spectrum width, which the view lacks.
    g = _true(spark, sf_dir).withColumn("width", F.abs("v"))
    return g.select(*KEY, rounded(S.residual_scale("tilt", "nyquist_ms", "width"), "same_tilt"), rounded(S.residual_scale("vertical", "nyquist_ms", "width", "range_m"), "vertical"))


@query(f"""{T}, c AS (SELECT *, greatest(1.5::DOUBLE, 0.12::DOUBLE * nyquist_ms, 2.5::DOUBLE * (gate_idx % 4)) AS s, abs(t - v) AS r FROM t)
SELECT elevation_number, ray_idx, gate_idx, round((CASE WHEN r <= s THEN r * r / (2 * s) ELSE r - s / 2 END) * CASE ray_idx % 3 WHEN 2 THEN 0.45::DOUBLE WHEN 1 THEN 0.75::DOUBLE ELSE 1 END + 1e-9, 6) AS cost FROM c""")
def q_candidate_cost(spark, sf_dir):
    cost = S.candidate_cost("t", "v", "nyquist_ms", F.col("gate_idx") % 4, F.col("ray_idx") % 3)
    return _true(spark, sf_dir).select(*KEY, rounded(cost + 1e-9, "cost"))


@query(f"""{T}, c AS (SELECT *, abs(t - v) AS b, abs(t) AS s, ray_idx % 5 + 2 * (gate_idx % 3) AS p, gate_idx AS n FROM t)
SELECT elevation_number, ray_idx, gate_idx, round(least(1, greatest(0, 0.4::DOUBLE * least(1, greatest(0, (s - b) / greatest(s, 0.001::DOUBLE))) + 0.25::DOUBLE * (1 - exp(-0.35::DOUBLE * p)) + 0.2::DOUBLE * (1 - exp(-0.15::DOUBLE * greatest(1, n))) + 0.15::DOUBLE * exp(-b / greatest(1, 4 * greatest(1, p))))) + 1e-9, 6) AS confidence FROM c""")
def q_fold_confidence(spark, sf_dir):
    c = S.fold_trust(F.abs(F.col("t") - F.col("v")), F.abs("t"), F.col("ray_idx") % 5, F.col("gate_idx") % 3, "gate_idx")
    return _true(spark, sf_dir).select(*KEY, rounded(c + 1e-9, "confidence"))


@query(f"""{AZ}, e AS (SELECT az.elevation_number, az.ray_idx, az.gate_idx, abs(az.v - to_v) / az.nyquist_ms AS s, abs(az.dbz - g.dbz) AS d FROM az JOIN g ON g.elevation_number = az.elevation_number AND g.ray_idx = to_ray AND g.gate_idx = az.gate_idx)
SELECT elevation_number, ray_idx, gate_idx, round(greatest(0.05::DOUBLE, least(1, CASE WHEN s >= 0.75 THEN 0.2::DOUBLE WHEN s >= 0.55 THEN 0.5::DOUBLE ELSE 1 END * CASE WHEN d > 25 THEN 0.75::DOUBLE WHEN d < 8 THEN 1.05::DOUBLE ELSE 1 END)), 6) AS weight FROM e""")
def q_edge_weight(spark, sf_dir):
    g = gates(spark, sf_dir)
    pairs = grid.azimuth_neighbours(g).join(g.select(*BY, F.col("ray_idx").alias("to_ray"), "gate_idx", F.col("dbz").alias("to_dbz")), [*BY, "to_ray", "gate_idx"])
    return pairs.select(*KEY, rounded(S.edge_weight("v", "to_v", "nyquist_ms", None, F.col("dbz"), F.col("to_dbz")), "weight"))


def _vertex(k: int, dr: int, da: int) -> str:
    return _corner(dr, da, k).replace("round(", "(").replace(", 6) AS", ") AS")


@query(f"""WITH c AS (SELECT elevation_number, ray_idx, gate_idx, (vel_code - 129) / 2.0::DOUBLE AS value, {_vertex(0, -1, -1)}, {_vertex(1, 1, -1)}, {_vertex(2, -1, 1)}, {_vertex(3, 1, 1)} FROM v_gates),
u AS (SELECT elevation_number, ray_idx, gate_idx, value, unnest([0, 1, 2, 3, 4, 5]) AS vertex, unnest([lon0_, lon1_, lon2_, lon1_, lon3_, lon2_]) AS lo, unnest([lat0_, lat1_, lat2_, lat1_, lat3_, lat2_]) AS la FROM c)
SELECT elevation_number, ray_idx, gate_idx, value, vertex, round((lo + 180) / 360, 8) AS x, round((1 - ln(tan(radians(la) / 2 + pi() / 4)) / pi()) / 2, 8) AS y FROM u""")
def q_gpu_quads(spark, sf_dir):
    q = raster.quads(gates(spark, sf_dir), KEY, "v", LAT0, LON0)
    return q.select(*KEY, "value", "vertex", rounded("x", "x", 8), rounded("y", "y", 8))


def _best_sql(c: str) -> str:
    return f"arg_max(t, {c} * 100 - t)"


@query(f"""{LABELS}, te AS (SELECT elevation_number, avg(elevation_deg) AS d FROM r GROUP BY 1), cd AS (SELECT s, a.elevation_number, a.id, a.region, a.v, a.nyquist_ms, b.v AS nearest, row_number() OVER (PARTITION BY s, a.id ORDER BY round(abs(a.range_m * cos(radians(a.elevation_deg)) / cos(radians(te.d)) - b.range_m), 6), b.range_m) AS i
FROM r a, (VALUES (-1), (1)) q(s), te, r b WHERE te.elevation_number = a.elevation_number + s AND b.elevation_number = a.elevation_number + s AND b.ray_idx = a.ray_idx AND abs(a.range_m * cos(radians(a.elevation_deg)) / cos(radians(te.d)) - b.range_m) <= 750),
vk AS (SELECT *, CAST(round((nearest - v) / (2 * nyquist_ms)) AS INT) AS k FROM cd WHERE i = 1), vt AS (SELECT elevation_number, region, CAST(t AS INT) AS t, count(*) FILTER (k = t) AS votes, count(*) FILTER (k = t AND s = -1) AS below, count(*) FILTER (k = t AND s = 1) AS above, sum(abs(v + t * 2 * nyquist_ms - nearest)) AS cost FROM vk, range(-3, 4) x(t) GROUP BY 1, 2, 3),
vo AS (SELECT elevation_number, region, {_best_sql('votes')} AS k, max(votes) AS best_votes, CAST(sum(votes) AS BIGINT) AS n_votes, {_best_sql('below')} AS k_below, max(below) AS votes_below, CAST(sum(below) AS BIGINT) AS n_below, {_best_sql('above')} AS k_above, max(above) AS votes_above, CAST(sum(above) AS BIGINT) AS n_above,
arg_max(cost, votes * 100 - t) AS new_cost, max(cost) FILTER (t = 0) AS old_cost FROM vt GROUP BY 1, 2)
SELECT * REPLACE (round(new_cost, 4) AS new_cost, round(old_cost, 4) AS old_cost), n_votes >= 6 AND k <> 0 AND best_votes >= 0.72::DOUBLE * n_votes AND (n_below < 3 OR n_above < 3 OR (k_below = k AND k_above = k AND votes_below >= 0.65::DOUBLE * n_below AND votes_above >= 0.65::DOUBLE * n_above)) AND new_cost <= 0.45::DOUBLE * old_cost AS accepted FROM vo""")
def q_vertical_votes(spark, sf_dir):
    g = labelled(spark, sf_dir)
    tilts = volume.tilt_neighbours(volume.tilt_summary(g, BY), ["volume_id"])
    return dealias.vertical_votes(g, tilts, ["volume_id"]).withColumns({"new_cost": F.round("new_cost", 4), "old_cost": F.round("old_cost", 4)})


@query(f"{SC} SELECT DISTINCT icao, substr(\"time\", 1, 2) || ':' || substr(\"time\", 3, 2) || ':' || substr(\"time\", 5, 2) || ' UTC' AS label FROM c")
def q_clock_labels(spark, sf_dir):
    return scans(spark, sf_dir).select("icao", S.clock_label("time").alias("label")).distinct()


from . import more  # noqa: E402, F401  (registers its queries here)

from . import stages as _stages  # noqa: E402, F401  (so does this)
