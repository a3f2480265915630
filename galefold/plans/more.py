"""More registered queries: catalogue, alerts, grid predictions, looser alignment, folds and legends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import align, dealias, evaluate, grid, raster, volume, wind
from ..operators.rounds import written
from ..sources import catalog
from ..sources.tables import view
from ..streaming import alerts
from .queries import AZ, BY, FEED, KEY, LABELS, LAT0, LON0, NOW, RAYS, SC, X0, G, T, _true, _vad_sql, cuts, encoded_volumes, feed, gates, known, labelled, query, rounded, scans

# -- catalogue ---------------------------------------------------------------------------------


@query(f"{SC} SELECT url, starts_with(url, 'https://archive.example.org/2024/01/0') OR starts_with(url, 'https://archive.example.org/2024/01/2') AS allowed FROM (SELECT CASE WHEN icao < 'KM' THEN 'https://archive.example.org/' ELSE 'https://other.example.org/' END || path AS url FROM c)")
def q_url_allowed(spark, sf_dir):
    host = F.when(F.col("icao") < "KM", "https://archive.example.org/").otherwise("https://other.example.org/")
    urls = scans(spark, sf_dir).select(F.concat(host, "path").alias("url"))
    return urls.select("url", catalog.allowed(F.col("url"), [f"https://archive.example.org/2024/01/{d}" for d in (0, 2)]).alias("allowed"))


@query(f"{SC} SELECT DISTINCT icao, '2024/01/18/' || icao || '/' AS prefix, (SELECT count(*) FROM c b WHERE b.icao = c.icao AND starts_with(b.path, '2024/01/18/')) AS n_scans FROM c")
def q_day_prefix(spark, sf_dir):
    rows = scans(spark, sf_dir).withColumn("prefix", catalog.day_prefix(F.lit(NOW).cast("timestamp"), F.col("icao"), 2))
    return rows.groupBy("icao", "prefix").agg(F.count_if(F.startswith("path", "prefix")).alias("n_scans"))


@query(f"{SC} SELECT icao, path, CAST(row_number() OVER (PARTITION BY icao ORDER BY path DESC) - 1 AS INT) AS place FROM c")
def q_list_newest(spark, sf_dir):
    return catalog.listed(scans(spark, sf_dir).select("icao", "path"), "path", ["icao"], newest_first=True)


_STATIONS = "SELECT 'K' || chr(CAST(65 + s_suppkey % 26 AS INT)) || chr(CAST(65 + (s_suppkey * 7) % 26 AS INT)) || chr(CAST(65 + (s_suppkey * 3) % 26 AS INT)) AS icao, min(s_name) AS city, CAST(min(s_suppkey) AS DOUBLE) AS latitude, CAST(-min(s_suppkey) AS DOUBLE) AS longitude FROM supplier GROUP BY 1"


@query(f"{SC}, st AS ({_STATIONS}) SELECT path, icao, city, latitude, longitude FROM c LEFT JOIN st USING (icao)")
def q_station_scans(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/supplier.parquet").createOrReplaceTempView("given_supplier")
    stations = spark.sql(_STATIONS.replace("FROM supplier", "FROM given_supplier"))
    return catalog.with_stations(scans(spark, sf_dir).select("path", "icao"), stations)


# -- tilts and volumes -------------------------------------------------------------------------


@query("""SELECT elevation_number, collected, CAST(row_number() OVER (PARTITION BY volume_id ORDER BY t NULLS LAST, elevation_number) - 1 AS INT) AS place FROM (SELECT volume_id, elevation_number, CASE WHEN elevation_number % 32 <> 3 THEN collect_ms END AS t,
CASE WHEN elevation_number % 32 <> 3 THEN strftime(TIMESTAMP '1970-01-01' + INTERVAL 18971 DAY + to_milliseconds(collect_ms), '%Y-%m-%d %H-%M-%S') ELSE 'unknown' END AS collected FROM v_cuts)""")
def q_tilts_by_time(spark, sf_dir):
    # The fourth cut's label is none, so that it comes last.
    c = volume.tilt_info(cuts(spark, sf_dir), ["volume_id"], 18972).withColumn("collected", F.when(F.col("elevation_number") % 32 != 3, F.col("collected")).otherwise("unknown"))
    return volume.by_time(c, ["volume_id"]).select("elevation_number", "collected", "place")


@query("SELECT elevation_number, CAST(greatest(0, least(elevation_number % 32 * 2 - 3, n - 1)) AS INT) AS tilt FROM (SELECT elevation_number, count(*) OVER (PARTITION BY volume_id) AS n FROM v_cuts)")
def q_tilt_clamp(spark, sf_dir):
    c = cuts(spark, sf_dir)
    n = c.groupBy("volume_id").agg(F.count("*").alias("n"))
    return c.join(n, "volume_id").select("elevation_number", S.clamped_index(F.col("elevation_number") % 32 * 2 - 3, "n").cast("int").alias("tilt"))


@query("SELECT elevation_number, elevation_deg FROM (SELECT elevation_number, CASE WHEN elevation_number % 5 = 0 THEN -1 ELSE elevation_deg END AS elevation_deg, moments FROM v_cuts) WHERE elevation_deg <> -1 AND contains(moments, 'VEL')")
def q_usable_tilts(spark, sf_dir):
    c = cuts(spark, sf_dir).withColumn("elevation_deg", F.when(F.col("elevation_number") % 5 == 0, S.number(-1)).otherwise(F.col("elevation_deg")))
    return volume.usable_tilts(c).select("elevation_number", "elevation_deg")


@query(f"{G}, n AS (SELECT elevation_number, max(nyquist_ms) AS n FROM g GROUP BY 1) SELECT a.elevation_number, abs(a.n - b.n) <= 0.03::DOUBLE * greatest(a.n, b.n) AS strict, abs(a.n - b.n) <= 0.08::DOUBLE * greatest(a.n, b.n) AS loose FROM n a JOIN n b ON b.elevation_number = a.elevation_number + 1")
def q_nyquist_compatible(spark, sf_dir):
    t = volume.tilt_neighbours(volume.tilt_summary(gates(spark, sf_dir), BY), ["volume_id"])
    other = t.select("volume_id", F.col("elevation_number").alias("above"), F.col("nyquist_ms").alias("other"))
    return t.join(other, ["volume_id", "above"]).select("elevation_number", S.compatible_nyquist("nyquist_ms", "other").alias("strict"), S.compatible_nyquist("nyquist_ms", "other", 0.08).alias("loose"))


@query("""WITH RECURSIVE r AS MATERIALIZED (SELECT elevation_number, row_number() OVER (PARTITION BY elevation_number ORDER BY ray_idx) AS i, min(elevation_deg) + ray_idx * 0.001::DOUBLE AS e FROM v_gates GROUP BY elevation_number, ray_idx),
m AS (SELECT elevation_number, i, 2 AS n, e AS mean FROM r WHERE i = 1 UNION ALL SELECT r.elevation_number, r.i, m.n + 2, (m.mean * m.n + r.e) / (m.n + 1) FROM m JOIN r ON r.elevation_number = m.elevation_number AND r.i = m.i + 1)
SELECT elevation_number, round(arg_max(mean, i), 6) AS biased_elevation_deg FROM m GROUP BY 1""")
def q_biased_elevation(spark, sf_dir):
    rays = gates(spark, sf_dir).groupBy(*BY, "ray_idx").agg((F.min("elevation_deg") + F.col("ray_idx") * S.number(0.001)).alias("elevation_deg")).withColumnRenamed("ray_idx", "seq")
    return volume.biased_mean_elevation(rays, BY).select(*BY, rounded("biased_elevation_deg", "biased_elevation_deg"))


@query("""SELECT DISTINCT 'KXYZ20240115_' || lpad(CAST(volume_id AS VARCHAR), 6, '0') || '_V06' AS volume_id, CAST(elevation_number % 32 AS INT) AS elevation_number, nyquist_ms, 36.98::DOUBLE AS lat, -77.01::DOUBLE AS lon, 212 AS vcp, count(DISTINCT ray_idx) AS n_radials FROM v_gates GROUP BY 1, 2, 3""", keep=True)
def q_radial_headers(spark, sf_dir):
    from ..sources.level2 import decode_blocks, volume_blocks

    radials = decode_blocks(volume_blocks(encoded_volumes(view(spark, sf_dir, "v_gates"))))
    place = lambda c: F.round(F.col(c).cast("double"), 4).alias(c)
    return radials.groupBy("volume_id", "elevation_number", F.col("nyquist_ms").cast("double").alias("nyquist_ms"), place("lat"), place("lon"), "vcp").agg(F.count("*").alias("n_radials"))


@query("SELECT elevation_number, ray_idx, gate_idx, (ref_code - 66) / 2.0::DOUBLE AS reflectivity FROM v_gates WHERE ref_code <> 0")
def q_moment_select(spark, sf_dir):
    coded = view(spark, sf_dir, "v_gates").select(*KEY, F.explode(F.array(*(F.struct(F.lit(m).alias("moment"), F.col(c).alias("raw_code"), S.number(2).alias("scale"), S.number(o).alias("offset")) for m, c, o in (("VEL", "vel_code", 129), ("REF", "ref_code", 66))))).alias("m")).select(*KEY, "m.*")
    return grid.decode_gates(coded).where(F.col("moment") == "REF").select(*KEY, F.col("value").cast("double").alias("reflectivity"))


# -- boxes -------------------------------------------------------------------------------------

_FAR_BOX = (37.20, 37.06, -76.93, -77.09)  # due north of the radar: its azimuths go through 0
_BOUNDS = raster.polar_box(LAT0, LON0, _FAR_BOX)


@query(f"SELECT elevation_number, ray_idx, gate_idx FROM v_gates WHERE range_m >= {_BOUNDS[0] * 0.98!r}::DOUBLE AND range_m * cos(radians(elevation_deg)) <= {_BOUNDS[1] * 1.02!r}::DOUBLE AND (azimuth_deg - {_BOUNDS[2] - 3.6!r}::DOUBLE + 720) % 360 <= {_BOUNDS[3] + 7.2!r}::DOUBLE")
def q_polar_box(spark, sf_dir):
    return gates(spark, sf_dir).where(raster.in_polar_box(LAT0, LON0, _FAR_BOX)).select(*KEY)


@query("SELECT elevation_number, ray_idx, gate_idx FROM v_gates WHERE azimuth_deg BETWEEN 30 AND 75 AND range_m BETWEEN 5000 AND 12000")
def q_window_slice(spark, sf_dir):
    return gates(spark, sf_dir).where(grid.in_window((30, 75), (5000, 12000))).select(*KEY)


@query("SELECT elevation_number, ray_idx, gate_idx FROM v_gates WHERE abs(range_m * sin(radians(azimuth_deg)) - 4000) <= 3000 AND abs(range_m * cos(radians(azimuth_deg)) + 2000) <= 5000")
def q_core_box(spark, sf_dir):
    return gates(spark, sf_dir).where(grid.in_core((4000, -2000), (3000, 5000))).select(*KEY)


@query("SELECT elevation_number, ray_idx, gate_idx, CAST(ray_idx % 24 + (gate_idx % 24) * 24 + (elevation_number % 5) * 576 AS BIGINT) AS voxel FROM v_gates")
def q_voxel_number(spark, sf_dir):
    return gates(spark, sf_dir).select(*KEY, S.voxel_number(F.col("ray_idx") % 24, F.col("gate_idx") % 24, F.col("elevation_number") % 5, 24, 24).alias("voxel"))


# -- neighbours and predictions ----------------------------------------------------------------

_JITTER = "range_m + 60 * (ray_idx % 4)"


@query(f"""{RAYS}, j AS (SELECT g.*, n_rays, {_JITTER} AS r FROM g JOIN rays USING (elevation_number)), p AS (SELECT a.elevation_number, a.ray_idx, a.gate_idx, b.ray_idx AS to_ray, b.gate_idx AS to_gate, row_number() OVER (PARTITION BY a.elevation_number, a.ray_idx, a.gate_idx ORDER BY abs(a.r - b.r), b.r) AS n
FROM j a JOIN j b ON a.elevation_number = b.elevation_number AND b.ray_idx = (a.ray_idx + 1) % a.n_rays AND abs(a.r - b.r) <= 187.5 WHERE a.n_rays >= 8 OR a.ray_idx + 1 < a.n_rays) SELECT elevation_number, ray_idx, gate_idx, to_ray, to_gate FROM p WHERE n = 1""")
def q_tolerant_neighbors(spark, sf_dir):
    # Rays begin at different ranges, so that the same gate number isn't always the nearest.
    g = gates(spark, sf_dir).withColumn("range_m", F.col("range_m") + 60 * (F.col("ray_idx") % 4))
    return grid.tolerant_neighbours(g).select(*KEY, "to_ray", "to_gate")


_CROSS = """, c1 AS (SELECT g.*, n_rays, lag(gate_idx) OVER w AS i1, lag(gate_idx, 2) OVER w AS i2, lag(gate_idx, 3) OVER w AS i3, lag(v) OVER w AS p1, lag(v, 2) OVER w AS p2, lag(v, 3) OVER w AS p3, lead(gate_idx) OVER w AS o1, lead(gate_idx, 2) OVER w AS o2, lead(v) OVER w AS q1, lead(v, 2) OVER w AS q2
FROM g JOIN rays USING (elevation_number) WINDOW w AS (PARTITION BY elevation_number, ray_idx ORDER BY gate_idx))"""


@query(f"""{RAYS}{_CROSS}, c2 AS (SELECT c1.*, a.v AS a1, b.v AS a2, d.v AS b1, e.v AS b2 FROM c1 LEFT JOIN g a ON a.elevation_number = c1.elevation_number AND a.gate_idx = c1.gate_idx AND a.ray_idx = (c1.ray_idx + 1) % n_rays LEFT JOIN g b ON b.elevation_number = c1.elevation_number AND b.gate_idx = c1.gate_idx AND b.ray_idx = (c1.ray_idx + 2) % n_rays
LEFT JOIN g d ON d.elevation_number = c1.elevation_number AND d.gate_idx = c1.gate_idx AND d.ray_idx = (c1.ray_idx + n_rays - 1) % n_rays LEFT JOIN g e ON e.elevation_number = c1.elevation_number AND e.gate_idx = c1.gate_idx AND e.ray_idx = (c1.ray_idx + n_rays - 2) % n_rays),
x AS (SELECT elevation_number, ray_idx, gate_idx, list_filter([CASE WHEN gate_idx - i1 = 1 THEN p1 + coalesce(CASE WHEN gate_idx - i2 = 2 THEN (p1 - p2) / 2 END, 0) END, CASE WHEN o1 - gate_idx = 1 THEN q1 + coalesce(CASE WHEN o2 - gate_idx = 2 THEN (q1 - q2) / 2 END, 0) END, a1 + coalesce((a1 - a2) / 2, 0), b1 + coalesce((b1 - b2) / 2, 0)], lambda z: z IS NOT NULL) AS l FROM c2)
SELECT elevation_number, ray_idx, gate_idx, round(list_median(l), 6) + 0.0 AS predicted, CAST(len(l) AS INT) AS n_directions FROM x""")
def q_cross_prediction(spark, sf_dir):
    return grid.cross_prediction(gates(spark, sf_dir)).select(*KEY, rounded("predicted", "predicted"), "n_directions")


@query(f"""{RAYS}{_CROSS} SELECT elevation_number, ray_idx, gate_idx, CASE WHEN gate_idx - i1 <> 1 THEN NULL WHEN gate_idx - i2 = 2 AND gate_idx - i3 = 3 AND abs(p1 - p2) <= 0.5 * nyquist_ms AND abs(p1 - p2 - (p2 - p3)) <= 0.2::DOUBLE * nyquist_ms THEN 2 * p1 - p2 ELSE p1 END AS reference FROM c1""")
def q_gradient_reference(spark, sf_dir):
    return grid.gradient_reference(gates(spark, sf_dir)).select(*KEY, "reference")


@query(f"{G}, m AS (SELECT elevation_number, ray_idx, median(v) AS m FROM g GROUP BY 1, 2) SELECT elevation_number, ray_idx, round(any_value(m), 6) + 0.0 AS median_v, round(median(abs(v - m)), 6) AS mad FROM g JOIN m USING (elevation_number, ray_idx) GROUP BY 1, 2")
def q_ray_mad(spark, sf_dir):
    m = grid.median_and_mad(gates(spark, sf_dir), [*BY, "ray_idx"], "v")
    return m.select(*BY, "ray_idx", rounded("median_v", "median_v"), rounded("mad", "mad"))


@query(f"""{AZ}, f AS (SELECT elevation_number, ray_idx, gate_idx, 1 AS bit FROM rg WHERE abs(to_v - v) >= 0.5 * nyquist_ms UNION ALL SELECT elevation_number, ray_idx, to_gate, 2 FROM rg WHERE abs(to_v - v) >= 0.5 * nyquist_ms UNION ALL SELECT elevation_number, ray_idx, gate_idx, 4 FROM az WHERE abs(to_v - v) >= 0.5 * nyquist_ms UNION ALL SELECT elevation_number, to_ray, gate_idx, 8 FROM az WHERE abs(to_v - v) >= 0.5 * nyquist_ms),
s AS (SELECT elevation_number, ray_idx, gate_idx, CAST(sum(bit) AS INT) AS bits FROM f GROUP BY 1, 2, 3) SELECT g.elevation_number, g.ray_idx, g.gate_idx, coalesce(bits, 0) AS bits, coalesce((bits & 3) <> 0 AND (bits & 12) <> 0, false) AS both_axes FROM g LEFT JOIN s USING (elevation_number, ray_idx, gate_idx)""")
def q_axis_bits(spark, sf_dir):
    out = grid.jump_bits(gates(spark, sf_dir), share=0.5)
    return out.select(*KEY, "bits", S.both_axes(F.col("bits")).alias("both_axes"))


# -- alignment ---------------------------------------------------------------------------------

_TILT_PAIR = f"{G}, e AS (SELECT elevation_number, avg(elevation_deg) AS d FROM g GROUP BY 1), l AS (SELECT g.* EXCLUDE (range_m), range_m * cos(radians(elevation_deg)) / cos(radians(e.d)) AS range_m FROM g JOIN e ON e.elevation_number = g.elevation_number + 1)"


def _nearest_sql(extra: str, metres: int, right: str = "g") -> str:
    return f"""{_TILT_PAIR}{extra}, c AS (SELECT a.elevation_number, a.ray_idx, a.gate_idx, a.range_m AS want, b.v AS x, b.ray_idx AS r_ray, b.gate_idx AS r_gate, row_number() OVER (PARTITION BY a.elevation_number, a.ray_idx, a.gate_idx ORDER BY round(abs(a.range_m - b.range_m), 6), b.range_m) AS n
FROM l a JOIN {right} b ON b.elevation_number = a.elevation_number + 1 AND a.ray_idx = b.ray_idx AND abs(a.range_m - b.range_m) <= {metres})"""


def _above(spark, sf_dir):
    g = written(gates(spark, sf_dir))  # read five times
    return g, volume.tilt_neighbours(volume.tilt_summary(g, BY), ["volume_id"])


@query(_nearest_sql("", 60) + " SELECT l.elevation_number, l.ray_idx, l.gate_idx, x AS above_v FROM l LEFT JOIN (SELECT * FROM c WHERE n = 1) q USING (elevation_number, ray_idx, gate_idx)")
def q_align_strict(spark, sf_dir):
    # One degree and 60 m: most gates have no partner.
    g, tilts = _above(spark, sf_dir)
    return align.vertical_lookup(g, tilts, ["volume_id"], azimuth_tolerance=1.0, range_tolerance=60).select(*KEY, F.col("nearest").alias("above_v"))


@query(_nearest_sql(", k AS (SELECT * FROM g WHERE dbz < 15)", 750, "k") + " SELECT l.elevation_number, l.ray_idx, l.gate_idx, x AS above_v FROM l LEFT JOIN (SELECT * FROM c WHERE n = 1) q USING (elevation_number, ray_idx, gate_idx)")
def q_vertical_rejecting(spark, sf_dir):
    # Gates of 15 dBZ and more stand in for hard gates, which aren't looked up.
    g, tilts = _above(spark, sf_dir)
    return align.vertical_lookup(g.withColumn("hard", F.col("dbz") >= 15), tilts, ["volume_id"], reject="hard").select(*KEY, F.col("nearest").alias("above_v"))


@query(_nearest_sql("", 750) + """, o AS (SELECT *, row_number() OVER (PARTITION BY elevation_number, ray_idx ORDER BY gate_idx) AS i FROM g), b AS (SELECT c.*, o.i FROM c JOIN o ON o.elevation_number = c.elevation_number + 1 AND o.ray_idx = r_ray AND o.gate_idx = r_gate WHERE n = 1),
m AS (SELECT b.elevation_number, b.ray_idx, b.gate_idx, median(o.v) AS m, count(*) AS n_used FROM b JOIN o ON o.elevation_number = b.elevation_number + 1 AND o.ray_idx = b.r_ray AND abs(o.i - b.i) <= 2 AND abs(o.range_m - b.want) <= 400 GROUP BY 1, 2, 3)
SELECT l.elevation_number, l.ray_idx, l.gate_idx, round(m, 6) + 0.0 AS median_v, coalesce(n_used, 0) AS n_used FROM l LEFT JOIN m USING (elevation_number, ray_idx, gate_idx)""")
def q_vertical_median(spark, sf_dir):
    g, tilts = _above(spark, sf_dir)
    return align.vertical_median(g, tilts, ["volume_id"], within=400).select(*KEY, rounded("median_v", "median_v"), "n_used")


@query("""WITH r AS (SELECT DISTINCT elevation_number, ray_idx, azimuth_deg + (elevation_number % 32) * 1.1::DOUBLE AS a FROM v_gates), p AS (SELECT x.elevation_number, x.ray_idx, y.ray_idx AS nearest_ray, row_number() OVER (PARTITION BY x.elevation_number, x.ray_idx ORDER BY round(least(abs(x.a - y.a) % 360, 360 - abs(x.a - y.a) % 360), 6), y.a) AS n
FROM r x JOIN r y ON y.elevation_number = x.elevation_number + 1 WHERE least(abs(x.a - y.a) % 360, 360 - abs(x.a - y.a) % 360) <= 5) SELECT r.elevation_number, r.ray_idx, nearest_ray FROM r LEFT JOIN (SELECT * FROM p WHERE n = 1) p USING (elevation_number, ray_idx)""")
def q_nearest_azimuth(spark, sf_dir):
    rays = gates(spark, sf_dir).select(*BY, "ray_idx", (F.col("azimuth_deg") + (F.col("elevation_number") % 32) * S.number(1.1)).alias("azimuth_deg")).distinct()
    other = rays.withColumn("elevation_number", F.col("elevation_number") - 1)
    return align.nearest_rays(rays, other, BY, 5.0).select(*BY, "ray_idx", "nearest_ray")


# -- folds -------------------------------------------------------------------------------------


@query(f"""{LABELS}, k AS (SELECT elevation_number, region, CAST(round(((true_code - 129) / 2.0::DOUBLE - v) / (2 * nyquist_ms)) AS INT) AS k, count(*) AS n FROM r GROUP BY 1, 2, 3), c AS (SELECT *, sum(n) OVER (PARTITION BY elevation_number, region ORDER BY k) AS upto, sum(n) OVER (PARTITION BY elevation_number, region) AS total FROM k)
SELECT elevation_number, region, min(k) AS folds FROM c WHERE upto > total // 2 GROUP BY 1, 2""")
def q_median_fold(spark, sf_dir):
    g = labelled(spark, sf_dir).join(_true(spark, sf_dir).select(*KEY, "t"), KEY).withColumn("folds", S.folds_between("v", "t", "nyquist_ms"))
    return dealias.median_fold(g, [*BY, "region"], "folds").select(*BY, "region", "folds")


@query(f"""{G}, m AS (SELECT elevation_number, count(*) AS n, avg(v) + (elevation_number % 3) * 20 AS m, avg(nyquist_ms) AS q FROM g GROUP BY 1), k AS (SELECT *, CAST(k AS INT) AS kk, abs(m + k * 2 * q) AS a FROM m, range(-3, 4) t(k)), b AS (SELECT *, row_number() OVER (PARTITION BY elevation_number ORDER BY round(a, 9), abs(kk), kk) AS i FROM k)
SELECT elevation_number, round(m, 6) AS mean_v, CASE WHEN n >= 40 AND kk <> 0 AND a < 0.35::DOUBLE * abs(m) AND a < 0.3::DOUBLE * q THEN kk ELSE 0 END AS shift FROM b WHERE i = 1""")
def q_tilt_anchor(spark, sf_dir):
    # Some tilts are moved by 20 and 40 m/s, so that there is something to anchor.
    g = gates(spark, sf_dir).withColumn("v", F.col("v") + (F.col("elevation_number") % 3) * 20)
    return dealias.tilt_anchor(g).select(*BY, rounded("mean_v", "mean_v"), "shift")


@query(f"{LABELS}, sz AS (SELECT elevation_number, region, count(*) AS n_gates FROM r GROUP BY 1, 2), o AS (SELECT *, CAST(row_number() OVER (PARTITION BY elevation_number ORDER BY n_gates DESC, region) AS INT) AS rank FROM sz) SELECT * FROM o WHERE rank <= 4")
def q_largest_regions(spark, sf_dir):
    return dealias.largest_regions(labelled(spark, sf_dir), most=4).select(*BY, "region", "n_gates", "rank")


@query(f"{T}, o AS (SELECT elevation_number, ray_idx, gate_idx, round(t - v, 6) AS difference, CAST(row_number() OVER (PARTITION BY elevation_number ORDER BY ray_idx, gate_idx) AS INT) AS place FROM t WHERE abs(t - v) > 0.01) SELECT * FROM o WHERE place <= 20")
def q_first_disagreements(spark, sf_dir):
    return evaluate.first_disagreements(_true(spark, sf_dir), "t", "v", most=20).select(*KEY, rounded("difference", "difference"), "place")


@query(f"{LABELS} SELECT DISTINCT elevation_number, region, CAST(round(((true_code - 129) / 2.0::DOUBLE - v) / (2 * nyquist_ms)) AS INT) AS folds FROM r")
def q_region_hints(spark, sf_dir):
    g = labelled(spark, sf_dir).join(_true(spark, sf_dir).select(*KEY, "t"), KEY)
    return g.select(*BY, "region", S.folds_between("v", "t", "nyquist_ms").alias("folds")).dropDuplicates()


@query(f"""{X0}, {_vad_sql(1)}, {_vad_sql(2)}, {_vad_sql(3)}, k AS (SELECT x0.bin, CAST(floor(azimuth_deg / 30) AS INT) AS s, count(*) AS m FROM x0 JOIN f2 USING (bin) WHERE abs(v - u * x1 - w * x2) <= 0.6::DOUBLE * nyquist_ms GROUP BY 1, 2 HAVING count(*) >= 6)
SELECT f3.bin, CAST(coalesce(any_value(b), 0) AS INT) AS sectors FROM f3 LEFT JOIN (SELECT bin, bit_or(1 << s) AS b FROM k GROUP BY 1) USING (bin) GROUP BY 1""")
def q_vad_sectors(spark, sf_dir):
    fit = wind.vad(_true(spark, sf_dir).withColumn("v", F.col("t")), ["volume_id"])
    return fit.select((F.col("volume_id") * 1000 + F.col("bin")).alias("bin"), "sectors")


# -- alerts ------------------------------------------------------------------------------------


@query("SELECT feed_seq, event FROM v_alert_feed WHERE event IN ({})".format(", ".join(f"'{e}'" for e in alerts.FEED_EVENTS)))
def q_alerts_wanted(spark, sf_dir):
    return alerts.wanted(feed(spark, sf_dir)).select("feed_seq", "event")


@query("SELECT feed_seq, '{\"type\":\"Polygon\"}' AS geometry, CASE feed_seq % 4 WHEN 0 THEN 'Extreme' WHEN 1 THEN 'Severe' WHEN 2 THEN 'Moderate' ELSE 'Minor' END AS severity FROM v_alert_feed WHERE feed_seq % 3 <> 0")
def q_alert_shapes(spark, sf_dir):
    return alerts.with_shapes(feed(spark, sf_dir)).select("feed_seq", "geometry", "severity")


@query(f"""{FEED}, e AS (SELECT nws_id FROM k WHERE expires IS NULL OR expires >= TIMESTAMP '{NOW}')
SELECT (SELECT count(*) FROM v_alert_feed) AS fetched, (SELECT count(DISTINCT nws_id) FROM f WHERE nws_id NOT IN (SELECT nws_id FROM e)) AS added, (SELECT count(*) FROM k WHERE expires < TIMESTAMP '{NOW}') AS expired""")
def q_sync_counts(spark, sf_dir):
    return alerts.sync_counts(known(spark, sf_dir), feed(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"), "feed_seq")


@query("SELECT feed_seq, coalesce(strftime(expires, '%b %-d, %H:%M'), '—') AS label FROM v_alert_feed")
def q_expiry_label(spark, sf_dir):
    return feed(spark, sf_dir).select("feed_seq", alerts.expiry_label(F.col("expires")).alias("label"))


# -- labels and legends ------------------------------------------------------------------------


@query("""SELECT elevation_number, CASE WHEN elevation_number % 32 <> 2 THEN TIMESTAMP '1970-01-01' + INTERVAL 18971 DAY + to_milliseconds(collect_ms // 1000 * 1000) END AS collected FROM v_cuts""")
def q_tilt_time(spark, sf_dir):
    c = volume.tilt_info(cuts(spark, sf_dir), ["volume_id"], 18972)
    label = F.when(F.col("elevation_number") % 32 == 2, F.concat("collected", F.lit(" UTC"))).otherwise(F.col("collected"))
    return c.select("elevation_number", S.parse_tilt_time(label).cast("timestamp_ntz").alias("collected"))


@query("""WITH p AS (SELECT p_partkey, CAST(p_partkey % 50 AS DOUBLE) AS low, CAST(p_partkey % 50 + p_partkey % 37 AS DOUBLE) AS high, (p_partkey % 9) / 4.0::DOUBLE AS step FROM part), w AS (SELECT *, (CASE WHEN step > 0 THEN step ELSE (high - low) / 5 END) AS own FROM p), x AS (SELECT *, own * greatest(1, ceil((high - low) / own / 6)) AS wide FROM w WHERE high > low),
t AS (SELECT p_partkey, step, unnest(list_concat(list_concat([low], list_filter(list_transform(range(CAST(ceil(low / wide) AS BIGINT), CAST(floor(high / wide) AS BIGINT) + 1), lambda k: k * wide), lambda z: z > low AND z < high)), [high])) AS tick FROM x UNION ALL SELECT p_partkey, step, low FROM p WHERE high <= low)
SELECT p_partkey, round(tick, 6) AS tick, CAST(CASE WHEN step > 0 AND step < 1 THEN least(3, ceil(-log10(step))) ELSE 0 END AS INT) AS digits FROM t""")
def q_legend_ticks(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    p = part.select("p_partkey", (F.col("p_partkey") % 50).cast("double").alias("low"), (F.col("p_partkey") % 50 + F.col("p_partkey") % 37).cast("double").alias("high"), ((F.col("p_partkey") % 9) / S.number(4)).alias("step"))
    return p.select("p_partkey", F.explode(S.legend_ticks(F.col("low"), F.col("high"), F.col("step"))).alias("tick"), S.legend_digits(F.col("step")).alias("digits")).withColumn("tick", F.round("tick", 6))


@query("""WITH have AS (SELECT DISTINCT 'M' || (p_partkey % 3) AS moment, 'p' || (p_partkey % 40) AS name FROM part WHERE p_partkey % 4 <> 0), want AS (SELECT p_partkey, 'M' || (p_partkey % 4) AS own, 'M' || (p_partkey % 3) AS selected, 'p' || (p_partkey % 50) AS name FROM part), f AS (SELECT moment, min(name) AS first FROM have GROUP BY 1)
SELECT p_partkey, coalesce(a.moment || '/' || a.name, b.moment || '/' || b.name, f.moment || '/' || f.first) AS palette FROM want w LEFT JOIN have a ON a.moment = w.own AND a.name = w.name LEFT JOIN have b ON b.moment = w.selected AND b.name = w.name LEFT JOIN f ON f.moment = w.selected""")
def q_palette_choice(spark, sf_dir):
    from ..sources import palettes

    part, word = spark.read.parquet(f"{sf_dir}/part.parquet"), lambda letter, n: F.concat(F.lit(letter), (F.col("p_partkey") % n).cast("string"))
    have = part.where("p_partkey % 4 <> 0").select(word("M", 3).alias("moment"), word("p", 40).alias("name")).distinct()
    want = part.select("p_partkey", F.concat_ws("/", word("M", 4), word("p", 50)).alias("wanted"), word("M", 3).alias("moment"))
    return palettes.choose(want, have).select("p_partkey", "palette")


@query("SELECT DISTINCT 'M' || (p_partkey % 3) AS moment, 'p' || (p_partkey % 40) AS name FROM part")
def q_palette_list(spark, sf_dir):
    from ..sources import palettes

    part, word = spark.read.parquet(f"{sf_dir}/part.parquet"), lambda letter, n: F.concat(F.lit(letter), (F.col("p_partkey") % n).cast("string"))
    return palettes.catalogue(part.select(F.concat(F.lit("/palettes/"), word("M", 3), F.lit("/"), word("p", 40), F.lit(".pal")).alias("path")), "path")


_KINDS = {name: sorted(points) for name, points in raster.STEP_PALETTES.items()}
_STEP_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS kind, CASE {' '.join(f'WHEN x >= {p[0]!r}::DOUBLE THEN {p[1]} * 65536 + {p[2]} * 256 + {p[3]}' for p in reversed(points))} END AS rgb FROM k WHERE kind = '{name}'" for name, points in _KINDS.items()
)


@query(f"""WITH k AS (SELECT 'reflectivity' AS kind, (ref_code - 66) / 2.0::DOUBLE AS x FROM v_gates UNION ALL SELECT 'velocity', (vel_code - 129) / 2.0::DOUBLE FROM v_gates UNION ALL SELECT 'width', gate_idx / 8.0::DOUBLE FROM v_gates UNION ALL SELECT 'correlation', ray_idx / 100.0::DOUBLE FROM v_gates UNION ALL SELECT 'decibel', gate_idx / 10.0::DOUBLE - 4 FROM v_gates), c AS ({_STEP_SQL}) SELECT kind, CAST(rgb AS INT) AS rgb, count(*) AS n FROM c GROUP BY 1, 2""")
def q_step_colours(spark, sf_dir):
    g = gates(spark, sf_dir)
    values = {"reflectivity": F.col("dbz"), "velocity": F.col("v"), "width": F.col("gate_idx") / S.number(8), "correlation": F.col("ray_idx") / S.number(100), "decibel": F.col("gate_idx") / S.number(10) - 4}
    rows = g.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), raster.step_colour(v, raster.STEP_PALETTES[k]).alias("rgb")) for k, v in values.items()))).alias("c")).select("c.*")
    return rows.groupBy("kind", "rgb").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT *, (vel_code - 129) / 2.0::DOUBLE AS v, CAST(floor(range_m * sin(radians(azimuth_deg)) / 700 + 40) AS INT) AS px, CAST(floor(40 - range_m * cos(radians(azimuth_deg)) / 700) AS INT) AS py FROM v_gates WHERE range_m > 3000)
SELECT elevation_number, px, py, round(avg(v), 6) + 0.0 AS value, count(*) AS n_gates FROM p WHERE px BETWEEN 0 AND 79 AND py BETWEEN 0 AND 79 GROUP BY 1, 2, 3""")
def q_nearest_pixels(spark, sf_dir):
    return raster.nearest_pixels(gates(spark, sf_dir), BY, "v", size=80, metres=700, least_r=3000).select(*BY, "px", "py", rounded("value", "value"), "n_gates")


@query("""SELECT icao, round(greatest(latitude + CAST(length(city) % 5 - 2 AS DOUBLE), latitude - 1 + 0.001::DOUBLE), 6) AS north, round(least(latitude + CAST(length(city) % 5 - 2 AS DOUBLE), latitude + 1 - 0.001::DOUBLE), 6) AS south FROM v_sites""")
def q_box_edits(spark, sf_dir):
    sites = view(spark, sf_dir, "v_sites")
    dragged = F.col("latitude") + (F.length("city") % 5 - 2).cast("double")
    return sites.select("icao", F.round(raster.moved_side(dragged, F.col("latitude") - 1, True), 6).alias("north"), F.round(raster.moved_side(dragged, F.col("latitude") + 1, False), 6).alias("south"))
