import itertools

import duckdb
import numpy as np
from pyspark.sql import functions as F

from galefold.operators import evaluate, raster, wind
from galefold.plans.queries import ORACLE, QUERIES
from galefold.sources import exports, palettes


def test_palette_files(spark, tmp_path):
    (tmp_path / "REF").mkdir()
    (tmp_path / "REF" / "Own.pal").write_text("; comment\nProduct: BR\nStep: 5\nRF: 1 2 3\ncolor: 10 0 0 0 100 0 0\nColor4: 20 10 20 30 128 ; end\ncolor: 40 250 0 0\n")
    lines = palettes.palette_lines(spark, f"file://{tmp_path}")
    points = palettes.control_points(lines)
    assert [tuple(r) for r in points.orderBy("value").collect()] == [("REF", "Own", 10.0, 0, 0, 0, 255), ("REF", "Own", 15.0, 100, 0, 0, 255), ("REF", "Own", 20.0, 10, 20, 30, 128), ("REF", "Own", 40.0, 250, 0, 0, 255)]
    assert {(r.key, r.value) for r in palettes.metadata(lines).collect()} == {("product", "BR"), ("step", "5"), ("rf", "1 2 3")}


def test_dense_palette_equals_the_plain_table(spark):
    points = spark.createDataFrame([("REF", "own", float(v), r, g, b, a) for v, r, g, b, a in raster.CONTROL_POINTS], "moment string, name string, value double, r int, g int, b int, a int")
    got = palettes.dense(points).orderBy("i").collect()
    assert [r.i for r in got] == list(range(256))
    assert [(r.r, r.g, r.b, r.a) for r in got] == [e[1:] for e in raster.palette()]


def test_colours_of_values(spark):
    rows = spark.createDataFrame([(-99.0,), (10.0,), (999.0,), (None,)], "x double").select(raster.colour(F.col("x")).alias("c"), raster.colour_steps(F.col("x")).alias("s")).collect()
    assert [tuple(r.c) if r.c else None for r in rows] == [(0, 0, 0, 0), (20, 40, 200, 255), (255, 0, 255, 255), None] or abs(rows[1].c.b - 200) <= 2
    assert [r.s for r in rows] == [None, 10, 70, None]


def test_wind_track_is_the_cheapest_path(spark):
    rng = np.random.default_rng(3)
    rows = [(1, b, float(rng.integers(-40, 40)), float(rng.integers(-40, 40)), float(rng.random()), k) for b in (0, 1, 3, 4) for k in (1, 2, 3)]
    got = wind.wind_track(spark.createDataFrame(rows, "volume int, bin int, u double, w double, score double, rank int"), ["volume"]).orderBy("bin").collect()
    groups = [[r for r in rows if r[1] == b] for b in (0, 1, 3, 4)]

    def cost(path):
        c = 0.05 * np.hypot(path[0][2], path[0][3])
        for own, r in zip(groups, path, strict=True):
            c += 20 * (max(x[4] for x in own) - r[4])
        return c + sum(0.5 * np.hypot(b[2] - a[2], b[3] - a[3]) / (b[1] - a[1]) for a, b in zip(path, path[1:], strict=False))

    assert [r["rank"] for r in got] == [r[5] for r in min(itertools.product(*groups), key=cost)]


def ring(spark, u, w, offset=0.0, noise=0.0):
    rng = np.random.default_rng(1)
    rows = [(1, r, g, r * 5.0, 3000.0 + 250 * g, 0.5, 30.0, float(offset + u * np.sin(np.radians(r * 5)) + w * np.cos(np.radians(r * 5)) + noise * rng.standard_normal())) for r in range(72) for g in range(20)]
    return spark.createDataFrame(rows, "elevation_number int, ray_idx int, gate_idx int, azimuth_deg double, range_m double, elevation_deg double, nyquist_ms double, v double")


def test_planted_winds_are_found(spark):
    g = ring(spark, 12.0, -5.0, noise=0.5)
    for r in wind.vad(g, ["elevation_number"]).collect():
        assert abs(r.u - 12) < 0.6 and abs(r.w + 5) < 0.6 and r.spread > 0.9
    (fit,) = wind.robust_vad(ring(spark, 12.0, -5.0, offset=2.0), ["elevation_number"]).collect()
    assert np.allclose([fit.a0, fit.a1, fit.a2], [2, -5, 12], atol=0.2)
    best = wind.best_alias_wind(wind.alias_scores(ring(spark, 10.0, -20.0), ["elevation_number"], 30, 10), ["elevation_number"]).first()
    assert (best.iu, best.iw) == (1, -2)
    balance = wind.sector_balance(ring(spark, 12.0, -5.0, offset=60.0), sectors=12).first()
    assert balance.folds == -1


def test_single_gaps(spark):
    rows = spark.createDataFrame([(1, 0, 1.0, 1.0), (1, 2, 3.0, 5.0), (1, 5, 0.0, 0.0)], "volume int, bin int, u double, w double")
    assert [(r.bin, r.u, r.filled) for r in wind.fill_single_gaps(rows, ["volume"]).orderBy("bin").collect()] == [(0, 1.0, False), (1, 2.0, True), (2, 3.0, False), (5, 0.0, False)]


def test_gate_csv_and_stations(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5, 10, 0, 1.5, 2125.0, 12.0, -3.5, 20.5)], exports.GATE_CSV)
    exports.write_gate_csv(rows, f"file://{tmp_path}/csv")
    assert exports.read_gate_csv(spark, f"file://{tmp_path}/csv").collect() == rows.collect()
    (tmp_path / "sites.json").write_text('[{"city": "Wakefield", "icao": "KAKQ", "latitude": 36.98, "longitude": -77.0}]')
    assert exports.read_stations(spark, f"file://{tmp_path}/sites.json").first().icao == "KAKQ"


def test_png_and_points(spark):
    rows = spark.createDataFrame([(1, 2, 3, 255, 0, 0, 255)], "elevation_number int, px int, py int, r int, g int, b int, a int")
    assert exports.png_tilts(rows, ["elevation_number"], 8).first().png[:4] == b"\x89PNG"
    p = exports.synthetic_points(spark, 500, 37.0, -77.0, 100, 60).toPandas()
    assert len(p) == 500 and p.intensity.between(0, 60).all() and (abs(p.latitude - 37) < 0.91).all()


def test_nearest_in_time_ties_take_the_earlier(spark):
    a = spark.createDataFrame([(1, "k", 100), (2, "k", 5000)], "id int, u string, s long")
    b = spark.createDataFrame([("x", "k", 90), ("y", "k", 110), ("z", "k", 9999)], "m string, u string, s long")
    got = {r.id: r.matched for r in evaluate.nearest_in_time(a, b, ["u"], "s", "m", 50, ["id"]).collect()}
    assert got == {1: "x", 2: None}


def test_nearest_in_time_rounds_to_milliseconds(spark, tmp_path):
    times = ["2024-01-23 22:13:26.9994", "2024-01-23 22:13:26.9995", "2024-01-23 22:13:27.2", "1969-12-31 23:59:59.4", "1969-12-31 23:59:58.9996", "1969-12-31 23:59:57.9"]
    rows = ", ".join(f"({2 * k + n}::BIGINT, {k}::BIGINT, TIMESTAMP '{t}', '{e}')" for k, t in enumerate(times) for n, e in enumerate(("error", "click")))
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM (VALUES {rows}) e(event_id, user_id, ts, event_type)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = QUERIES["q_nearest_in_time"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(ORACLE["q_nearest_in_time"]).fetchall())
    assert sorted(r.matched_time for r in got) == [-2, -1, 0, 1706048006, 1706048007, 1706048007]


def test_holes_need_five_neighbours(spark):
    ringed = [(0, x, y, 8.0) for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    out = evaluate.fill_holes(spark.createDataFrame(ringed, "t int, px int, py int, value double"), ["t"], passes=2)
    assert out.count() == 9 and out.where("px = 1 and py = 1").first().value == 8.0
