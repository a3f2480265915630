"""Invariants, planted truth, the binary format and the alert stream."""

import bz2
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from galefold.functions import scalar as S
from galefold.operators import dealias, grid, raster, volume
from galefold.sources import catalog, level2
from galefold.streaming import alerts


def field(spark, seed=0, nyquist=10.0, speed=25.0, holes=0.1, rays=72, n_gates=40):
    """A uniform wind folded at the Nyquist velocity, with holes; `t` is the truth."""
    rng = np.random.default_rng(seed)
    rows = []
    for r in range(rays):
        for g in range(n_gates):
            if rng.random() > holes:
                t = float(speed * np.sin(np.radians(r * 360 / rays + 2)) * (1 + 0.002 * g))
                v = float((t + nyquist) % (2 * nyquist) - nyquist)
                rows.append((1, r, g, r * 360.0 / rays, 2000.0 + 250 * g, 0.5, nyquist, v, t))
    return spark.createDataFrame(rows, "elevation_number int, ray_idx int, gate_idx int, azimuth_deg double, range_m double, elevation_deg double, nyquist_ms double, v double, t double")


@pytest.mark.parametrize("seed", [0, 1])
def test_dealias_recovers_a_planted_wind(spark, seed):
    g = field(spark, seed)
    out = dealias.dealias(g).join(g.select("ray_idx", "gate_idx", "t"), ["ray_idx", "gate_idx"]).toPandas()
    folds = (out.corrected - out.v) / 20
    assert np.allclose(folds, folds.round())
    shift = ((out.corrected - out.t) / 20).round()
    assert shift.nunique() == 1 and np.allclose(out.corrected - out.t, shift * 20, atol=1e-6)


def test_dealias_lowers_fold_jumps(spark):
    g = field(spark, 3)
    fixed = dealias.dealias(g).select("elevation_number", "ray_idx", "gate_idx", "corrected").join(g, ["elevation_number", "ray_idx", "gate_idx"])
    before = grid.fold_jumps(g).first().range_jumps + grid.azimuth_neighbours(g, most_gap=6).where("abs(to_v - v) >= 18").count()
    after = grid.fold_jumps(fixed, value="corrected").first().range_jumps + grid.azimuth_neighbours(fixed.withColumn("v", F.col("corrected")), most_gap=6).where("abs(to_v - v) >= 18").count()
    assert before > 0 and after == 0


def test_tilts_that_keep_their_values(spark):
    g = field(spark, speed=3.0)
    assert dealias.dealias(g).where("corrected <> v").count() == 0
    assert dealias.dealias(g.withColumn("nyquist_ms", F.lit(0.0))).where("corrected <> v").count() == 0
    assert dealias.dealias(g.limit(0)).count() == 0


def test_labels_and_edges_agree_with_plain_loops():
    rng = np.random.default_rng(5)
    label_in = rng.integers(-1, 3, (7, 9))
    ray, gate = np.nonzero(label_in >= 0)
    v = label_in[ray, gate] * 6.0 - 7
    got = dealias.label_regions(ray, gate, v, dealias.band_limits(v.min(), v.max(), 9.0))
    cells, seen, n = {(r, g): x for r, g, x in zip(ray, gate, v, strict=True)}, {}, 0
    for value in sorted(set(v)):
        for start in sorted(c for c, x in cells.items() if x == value):
            if start not in seen:
                n += 1
                todo = [start]
                seen[start] = n
                while todo:
                    r, g = todo.pop()
                    for c in ((r + 1, g), (r - 1, g), (r, g + 1), (r, g - 1)):
                        if cells.get(c) == value and c not in seen:
                            seen[c] = n
                            todo.append(c)
    assert got.tolist() == [seen[r, g] for r, g in zip(ray, gate, strict=True)]
    dense, values = np.zeros((7, 9), np.int64), np.zeros((7, 9))
    dense[ray, gate], values[ray, gate] = got, v
    want: dict = {}
    for r, g in cells:
        for dr, dg in ((1, 0), (-1, 0), (0, 1), (0, -1)):
            x, y = r, g
            for _ in range(101):
                x, y = (x + dr) % 7, y + dg
                if not 0 <= y < 9:
                    break
                if dense[x, y]:
                    if dense[x, y] != dense[r, g]:
                        a, b, d = (dense[r, g], dense[x, y], values[r, g] - values[x, y])
                        if a < b:
                            a, b, d = b, a, -d
                        s, w = want.get((a, b), (0.0, 0))
                        want[a, b] = (s + d / 18, w + 1)
                    break
    found = {(a, b): (round(s, 9), w) for a, b, s, w in dealias.grid_edges(dense, values, 9.0)}
    assert found == {k: (round(s, 9), w) for k, (s, w) in want.items()}


def test_merge_takes_the_heaviest_edge_first():
    # 1 and 2 differ by a fold, 3 hangs on 2 with less weight; the larger node keeps its values.
    fold = dealias.merge_regions({1: 50, 2: 10, 3: 5}, [(2, 1, -12.0, 12), (3, 2, 4.4, 4), (3, 1, 0.4, 2)])
    assert fold == {1: 0, 2: 1, 3: 0}
    assert dealias.centred({1: 1, 2: 1}, {1: 9, 2: 1}) == {1: 0, 2: 0}


def test_band_limits_extend():
    assert np.allclose(dealias.band_limits(-9, 8, 9), [-9, -3, 3, 9])
    assert np.allclose(dealias.band_limits(-9, 12, 9), [-15, -9, -3, 3, 9])
    assert np.allclose(dealias.band_limits(-10, 9, 9), [-9, -3, 3, 9, 15])


def test_geometry_round_trip(spark):
    rows = spark.createDataFrame([(float(r), float(a), e) for r in (2000, 90_000, 230_000) for a in (0.0, 45, 123.4, 359) for e in (0.5, 4.3, 19.5)], "range_m double, azimuth_deg double, elevation_deg double")
    place = rows.withColumns(S.gate_position("range_m", "azimuth_deg", "elevation_deg", S.number(36.98), S.number(-77.0)))
    back = S.position_gate("latitude", "longitude", "elevation_deg", S.number(36.98), S.number(-77.0))
    out = place.select("range_m", "azimuth_deg", "height_m", back["range_m"].alias("r"), back["azimuth_deg"].alias("a"), back["height_m"].alias("h")).toPandas()
    assert np.allclose(out.range_m, out.r, atol=0.01) and np.allclose(out.height_m, out.h, atol=0.01)
    assert np.allclose((out.azimuth_deg - out.a + 180) % 360 - 180, 0, atol=1e-6)


def moment(name, codes, word=8):
    return {"name": name, "gate_count": len(codes), "first_gate": 2125, "gate_spacing": 250, "word_size": word, "scale": 2.0, "offset": 66.0, "codes": list(codes)}


def small_volume():
    radials = []
    for k in range(10):
        number = 1 + k // 4
        vel = [0, 1, 2, 200] if k % 4 else [0, 1, 0, 1]
        radials.append({"azimuth_deg": k * 36.0, "elevation_deg": 0.5 + 0.05 * number, "elevation_number": number, "collect_ms": 1000 * k, "nyquist_ms": 26.5, "moments": [moment("VEL", vel), moment("PHI", [0, 1, 1000, 2000], 16), moment("CFP", [5, 6])]})
    return level2.encode_volume("KAKQ", 19_000, radials, per_block=6), radials


def test_level2_round_trip(spark, tmp_path):
    data, radials = small_volume()
    (tmp_path / "KAKQ20240101_000000_V06").write_bytes(data)
    (tmp_path / "empty").write_bytes(b"short")
    out = level2.read_volumes(spark, f"file://{tmp_path}").orderBy("block_idx", "seq").collect()
    assert [round(r.azimuth_deg, 3) for r in out] == [r["azimuth_deg"] for r in radials]
    assert {r.icao for r in out} == {"KAKQ"} and all(abs(r.nyquist_ms - 26.5) < 1e-3 and abs(r.lat - 36.98) < 1e-4 for r in out)
    assert [[m.name for m in r.moments] for r in out] == [["VEL", "PHI"]] * 10  # the unknown moment goes
    spark.dataSource.register(level2.Level2DataSource)
    assert spark.read.format("level2").load(str(tmp_path)).count() == 10
    gates = level2.radial_gates(level2.read_volumes(spark, f"file://{tmp_path}"))
    vel = gates.where("moment = 'VEL'").collect()
    assert {g.raw_code for g in vel} == {2, 200} and {g.range_m for g in vel} == {2625.0, 2875.0}
    assert {g.raw_code for g in gates.where("moment = 'PHI'").collect()} == {1, 1000, 2000}
    # Radials without a valid VEL gate have no ordinal.
    assert [r.ray_idx for r in gates.where("elevation_number = 1 and moment = 'VEL' and raw_code = 2").orderBy("seq").collect()] == [0, 1, 2]
    assert gates.where("moment = 'PHI' and seq = 0 and block_idx = 0 and ray_idx is not null").count() == 0


def test_level2_damage():
    data, _ = small_volume()
    icao, blocks = level2.split_blocks(data[:24] + b"\0\0\0\7garbage" + data[24:])
    assert icao == "KAKQ" and len(blocks) == 2
    assert list(level2.decode_block(blocks[0][:30])) == [] and list(level2.decode_block(b"BZh9junk")) == []
    other = b"\0" * 12 + struct.pack(">HBBHHIHH", 50, 0, 2, 0, 1, 0, 1, 1) + b"\0" * (2432 - 28)
    assert len(list(level2.decode_block(bz2.compress(other + bz2.decompress(blocks[1]))))) == 4  # a frame of another kind is stepped over


def test_catalogue(spark):
    keys = spark.createDataFrame([("2024/01/05/KAKQ/KAKQ20240105_010203_V06",), ("2024/01/05/KAKQ/KAKQ20240105_010203_V06_MDM",), ("2024/01/04/KAKQ/KAKQ20240104_235959_V06",), ("x",), (None,)], "path string")
    s = catalog.parse_scans(keys)
    assert s.count() == 2 and catalog.days(s, "KAKQ", "2024", "01").count() == 2
    assert catalog.find_scan(s, "KAKQ", "2024", "01", "05", "010203").count() == 1 and catalog.find_scan(s, "KAKQ", "2024", "01", "05", "000000").count() == 0
    assert catalog.latest_scans(s, F.lit("2024-01-06 00:00:00").cast("timestamp")).first().path.endswith("KAKQ20240105_010203_V06")
    assert catalog.latest_scans(s, F.lit("2024-01-09 00:00:00").cast("timestamp")).count() == 0
    parts = spark.range(1).select(catalog.download_ranges(F.lit(3_000_001)).alias("p")).first().p
    assert len(parts) == 6 and parts[0].first == 0 and parts[-1].last == 3_000_000 and all(a.last + 1 == b.first for a, b in zip(parts, parts[1:], strict=False))


def test_split_cut_pairs_only_the_first_two(spark):
    cuts = spark.createDataFrame([(1, n, e, m, n * 10) for n, e, m in ((1, 0.50, "REF,ZDR"), (2, 0.52, "REF,VEL"), (3, 0.54, "REF,ZDR"), (4, 1.5, "REF,VEL"))], "volume int, elevation_number int, elevation_deg double, moments string, collect_ms int")
    assert sorted((r.kept_number, r.owners) for r in volume.merged_cuts(cuts, ["volume"]).collect()) == [(1, "REF:1,VEL:2,ZDR:1"), (3, "REF:3,ZDR:3"), (4, "REF:4,VEL:4")]


def test_palette_ends_and_middle():
    p = raster.palette()
    assert len(p) == 256 and p[0][1:] == (0, 0, 0, 0) and p[-1][1:] == (255, 0, 255, 255)


def feature(nws_id, effective="2024-01-01T00:00:00Z", **more):
    return json.dumps({"properties": {"id": nws_id, "event": "Tornado Warning", "effective": effective, "expires": "", **more}, "geometry": None})


def test_alert_features(spark):
    rows = alerts.parse_features(spark.createDataFrame([(feature("a"),), (feature(None),), (feature("b", effective="soon"),)], "feature string"))
    assert rows.count() == 3 and [r.nws_id for r in alerts.usable(rows).collect()] == ["a"]
    assert rows.first().headline == "" and rows.first().expires is None


def test_alert_stream_equals_batch(spark, tmp_path):
    source, store = tmp_path / "feed", str(tmp_path / "store")
    feed = spark.createDataFrame([(k, f"id{k % 7}", "Tornado Warning", k) for k in range(20)], "feed_seq int, nws_id string, event string, m int").selectExpr("feed_seq", "nws_id", "event", "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, m) as effective")
    feed.coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(feed.schema).parquet(str(source))

    def write(rows, batch):
        rows.write.mode("overwrite").parquet(f"{store}/batch={batch}")

    alerts.alert_stream(stream, write, str(tmp_path / "checkpoint")).awaitTermination()
    got = {r.nws_id for r in spark.read.parquet(store).collect()}
    assert got == {r.nws_id for r in alerts.first_of_each(alerts.usable(feed), "feed_seq").collect()} and spark.read.parquet(store).count() == 7
