"""Several volumes at once, boxes, streams of alerts, and the two ways to region edges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from galefold.operators import dealias, grid, raster
from galefold.sources.tables import view
from galefold.streaming import alerts


@pytest.fixture(scope="module")
def gates(spark):
    return grid.velocity_gates(view(spark, "/root/testdata/sf0.001", "v_gates")).withColumn("dbz", (F.col("ref_code") - 66) / 2.0).cache()


def test_two_volumes_give_what_each_gives(gates):
    """Doubled rows under another volume_id: every result stands twice, and no volume sees the other."""
    two = gates.unionByName(gates.withColumn("volume_id", F.col("volume_id") + 7))
    for f in (grid.fold_jumps, grid.azimuth_neighbours, grid.hard_gates, grid.cross_prediction, dealias.dealias, dealias.tilt_anchor):
        rows = lambda d: sorted(map(str, d.drop("volume_id").collect()))
        one, both = rows(f(gates)), rows(f(two))
        assert both == sorted(one + one), f.__name__


def test_rows_without_a_volume_are_one_volume(gates):
    rows = lambda d: sorted(map(str, d.collect()))
    assert rows(grid.fold_jumps(gates.drop("volume_id"))) == rows(grid.fold_jumps(gates).drop("volume_id"))


def test_merge_makes_tilts_smooth(gates):
    fixed = dealias.dealias(gates).join(gates.select(*grid.BY, "ray_idx", "gate_idx", "azimuth_deg", "range_m"), [*grid.BY, "ray_idx", "gate_idx"])
    before, after = (sum(r.jumps for r in f.collect()) for f in (grid.fold_jumps(gates), grid.fold_jumps(fixed, value="corrected")))
    assert after < before  # the smallest table has one gate in ten, so few neighbours


def test_edges_of_the_merge_are_those_of_region_edges(gates):
    """dealias() makes a tilt's edges by grid_edges where it labels; region_edges gives the same rows by windows."""
    named = dealias.regions(gates).where("region > 0")
    want = {(r.elevation_number, r.node_a, r.node_b): (round(r.sum_diff, 6), r.weight) for r in grid.region_edges(named).collect()}
    tilts = {}
    for r in named.collect():
        tilts.setdefault(r.elevation_number, []).append(r)
    got = {}
    for tilt, rows in tilts.items():
        shape = (max(r.ray_idx for r in rows) + 1, max(r.gate_idx for r in rows) + 1)
        label, v = np.zeros(shape, np.int64), np.zeros(shape)
        for r in rows:
            label[r.ray_idx, r.gate_idx], v[r.ray_idx, r.gate_idx] = r.region, r.v
        nyquist = min(rows, key=lambda r: (r.ray_idx, r.gate_idx)).nyquist_ms
        got |= {(tilt, a, b): (round(s, 6), w) for a, b, s, w in dealias.grid_edges(label, v, nyquist)}
    assert got == want and len(want) > 100


def test_folds_of_the_merge_agree_with_their_own_edges():
    """On a line of regions each a known number of folds off, the merge finds these numbers but for a common shift."""
    rng = random.Random(4)
    for _ in range(50):
        n = rng.randint(2, 12)
        truth = {k: rng.randint(-3, 3) for k in range(1, n + 1)}
        size = {k: rng.randint(1, 50) for k in truth}
        pairs = {(k + 1, k) for k in range(1, n)} | {tuple(sorted(rng.sample(range(1, n + 1), 2), reverse=True)) for _ in range(n)}
        edges = [(a, b, w * (truth[b] - truth[a] + rng.uniform(-0.3, 0.3)), w) for a, b in pairs for w in [2 * rng.randint(1, 40)]]
        fold = dealias.merge_regions(size, edges)
        assert len({fold[k] - truth[k] for k in truth}) == 1


@pytest.mark.parametrize("box", [(37.20, 37.06, -76.93, -77.09), (37.10, 36.86, -76.86, -77.16), (36.90, 36.80, -77.20, -77.30), (37.05, 36.95, -76.80, -76.90)])
def test_polar_box_keeps_every_gate_of_the_box(gates, box):
    from galefold.functions import scalar as S

    place = S.gate_position("range_m", "azimuth_deg", "elevation_deg", S.number(36.98), S.number(-77.01))
    inside = gates.withColumns(place).where((F.col("latitude") >= box[1]) & (F.col("latitude") < box[0]) & (F.col("longitude") >= box[3]) & (F.col("longitude") < box[2]))
    kept = gates.where(raster.in_polar_box(36.98, -77.01, box))
    key = ["elevation_number", "ray_idx", "gate_idx"]
    assert inside.select(key).subtract(kept.select(key)).count() == 0 and kept.count() <= gates.count()


def test_voxels_against_all_pairs(spark):
    rng = random.Random(8)
    rows = [(1, rng.uniform(3000, 26000), rng.uniform(0, 360), rng.uniform(0.5, 15), rng.uniform(-10, 60)) for _ in range(60)]
    gates = spark.createDataFrame(rows, "volume_id int, range_m double, azimuth_deg double, elevation_deg double, dbz double")
    got = {(r.ix, r.iy, r.iz): (r.value, r.weight) for r in raster.voxels(gates, ["volume_id"], "dbz", 36.98, -77.01, (37.10, 36.86, -76.86, -77.16), most=12, sharpness=5).collect()}
    from galefold.functions import scalar as S

    north, south, east, west = 37.10, 36.86, -76.86, -77.16
    n = raster.voxel_counts(north, south, east, west, 12)
    km = [(north - south) / n[0] * S.METRES_PER_DEGREE / 1000, (east - west) / n[1] * S.METRES_PER_DEGREE / 1000 * np.cos(np.radians((north + south) / 2)), S.VOLUME_TOP_M / 1000 / n[2]]
    want = {}
    for g in gates.withColumns(S.gate_position("range_m", "azimuth_deg", "elevation_deg", S.number(36.98), S.number(-77.01))).collect():
        if not (south <= g.latitude < north and west <= g.longitude < east and 0 <= g.height_m < S.VOLUME_TOP_M):
            continue
        c = [int(np.floor((north - g.latitude) / ((north - south) / n[0]))), int(np.floor((east - g.longitude) / ((east - west) / n[1]))), int(np.floor(g.height_m / (S.VOLUME_TOP_M / n[2])))]
        width = np.hypot(0.7, 0.065 * g.range_m / 1000)
        reach = [min(m - 1, 64, int(np.ceil(3 * width / (np.sqrt(5) * k)))) for m, k in zip(n, km)]
        cells = [range(max(0, c[a] - reach[a]), min(n[a] - 1, c[a] + reach[a]) + 1) for a in range(3)]
        for x in cells[0]:
            for y in cells[1]:
                for z in cells[2]:
                    w = np.exp(-5 * sum(((i - c[a]) * km[a]) ** 2 for a, i in enumerate((x, y, z))) / width**2)
                    s = want.setdefault((x, y, z), [0.0, 0.0])
                    s[0] += w * g.dbz
                    s[1] += w
    assert got.keys() == want.keys() and all(abs(got[k][0] - s / w) < 1e-6 and abs(got[k][1] - w) < 1e-6 for k, (s, w) in want.items())


def test_alert_table_expires_and_takes_in(spark, tmp_path):
    source, store, check = (str(tmp_path / x) for x in ("feed", "store", "checkpoint"))
    at = lambda s: f"timestamp'2024-01-{s}'"
    rows = spark.range(12).selectExpr("id as feed_seq", "concat('id', cast(id % 5 as string)) as nws_id", "'Tornado Warning' as event", f"{at('01 00:00:00')} as effective", f"case when id % 5 = 0 then {at('02 00:00:00')} when id % 5 = 1 then null else {at('09 00:00:00')} end as expires", "'{}' as geojson")
    for k, part in enumerate((rows.where("feed_seq < 6"), rows.where("feed_seq >= 6"))):
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        alerts.alert_table(stream, store, check, now=lambda k=k: F.lit(f"2024-01-0{1 + 4 * k} 00:00:00").cast("timestamp")).awaitTermination()
    first, second = (sorted(r.nws_id for r in alerts.stored_alerts(spark, store, k).collect()) for k in (0, 1))
    # id0 has expired before the second poll and comes in anew, as the feed still has it.
    assert first == ["id0", "id1", "id2", "id3", "id4"] and second == first
    assert alerts.stored_alerts(spark, store, -1) is None
