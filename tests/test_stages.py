"""Graphs in rounds, later stages and refraction against plain versions."""

import heapq
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from galefold.functions import refraction
from galefold.operators import dealias, rounds, stages

BY = ["volume_id", "elevation_number"]
GATES = "volume_id long, elevation_number int, ray_idx int, gate_idx int, azimuth_deg double, range_m double, elevation_deg double, nyquist_ms double, v double"


def tilt(number, cells, nyquist=10.0, rays=36, elevation=0.5, volume=1, spacing=250.0):
    """cells: (ray, gate) -> v."""
    return [(volume, number, r, g, r * 360.0 / rays, 2125 + spacing * g, elevation, nyquist, float(v)) for (r, g), v in sorted(cells.items())]


def plain_components(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def test_components_of_hubs_paths_and_random_graphs(spark):
    rng = random.Random(1)
    edges = {1: [(0, k) for k in range(1, 400)] + [(1000, 1000 + k) for k in range(-3, 4)], 2: [(k, k + 1) for k in rng.sample(range(300), 300)], 3: [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]}
    rows = [(t, a, b) for t, e in edges.items() for a, b in e] + [(3, None, 5), (3, 7, 7), *[(3, *edges[3][0])] * 5]
    frame = spark.createDataFrame(rows, "t int, a long, b long").repartition(3)
    got = {(r.t, r.node): r.root for r in rounds.components(frame, ["t"]).collect()}
    want = {(t, x): y for t, e in edges.items() for x, y in plain_components([p for p in e if p[0] != p[1]]).items()}
    assert got == want
    assert rounds.components(frame.where("false"), ["t"]).count() == 0


def plain_rounds(sizes, votes, most=6):
    """The rounds of solve_in_rounds for one tilt, by dictionaries."""
    home = {r: (r, 0) for r in sizes}
    e = Counter()
    for (a, b, k), w in votes.items():
        e[a, b, k] += w
    while True:
        total, by_pair = Counter(), defaultdict(list)
        for (a, b, k), w in e.items():
            if abs(k) <= most:
                total[a, b] += w
                by_pair[a, b].append((-w, abs(k), k))
        take = {}
        for (a, b), w in total.items():
            k = min(by_pair[a, b])[2]
            for x, y, own in ((a, b, k), (b, a, -k)):
                take[x] = min(take.get(x, ((math.inf,),)), ((-w, a, b), y, own))
        if not take:
            break
        n = Counter()
        for r, (c, _) in home.items():
            n[c] += sizes[r]
        stays = {x for x, (_, y, _) in take.items() if take[y][1] == x and (n[x] > n[y] or (n[x] == n[y] and x < y))}

        def follow(x):
            k = 0
            while x in take and x not in stays:
                k, x = k + take[x][2], take[x][1]
            return x, k

        home = {r: (follow(c)[0], k + follow(c)[1]) for r, (c, k) in home.items()}
        moved = Counter()
        for (a, b, k), w in e.items():
            (x, i), (y, j) = follow(a), follow(b)
            if x != y:
                k = k - i + j
                moved[(x, y, k) if x < y else (y, x, -k)] += w
        e = moved
    first = {}
    for r, (c, k) in sorted(home.items(), key=lambda kv: (-sizes[kv[0]], kv[0])):
        first.setdefault(c, k)
    return {r: (c, k - first[c]) for r, (c, k) in home.items()}


def test_solve_equals_plain_rounds_on_contradicting_votes(spark):
    rng = random.Random(3)
    sizes, votes, want = [], [], {}
    for t in range(6):
        n = 40 + t
        own = {r: rng.randint(1, 9) for r in range(n)}
        v = Counter()
        for _ in range(3 * n):
            a, b = sorted(rng.sample(range(n - 3), 2))  # the last three have no neighbour
            v[a, b, rng.randint(-7, 7)] += rng.randint(1, 3)
        sizes += [(t, r, s) for r, s in own.items()]
        votes += [(t, a, b, k, float(w)) for (a, b, k), w in v.items()]
        want |= {(t, r): x for r, x in plain_rounds(own, v).items()}
    got = rounds.solve_in_rounds(spark.createDataFrame(sizes, "t int, region long, n_gates long"), spark.createDataFrame(votes, "t int, a long, b long, k int, w double"), ["t"])
    rows = {(r.t, r.region): (r.component, r.folds) for r in got.collect()}
    # A component's number is that of the region it was merged into; the partition and the folds are compared.
    parts = lambda x: sorted(sorted(k for k, (c, _) in x.items() if (k[0], c) == p) for p in {(k[0], c) for k, (c, _) in x.items()})
    assert {k: f for k, (_, f) in rows.items()} == {k: f for k, (_, f) in want.items()} and parts(rows) == parts(want)


def test_solve_agrees_with_the_greedy_merge_where_votes_agree(spark):
    rng = random.Random(5)
    n = 60
    true, sizes = {r: rng.randint(-3, 3) for r in range(1, n)}, {r: rng.randint(1, 50) for r in range(1, n)}
    pairs = {tuple(sorted(rng.sample(range(1, n), 2))) for _ in range(150)}
    weight = dict(zip(sorted(pairs), rng.sample(range(1, 500), len(pairs)), strict=True))
    # k folds bring a to b; a region that is `true` folds too low needs as many more.
    votes = [(1, a, b, true[a] - true[b], float(w)) for (a, b), w in weight.items()]
    got = {r.region: r.folds for r in rounds.solve_in_rounds(spark.createDataFrame([(1, r, s) for r, s in sizes.items()], "t int, region long, n_gates long"), spark.createDataFrame(votes, "t int, a long, b long, k int, w double"), ["t"]).collect()}
    fold = dealias.merge_regions(sizes, [(b, a, float(w * (true[a] - true[b])), w) for (a, b), w in weight.items()])
    for a, b in pairs:
        assert got[a] - got[b] == true[a] - true[b] == fold[a] - fold[b]


def wavy(rays=36, gates=30, nyquist=10.0, tops=25.0):
    true = {(r, g): tops * math.sin(2 * math.pi * r / rays) * math.cos(g / 20) for r in range(rays) for g in range(gates)}
    folded = {k: (v + nyquist) % (2 * nyquist) - nyquist for k, v in true.items()}
    return true, folded


def test_stage_a_unfolds_a_tilt_and_joins_through_hard_gates(spark):
    true, folded = wavy(rays=120)
    rows = [(*r, False) for r in tilt(1, folded, rays=120)]
    frame = spark.createDataFrame(rows, GATES + ", hard boolean").repartition(3)
    got = rounds.stage_a(frame).collect()
    off = Counter(round((r.corrected - true[r.ray_idx, r.gate_idx]) / 20) for r in got)
    assert len(got) == len(rows) and len(off) == 1 and len({r.component for r in got}) == 1
    # A ring of hard gates cuts the tilt in two components, which touch through it; a third lies apart.
    rows = [(*r, r[3] in (10, 11, 12, 13)) for r in tilt(1, {k: 1.0 for k in folded}, rays=120) if r[3] < 20 or r[3] > 26]
    frame = spark.createDataFrame(rows, GATES + ", hard boolean")
    groups = rounds.groups_through_hard(frame, rounds.stage_a(frame)).collect()
    assert len(groups) == 3 and len({r["group"] for r in groups}) == 2


def test_stage_a_looks_for_links_twice(spark, monkeypatch):
    """Once for segments, once between regions; the repair takes the latter with their folds."""
    calls, real = [], rounds.links
    monkeypatch.setattr(rounds, "links", lambda *args, **more: (calls.append(1), real(*args, **more))[1])
    rows = [(*r, False) for r in tilt(1, wavy(rays=120)[1], rays=120)]
    frame = spark.createDataFrame(rows, GATES + ", hard boolean")
    assert rounds.stage_a(frame).count() == len(rows) and len(calls) == 2


def test_repair_moves_one_of_two_rivals(spark):
    cells = {(r, g): 0.0 for r in range(4) for g in range(6)}
    rows = [(*r, 1 if r[3] < 3 else 2, r[8] + (20.0 if r[3] >= 3 else 0.0)) for r in tilt(1, cells, rays=36)]
    got = rounds.repairs(spark.createDataFrame(rows, GATES + ", region long, corrected double")).collect()
    assert [(r.region, r["shift"]) for r in got] == [(1, 1)]


def test_growth_writes_no_table_for_a_step(spark, monkeypatch):
    tables, put = [], rounds.written
    monkeypatch.setattr(rounds, "written", lambda df: (tables.append(1), put(df))[1])
    rows = [(*r, r[3] == 0, 2) for n in (1, 2) for r in tilt(n, {(0, g): (g * 7) % 20 - 10.0 for g in range(40)})]
    got = rounds.grow(spark.createDataFrame(rows, GATES + ", seed boolean, folds int"), most_cost=1.0).collect()
    assert len(got) == 80 and all(r.cost is not None for r in got) and {r.folds for r in got if r.gate_idx == 0} == {2}
    assert all(abs(r.corrected - 30.0 - 7 * r.gate_idx) < 1e-9 for r in got) and len(tables) < 5


def test_segments_join_runs_not_gates(spark, monkeypatch):
    edges, real = [], rounds.components
    monkeypatch.setattr(rounds, "components", lambda e, by: (edges.append(e.select(*by, "a", "b").distinct().count()), real(e, by))[1])
    cells = {(r, g): 1.0 for r in range(6) for g in range(30)} | {(3, g): 9.0 for g in range(10, 20)}
    rows = [(*r, r[2] == 1 and r[3] == 5) for r in tilt(1, cells, rays=120)]
    got = {(r.ray_idx, r.gate_idx): r.region for r in rounds.segments(spark.createDataFrame(rows, GATES + ", hard boolean")).collect()}
    assert len(got) == 179 and set(got.values()) == {0, 3 * rounds.CELL + 10}
    # Rays 0, 2, 4 and 5 are one run, ray 1 two, ray 3 three.
    assert edges == [9]


def test_growth_equals_a_priority_search(spark):
    rng = random.Random(8)
    rays = 24
    cells = {(r, g): rng.choice([-9.5, -4.0, 0.0, 3.5, 8.0, 9.5]) + rng.randint(-2, 2) / 2 for r in range(rays) for g in range(25) if rng.random() < 0.8}
    seeds = {k: rng.randint(-1, 1) for k in rng.sample(sorted(cells), 3)}
    rows = [(*r, (r[2], r[3]) in seeds, seeds.get((r[2], r[3]), 0)) for r in tilt(1, cells, rays=rays)]
    got = {(r.ray_idx, r.gate_idx): (r.cost, r.folds, r.corrected) for r in rounds.grow(spark.createDataFrame(rows, GATES + ", seed boolean, folds int").repartition(3), most_gap=16.0).collect()}
    near = defaultdict(list)

    def link(a, b):
        d = abs(cells[a] - cells[b]) % 20
        s = (20 - d if d > 10 else d) / 10
        if s <= 0.6:
            step = math.floor(s * 1e6 + 0.5) + rounds.STEP
            half_away = lambda x: int(math.copysign(math.floor(abs(x) + 0.5), x))
            near[a].append((b, step, half_away((cells[a] - cells[b]) / 20)))
            near[b].append((a, step, half_away((cells[b] - cells[a]) / 20)))

    for (r, g) in cells:
        nxt = next((g + k for k in (1, 2, 3) if (r, g + k) in cells), None)
        if nxt is not None:
            link((r, g), (r, nxt))
        if ((r + 1) % rays, g) in cells:
            link((r, g), ((r + 1) % rays, g))
    number = lambda k: k[0] * rounds.CELL + k[1]
    heap, done = [(0, -1, number(k), k, f) for k, f in seeds.items()], {}
    heapq.heapify(heap)
    while heap:
        cost, via, _, k, fold = heapq.heappop(heap)
        if k in done:
            continue
        done[k] = (cost, fold)
        for to, step, more in near[k]:
            heapq.heappush(heap, (cost + step, number(k), number(to), to, fold + more))
    assert {k: (c, f) for k, (c, f, _) in got.items() if c is not None} == done
    assert all(v == cells[k] + 20 * (f or 0) for k, (_, f, v) in got.items()) and len(done) > 300


def test_votes_in_sequence_differ_from_votes_at_once(spark):
    """The second and third tilt are folded alike. At once the third has the second below it and nothing above, and stays; in sequence it follows."""
    flat = lambda v: {(r, g): v for r in range(8) for g in range(10)}
    rows = []
    for number, v in ((1, 9.0), (2, -11.0), (3, -11.0)):
        rows += [(*r, 1) for r in tilt(number, flat(v), rays=36, elevation=0.4 + 0.1 * number)]
    frame = spark.createDataFrame(rows, GATES + ", region long")
    got = {r.elevation_number: r.folds for r in stages.vertical_in_sequence(frame, ["volume_id"], side_share=0.0).select("elevation_number", "folds").distinct().collect()}
    from galefold.operators import volume

    near = volume.tilt_neighbours(volume.tilt_summary(frame, BY), ["volume_id"])
    once = {r.elevation_number: r.k if r.accepted else 0 for r in dealias.vertical_votes(frame, near, ["volume_id"], side_share=0.0).collect()}
    assert once[3] == 0
    # The second tilt's neighbours disagree (9 below, -11 above), so what decides is the order: the first moves to the second, or stays.
    assert got != {1: 0, 2: 0, 3: 0} and len(set(9.0 + 20 * got[1] if n == 1 else -11.0 + 20 * got[n] for n in (1, 2, 3))) == 1
    assert stages.vertical_in_sequence(frame.where("false"), ["volume_id"]).count() == 0


def test_rescue_looks_up_hard_gates_alone(spark, monkeypatch):
    sides, tables = [], []
    real, put = stages.align.nearest_polar, stages.written
    monkeypatch.setattr(stages.align, "nearest_polar", lambda left, *args, **more: (sides.append(left.count()), real(left, *args, **more))[1])
    monkeypatch.setattr(stages, "written", lambda df: (tables.append(df.columns), put(df))[1])
    rows = [(*r[:8], 21.0 if r[2] == r[3] else 1.0, r[2] == r[3]) for n in (1, 2, 3) for r in tilt(n, {(r, g): 1.0 for r in range(30) for g in range(20)}, rays=30, elevation=0.4 + 0.1 * n)]
    rows += [(*r, True) for r in tilt(9, {(r, 0): 1.0 for r in range(30)}, rays=30, elevation=5.0)]  # a tilt beyond its budget
    got = stages.rescue(spark.createDataFrame(rows, GATES + ", hard boolean"), ["volume_id"], most_share=0.4)
    assert {(r.elevation_number, r.ray_idx, r.folds) for r in got.collect()} == {(n, k, -1) for n in (1, 2, 3) for k in range(20)}
    # 20 hard gates of each tilt look below and above, and each side is written before the next one is looked for.
    assert sorted(sides) == [40, 60] and sum(c[-1] == "nearest" for c in tables) == 2


@pytest.mark.parametrize("share,most", [(0.5, 4096), (0.05, 4096), (0.5, 7)])
def test_rescue_keeps_its_budget(spark, share, most):
    rng = random.Random(2)
    cells = {(r, g): 1.0 for r in range(30) for g in range(20)}
    bad = {k: rng.choice([-20.0, 20.0]) for k in rng.sample(sorted(cells), 40)}
    rows = [(*r[:8], r[8] + bad.get((r[2], r[3]), 0.0), (r[2], r[3]) in bad) for r in tilt(1, cells, rays=90)]
    got = stages.rescue(spark.createDataFrame(rows, GATES + ", hard boolean").repartition(3), ["volume_id"], most_share=share, most_gates=most, vertical=False).collect()
    budget = min(most, max(1, math.floor(600 * share)))
    if 40 > 2 * budget:
        assert not got
    else:
        assert 0 < len(got) <= budget and all(r.folds * 20 == -bad[r.ray_idx, r.gate_idx] for r in got)
        assert budget < 40 or len(got) > 30


def test_a_planted_vortex_is_found_and_unfolded(spark):
    rays, vn = 360, 15.0
    xc, yc, radius, vt, vr, wind = 1200.0, 9000.0, 700.0, 36.0, 0.0, 4.0
    true = {}
    for r in list(range(20)) + list(range(350, 360)):
        a = math.radians(r)
        for g in range(16, 42):
            rng_m = (2125 + 250 * g) * math.cos(math.radians(0.5))
            dx, dy = rng_m * math.sin(a) - xc, rng_m * math.cos(a) - yc
            far = math.hypot(dx, dy)
            f = far / radius if far < radius else radius / far
            rot = f * (-dy * math.sin(a) + dx * math.cos(a)) / far if far >= 1 else 0.0
            true[r, g] = math.cos(math.radians(0.5)) * vt * rot + wind
    folded = {k: (v + vn) % (2 * vn) - vn for k, v in true.items()}
    core = lambda r, g: math.hypot((2125 + 250 * g) * math.sin(math.radians(r)) - xc, (2125 + 250 * g) * math.cos(math.radians(r)) - yc) < 900
    rows = [(*x, core(x[2], x[3])) for x in tilt(1, folded, nyquist=vn, rays=rays)]
    frame = spark.createDataFrame(rows, GATES + ", hard boolean").repartition(3)
    centres = stages.hard_clusters(frame)
    assert centres.count() == 1
    small = {"offset": [-300.0, 0.0, 300.0], "radius": [400.0, 700.0, 1100.0], "vr": [-10.0, 0.0], "vt": [6.0 * k for k in range(-8, 9)]}
    fits = rounds.written(stages.vortex_fits(frame, centres, coarse=small))
    (best,) = fits.collect()
    assert math.hypot(best.xc - xc, best.yc - yc) < 150 and abs(best.vt - vt) <= 4 and abs(best.radius - radius) <= 240 and best.score > 0.95
    moved = stages.vortex_corrections(frame, centres, fits).collect()
    changed = [r for r in moved if r.folds]
    wrong = [k for k, v in true.items() if abs(v - folded[k]) > 1 and core(*k)]
    right = sum(abs(folded[r.ray_idx, r.gate_idx] + 2 * vn * r.folds - true[r.ray_idx, r.gate_idx]) < 1 for r in changed)
    assert right == len(changed) and len(wrong) and len(changed) >= 0.8 * len(wrong)


def test_refraction_is_near_four_thirds_and_ends_at_the_ground(spark):
    tilts = spark.createDataFrame([(1, 0.5), (2, 4.0), (3, -1.0)], "t int, elevation_deg double")
    table = rounds.written(refraction.ray_tables(tilts, ["t"], 60_000, 500))
    earth = refraction.EARTH_M
    for t, e in ((1, 0.5), (2, 4.0)):
        for r in table.where(f"t = {t} and step % 40 = 0").collect():
            s, k = r.step * 500.0, 4 / 3
            height = math.sqrt(s * s + (k * earth) ** 2 + 2 * s * k * earth * math.sin(math.radians(e))) - k * earth
            arc = math.asin(s * math.cos(math.radians(e)) / (k * earth + height)) * k
            assert abs(r.height_m - height) < 15 and abs(r.arc_rad - arc) * earth < 15
    down = table.where("t = 3").orderBy("step").collect()
    assert down[-1].height_m <= 0 < len(down) < 10 and all(r.height_m > 0 for r in down[1:-1])
    gates = spark.createDataFrame([(1, 750.0), (1, 59_999.0), (1, 70_000.0)], "t int, range_m double")
    heights = [r.height_m for r in refraction.with_refraction(gates, table, ["t"], 500).orderBy("range_m").collect()]
    assert abs(heights[0] - 750 * math.sin(math.radians(0.5))) < 1 and heights[2] is None and heights[1] > 500


def test_empty_tilts(spark):
    none = spark.createDataFrame([], GATES + ", hard boolean, seed boolean, folds int, region long")
    assert rounds.stage_a(none.drop("folds", "region")).count() == 0 and rounds.grow(none).count() == 0
    assert stages.rescue(none, ["volume_id"]).count() == 0
    assert stages.vortex_fits(none, stages.hard_clusters(none)).count() == 0
    assert none.where(F.lit(True)).count() == 0


def test_descent_never_raises_the_energy_and_undoes_planted_folds(spark):
    rng = random.Random(12)
    rays = 37  # an odd ring
    cells = {(r, g): 3.0 * math.sin(2 * math.pi * r / rays) + rng.random() for r in range(rays) for g in range(15)}
    planted = {k: rng.choice([-1, 1]) for k in rng.sample(sorted(cells), 40)}
    frame = spark.createDataFrame(tilt(1, {k: v + 20 * planted.get(k, 0) for k, v in cells.items()}, rays=rays), GATES).repartition(3)
    last = math.inf
    for passes in range(4):
        out = rounds.written(stages.descend(frame, passes=passes, most_gap=12.0))
        (energy,) = (r.energy for r in stages.fold_energy(out, most_gap=12.0).collect())
        assert energy <= last + 1e-6
        last = energy
    got = {(r.ray_idx, r.gate_idx): r.folds for r in out.collect()}
    shift = Counter(f + planted.get(k, 0) for k, f in got.items())
    assert shift.most_common(1)[0][1] >= len(cells) - 2


def test_planted_couplets_chain_into_flags(spark):
    rows = []
    for number, (low, dbz, rho) in enumerate([(21.0, 45.0, 0.6), (20.0, 45.0, 0.95), (18.5, 45.0, 0.95)], 1):
        cells = {(r, g): 0.0 for r in range(0, 40) for g in range(30)}
        for g in (10, 11):
            cells[10, g], cells[11, g] = -low, low
        if number == 1:
            cells[30, 20], cells[31, 20] = -15.0, 15.0  # one tilt only
        rows += [(*r, rho if 9 < r[2] < 12 else 0.98, dbz) for r in tilt(number, cells, nyquist=30.0, rays=360, elevation=0.5 * number)]
    found = rounds.written(stages.couplets(spark.createDataFrame(rows, GATES + ", rho double, dbz double").repartition(3), least_ms=25.0))
    got = sorted((r.elevation_number, r.n_tilts, r.chain_ms, r.n_pairs, r.vortex, r.debris) for r in stages.chains(found, ["volume_id"]).collect())
    assert got == [(1, 1, 30.0, 1, False, False), (1, 3, 42.0, 2, True, True), (2, 3, 42.0, 2, True, True), (3, 3, 42.0, 2, True, True)]
    assert stages.chains(found.where("false"), ["volume_id"]).count() == 0


def plain_merge(size, edges):
    """The greedy merge without heap or live links: every step looks at all edges again and writes the graph anew."""
    edges = [list(e) for e in sorted(edges, key=lambda e: (e[1], e[0]))]  # a, b, sum of (a - b), weight; the place in this list breaks ties
    size, group, fold = dict(size), {n: [n] for n in size}, dict.fromkeys(size, 0)
    while any(e is not None for e in edges):
        at = min((k for k, e in enumerate(edges) if e is not None), key=lambda k: (-edges[k][3], k))
        a, b, s, w = edges[at]
        mean = s / w
        k = int(math.copysign(math.floor(abs(mean) + 0.5), mean)) if mean else 0
        keep, gone, k = (a, b, k) if size[a] >= size[b] else (b, a, -k)
        for r in group[gone]:
            fold[r] += k
        edges[at] = None
        for i, e in enumerate(edges):
            if e is None or gone not in e[:2]:
                continue
            x, total = (e[1], e[2]) if e[0] == gone else (e[0], -e[2])
            total += e[3] * k
            twin = next((j for j, o in enumerate(edges) if o is not None and j != i and {keep, x} == set(o[:2])), None)
            if twin is None:
                edges[i] = [keep, x, total, e[3]]
            else:
                o = edges[twin]
                own = o[2] if o[0] == keep else -o[2]
                edges[twin], edges[i] = [keep, x, own + total, o[3] + e[3]], None
        # From here on an edge of the node that stays is seen from it.
        for i, e in enumerate(edges):
            if e is not None and e[1] == keep:
                edges[i] = [e[1], e[0], -e[2], e[3]]
        group[keep] += group.pop(gone)
        size[keep] += size.pop(gone)
    total = sum(size.values())
    mean = sum(fold[r] * n for r, n in {**{r: 0 for r in fold}, **START}.items()) / total
    shift = int(math.copysign(math.floor(abs(mean) + 0.5), mean)) if mean else 0
    return {r: f - shift for r, f in fold.items()}


START: dict[int, int] = {}


def test_the_dealiaser_equals_a_plain_one_on_every_given_tilt(spark):
    """Labels by flooding, edges gate by gate, the merge anew at each step: folds of all gates of sf0.001."""
    from galefold.plans.queries import gates

    g = gates(spark, "/root/testdata/sf0.001")
    want_rows = dealias.dealias(g).select("elevation_number", "ray_idx", "gate_idx", "v", "region", "folds").collect()
    nyquist = {r.elevation_number: r.nyquist_ms for r in g.select("elevation_number", "nyquist_ms").distinct().collect()}
    tilts = defaultdict(dict)
    for r in want_rows:
        tilts[r.elevation_number][r.ray_idx, r.gate_idx] = r
    assert len(tilts) == 5
    for number, cells in tilts.items():
        vn = nyquist[number]
        limits = dealias.band_limits(min(r.v for r in cells.values()), max(r.v for r in cells.values()), vn)
        band = {k: next((i for i in range(len(limits) - 1) if limits[i] <= r.v < limits[i + 1]), -1) for k, r in cells.items()}
        label, n = {}, 0
        for b in range(len(limits) - 1):
            for k in sorted(k for k in cells if band[k] == b):
                if k in label:
                    continue
                n += 1
                label[k], stack = n, [k]
                while stack:
                    r, c = stack.pop()
                    for to in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                        if to in cells and to not in label and band[to] == b:
                            label[to] = n
                            stack.append(to)
        assert {k: label.get(k, 0) for k in cells} == {k: r.region for k, r in cells.items()}
        rays = 1 + max(k[0] for k in cells)
        by_edge = defaultdict(lambda: [0.0, 0])
        for (r, c), own in cells.items():
            if (r, c) not in label:
                continue
            out = next((s for s in range(1, 102) if (r, c + s) in label), None)
            on = next((s for s in range(1, 102) if (((r + s) % rays), c) in label and s % rays), None)
            for to in ([(r, c + out)] if out else []) + ([((r + on) % rays, c)] if on else []):
                a, b = label[r, c], label[to]
                if a != b:
                    e = by_edge[max(a, b), min(a, b)]
                    e[0] += 2 * ((own.v - cells[to].v) if a > b else (cells[to].v - own.v)) / (2 * vn)
                    e[1] += 2
        START.clear()
        START.update(Counter(label.values()))
        folds = plain_merge(START, [(a, b, s, w) for (a, b), (s, w) in by_edge.items()])
        assert {k: r.folds for k, r in cells.items()} == {k: folds[label[k]] if k in label else 0 for k in cells}, number


def test_all_stages_unfold_a_volume(spark):
    """Three tilts of a strong wind with folded specks; every gate comes out once and nearly all as they were, up to one shift a tilt."""
    rng = random.Random(21)
    rows, true = [], {}
    for number in (1, 2, 3):
        real = {(r, g): 24 * math.sin(2 * math.pi * r / 120) * (1 + g / 200) for r in range(120) for g in range(40)}
        specks = set(rng.sample(sorted(real), 60))
        true |= {(number, *k): v for k, v in real.items()}
        cells = {k: (v + 10) % 20 - 10 + (20 if k in specks else 0) for k, v in real.items()}
        rows += tilt(number, cells, rays=120, elevation=0.4 + 0.1 * number)
    frame = spark.createDataFrame(rows, GATES).repartition(3)
    small = {"coarse": {"offset": [0.0], "radius": [500.0], "vr": [0.0], "vt": [-20.0, 20.0]}, "fine": {}}
    got = stages.dealias_in_stages(frame, ["volume_id"], fits=small, rescued={"most_share": 0.2}).collect()
    assert len(got) == len(rows) and len({(r.elevation_number, r.ray_idx, r.gate_idx) for r in got}) == len(rows)
    off = Counter((r.elevation_number, round((r.corrected - true[r.elevation_number, r.ray_idx, r.gate_idx]) / 20)) for r in got)
    assert all(abs((r.corrected - r.v) / 20 - r.folds) < 1e-9 for r in got)
    assert sum(n for _, n in off.most_common(3)) >= 0.99 * len(rows)
