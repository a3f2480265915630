"""Registered queries of the later dealiasing stages, graphs in rounds, vortices and refraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import refraction
from ..functions import scalar as S
from ..operators import grid, rounds, stages
from .queries import BY, FAR, KEY, LABELS, G, gates, labelled, query, rounded

#: Gates with `hard`, their cells, and links that bridge two missing gates, both ways.
#: The views' velocities jump little, so a gate is hard from HARD Vn on.
HARD, SEED_GATES = 0.12, 10
_HARD = FAR.replace("WITH g AS", "WITH RECURSIVE g AS", 1).replace("far >= 0.5", f"far >= {HARD}::DOUBLE") + """,
hd AS MATERIALIZED (SELECT sd.*, sd.ray_idx * 1048576 + sd.gate_idx AS cell, (CASE WHEN share <= 0.1 THEN gr.ray_idx IS NOT NULL ELSE seed END) AND dbz >= 25 AS hard FROM sd JOIN ts USING (elevation_number) LEFT JOIN gr ON sd.elevation_number = gr.elevation_number AND sd.ray_idx = gr.ray_idx AND sd.gate_idx = gr.gate_idx),
lk AS MATERIALIZED (SELECT elevation_number AS t, cell AS ac, bc, v AS va, vb, hard AS ha, hb, nyquist_ms AS vn, 0 AS d FROM (SELECT *, lead(cell) OVER w AS bc, lead(v) OVER w AS vb, lead(hard) OVER w AS hb, lead(range_m) OVER w - range_m AS dr FROM hd WINDOW w AS (PARTITION BY elevation_number, ray_idx ORDER BY gate_idx)) WHERE dr > 125 AND dr <= 3.05::DOUBLE * 250
  UNION ALL SELECT a.elevation_number, a.cell, b.cell, a.v, b.v, a.hard, b.hard, a.nyquist_ms, 2 FROM az JOIN hd a ON a.elevation_number = az.elevation_number AND a.ray_idx = az.ray_idx AND a.gate_idx = az.gate_idx JOIN hd b ON b.elevation_number = az.elevation_number AND b.ray_idx = az.to_ray AND b.gate_idx = az.gate_idx),
lb AS MATERIALIZED (SELECT * FROM lk UNION ALL SELECT t, bc, ac, vb, va, hb, ha, vn, d + 1 FROM lk)"""
_ID = 1 << 40  # a tilt's number times this and a cell are one id
_SEGMENTS = f"""{_HARD}, ed AS MATERIALIZED (SELECT t * {_ID} + ac AS x, t * {_ID} + bc AS y FROM lb WHERE NOT ha AND NOT hb AND abs(va - vb) <= 0.2::DOUBLE * vn),
nd AS MATERIALIZED (SELECT elevation_number * {_ID} + cell AS id, * FROM hd WHERE NOT hard),
lab(id, l) USING KEY (id) AS (SELECT id, id FROM nd UNION SELECT ed.y, min(lab.l) FROM lab JOIN ed ON ed.x = lab.id JOIN recurring.lab AS cur ON cur.id = ed.y WHERE lab.l < cur.l GROUP BY ed.y),
sg AS MATERIALIZED (SELECT nd.*, l % {_ID} AS region FROM nd JOIN lab USING (id))"""
ROUNDS = 9


def _solve_sql() -> str:
    """ROUNDS rounds of merging, written out one after the other."""
    out = [_SEGMENTS, """e0 AS MATERIALIZED (SELECT t, least(a.region, b.region) AS a, greatest(a.region, b.region) AS b, (CASE WHEN a.region > b.region THEN -1 ELSE 1 END) * CAST(round((vb - va) / (2 * vn)) AS INT) AS k, CAST(count(*) AS DOUBLE) AS w FROM lk
JOIN sg a ON a.elevation_number = t AND a.cell = ac JOIN sg b ON b.elevation_number = t AND b.cell = bc WHERE a.region <> b.region GROUP BY ALL)""",
           "f0 AS MATERIALIZED (SELECT elevation_number AS t, region, region AS c, 0 AS k, count(*) AS n FROM sg GROUP BY ALL)"]
    for r in range(ROUNDS):
        out += [
            f"p{r} AS (SELECT t, a, b, sum(w) AS total, arg_min(k, (-w, abs(k), k)) AS k FROM e{r} WHERE abs(k) <= 6 GROUP BY t, a, b)",
            f"h{r} AS MATERIALIZED (SELECT t, x, y, k FROM (SELECT t, a, b, total, a AS x, b AS y, k FROM p{r} UNION ALL SELECT t, a, b, total, b, a, -k FROM p{r}) QUALIFY row_number() OVER (PARTITION BY t, x ORDER BY total DESC, a, b) = 1)",
            f"n{r} AS (SELECT t, c AS x, sum(n) AS n FROM f{r} GROUP BY t, c)",
            f"m{r} AS MATERIALIZED (SELECT h.*, z.x IS NOT NULL AND (n1.n > n2.n OR (n1.n = n2.n AND h.x < h.y)) AS stays FROM h{r} h LEFT JOIN h{r} z ON z.t = h.t AND z.x = h.y AND z.y = h.x JOIN n{r} n1 ON n1.t = h.t AND n1.x = h.x JOIN n{r} n2 ON n2.t = h.t AND n2.x = h.y)",
            f"q{r}(t, x, root, k) AS (SELECT t, x, x, 0 FROM m{r} WHERE stays UNION ALL SELECT m.t, m.x, q.root, m.k + q.k FROM m{r} m JOIN q{r} q ON q.t = m.t AND q.x = m.y WHERE NOT m.stays)",
            f"f{r + 1} AS MATERIALIZED (SELECT f.t, f.region, coalesce(q.root, f.c) AS c, f.k + coalesce(q.k, 0) AS k, f.n FROM f{r} f LEFT JOIN q{r} q ON q.t = f.t AND q.x = f.c)",
            f"i{r} AS (SELECT e.t, coalesce(x.root, a) AS a, coalesce(y.root, b) AS b, e.k - coalesce(x.k, 0) + coalesce(y.k, 0) AS k, w FROM e{r} e LEFT JOIN q{r} x ON x.t = e.t AND x.x = a LEFT JOIN q{r} y ON y.t = e.t AND y.x = b)",
            f"e{r + 1} AS MATERIALIZED (SELECT t, least(i.a, i.b) AS a, greatest(i.a, i.b) AS b, (CASE WHEN i.a > i.b THEN -1 ELSE 1 END) * i.k AS k, sum(w) AS w FROM i{r} i WHERE i.a <> i.b GROUP BY ALL)",
        ]
    out.append(f"so AS MATERIALIZED (SELECT t, region, c, CAST(k - first_value(k) OVER (PARTITION BY t, c ORDER BY n DESC, region) AS INT) AS folds FROM f{ROUNDS})")
    return ",\n".join(out)


_SOLVE = _solve_sql()
_REPAIR = f"""{_SOLVE}, st AS MATERIALIZED (SELECT sg.*, c, folds, v + folds * 2 * nyquist_ms AS cv FROM sg JOIN so ON so.t = sg.elevation_number AND so.region = sg.region),
ps AS MATERIALIZED (SELECT lb.t, a.region, b.region AS other, a.cv - b.cv AS d, 2 * vn AS p FROM lb JOIN st a ON a.elevation_number = t AND a.cell = ac JOIN st b ON b.elevation_number = t AND b.cell = bc WHERE a.region <> b.region),
sm AS (SELECT t, region, count(*) AS n, sum(abs(d)) AS e0, sum(abs(d - p)) AS em, sum(abs(d + p)) AS ep, count(*) FILTER (abs(d - p) < 0.75 * abs(d)) AS sm, count(*) FILTER (abs(d + p) < 0.75 * abs(d)) AS sp FROM ps GROUP BY t, region),
aq AS MATERIALIZED (SELECT t, region, CASE WHEN sm >= 2 AND em < 0.8::DOUBLE * e0 AND em < ep THEN -1 WHEN sp >= 2 AND ep < 0.8::DOUBLE * e0 AND ep < em THEN 1 END AS shift, round(e0 - least(em, ep), 6) AS gain FROM sm WHERE n >= 2 AND shift IS NOT NULL),
be AS (SELECT DISTINCT a.t, a.region FROM ps JOIN aq a ON a.t = ps.t AND a.region = ps.region JOIN aq b ON b.t = ps.t AND b.region = ps.other WHERE b.gain > a.gain OR (b.gain = a.gain AND b.region < a.region)),
fin AS MATERIALIZED (SELECT st.* REPLACE (CAST(folds + coalesce(shift, 0) AS INT) AS folds) FROM st LEFT JOIN (SELECT * FROM aq ANTI JOIN be ON be.t = aq.t AND be.region = aq.region) m ON m.t = st.elevation_number AND m.region = st.region)"""


def _hard(spark, sf_dir, *more):
    return grid.hard_gates(gates(spark, sf_dir), share=HARD).select(*KEY, "v", "nyquist_ms", "range_m", "azimuth_deg", "elevation_deg", "dbz", "hard", *more)


@query(f"{_SEGMENTS} SELECT elevation_number, ray_idx, gate_idx, region FROM sg")
def q_segments(spark, sf_dir):
    return rounds.segments(_hard(spark, sf_dir)).select(*KEY, "region")


@query(f"{_REPAIR} SELECT elevation_number, ray_idx, gate_idx, region, c AS component, folds, v + folds * 2 * nyquist_ms AS corrected FROM fin")
def q_region_solve(spark, sf_dir):
    """The region solve of a tilt: segments, votes, rounds of merging and a repair."""
    return rounds.stage_a(_hard(spark, sf_dir)).select(*KEY, "region", "component", "folds", "corrected")


_JUMPS_AFTER = """, oj AS (SELECT a.elevation_number AS t, b.v - a.v AS d0, (b.v + b.folds * 2 * b.nyquist_ms) - (a.v + a.folds * 2 * a.nyquist_ms) AS d1, 0.9::DOUBLE * 2 * a.nyquist_ms AS most FROM rg JOIN fin a ON a.elevation_number = rg.elevation_number AND a.ray_idx = rg.ray_idx AND a.gate_idx = rg.gate_idx JOIN fin b ON b.elevation_number = rg.elevation_number AND b.ray_idx = rg.ray_idx AND b.gate_idx = rg.to_gate
  UNION ALL SELECT a.elevation_number, b.v - a.v, (b.v + b.folds * 2 * b.nyquist_ms) - (a.v + a.folds * 2 * a.nyquist_ms), 0.9::DOUBLE * 2 * a.nyquist_ms FROM az JOIN fin a ON a.elevation_number = az.elevation_number AND a.ray_idx = az.ray_idx AND a.gate_idx = az.gate_idx JOIN fin b ON b.elevation_number = az.elevation_number AND b.ray_idx = az.to_ray AND b.gate_idx = az.gate_idx)
SELECT n.t AS elevation_number, count(*) FILTER (abs(d0) >= most) AS jumps_before, count(*) FILTER (abs(d1) >= most) AS jumps_after FROM (SELECT DISTINCT elevation_number AS t FROM fin) n LEFT JOIN oj USING (t) GROUP BY n.t"""


@query(_REPAIR + _JUMPS_AFTER)
def q_region_solve_jumps(spark, sf_dir):
    """Fold jumps between gates that aren't hard, before and after the region solve."""
    hard = rounds.written(_hard(spark, sf_dir))
    solved = rounds.written(rounds.stage_a(hard))
    n = solved.groupBy(*BY).agg((F.max("ray_idx") + 1).alias("n"))
    # The ring's size is that of all gates; where the last rays have only hard gates, the ring stays open.
    whole = hard.groupBy(*BY).agg((F.max("ray_idx") + 1).alias("all"))
    # A link's ends carry both velocities; hard gates have none, and only keep others apart.
    both = hard.drop("v").join(solved.select(*KEY, F.struct("v", "corrected").alias("v")), KEY, "left")
    pairs = rounds.links(both, bridge=1.0004).where("a.v is not null and b.v is not null")
    most = 0.9 * 2 * F.col("a.nyquist_ms")
    jump = lambda c: F.count_if(F.abs(F.col(f"b.v.{c}") - F.col(f"a.v.{c}")) >= most)
    counts = pairs.groupBy(*BY).agg(jump("v").alias("jumps_before"), jump("corrected").alias("jumps_after"))
    return n.join(whole, BY).join(counts, BY, "left").na.fill(0).select(*BY, "jumps_before", "jumps_after")


@query(f"""{_REPAIR}, te AS MATERIALIZED (SELECT lb.t, CASE WHEN ha THEN ac * 2 + 1 ELSE x.c * 2 END AS x, CASE WHEN hb THEN bc * 2 + 1 ELSE y.c * 2 END AS y FROM lb LEFT JOIN fin x ON x.elevation_number = t AND x.cell = ac LEFT JOIN fin y ON y.elevation_number = t AND y.cell = bc WHERE ha OR hb),
tn AS MATERIALIZED (SELECT DISTINCT t * {_ID} + x AS id, t, x FROM te), ti AS MATERIALIZED (SELECT DISTINCT t * {_ID} + x AS x, t * {_ID} + y AS y FROM te),
tl(id, l) USING KEY (id) AS (SELECT id, id FROM tn UNION SELECT ti.y, min(tl.l) FROM tl JOIN ti ON ti.x = tl.id JOIN recurring.tl AS cur ON cur.id = ti.y WHERE tl.l < cur.l GROUP BY ti.y),
tg AS (SELECT t, x // 2 AS c, min(x // 2) OVER (PARTITION BY t, l) AS g FROM tn JOIN tl USING (id) WHERE x % 2 = 0)
SELECT elevation_number, n.c AS component, coalesce(g, n.c) AS "group" FROM (SELECT DISTINCT elevation_number, c FROM fin) n LEFT JOIN tg ON tg.t = n.elevation_number AND tg.c = n.c""")
def q_hard_groups(spark, sf_dir):
    """Components that touch through hard gates."""
    hard = rounds.written(_hard(spark, sf_dir))
    return rounds.groups_through_hard(hard, rounds.written(rounds.stage_a(hard)))


@query(f"""{_SEGMENTS}, sz AS (SELECT elevation_number AS t, region, count(*) AS n FROM sg GROUP BY ALL), top AS (SELECT t, region FROM sz WHERE n >= {SEED_GATES}),
sp AS MATERIALIZED (SELECT t * {_ID} + ac AS x, t * {_ID} + bc AS y, least(abs(va - vb) % (2 * vn), 2 * vn - abs(va - vb) % (2 * vn)) / vn AS s, CAST(round((va - vb) / (2 * vn)) AS INT) AS k FROM lb),
sq AS MATERIALIZED (SELECT x, y, k, CAST(floor(s * 1000000 + 0.5) AS BIGINT) + 1000 AS step FROM sp WHERE s <= 0.6::DOUBLE),
gw(id, o) USING KEY (id) AS (SELECT sg.id, {{'cost': 0::BIGINT, 'via': -1::BIGINT, 'folds': 0}} FROM sg JOIN top ON top.t = sg.elevation_number AND top.region = sg.region
  UNION SELECT n.id, n.o FROM (SELECT sq.y AS id, min({{'cost': g.o.cost + sq.step, 'via': sq.x, 'folds': g.o.folds + sq.k}}) AS o FROM gw g JOIN sq ON sq.x = g.id GROUP BY sq.y) n LEFT JOIN recurring.gw c ON c.id = n.id
  WHERE c.id IS NULL OR n.o.cost < c.o.cost OR (n.o.cost = c.o.cost AND c.o.via >= 0 AND (n.o.via < c.o.via OR (n.o.via = c.o.via AND n.o.folds <> c.o.folds))))
SELECT elevation_number, ray_idx, gate_idx, o.cost AS cost, CAST(o.folds AS INT) AS folds, v + coalesce(o.folds, 0) * 2 * nyquist_ms AS corrected FROM hd LEFT JOIN gw ON gw.id = elevation_number * {_ID} + cell""")
def q_seeded_growth(spark, sf_dir):
    """Growth of all gates from segments of SEED_GATES gates or more."""
    hard = rounds.written(_hard(spark, sf_dir))
    own = rounds.written(rounds.segments(hard))
    top = own.groupBy(*BY, "region").agg(F.count("*").alias("n")).where(F.col("n") >= SEED_GATES)
    seeds = own.join(top, [*BY, "region"]).select(*KEY, F.lit(True).alias("seed"))
    rows = hard.join(seeds, KEY, "left").withColumns({"seed": F.coalesce("seed", F.lit(False)), "folds": F.lit(0)})
    return rounds.grow(rows).select(*KEY, "cost", "folds", "corrected")


# -- refraction --------------------------------------------------------------------------------

STEP_M, STEPS = 1000.0, 28
_NUMBERS = f"{refraction.EARTH_M}::DOUBLE", f"{refraction.N0}::DOUBLE", f"{refraction.SCALE_M}::DOUBLE"


def _slopes(k: int, x: str, y: str, px: str, py: str) -> str:
    """Columns of the k-th slope at a state; the state itself comes first."""
    earth, n0, scale = _NUMBERS
    r = f"sqrt(({x}) * ({x}) + ({y}) * ({y}))"
    n = f"({n0} * exp(-greatest({r} - {earth}, 0) / {scale}) / 1e6)"
    return f"({px}) / (1 + {n}) AS x{k}, ({py}) / (1 + {n}) AS y{k}, -{n} / {scale} * ({x}) / {r} AS px{k}, -{n} / {scale} * ({y}) / {r} AS py{k}"


def _ray_sql() -> str:
    at = lambda k, by: [f"{c} + {c}{k} * {by}" for c in ("x", "y", "px", "py")]
    s, earth, n0 = f"{STEP_M}::DOUBLE", *_NUMBERS[:2]
    step = f"(SELECT *, {_slopes(1, 'x', 'y', 'px', 'py')} FROM ry WHERE i < {STEPS} AND NOT down)"
    for k, by in ((2, f"({s} / 2)"), (3, f"({s} / 2)"), (4, s)):
        step = f"(SELECT *, {_slopes(k, *at(k - 1, by))} FROM {step})"
    onward = ", ".join(f"{c} + {s} / 6 * ({c}1 + 2 * {c}2 + 2 * {c}3 + {c}4) AS {c}" for c in ("x", "y", "px", "py"))
    return f"""WITH RECURSIVE g AS MATERIALIZED (SELECT * FROM v_gates), tl AS (SELECT elevation_number AS t, avg(elevation_deg) AS e FROM g GROUP BY 1),
ry(t, i, x, y, px, py, down) AS (SELECT t, 0, 0::DOUBLE, {earth}, cos(radians(e)) * (1 + {n0} * exp(0::DOUBLE) / 1e6), sin(radians(e)) * (1 + {n0} * exp(0::DOUBLE) / 1e6), false FROM tl
  UNION ALL SELECT t, i + 1, x, y, px, py, sqrt(x * x + y * y) <= {earth} FROM (SELECT t, i, {onward} FROM {step})),
rt AS (SELECT t, i, sqrt(x * x + y * y) - {earth} AS h, atan2(x, y) AS a FROM ry)"""


@query(f"""{_ray_sql()} SELECT elevation_number, ray_idx, gate_idx, round(p.h + (range_m / {STEP_M} - p.i) * (q.h - p.h), 3) + 0.0 AS height_m, round(p.a + (range_m / {STEP_M} - p.i) * (q.a - p.a), 9) + 0.0 AS arc_rad FROM g LEFT JOIN (rt p JOIN rt q ON q.t = p.t AND q.i = p.i + 1) ON p.t = g.elevation_number AND p.i = CAST(floor(range_m / {STEP_M}) AS INT)""")
def q_refraction(spark, sf_dir):
    """Height and arc of every gate on a beam that is bent by the air."""
    g = gates(spark, sf_dir)
    tilts = g.groupBy(*BY).agg(F.avg("elevation_deg").alias("elevation_deg"))
    tables = rounds.written(refraction.ray_tables(tilts, BY, STEP_M * STEPS, STEP_M))
    return refraction.with_refraction(g, tables, BY, STEP_M).select(*KEY, rounded("height_m", "height_m", 3), rounded("arc_rad", "arc_rad", 9))


# -- votes in sequence -------------------------------------------------------------------------


def _sequence_sql(tilts: int = 5) -> str:
    """One tilt after the other; c1, c2, ... hold a tilt's gates with their corrected velocity."""
    out = [f"{LABELS}, te AS MATERIALIZED (SELECT elevation_number, avg(elevation_deg) AS d FROM r GROUP BY 1)"]
    most = "arg_max(t, {} * 100 - t)"
    for p in range(1, tilts + 1):
        below = f"SELECT elevation_number, ray_idx, range_m, cv AS v, -1 AS s FROM c{p - 1} UNION ALL " if p > 1 else ""
        out += [
            f"o{p} AS ({below}SELECT elevation_number, ray_idx, range_m, v, 1 AS s FROM r WHERE elevation_number % 32 = {p})",
            f"""d{p} AS (SELECT o.s, a.elevation_number, a.id, a.region, a.v, a.nyquist_ms, o.v AS nearest, row_number() OVER (PARTITION BY o.s, a.id ORDER BY round(abs(a.range_m * cos(radians(a.elevation_deg)) / cos(radians(te.d)) - o.range_m), 6), o.range_m) AS i
FROM r a JOIN o{p} o ON o.elevation_number = a.elevation_number + o.s AND o.ray_idx = a.ray_idx JOIN te ON te.elevation_number = o.elevation_number WHERE a.elevation_number % 32 = {p - 1} AND abs(a.range_m * cos(radians(a.elevation_deg)) / cos(radians(te.d)) - o.range_m) <= 750)""",
            f"k{p} AS (SELECT *, CAST(round((nearest - v) / (2 * nyquist_ms)) AS INT) AS k FROM d{p} WHERE i = 1)",
            f"v{p} AS (SELECT elevation_number, region, CAST(t AS INT) AS t, count(*) FILTER (k = t) AS votes, count(*) FILTER (k = t AND s = -1) AS below, count(*) FILTER (k = t AND s = 1) AS above, sum(abs(v + t * 2 * nyquist_ms - nearest)) AS cost FROM k{p}, range(-3, 4) x(t) GROUP BY 1, 2, 3)",
            f"""w{p} AS (SELECT elevation_number, region, {most.format('votes')} AS k, max(votes) AS votes, sum(votes) AS n, {most.format('below')} AS kb, max(below) AS vb, sum(below) AS nb, {most.format('above')} AS ka, max(above) AS va, sum(above) AS na, arg_max(cost, votes * 100 - t) AS c1, max(cost) FILTER (t = 0) AS c0 FROM v{p} GROUP BY 1, 2)""",
            f"""c{p} AS MATERIALIZED (SELECT r.*, coalesce(w.k, 0) AS folds, v + coalesce(w.k, 0) * 2 * nyquist_ms AS cv FROM r LEFT JOIN (SELECT * FROM w{p} WHERE n >= 6 AND k <> 0 AND votes >= 0.72::DOUBLE * n AND (nb < 3 OR na < 3 OR (kb = k AND ka = k AND vb >= 0.65::DOUBLE * nb AND va >= 0.65::DOUBLE * na)) AND c1 <= 0.45::DOUBLE * c0) w
ON w.elevation_number = r.elevation_number AND w.region = r.region WHERE r.elevation_number % 32 = {p - 1})""",
        ]
    return ",\n".join(out) + "\n" + " UNION ALL ".join(f"SELECT id, folds, cv AS corrected FROM c{p}" for p in range(1, tilts + 1))


@query(_sequence_sql())
def q_vertical_sequence(spark, sf_dir):
    """Votes of the tilts below and above, tilt by tilt, each on the corrected values of the one below."""
    return stages.vertical_in_sequence(labelled(spark, sf_dir), ["volume_id"]).select("id", "folds", "corrected")


# -- rescue ------------------------------------------------------------------------------------

RESCUE_SHARE = 0.25


def _pass_sql(number: int) -> str:
    done = " UNION ALL ".join(f"SELECT t, cell, k FROM y{n}" for n in range(1, number)) or "SELECT t, cell, 0 AS k FROM b WHERE false"
    huber = lambda r, d: f"CASE WHEN abs({r}) <= {d} THEN ({r}) * ({r}) / (2 * {d}) ELSE abs({r}) - {d} / 2 END"
    return f"""w{number} AS MATERIALIZED ({done}),
f{number} AS (SELECT bs.t, bs.cell, bs.dir, bs.o + coalesce(w.k, 0) * 2 * bs.ovn AS o, bs.ovn FROM bs LEFT JOIN w{number} w ON w.t = bs.t AND w.cell = bs.other WHERE NOT oh OR w.k IS NOT NULL),
t{number} AS (SELECT h.t, h.cell, h.vn, h.target, k, h.v + k * 2 * h.vn AS c FROM hg h ANTI JOIN w{number} w ON w.t = h.t AND w.cell = h.cell, range(-6, 7) x(k)),
s{number} AS (SELECT t.t, t.cell, k, any_value(vn) AS vn, any_value(target) AS target, any_value(c) AS c, count(o) AS n, sum({huber('c - o', 'greatest(1.5::DOUBLE, 0.38::DOUBLE * vn)')}) AS s, count(*) FILTER (abs(c - o) <= 0.55::DOUBLE * least(vn, ovn)) AS backed,
  count(*) FILTER (abs(c - o) <= 0.55::DOUBLE * least(vn, ovn) AND dir < 2) AS b1, count(*) FILTER (abs(c - o) <= 0.55::DOUBLE * least(vn, ovn) AND dir >= 2) AS b2 FROM t{number} t LEFT JOIN f{number} f ON f.t = t.t AND f.cell = t.cell GROUP BY t.t, t.cell, k),
u{number} AS (SELECT t, cell, k, round(CASE WHEN n > 0 THEN s / n ELSE 0 END + coalesce(0.2::DOUBLE * ({huber('c - target', 'greatest(2::DOUBLE, 0.4::DOUBLE * vn)')}), 0), 6) AS cost, (backed >= 2 AND b1 > 0 AND b2 > 0) OR (backed >= 1 AND coalesce(abs(c - target) <= 0.5 * vn, false)) AS fits FROM s{number}),
z{number} AS (SELECT t, cell, max(cost) FILTER (k = 0) AS old, min({{'cost': cost, 'far': abs(k), 'k': k}}) FILTER (fits AND k <> 0) AS b FROM u{number} GROUP BY t, cell),
y{number} AS MATERIALIZED (SELECT t, cell, b.k AS k, gain FROM (SELECT z.t, z.cell, b, round((old - b.cost) / old, 6) AS gain FROM z{number} z WHERE old > 0) q JOIN bu USING (t) WHERE gain >= 0.3::DOUBLE
  QUALIFY row_number() OVER (PARTITION BY t ORDER BY gain DESC, cell) <= any_value(budget) OVER (PARTITION BY t) - (SELECT count(*) FROM w{number} w WHERE w.t = q.t))"""


@query(f"""{_HARD}, b AS MATERIALIZED (SELECT elevation_number AS t, cell, ray_idx, gate_idx, CASE WHEN hard THEN v ELSE (true_code - 129) / 2.0::DOUBLE END AS v, nyquist_ms AS vn, range_m, elevation_deg, hard FROM hd),
bu AS MATERIALIZED (SELECT t, budget FROM (SELECT t, count(*) FILTER (hard) AS nh, least(4096, greatest(1, CAST(floor(count(*) * {RESCUE_SHARE}::DOUBLE + 1e-9) AS INT))) AS budget FROM b GROUP BY t) WHERE nh > 0 AND nh <= 2 * budget),
te AS (SELECT t, avg(elevation_deg) AS d FROM b GROUP BY t),
vl AS (SELECT a.t, a.cell, o.v AS nearest, row_number() OVER (PARTITION BY a.t, a.cell, o.t ORDER BY round(abs(a.range_m * cos(radians(a.elevation_deg)) / cos(radians(te.d)) - o.range_m), 6), o.range_m) AS i
  FROM b a JOIN b o ON o.t IN (a.t - 1, a.t + 1) AND o.ray_idx = a.ray_idx AND NOT o.hard JOIN te ON te.t = o.t WHERE a.hard AND abs(a.range_m * cos(radians(a.elevation_deg)) / cos(radians(te.d)) - o.range_m) <= 750),
ta AS (SELECT t, cell, avg(nearest) AS target FROM vl WHERE i = 1 GROUP BY t, cell), hg AS MATERIALIZED (SELECT b.*, target FROM b JOIN bu USING (t) LEFT JOIN ta ON ta.t = b.t AND ta.cell = b.cell WHERE hard),
bs AS MATERIALIZED (SELECT lb.t, ac AS cell, bc AS other, d AS dir, o.v AS o, o.vn AS ovn, o.hard AS oh FROM lb JOIN hg h ON h.t = lb.t AND h.cell = ac JOIN b o ON o.t = lb.t AND o.cell = bc),
{_pass_sql(1)}, {_pass_sql(2)}
SELECT t AS elevation_number, CAST(cell // 1048576 AS INT) AS ray_idx, CAST(cell % 1048576 AS INT) AS gate_idx, CAST(k AS INT) AS folds, gain, pass FROM (SELECT *, 1 AS pass FROM y1 UNION ALL SELECT *, 2 FROM y2)""")
def q_gate_rescue(spark, sf_dir):
    """Hard gates that are rescued, where all others have their true velocity."""
    rows = _hard(spark, sf_dir, "true_code")
    rows = rows.withColumn("v", F.when(F.col("hard"), F.col("v")).otherwise((F.col("true_code") - 129) / 2.0))
    return stages.rescue(rows, ["volume_id"], most_share=RESCUE_SHARE)


# -- vortices ----------------------------------------------------------------------------------

STEPS_OF_FIT = {"offset": [-500.0, 0.0, 500.0], "radius": [400.0, 900.0], "vr": [-8.0, 0.0], "vt": [-30.0, -15.0, 15.0, 30.0]}
WINDOW_GATES = 10


def _list(values: list[float]) -> str:
    return "unnest([" + ", ".join(f"{v}::DOUBLE" for v in values) + "])"


@query(f"""{_HARD}, hp AS MATERIALIZED (SELECT t * {_ID} + ac AS x, t * {_ID} + bc AS y FROM lb WHERE ha AND hb), hn AS MATERIALIZED (SELECT DISTINCT x AS id FROM hp),
hl(id, l) USING KEY (id) AS (SELECT id, id FROM hn UNION SELECT hp.y, min(hl.l) FROM hl JOIN hp ON hp.x = hl.id JOIN recurring.hl AS cur ON cur.id = hp.y WHERE hl.l < cur.l GROUP BY hp.y),
fl AS MATERIALIZED (SELECT elevation_number AS t, cell, range_m * cos(radians(elevation_deg)) * sin(radians(azimuth_deg)) AS x, range_m * cos(radians(elevation_deg)) * cos(radians(azimuth_deg)) AS y, sin(radians(azimuth_deg)) AS bx, cos(radians(azimuth_deg)) AS by_, cos(radians(elevation_deg)) AS ce, v, nyquist_ms AS vn FROM hd),
cl AS MATERIALIZED (SELECT fl.t, l % {_ID} AS cluster, count(*) AS n, avg(x) AS x, avg(y) AS y FROM fl JOIN hl ON hl.id = fl.t * {_ID} + cell GROUP BY ALL HAVING count(*) >= 4),
jo AS (SELECT a.t, a.cluster, arg_min(b.cluster, (-b.n, b.cluster)) AS home FROM cl a JOIN cl b ON a.t = b.t AND (b.n > a.n OR (b.n = a.n AND b.cluster < a.cluster)) AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 2000 GROUP BY a.t, a.cluster),
ce AS MATERIALIZED (SELECT cl.t, coalesce(home, cl.cluster) AS cluster, sum(x * n) / sum(n) AS x, sum(y * n) / sum(n) AS y, sum(n) AS n FROM cl LEFT JOIN jo ON jo.t = cl.t AND jo.cluster = cl.cluster GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY cl.t ORDER BY sum(n) DESC, coalesce(home, cl.cluster)) <= 4),
wn AS MATERIALIZED (SELECT fl.*, cluster, ce.x AS x0, ce.y AS y0, count(*) OVER (PARTITION BY ce.t, cluster) AS n FROM fl JOIN ce ON ce.t = fl.t WHERE sqrt((fl.x - ce.x) * (fl.x - ce.x) + (fl.y - ce.y) * (fl.y - ce.y)) <= 3000),
tr AS (SELECT t, cluster, x0 + dx AS xc, y0 + dy AS yc, radius, vr, vt FROM (SELECT DISTINCT t, cluster, x0, y0 FROM wn WHERE n >= {WINDOW_GATES}), (SELECT {_list(STEPS_OF_FIT['offset'])} AS dx), (SELECT {_list(STEPS_OF_FIT['offset'])} AS dy), (SELECT {_list(STEPS_OF_FIT['radius'])} AS radius), (SELECT {_list(STEPS_OF_FIT['vr'])} AS vr), (SELECT {_list(STEPS_OF_FIT['vt'])} AS vt)),
bb AS (SELECT w.*, tr.xc, tr.yc, radius, vr, vt, x - xc AS dx, y - yc AS dy, sqrt((x - xc) * (x - xc) + (y - yc) * (y - yc)) AS far FROM wn w JOIN tr ON tr.t = w.t AND tr.cluster = w.cluster),
ff AS (SELECT *, CASE WHEN far < 1 THEN 0 WHEN far < radius THEN 1 / radius ELSE radius / (far * far) END AS f FROM bb),
sc AS (SELECT t, cluster, xc, yc, radius, vt, vr, round(sqrt(sum(cos(a)) * sum(cos(a)) + sum(sin(a)) * sum(sin(a))) / count(*), 9) AS score FROM (SELECT *, pi() / vn * (v - ce * (vt * f * (dx * by_ - dy * bx) + vr * f * (dx * bx + dy * by_))) AS a FROM ff) GROUP BY ALL),
s0 AS (SELECT t, cluster, count(*) AS n, any_value(vn) AS vn, sqrt(sum(cos(pi() / vn * v)) ** 2 + sum(sin(pi() / vn * v)) ** 2) / count(*) AS score0 FROM wn GROUP BY t, cluster)
SELECT t AS elevation_number, cluster, round(xc, 4) + 0.0 AS xc, round(yc, 4) + 0.0 AS yc, radius, vt, vr, round(score, 6) AS score, round(score0, 6) AS score0, n FROM (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY t, cluster ORDER BY score DESC, xc, yc, radius, vt, vr) = 1) JOIN s0 USING (t, cluster)""")
def q_vortex_fit(spark, sf_dir):
    """The best of a small grid of vortices about each cluster of hard gates."""
    hard = rounds.written(_hard(spark, sf_dir))
    centres = rounds.written(stages.hard_clusters(hard))
    fits = stages.vortex_fits(hard, centres, coarse=STEPS_OF_FIT, fine={}, least=WINDOW_GATES)
    return fits.select(*BY, "cluster", rounded("xc", "xc", 4), rounded("yc", "yc", 4), "radius", "vt", "vr", F.round("score", 6).alias("score"), F.round("score0", 6).alias("score0"), "n")


# -- descent and couplets ----------------------------------------------------------------------

_ADJACENT = G + """, rays AS (SELECT elevation_number, max(ray_idx) + 1 AS n_rays FROM g GROUP BY 1),
ga AS MATERIALIZED (SELECT g.*, elevation_number AS t, ray_idx * 1048576 + gate_idx AS cell, (ray_idx + gate_idx) % 2 + CASE WHEN n_rays % 2 = 1 AND ray_idx = n_rays - 1 THEN 2 ELSE 0 END AS colour, n_rays FROM g JOIN rays USING (elevation_number)),
ad AS MATERIALIZED (SELECT a.t, a.cell AS ac, b.cell AS bc, a.v - b.v AS d, a.nyquist_ms AS vn, 0 AS way FROM ga a JOIN ga b ON a.t = b.t AND a.ray_idx = b.ray_idx AND b.gate_idx = a.gate_idx + 1
  UNION ALL SELECT a.t, a.cell, b.cell, a.v - b.v, a.nyquist_ms, 1 FROM ga a JOIN ga b ON a.t = b.t AND b.ray_idx = (a.ray_idx + 1) % a.n_rays AND a.gate_idx = b.gate_idx AND a.cell <> b.cell WHERE least(abs(a.azimuth_deg - b.azimuth_deg) % 360, 360 - abs(a.azimuth_deg - b.azimuth_deg) % 360) <= 4),
bo AS MATERIALIZED (SELECT * FROM ad UNION ALL SELECT t, bc, ac, -d, vn, way FROM ad)"""
PASSES = 2


def _descent_sql() -> str:
    cost = lambda k: f"sum(CASE WHEN abs(d + (s.k + {k} - o.k) * 2 * vn) <= 0.4::DOUBLE * vn THEN (d + (s.k + {k} - o.k) * 2 * vn) * (d + (s.k + {k} - o.k) * 2 * vn) / (2 * (0.4::DOUBLE * vn)) ELSE abs(d + (s.k + {k} - o.k) * 2 * vn) - 0.4::DOUBLE * vn / 2 END)"
    out, n = [f"{_ADJACENT}, s0 AS MATERIALIZED (SELECT t, cell, colour, 0 AS k FROM ga)"], 0
    for number in range(PASSES):
        for colour in (0, 1, 2, 3) if number % 2 == 0 else (3, 2, 1, 0):
            tries = ", ".join(f"{{'cost': round({cost(k)}, 6), 'far': {abs(k)}, 'k': {k}}}" for k in (-1, 0, 1))
            out += [
                f"m{n} AS (SELECT s.t, s.cell, any_value(s.k) AS k0, list_min([{tries}]).k AS k FROM s{n} s JOIN bo ON bo.t = s.t AND bo.ac = s.cell JOIN s{n} o ON o.t = s.t AND o.cell = bo.bc WHERE s.colour = {colour} GROUP BY s.t, s.cell)",
                f"s{n + 1} AS MATERIALIZED (SELECT s.t, s.cell, s.colour, s.k + coalesce(m.k, 0) AS k FROM s{n} s LEFT JOIN (SELECT * FROM m{n} WHERE k <> 0 AND abs(k0 + k) <= 6) m ON m.t = s.t AND m.cell = s.cell)",
            ]
            n += 1
    return ",\n".join(out) + f"\nSELECT elevation_number, ray_idx, gate_idx, CAST(k AS INT) AS folds, v + k * 2 * nyquist_ms AS corrected FROM ga JOIN s{n} s ON s.t = ga.t AND s.cell = ga.cell"


@query(_descent_sql())
def q_gate_descent(spark, sf_dir):
    """Single gates moved by whole folds, colour by colour, so that the cost of links never rises."""
    return stages.descend(gates(spark, sf_dir), passes=PASSES).select(*KEY, "folds", "corrected")


LEAST_MS = 4.0


@query(f"""{_ADJACENT.replace("WITH g", "WITH RECURSIVE g", 1)}, pr AS (SELECT t, ac, bc, abs(d) AS d FROM ad WHERE way = 1 AND abs(d) >= {LEAST_MS}::DOUBLE), ho AS MATERIALIZED (SELECT t, cell, max(d) AS d, count(*) AS n FROM (SELECT t, ac AS cell, d FROM pr UNION ALL SELECT t, bc, d FROM pr) GROUP BY t, cell),
ie AS MATERIALIZED (SELECT bo.t * {_ID} + ac AS x, bo.t * {_ID} + bc AS y FROM bo JOIN ho a ON a.t = bo.t AND a.cell = ac JOIN ho b ON b.t = bo.t AND b.cell = bc),
cp(id, l) USING KEY (id) AS (SELECT t * {_ID} + cell, t * {_ID} + cell FROM ho UNION SELECT ie.y, min(cp.l) FROM cp JOIN ie ON ie.x = cp.id JOIN recurring.cp AS cur ON cur.id = ie.y WHERE cp.l < cur.l GROUP BY ie.y),
dt AS MATERIALIZED (SELECT volume_id, ga.t, l % {_ID} AS couplet, CAST(sum(ho.n) / 2 AS BIGINT) AS n_pairs, max(ho.d) AS delta_ms, avg(range_m * cos(radians(elevation_deg)) * sin(radians(azimuth_deg))) AS x, avg(range_m * cos(radians(elevation_deg)) * cos(radians(azimuth_deg))) AS y,
  avg(sqrt(range_m * range_m + {S.BEAM_RADIUS_M}::DOUBLE * {S.BEAM_RADIUS_M}::DOUBLE + 2 * range_m * {S.BEAM_RADIUS_M}::DOUBLE * sin(radians(elevation_deg))) - {S.BEAM_RADIUS_M}::DOUBLE) AS h FROM ho JOIN ga ON ga.t = ho.t AND ga.cell = ho.cell JOIN cp ON cp.id = ho.t * {_ID} + ho.cell GROUP BY ALL),
lv AS MATERIALIZED (SELECT *, dense_rank() OVER (PARTITION BY volume_id ORDER BY t) AS level FROM dt),
ch AS MATERIALIZED (SELECT a.t * {_ID} + a.couplet AS x, b.t * {_ID} + b.couplet AS y FROM lv a JOIN lv b ON a.volume_id = b.volume_id AND b.level = a.level + 1 WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 2500 AND abs(a.h - b.h) <= 3000),
cb AS MATERIALIZED (SELECT * FROM ch UNION ALL SELECT y, x FROM ch),
cn(id, l) USING KEY (id) AS (SELECT t * {_ID} + couplet, t * {_ID} + couplet FROM lv UNION SELECT cb.y, min(cn.l) FROM cn JOIN cb ON cb.x = cn.id JOIN recurring.cn AS cur ON cur.id = cb.y WHERE cn.l < cur.l GROUP BY cb.y),
nm AS (SELECT lv.*, l FROM lv JOIN cn ON cn.id = t * {_ID} + couplet), su AS (SELECT l, count(DISTINCT level) AS n_tilts, max(h) - min(h) AS depth, max(delta_ms) AS chain_ms FROM nm GROUP BY l)
SELECT t AS elevation_number, couplet, n_pairs, delta_ms, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y, round(h, 4) + 0.0 AS height_m, l % {_ID} AS chain_couplet, n_tilts, round(depth, 4) + 0.0 AS depth_m, chain_ms, n_tilts >= 2 AND chain_ms >= 12 AS vortex FROM nm JOIN su USING (l)""")
def q_couplet_chains(spark, sf_dir):
    """Shear between rays, chained through the tilts of a volume."""
    found = stages.couplets(gates(spark, sf_dir), least_ms=LEAST_MS)
    rows = stages.chains(found, ["volume_id"], vortex_ms=12.0)
    return rows.select(*BY, "couplet", "n_pairs", "delta_ms", *(rounded(c, c, 4) for c in ("x", "y", "height_m")), F.col("chain.couplet").alias("chain_couplet"), "n_tilts", rounded("depth_m", "depth_m", 4), "chain_ms", "vortex")


@query(None)
def q_dealias_stages(spark, sf_dir):
    """Whole volumes through region solve, votes, vortices and rescue; a test holds it against planted folds."""
    out = stages.dealias_in_stages(gates(spark, sf_dir), ["volume_id"], hard={"share": HARD}, fits={"coarse": STEPS_OF_FIT, "fine": {}, "least": WINDOW_GATES}, rescued={"most_share": RESCUE_SHARE})
    return out.select(*KEY, "hard", "folds", "corrected")
