"""Radar-shaped views over the given tables, as SQL that Spark and DuckDB both run.

Each view is derived by Spark from a table that grows. Gates and cuts come in volumes, one
for each ORDERS_A_VOLUME orders, so that volumes, tilts and gates grow with lineitem; a
volume has five tilts of at most 12,000 gates. `elevation_number` counts the cuts of the
whole archive: CUTS_A_VOLUME times the volume, and the cut's number in its volume. The
alert feed has an id for each ten events, so ids repeat and grow with events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..streaming.alerts import EVENT_COLOURS

ORDERS_A_VOLUME, CUTS_A_VOLUME = 10_000, 32
_VOLUME = f"CAST(floor(l_orderkey / {ORDERS_A_VOLUME}) AS BIGINT)"

V_GATES = f"""
WITH g AS (
  SELECT {_VOLUME} AS volume_id, CAST(l_orderkey % 5 AS INT) AS cut, CAST(l_partkey % 120 AS INT) AS ray_idx,
         CAST((l_suppkey * 7 + l_linenumber * 13 + l_partkey) % 100 AS INT) AS gate_idx,
         max(l_discount) AS noise, max(l_quantity) AS qty
  FROM lineitem GROUP BY 1, 2, 3, 4),
p AS (
  SELECT volume_id, volume_id * {CUTS_A_VOLUME} + cut AS elevation_number, ray_idx, gate_idx, noise, qty, CAST(ray_idx * 3 + 1.5 AS DOUBLE) AS azimuth_deg,
         CAST(2125 + 250 * gate_idx AS DOUBLE) AS range_m, CAST(0.5 + 0.9 * cut AS DOUBLE) AS elevation_deg,
         CAST(12 + cut AS DOUBLE) AS nyquist_ms FROM g),
t AS (
  SELECT *, (CAST(22 AS DOUBLE) * sin(radians(azimuth_deg)) + CAST(9 AS DOUBLE) * cos(radians(azimuth_deg)))
            * cos(radians(elevation_deg)) * (CAST(1 AS DOUBLE) + CAST(0.004 AS DOUBLE) * gate_idx)
            + CAST(10 AS DOUBLE) * (noise - CAST(0.05 AS DOUBLE)) AS v_true FROM p),
f AS (SELECT *, v_true - 2 * nyquist_ms * floor((v_true + nyquist_ms) / (2 * nyquist_ms)) AS v_fold FROM t)
SELECT volume_id, elevation_number, ray_idx, gate_idx, azimuth_deg, range_m, elevation_deg, nyquist_ms,
       CAST(floor(v_fold * 2 + CAST(129.5 AS DOUBLE)) AS INT) AS vel_code,
       CAST(floor(v_true * 2 + CAST(129.5 AS DOUBLE)) AS INT) AS true_code,
       CAST(floor(qty * 2 + 66) AS INT) AS ref_code
FROM f
"""

V_SCANS = """
WITH e AS (
  SELECT concat('K', chr(CAST(65 + user_id % 26 AS INT)), chr(CAST(65 + (user_id * 7) % 26 AS INT)), chr(CAST(65 + (user_id * 3) % 26 AS INT))) AS icao,
         CAST(year(ts) AS STRING) AS yy, lpad(CAST(month(ts) AS STRING), 2, '0') AS mm, lpad(CAST(day(ts) AS STRING), 2, '0') AS dd,
         concat(lpad(CAST(hour(ts) AS STRING), 2, '0'), lpad(CAST(minute(ts) AS STRING), 2, '0'), lpad(CAST(second(ts) AS STRING), 2, '0')) AS hms,
         CASE WHEN event_type = 'error' THEN '_V06_MDM' WHEN event_type = 'view' THEN '_V03' ELSE '_V06' END AS suffix
  FROM events)
SELECT DISTINCT concat(yy, '/', mm, '/', dd, '/', icao, '/', icao, yy, mm, dd, '_', hms, suffix) AS path FROM e
"""

#: By number, an event; the last ones have no colour of their own.
_EVENTS = "CASE event_id % 20 " + " ".join(f"WHEN {k} THEN '{e}'" for k, e in enumerate(EVENT_COLOURS)) + " ELSE 'Something Else' END"
V_ALERT_FEED = f"""
SELECT event_id AS feed_seq, CASE WHEN event_id % 97 = 0 THEN NULL ELSE concat('urn:', CAST(CAST(floor(event_id / 1000) AS BIGINT) * 100 + event_id % 100 AS STRING)) END AS nws_id,
       {_EVENTS} AS event,
       ts AS effective, CASE WHEN event_id % 10 = 0 THEN NULL ELSE ts + (event_id % 48) * INTERVAL '1' HOUR END AS expires, concat('{{"type":"Feature","geometry":', CASE WHEN event_id % 3 = 0 THEN 'null' ELSE '{{"type":"Polygon"}}' END, ',"properties":{{"severity":"', CASE event_id % 4 WHEN 0 THEN 'Extreme' WHEN 1 THEN 'Severe' WHEN 2 THEN 'Moderate' ELSE 'Minor' END, '"}}}}') AS geojson
FROM events
"""

V_SITES = """
SELECT concat('K', lpad(CAST(s_suppkey AS STRING), 3, '0')) AS icao, s_name AS city,
       CAST(25 + (s_suppkey * 37) % 24 AS DOUBLE) AS latitude, CAST(-125 + (s_suppkey * 53) % 58 AS DOUBLE) AS longitude
FROM supplier
"""

#: Headers of five cuts, two of them split, that each volume has: degrees, moments, milliseconds.
_CUTS = [("0.50", "REF,ZDR,PHI,RHO", 1000), ("0.55", "REF,VEL,SW", 21000), ("1.40", "REF,ZDR,PHI,RHO", 60000), ("1.60", "REF,VEL,SW", 95000), ("2.40", "REF,VEL,SW,ZDR,PHI,RHO", 130000)]
_case = lambda k, shape: "CASE cut " + " ".join(f"WHEN {n} THEN {shape.format(c[k])}" for n, c in enumerate(_CUTS)) + " END"
V_CUTS = f"""
WITH c AS (SELECT DISTINCT {_VOLUME} AS volume_id, CAST(l_orderkey % 5 AS INT) AS cut FROM lineitem)
SELECT volume_id, volume_id * {CUTS_A_VOLUME} + cut AS elevation_number, {_case(0, "CAST({} AS DOUBLE)")} AS elevation_deg, {_case(1, "'{}'")} AS moments, {_case(2, "{}")} AS collect_ms FROM c
"""

#: name -> (SQL, tables it reads)
VIEWS = {
    "v_gates": (V_GATES, ["lineitem"]), "v_scans": (V_SCANS, ["events"]), "v_alert_feed": (V_ALERT_FEED, ["events"]), "v_sites": (V_SITES, ["supplier"]), "v_cuts": (V_CUTS, ["lineitem"]),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame."""
    sql, tables = VIEWS[name]
    for t in tables:
        table(spark, sf_dir, t).createOrReplaceTempView(f"given_{t}")
        sql = sql.replace(f"FROM {t}", f"FROM given_{t}")
    return spark.sql(sql)


def with_views(sql: str) -> str:
    """DuckDB's form of a query: the views that it names come first."""
    used = [n for n in VIEWS if n in sql]
    head = ", ".join(f"{n} AS ({VIEWS[n][0]})" for n in used)
    if not head:
        return sql
    rest = sql.lstrip()
    return f"WITH RECURSIVE {head}, {rest[15:]}" if rest.upper().startswith("WITH RECURSIVE ") else f"WITH {head}, {rest[5:]}" if rest.upper().startswith("WITH ") else f"WITH {head} {rest}"
