"""Severe-weather alerts: one row an id, first seen wins, expired rows go. Batch and stream."""

from __future__ import annotations

import colorsys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# The events that a feed is asked for, the events that have a colour of their own, and opacity by severity.
FEED_EVENTS = ["Tornado Warning", "Severe Thunderstorm Warning", "Flash Flood Warning", "Special Weather Statement", "Special Marine Warning", "Coastal Flood Warning", "Winter Storm Warning"]
COLOURED_EVENTS = [
    "Blizzard Warning", "Coastal Flood Advisory", "Coastal Flood Warning", "Flash Flood Warning", "Flash Flood Watch", "Flood Warning", "Flood Watch", "High Wind Warning", "Ice Storm Warning",
    "Severe Thunderstorm Warning", "Severe Thunderstorm Watch", "Special Marine Warning", "Special Weather Statement", "Tornado Warning", "Tornado Watch", "Wind Advisory", "Winter Storm Warning", "Winter Storm Watch",
]
#: An event's kind is its last word and gives the lightness; what is before it is the hazard, and hazards share the circle of hues.
LIGHTNESS = {"Warning": 0.40, "Watch": 0.55, "Advisory": 0.65, "Statement": 0.72}


def event_colours(events: list[str]) -> dict[str, str]:
    """Colours by rule: equal steps of hue for the hazards in alphabetical order, lightness by kind."""
    hazards = sorted({e.rpartition(" ")[0] for e in events})

    def colour(event: str) -> str:
        hazard, _, kind = event.rpartition(" ")
        rgb = colorsys.hls_to_rgb(hazards.index(hazard) / len(hazards), LIGHTNESS.get(kind, 0.5), 0.75)
        return "#" + "".join(f"{round(255 * c):02x}" for c in rgb)

    return {e: colour(e) for e in events}


EVENT_COLOURS = event_colours(COLOURED_EVENTS)
OTHER_COLOUR = "#999999"
OPACITY = {"Extreme": 0.38, "Severe": 0.30, "Moderate": 0.22}
OTHER_OPACITY = 0.15
COLUMNS = ["nws_id", "event", "effective", "expires", "geojson"]


def parse_features(feed: DataFrame, column: str = "feature", keep: tuple[str, ...] = ()) -> DataFrame:
    """GeoJSON features as text: id, event, headline, area, times and the whole feature; missing texts are empty. keep: other columns that stay."""
    prop = lambda n: F.get_json_object(column, f"$.properties.{n}")
    text = lambda n: F.coalesce(prop(n), F.lit(""))
    time = lambda n: F.try_to_timestamp(F.nullif(prop(n), F.lit("")))
    return feed.select(*keep, prop("id").alias("nws_id"), text("event").alias("event"), text("headline").alias("headline"), text("areaDesc").alias("area_desc"), time("effective").alias("effective"), time("expires").alias("expires"), F.get_json_object(column, "$.geometry").alias("geometry"), prop("severity").alias("severity"), F.col(column).alias("geojson"))


def usable(feed: DataFrame) -> DataFrame:
    """Rows with an id and a start; the rest would break the table."""
    return feed.where(F.col("nws_id").isNotNull() & (F.col("nws_id") != "") & F.col("effective").isNotNull())


def first_of_each(feed: DataFrame, order: str) -> DataFrame:
    w = Window.partitionBy("nws_id").orderBy(order)
    return feed.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")


def new_alerts(feed: DataFrame, known: DataFrame, order: str) -> DataFrame:
    """What the feed adds: the first row of each id that is not known. A known id is never updated."""
    return first_of_each(usable(feed).join(known.select("nws_id").distinct(), "nws_id", "left_anti"), order)


def expired(alerts: DataFrame, now: Column) -> DataFrame:
    return alerts.where(F.col("expires").isNotNull() & (F.col("expires") < now))


def unexpired(alerts: DataFrame, now: Column) -> DataFrame:
    return alerts.where(F.col("expires").isNull() | (F.col("expires") >= now))


def synced(known: DataFrame, feed: DataFrame, now: Column, order: str) -> DataFrame:
    """The table after a poll: expired rows go first, then new ones come, expired or not."""
    kept = unexpired(known, now)
    return kept.select(*COLUMNS).unionByName(new_alerts(feed, kept, order).select(*COLUMNS))


def shown_diff(shown: DataFrame, feed: DataFrame) -> DataFrame:
    """nws_id with action: add, keep or remove, of what a map shows against the feed."""
    a, b = shown.select("nws_id").distinct().withColumn("was", F.lit(True)), feed.where("nws_id is not null").select("nws_id").distinct().withColumn("now", F.lit(True))
    return a.join(b, "nws_id", "full_outer").select("nws_id", F.when(F.col("was").isNull(), "add").when(F.col("now").isNull(), "remove").otherwise("keep").alias("action"))


def style(event: Column, severity: Column | None = None) -> dict[str, Column]:
    pick = lambda key, table, other: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key), F.lit(other))
    return {"colour": pick(event, EVENT_COLOURS, OTHER_COLOUR), "opacity": pick(severity, OPACITY, OTHER_OPACITY) if severity is not None else F.lit(OTHER_OPACITY)}


def wanted(feed: DataFrame, events: list[str] = FEED_EVENTS) -> DataFrame:
    """The rows of the events that a feed is asked for."""
    return feed.where(F.col("event").isin(events))


def with_shapes(feed: DataFrame, column: str = "geojson") -> DataFrame:
    """The rows whose feature has a geometry, with its `geometry` and `severity`."""
    rows = feed.withColumns({"geometry": F.get_json_object(column, "$.geometry"), "severity": F.get_json_object(column, "$.properties.severity")})
    return rows.where(F.col("geometry").isNotNull())


def sync_counts(known: DataFrame, feed: DataFrame, now: Column, order: str) -> DataFrame:
    """One row about a poll: rows fetched, added and expired."""
    gone = expired(known, now).select(F.lit("expired").alias("what"))
    new = new_alerts(feed, unexpired(known, now), order).select(F.lit("added").alias("what"))
    rows = feed.select(F.lit("fetched").alias("what")).unionByName(new).unionByName(gone)
    return rows.agg(*(F.count_if(F.col("what") == w).alias(w) for w in ("fetched", "added", "expired")))


def expiry_label(expires: Column) -> Column:
    """Month, day and time of an expiry; a dash where there is none."""
    return F.coalesce(F.date_format(expires, "MMM d, HH:mm"), F.lit("—"))


def alert_stream(feed: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, delay: str = "2 hours") -> StreamingQuery:
    """Hand a streaming feed on to `write(new rows, batch)`: ids repeated within the watermark go. For a table, see alert_table.

    `write` must be idempotent by batch number, as Spark may repeat a batch after a failure.
    """
    rows = usable(feed).withWatermark("effective", delay).dropDuplicatesWithinWatermark(["nws_id"])
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def alert_table(feed: DataFrame, store: str, checkpoint: str, order: str = "feed_seq", now: Callable[[], Column] = F.current_timestamp, every: str | None = None) -> StreamingQuery:
    """Keep a table of alerts from a streaming feed, in folders under `store`, one for each batch.

    Each batch is a poll: rows that have expired leave the table, then ids that it lacks come
    in. A batch that fails leaves the last table as it was, and a batch that Spark repeats
    reads the same table before it and writes the same folder again; tables before the last
    two go. every: a trigger such as
    "60 seconds"; without it the stream ends when nothing is left to read.
    """

    def poll(rows: DataFrame, number: int) -> None:
        before = stored_alerts(rows.sparkSession, store, number - 1)
        kept = before if before is not None else usable(rows).select(*COLUMNS).limit(0)
        synced(kept, rows, now(), order).write.mode("overwrite").parquet(f"{store}/batch={number}")
        forget_batch(rows.sparkSession, store, number - 2)

    out = feed.writeStream.foreachBatch(poll).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def stored_alerts(spark: SparkSession, store: str, batch: int) -> DataFrame | None:
    """The table after a batch of alert_table; None before the first."""
    return spark.read.parquet(f"{store}/batch={batch}") if batch >= 0 else None


def forget_batch(spark: SparkSession, store: str, batch: int) -> None:
    """Delete the table of a batch that none will read again."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/batch={batch}")
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def windowed_counts(feed: DataFrame, window: str = "1 day", delay: str = "2 hours") -> DataFrame:
    """Alerts by event in windows of their start; works on a batch and on a stream."""
    rows = usable(feed)
    rows = rows.withWatermark("effective", delay) if feed.isStreaming else rows
    return rows.groupBy(F.window("effective", window).alias("w"), "event").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event", "n")
