"""The paged feed, expiry by timers, the poller and cancellation."""

import json
import threading
import time
from concurrent.futures import CancelledError
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import In

from galefold.streaming import alerts, feed
from galefold.streaming.latest import Latest


def feature(ident, event="Flood Watch", expires=None):
    return {"type": "Feature", "geometry": None, "properties": {"id": ident, "event": event, "effective": "2026-01-01T00:00:00Z", "expires": expires and expires.isoformat()}}


def put(folder, name, *features):
    (folder / f".{name}").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    (folder / f".{name}").rename(folder / name)


def test_pages_as_a_batch_with_the_event_filter_pushed_down(spark, tmp_path):
    put(tmp_path, "p1.json", feature("a", "Tornado Watch"), feature("b"))
    put(tmp_path, "p2.json", feature("c", "Tornado Warning"), {"type": "Feature"}, feature("d", 'Odd "event", é'))
    put(tmp_path, "p3.json")
    (tmp_path / "notes.txt").write_text("no page")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(feed.GeoJsonPages)
    rows = spark.read.format("geojson_pages").load(str(tmp_path))
    assert rows.count() == 5
    some = rows.where(F.col("event").isin("Tornado Watch", "Tornado Warning"))
    assert [r.feed_seq for r in some.orderBy("feed_seq").collect()] == ["p1.json:00000000", "p2.json:00000000"]
    reader = feed.PagesReader({"path": str(tmp_path)})
    assert not list(reader.pushFilters([In(("event",), ["Tornado Watch"])])) and [r[1] for p in reader.partitions() for r in reader.read(p)] == ["Tornado Watch"]
    only = feed.pages(spark, f"file://{tmp_path}", ["Flood Watch"]).collect()
    assert [(r.nws_id, r.event, r.effective.isoformat()) for r in only] == [("b", "Flood Watch", "2026-01-01T00:00:00")]


def test_a_stream_of_pages_restarts_without_loss_or_repeat(spark, tmp_path):
    folder, out = tmp_path / "pages", tmp_path / "out"
    folder.mkdir()

    def run():
        q = feed.pages(spark, str(folder), stream=True).select("nws_id", "feed_seq").writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()

    put(folder, "p1.json", feature("a"), feature("b"))
    run()
    run()
    put(folder, "p2.json", feature("c"))
    put(folder, "p3.json", feature("d"), feature("a"))
    run()
    assert sorted(r.nws_id for r in spark.read.parquet(str(out)).collect()) == ["a", "a", "b", "c", "d"]


def test_an_alert_goes_with_no_new_input(spark, tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    now = datetime.now(timezone.utc)
    put(folder, "p1.json", feature("soon", expires=now + timedelta(seconds=12)), feature("never"), feature("late", expires=now + timedelta(days=1)), feature("past", expires=now - timedelta(days=1)), feature("soon", "Second"), feature(None))
    seen = []
    changes = feed.expiring_alerts(feed.pages(spark, str(folder), stream=True))
    q = changes.writeStream.outputMode("append").foreachBatch(lambda rows, n: seen.extend((r.nws_id, r.event, r.action) for r in rows.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="1 second").start()
    try:
        until = time.time() + 90
        while time.time() < until and ("soon", "Flood Watch", "remove") not in seen and q.isActive:
            time.sleep(0.5)
    finally:
        q.stop()
    assert q.exception() is None
    assert sorted(x for x in seen if x[2] == "add") == [(k, "Flood Watch", "add") for k in ("late", "never", "past", "soon")]
    assert sorted(x[0] for x in seen if x[2] == "remove") == ["past", "soon"]


def test_the_poller_starts_again_after_errors(spark, tmp_path):
    (tmp_path / "in").mkdir()
    calls, errors, stop, got = [], [], threading.Event(), []

    def start():
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("no connection")

        def write(rows, number):
            if len(calls) == 2:
                raise RuntimeError("no table")
            got.extend(r.nws_id for r in rows.collect())

        rows = feed.pages(spark, str(tmp_path / "in"), stream=True)
        return rows.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()

    put(tmp_path / "in", "p1.json", feature("a"))
    assert feed.keep_running(start, stop, 0.1, errors.append) == 2
    assert got == ["a"] and len(errors) == 2


def test_a_newer_request_cancels_the_older(spark):
    latest = Latest(spark)
    slow = lambda: spark.range(0, 4_000_000_000, 1, 4).selectExpr("sum(sqrt(id) * hash(id))").collect()
    older = latest.request(slow)
    time.sleep(1)
    newer = latest.request(lambda: spark.range(10).count())
    assert newer.result(60) == 10
    with pytest.raises(CancelledError):
        older.result(60)
    failing = latest.request(lambda: spark.sql("SELECT nothing").collect())
    with pytest.raises(Exception, match="nothing"):
        failing.result(60)


def test_colours_follow_the_rule():
    assert len(set(alerts.EVENT_COLOURS.values())) == len(alerts.EVENT_COLOURS) == 18
    assert list(alerts.EVENT_COLOURS) == sorted(alerts.EVENT_COLOURS)
