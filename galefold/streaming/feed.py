"""Alert feeds: pages of GeoJSON as a batch and streaming source, alerts that expire by timers, a poller that outlives errors."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from . import alerts

FEED = "feed_seq string, event string, feature string"


class Page(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


class _Pages:
    """The pages (*.json or *.geojson) of a folder, in any file system that Arrow reads; their names must ascend as they come."""

    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("the folder of the pages is missing: load(path) or option path")
        self.path = options["path"]
        names = [e.strip() for e in options.get("events", "").split(",") if e.strip()]
        self.events = set(names) or None

    def _folder(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def names(self) -> list[str]:
        from pyarrow import fs

        system, folder = self._folder()
        found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == fs.FileType.File and f.base_name.endswith((".json", ".geojson")) and not f.base_name.startswith((".", "_")))

    def rows(self, name: str) -> Iterator[tuple]:
        system, folder = self._folder()
        with system.open_input_stream(f"{folder.rstrip('/')}/{name}") as f:
            page = json.loads(f.read())
        for place, feature in enumerate(page.get("features") or []):
            event = ((feature or {}).get("properties") or {}).get("event") or ""
            if self.events is None or event in self.events:
                yield f"{name}:{place:08d}", event, json.dumps(feature, ensure_ascii=False)


class PagesReader(DataSourceReader):
    """All pages there are, one a task; conditions on `event` (= or IN) are applied as pages are read."""

    def __init__(self, options: dict):
        self.pages = _Pages(options)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else f.value if isinstance(f, In) else None
            if values is not None and f.attribute == ("event",):
                own = set(values)
                self.pages.events = own if self.pages.events is None else self.pages.events & own
            else:
                yield f

    def partitions(self) -> list[Page]:
        return [Page(n) for n in self.pages.names()]

    def read(self, partition: Page) -> Iterator[tuple]:
        return self.pages.rows(partition.name) if partition is not None else iter(())


class PagesStream(DataSourceStreamReader):
    """An offset is the name of the last page taken, so a restart goes on right after it."""

    def __init__(self, options: dict):
        self.pages = _Pages(options)

    def initialOffset(self) -> dict:
        return {"upto": ""}

    def latestOffset(self) -> dict:
        names = self.pages.names()
        return {"upto": names[-1] if names else ""}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [Page(n) for n in self.pages.names() if start["upto"] < n <= end["upto"]]

    def read(self, partition: Page) -> Iterator[tuple]:
        return self.pages.rows(partition.name)


class GeoJsonPages(DataSource):
    """`spark.read` or `spark.readStream.format("geojson_pages").load(folder)`: feed_seq (page and place), event, feature (its JSON).

    Option events: names, with commas between, to which the feed is narrowed before rows are made
    (a stream pushes no filters down). A page without features gives no rows; one that isn't JSON
    fails the read.
    """

    @classmethod
    def name(cls) -> str:
        return "geojson_pages"

    def schema(self) -> str:
        return FEED

    def reader(self, schema) -> PagesReader:
        return PagesReader(dict(self.options))

    def streamReader(self, schema) -> PagesStream:
        return PagesStream(dict(self.options))


def pages(spark: SparkSession, folder: str, events: list[str] | None = None, stream: bool = False) -> DataFrame:
    """Alerts of a folder's pages as columns (see alerts.parse_features), with feed_seq."""
    spark.dataSource.register(GeoJsonPages)
    reader = (spark.readStream if stream else spark.read).format("geojson_pages")
    reader = reader.option("events", ",".join(events)) if events else reader
    rows = reader.load(folder)
    return alerts.parse_features(rows, keep=("feed_seq",))


# -- expiry ------------------------------------------------------------------------------------


class Expiring(StatefulProcessor):
    """One alert an id: the first row stays until its timer goes off."""

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "event string, effective timestamp, expires timestamp, geojson string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first = None
        for row in rows:  # of the rows of one batch the first in the feed's order
            if first is None or row.feed_seq < first.feed_seq:
                first = row
        if first is None or self.held.exists():
            return
        self.held.update((first.event, first.effective, first.expires, first.geojson))
        if first.expires is not None:
            # An alert that has expired already comes in, and goes with the next batch.
            self.handle.registerTimer(max(int(first.expires.timestamp() * 1000), timerValues.getCurrentProcessingTimeInMs() + 1))
        yield Row(nws_id=key[0], event=first.event, effective=first.effective, expires=first.expires, geojson=first.geojson, action="add")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.held.exists():
            event, effective, expires, geojson = self.held.get()
            self.held.clear()
            yield Row(nws_id=key[0], event=event, effective=effective, expires=expires, geojson=geojson, action="remove")

    def close(self) -> None:
        pass


CHANGES = "nws_id string, event string, effective timestamp, expires timestamp, geojson string, action string"
_STORE = "spark.sql.streaming.stateStore.providerClass"


def expiring_alerts(feed: DataFrame) -> DataFrame:
    """Changes to the table of alerts: a row with action add for each id that isn't held, and one with remove when it expires.

    The removal comes by a processing-time timer, with or without new rows; after it the id may
    come in again. An alert without an expiry stays. feed: a stream with feed_seq and alerts.COLUMNS. Sets the
    session's state store to RocksDB, which timers need.
    """
    feed.sparkSession.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = alerts.usable(feed).select("feed_seq", *alerts.COLUMNS)
    return rows.groupBy("nws_id").transformWithState(statefulProcessor=Expiring(), outputStructType=CHANGES, outputMode="Append", timeMode="ProcessingTime")


# -- polling -----------------------------------------------------------------------------------


def keep_running(start: Callable[[], StreamingQuery], stop: threading.Event, pause_s: float = 60.0, on_error: Callable[[Exception], None] = print) -> int:
    """Run a stream until `stop` is set, and start it again from its checkpoint, pause_s later, whenever it fails or can't start: how often it failed."""
    failures = 0
    while not stop.is_set():
        try:
            query = start()
            while query.isActive and not stop.wait(0.2):
                pass
            if query.isActive:
                query.stop()
            elif query.exception() is not None:
                raise query.exception()
            else:
                return failures  # it has ended by itself
        except Exception as error:  # noqa: BLE001  (a poll that fails must not end the poller)
            failures += 1
            on_error(error)
            stop.wait(pause_s)
    return failures
