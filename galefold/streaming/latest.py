"""Requests of which only the newest counts: a newer one cancels the Spark jobs of the older."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import CancelledError, Future
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


class Latest:
    """Runs requests in threads of their own, each under a job tag.

    request(f) gives a Future of f(). An older request that is still at work ends as cancelled:
    its running jobs are stopped by tag, again and again until it has ended, since it may
    be between two jobs; work that needs no job runs on, but its result is dropped.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self._lock = spark, threading.Lock()
        self._running: tuple[str, Future, threading.Event] | None = None

    def request(self, f: Callable[[], Any]) -> Future:
        tag, future, stale = f"latest-{uuid.uuid4().hex}", Future(), threading.Event()
        with self._lock:
            older, self._running = self._running, (tag, future, stale)

        def run() -> None:
            sc = self.spark.sparkContext
            sc.addJobTag(tag)
            result, error = None, None
            try:
                if not stale.is_set():
                    result = f()
            except Exception as e:  # noqa: BLE001  (it is handed on)
                error = e
            finally:
                sc.removeJobTag(tag)
            if stale.is_set():
                future.set_exception(CancelledError("a newer request came"))
            elif error is not None:
                future.set_exception(error)
            else:
                future.set_result(result)

        if older is not None and not older[1].done():
            older[2].set()
            threading.Thread(target=self._cancel, args=older[:2], daemon=True).start()
        threading.Thread(target=inheritable_thread_target(self.spark)(run), daemon=True).start()
        return future

    def _cancel(self, tag: str, future: Future) -> None:
        waiting = threading.Event()
        while not future.done():
            self.spark.sparkContext.cancelJobsWithTag(tag)
            waiting.wait(0.1)
