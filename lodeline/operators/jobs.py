"""Background jobs: a newer one makes older results stale, a result is taken once, cancelling stops its Spark work."""

from __future__ import annotations

import threading
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import SparkSession


class Job:
    def __init__(self, spark: SparkSession | None = None, name: str = "lodeline"):
        self.spark, self.name = spark, name
        self.generation = 0
        self._pool = ThreadPoolExecutor(1, thread_name_prefix=name)
        self._future: Future | None = None
        self._lock = threading.Lock()

    def _tag(self, generation: int) -> str:
        return f"{self.name}-{id(self)}-{generation}"

    def launch(self, work: Callable[[], object]) -> int:
        """Starts work; what was launched before is cancelled and its result never taken."""
        self.cancel()
        with self._lock:
            self.generation += 1
            mine = self.generation

            def run():
                if self.spark is not None:
                    self.spark.addTag(self._tag(mine))
                try:
                    return mine, work()
                finally:
                    if self.spark is not None:
                        self.spark.removeTag(self._tag(mine))

            self._future = self._pool.submit(run)
        return mine

    @property
    def busy(self) -> bool:
        return self._future is not None and not self._future.done()

    def cancel(self) -> None:
        with self._lock:
            if self._future is not None and not self._future.done():
                self._future.cancel()
                if self.spark is not None:
                    self.spark.interruptTag(self._tag(self.generation))
            self._future = None
            self.generation += 1

    def take(self, timeout: float | None = None):
        """The result of the latest launch, once; None before it is there or after it was taken. Its failure is raised."""
        future = self._future
        if future is None or (timeout is None and not future.done()):
            return None
        try:
            generation, result = future.result(timeout)
        finally:
            if future.done() and self._future is future:
                self._future = None
        return result if generation == self.generation else None

    def progress(self) -> tuple[int, int]:
        """(finished, all) tasks of the Spark work under way."""
        if self.spark is None:
            return 0, 0
        tracker = self.spark.sparkContext.statusTracker()
        done = total = 0
        for stage in tracker.getActiveStageIds():
            if (info := tracker.getStageInfo(stage)) is not None:
                done, total = done + info.numCompletedTasks, total + info.numTasks
        return done, total
