"""Ends a run's Spark jobs from outside, also in the middle of a step."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


class RunCancelled(RuntimeError):
    pass


class RunTimedOut(TimeoutError):
    pass


class Watch:
    """While it is open, the jobs of this thread carry a tag of their own, and a thread beside it looks
    every `every` seconds whether the run is cancelled or over its time. If so, it interrupts the
    tagged jobs until the watch is closed, and the error that they fail with becomes RunCancelled or
    RunTimedOut. An error of `cancelled` itself ends the run in the same way. Work that ends before it
    could be interrupted stands; other jobs of the session are not touched."""

    def __init__(self, spark: SparkSession, cancelled: Callable[[], bool] | None = None, timeout_seconds: float = 900, every: float = 0.5):
        self.context, self.cancelled, self.timeout_seconds, self.every = spark.sparkContext, cancelled, timeout_seconds, every
        self.tag = f"run-{uuid.uuid4().hex}"
        self.began = time.perf_counter()
        self.reason: Exception | None = None
        self.closed = threading.Event()
        self.thread = threading.Thread(target=self._look, name=self.tag, daemon=True)

    def check(self) -> None:
        """Raises if the run has to end now."""
        if self.cancelled and self.cancelled():
            raise RunCancelled("The run was cancelled")
        if time.perf_counter() - self.began > self.timeout_seconds:
            raise RunTimedOut(f"The run took longer than {self.timeout_seconds:g} seconds")

    def _look(self) -> None:
        while not self.closed.wait(self.every):
            if self.reason is None:
                try:
                    self.check()
                except Exception as e:
                    self.reason = e
            if self.reason is not None:
                self.context.cancelJobsWithTag(self.tag)

    def __enter__(self) -> Watch:
        self.context.addJobTag(self.tag)
        self.thread.start()
        return self

    def __exit__(self, kind, error, trace) -> None:
        self.closed.set()
        self.thread.join()
        self.context.removeJobTag(self.tag)
        if isinstance(error, Exception) and self.reason is not None and not isinstance(error, (RunCancelled, RunTimedOut)):
            raise self.reason from error
