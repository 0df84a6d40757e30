"""What a run uses: memory and CPU of the driver, and what Spark reports of its executors."""

from __future__ import annotations

import os
import threading
import time

from pyspark.sql import SparkSession


def resident_bytes(pid: int | str = "self") -> int:
    """Resident memory of a process, 0 where the system does not tell."""
    try:
        with open(f"/proc/{pid}/statm") as file:
            return int(file.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")
    except (OSError, ValueError, IndexError):
        return 0


class ResourceMonitor:
    """Samples while it is entered. The Python process of the driver is watched by a thread; its JVM
    and the executors are asked at the end, as their counters only grow or hold peaks."""

    def __init__(self, spark: SparkSession, interval: float = 0.25):
        self.spark, self.interval = spark, interval
        self.peak = self.samples = 0
        self._over = threading.Event()
        self._thread = threading.Thread(target=self._watch, daemon=True)

    def _sample(self) -> None:
        self.peak = max(self.peak, resident_bytes())
        self.samples += 1

    def _watch(self) -> None:
        while not self._over.wait(self.interval):
            self._sample()

    def _executors(self) -> dict[str, int]:
        """Sums over the executors since the application began."""
        found = self.spark.sparkContext._jsc.sc().statusStore().executorList(False)
        each = [found.apply(i) for i in range(found.size())]
        return {
            "tasks": sum(e.totalTasks() for e in each), "task_ms": sum(e.totalDuration() for e in each), "gc_ms": sum(e.totalGCTime() for e in each),
            "shuffle_read_bytes": sum(e.totalShuffleRead() for e in each), "shuffle_write_bytes": sum(e.totalShuffleWrite() for e in each),
        }

    def __enter__(self) -> ResourceMonitor:
        self.before, self.cpu, self.began = self._executors(), time.process_time(), time.perf_counter()
        self._sample()
        self._thread.start()
        return self

    def __exit__(self, *error) -> None:
        self._over.set()
        self._thread.join()
        self._sample()
        self.seconds, self.cpu = time.perf_counter() - self.began, time.process_time() - self.cpu
        self.after = self._executors()

    def report(self) -> dict[str, float]:
        runtime = self.spark._jvm.java.lang.Runtime.getRuntime()
        used = {f"executor_{k}": v - self.before[k] for k, v in self.after.items()}
        return {
            "seconds": round(self.seconds, 6), "samples": self.samples, "driver_peak_rss_bytes": self.peak, "driver_cpu_seconds": round(self.cpu, 6),
            "driver_cpu_percent": round(100 * self.cpu / max(self.seconds, 1e-9), 2), "driver_heap_bytes": runtime.totalMemory() - runtime.freeMemory(), **used,
        }
