"""Shared plumbing of the training-data operators: working tables, Arrow batches, Python workers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package

#: Rows and bytes of text per Arrow batch. Python tasks hold one batch at a time, so this bounds
#: their memory to the larger of BATCH_BYTES and the longest text.
TEXT_ROWS = 256
BATCH_BYTES = 4 << 20


#: The folder made for a local session without `spark.checkpoint.dir`.
_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, or the context's checkpoint
    folder. Only a local session without either gets a temporary one."""
    global _own_dir
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if _own_dir is None:
            _own_dir = tempfile.mkdtemp(prefix="larkspur-")
        found = _own_dir
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/larkspur/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder in any store that Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _folder_of(file: str) -> str | None:
    """The name of the working table that a file belongs to."""
    return file.rsplit("/larkspur/", 1)[1].split("/", 1)[0] if "/larkspur/" in file else None


class Work:
    """The working tables of one run of an operator.

    `cut` writes a frame to the shared folder and reads it back, so that no later stage depends on
    shuffle files or memory of an executor that may be lost. `drop` deletes what is not needed any
    more: operators keep only the tables that the frame they return reads, and `release` deletes
    those when that frame is done with. Each run has its own list, so runs do not disturb each other.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def cut(self, frame: DataFrame, name: str) -> DataFrame:
        path = scratch(self.spark, name)
        self.paths.append(path)
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def bucketed(self, frame: DataFrame, name: str, *keys: str) -> DataFrame:
        """Like `cut`, with the rows dealt to as many buckets by `keys` as the session has shuffle
        partitions: later joins and groups by these keys do not move the rows again. The table needs
        no entry in the catalogue once it is read."""
        path, n = scratch(self.spark, name), int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.paths.append(path)
        table = f"larkspur_{uuid.uuid4().hex}"
        frame.repartition(n, *keys).write.bucketBy(n, *keys).option("path", path).option("compression", "zstd").saveAsTable(table)
        out = self.spark.table(table)
        self.spark.sql(f"DROP TABLE {table}")
        return out

    def drop(self, *frames: DataFrame, keep: tuple[DataFrame, ...] | None = None) -> None:
        """Delete the tables that `frames` read, or all but those that `keep` reads."""
        used = {_folder_of(f) for frame in (frames if keep is None else keep) for f in frame.inputFiles()}
        gone = [p for p in self.paths if (p.rsplit("/", 1)[1] in used) == (keep is None)]
        for path in gone:
            remove_path(self.spark, path)
            self.paths.remove(path)


def release(frame: DataFrame) -> None:
    """Delete the tables below the shared folder that a frame reads: what an operator left for its
    result, and an earlier result that it was made from. For callers that have done with it, say
    after writing it; inputs elsewhere stay."""
    spark = frame.sparkSession
    top = f"{shared_dir(spark)}/larkspur/"
    for name in {_folder_of(f) for f in frame.inputFiles()} - {None}:
        remove_path(spark, top + name)


def small_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Make the session fit for Python tasks on texts: the package on the workers, and Arrow batches
    of `rows` and BATCH_BYTES at most; smaller settings stay."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def by_size(spark: SparkSession) -> None:
    """Let adaptive execution merge small partitions up to the advisory size, whatever the number of
    cores: iterative operators write many small tables, and each task there costs two files."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """A task function that gives freed memory back to the system when the task ends. Workers are
    used again by later tasks and operators, and neither Arrow nor the C library does it by itself."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                import ctypes

                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return task
