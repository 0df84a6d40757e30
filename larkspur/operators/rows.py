"""Row order as a column.

Frames have no order, yet fills, "first" choices and default record ids depend on it. The hidden
column ROW carries the position: sources attach it, steps keep it, sinks drop it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = "__row_id"


def with_rows(frame: DataFrame) -> DataFrame:
    """The frame with ROW: increasing in the order of the source, not dense."""
    return frame if ROW in frame.columns else frame.withColumn(ROW, F.monotonically_increasing_id())


def without_rows(frame: DataFrame) -> DataFrame:
    return frame.drop(ROW)


def dense_rows(frame: DataFrame) -> DataFrame:
    """ROW as 0, 1, 2, ... Runs one small job: the number of rows in each partition is all that
    reaches the driver."""
    marked = frame.drop(ROW).withColumn(ROW, F.monotonically_increasing_id())
    counts = marked.groupBy(F.shiftright(ROW, 33).alias("p")).count().collect()
    before, total = [], 0
    for r in sorted(counts, key=lambda r: r["p"]):
        before.append((r["p"], total))
        total += r["count"]
    if not before:
        return marked
    starts = marked.sparkSession.createDataFrame(before, "__p long, __before long")
    local = F.col(ROW).bitwiseAND(F.lit((1 << 33) - 1))
    joined = marked.join(F.broadcast(starts), F.shiftright(ROW, 33) == F.col("__p"))  # one row a partition
    return joined.withColumn(ROW, F.col("__before") + local).drop("__p", "__before")


def visible(frame: DataFrame) -> list[str]:
    return [c for c in frame.columns if c != ROW]


def named(column: str):
    """A column by its exact name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def require(frame: DataFrame, columns, text: str = "Columns not found") -> None:
    missing = sorted(set(columns) - set(frame.columns))
    if missing:
        raise ValueError(f"{text}: {', '.join(missing)}")
