"""Sinks: zstd Parquet, JSON lines, and CSV that spreadsheets can open safely."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import protect_cell
from ..operators.rows import named, without_rows

#: Rows of a file of text. Text is several times larger than the columns that a task reads, and a digest takes a
#: file whole, in one task.
ROWS_A_FILE = 100_000


def safe_for_csv(frame: DataFrame, protect: bool = True) -> DataFrame:
    """Texts that look like formulas get a leading quote if they are to be protected; nested values become JSON."""
    out = []
    for f in frame.schema:
        value = named(f.name)
        if isinstance(f.dataType, T.StringType):
            value = protect_cell(value) if protect else value
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            value = F.to_json(value)
        out.append(value.alias(f.name))
    return frame.select(*out)


def write_dataset(frame: DataFrame, path: str, file_format: str = "parquet", protect: bool = True) -> None:
    """Spark's committers make the folder visible only when the write is whole. CSV is for spreadsheets
    unless `protect` is off: then texts are written as they are, to be read back."""
    frame = without_rows(frame)
    if file_format == "parquet":
        frame.write.mode("overwrite").option("compression", "zstd").parquet(path)
    elif file_format == "csv":
        kept = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}  # Spark's writer trims by default
        safe_for_csv(frame, protect).write.mode("overwrite").options(header="true", escape='"', maxRecordsPerFile=ROWS_A_FILE, **kept).csv(path)
    elif file_format == "jsonl":
        frame.write.mode("overwrite").options(ignoreNullFields="false", maxRecordsPerFile=ROWS_A_FILE).json(path)
    else:
        raise ValueError(f"Unsupported export format: {file_format}")
