"""One place for the session settings that the engine expects."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Applications whose workers have the package.
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Send the package to the Python workers, once an application: they may run where the driver's
    import path does not reach."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        top = Path(__file__).resolve().parent
        if top.is_dir():  # else the package comes from such an archive already
            archive = Path(tempfile.mkdtemp(prefix="larkspur-package-")) / "larkspur.zip"
            with zipfile.ZipFile(archive, "w") as out:
                for file in sorted(top.rglob("*.py")):
                    out.write(file, file.relative_to(top.parent))
            context.addPyFile(str(archive))
        _shipped.add(context.applicationId)
    return spark


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path that driver and executors share: below `spark.checkpoint.dir`, or a temporary folder
    of a local session."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="larkspur-")
    return f"{top.rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


#: ANSI casts, UTC and adaptive execution are what the operators are written for.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def build_session(
    name: str = "larkspur", master: str | None = None, extra: dict[str, str] | None = None
) -> SparkSession:
    """A session with SETTINGS; `extra` wins over them."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | (extra or {})).items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return ship_package(session)
