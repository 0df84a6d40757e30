"""Runs: from a dataset file to results, reports and audit evidence.

Metadata lives in small tables of a catalogue folder, written as JSON lines through Spark; results
are written by Spark, reports by the driver next to them, in any store that Spark reaches.
"""

from __future__ import annotations

import datetime
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.profile import Options, jsonable, profile
from ..operators.rows import ROW
from ..sources import files, readers, store, writers
from ..sources.demo import demo_dataset
from .compiler import StepMetric, execute
from .definition import Pipeline, to_yaml, warnings_of
from .resources import ResourceMonitor
from .watch import RunCancelled, RunTimedOut

STATUSES = ("queued", "running", "completed", "cancelled", "timed_out", "failed")
#: Columns of the catalogue's tables.
TABLES = {
    "datasets": "id string, name string, path string, format string, sha256 string, size_bytes long, row_count long, column_count long, schema_json string, preview_json string, profile_json string, encoding string, delimiter string, status string, duplicate_of string, created_at string",
    "pipelines": "id string, name string, description string, version long, yaml string, definition_json string, checksum string, created_at string",
    "runs": "id string, dataset_id string, pipeline_id string, status string, created_at string, started_at string, finished_at string, input_rows long, output_rows long, quarantined_rows long, duplicate_count long, quality_before double, quality_after double, errors string, warnings string, cancel_requested boolean, metrics_json string",
    "artifacts": "id string, run_id string, name string, path string, sha256 string, size_bytes long, created_at string",
    "review_decisions": "id string, run_id string, group_id string, decision string, canonical_record_id string, created_at string",
}


def now() -> str:
    return datetime.datetime.now(datetime.UTC).isoformat()


class Catalogue:
    """Append-only tables; the newest row of an id is its state."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def append(self, table: str, **row) -> dict:
        row = {"id": uuid.uuid4().hex, "created_at": now()} | row
        schema = T._parse_datatype_string(TABLES[table] + ", version_at long")
        values = tuple(row.get(f.name) if f.name != "version_at" else time.time_ns() for f in schema)
        self.spark.createDataFrame([values], schema).write.mode("append").json(f"{self.root}/{table}")
        return row

    def table(self, table: str) -> DataFrame:
        schema = TABLES[table] + ", version_at long"
        if not readers.exists(self.spark, f"{self.root}/{table}"):
            return self.spark.createDataFrame([], schema).drop("version_at")
        newest = Window.partitionBy("id").orderBy(F.desc("version_at"))
        return self.spark.read.schema(schema).json(f"{self.root}/{table}").withColumn("n", F.row_number().over(newest)).where("n = 1").drop("n", "version_at")

    def get(self, table: str, key: str) -> dict:
        row = self.table(table).where(F.col("id") == key).first()
        if row is None:
            raise KeyError(f"{table}: {key}")
        return row.asDict()

    def add_dataset(self, name: str, stream, most_bytes: int = 100_000_000) -> dict:
        """Store, hash, decode and register an upload; a file that is there already is a duplicate."""
        safe, kind, key = files.sanitize_filename(name), files.validate_extension(name), uuid.uuid4().hex
        path = f"{self.root}/uploads/{key}/original.{kind}"
        checksum, size = store.put_stream(self.spark, stream, path, most_bytes)
        earlier = self.table("datasets").where((F.col("sha256") == checksum) & F.col("duplicate_of").isNull()).first()
        frame, encoding, delimiter = readers.read_dataset(self.spark, path, kind)
        return self.append(
            "datasets", id=key, name=safe, path=path, format=kind, sha256=checksum, size_bytes=size, row_count=frame.count(), column_count=len(frame.columns) - 1,
            schema_json=json.dumps(readers.schema_payload(frame)), preview_json=json.dumps(readers.preview(frame)), encoding=encoding, delimiter=delimiter,
            status="duplicate" if earlier else "ready", duplicate_of=earlier["id"] if earlier else None,
        )

    def add_demo(self, theme: str, rows: int = 1000) -> dict:
        """Make and register a demonstration dataset; one of the same make is not made again."""
        name = f"demo-{theme}-{rows}"
        there = self.table("datasets").where(F.col("name") == name).first()
        if there is not None:
            return there.asDict()
        path = f"{self.root}/uploads/{uuid.uuid4().hex}/original.parquet"
        writers.write_dataset(demo_dataset(self.spark, theme, rows), path)
        frame = readers.read_dataset(self.spark, path, "parquet")[0]
        return self.append(
            "datasets", name=name, path=path, format="parquet", row_count=rows, column_count=len(frame.columns) - 1, schema_json=json.dumps(readers.schema_payload(frame)),
            preview_json=json.dumps(readers.preview(frame)), status="ready",
        )

    def profile_dataset(self, key: str, options: Options | None = None) -> dict:
        row = self.get("datasets", key)
        report = profile(readers.read_dataset(self.spark, row["path"], row["format"])[0], options)
        self.append("datasets", **row | {"profile_json": json.dumps(jsonable(report)), "status": "profiled"})
        return report

    def add_pipeline(self, definition: Pipeline) -> dict:
        return self.append("pipelines", name=definition.name, description=definition.description, version=definition.version, yaml=to_yaml(definition), definition_json=json.dumps(definition.payload()), checksum=definition.checksum)

    def decide(self, run_id: str, group_id: str, decision: str, canonical_record_id: str | None = None) -> dict:
        """A review decision; it never changes data."""
        if decision not in ("accepted", "rejected"):
            raise ValueError("decision must be accepted or rejected")
        return self.append("review_decisions", run_id=run_id, group_id=group_id, decision=decision, canonical_record_id=canonical_record_id)

    def newest(self, table: str, n: int | None = None) -> DataFrame:
        ordered = self.table(table).orderBy(F.desc("created_at"))
        return ordered.limit(n) if n else ordered


def run_figures(rows_in: int, rows_out: int, quarantined: int, seconds: float, before: float, after: float, size_in: int, size_out: int) -> dict:
    return {
        "rows_per_second": round(rows_in / seconds, 2) if seconds > 0 else 0.0,
        "compression_ratio": round(size_in / size_out, 4) if size_out else 0.0,
        "quality_delta": round(after - before, 2),
        "quality_delta_percent": round((after - before) / before * 100, 2) if before else 0.0,
        "data_loss_rows": max(0, rows_in - rows_out - quarantined),
    }


def overview(runs: DataFrame) -> dict:
    """Counts, sums and the latest runs of a run table."""
    total = runs.agg(
        F.count("*").alias("runs"), F.count_distinct(F.when(F.col("status") == "completed", F.col("dataset_id"))).alias("datasets"),
        F.round(F.avg("quality_after"), 2).alias("mean_quality"), F.coalesce(F.sum("duplicate_count"), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum("quarantined_rows"), F.lit(0)).alias("quarantined"), F.max_by("id", "created_at").alias("latest"),
    ).first()
    by_status = {r["status"]: r["count"] for r in runs.groupBy("status").count().collect()}
    series = [r.asDict() for r in runs.orderBy(F.desc("created_at")).limit(20).select("id", "created_at", "quality_before", "quality_after", "output_rows").collect()][::-1]
    return total.asDict() | {"by_status": {s: by_status.get(s, 0) for s in STATUSES}, "series": series}


def execute_run(catalogue: Catalogue, dataset_id: str, definition: Pipeline, out: str, cancelled: Callable[[], bool] | None = None, timeout_seconds: float = 900, pipeline_id: str | None = None, options: Options | None = None) -> dict:
    """Load, profile, run, profile again, write ten artifacts, and record it all. `out` is a folder
    of any store that Spark writes. `checksums.sha256` is written last, with the digests of the others: a
    folder without it is not whole."""
    spark, data = catalogue.spark, catalogue.get("datasets", dataset_id)
    run = catalogue.append("runs", dataset_id=dataset_id, pipeline_id=pipeline_id, status="running", started_at=now(), cancel_requested=False)
    began, metrics, folder = time.perf_counter(), [], f"{out.rstrip('/')}/{run['id']}"
    stopped = lambda: bool(cancelled and cancelled()) or bool(catalogue.get("runs", run["id"])["cancel_requested"])
    try:
        frame, _, _ = readers.read_dataset(spark, data["path"], data["format"])
        before = profile(frame, options)
        with ResourceMonitor(spark) as used:
            done = execute(frame, definition, stopped, timeout_seconds, metrics)
        result, aside = done.frame.persist(), done.quarantine.persist()
        after = profile(result)
        for name, kind in (("result.parquet", "parquet"), ("result.csv", "csv"), ("result.jsonl", "jsonl")):
            writers.write_dataset(result, f"{folder}/{name}", kind)
        writers.write_dataset(aside, f"{folder}/quarantine.parquet")
        sums = {name: store.checksum(spark, f"{folder}/{name}") for name in store.names(spark, folder)}
        rows_out, quarantined, seconds = result.count(), aside.count(), time.perf_counter() - began
        figures = run_figures(before["row_count"], rows_out, quarantined, seconds, before["quality_score"], after["quality_score"], data["size_bytes"], sums["result.parquet"][1])
        figures |= {"steps": done.metrics_payload(), "seconds": round(seconds, 6), "resources": used.report(), "result_preview": readers.preview(result, 25), "quarantine_preview": readers.preview(aside, 25)}

        def write(name: str, text: str) -> None:
            sums[name] = store.put_text(spark, text, f"{folder}/{name}")

        write("quality-report.json", json.dumps(jsonable({"before": before, "after": after}), ensure_ascii=False, indent=2))
        write("performance-report.json", json.dumps(jsonable(figures), ensure_ascii=False, indent=2))
        write("pipeline.yaml", to_yaml(definition))
        write("audit-log.jsonl", "".join(json.dumps(jsonable(m)) + "\n" for m in done.metrics_payload()))
        write("run-manifest.json", json.dumps({"run_id": run["id"], "dataset_id": dataset_id, "dataset_sha256": data["sha256"], "pipeline": definition.name, "pipeline_checksum": definition.checksum, "finished_at": now()}, indent=2))
        write("checksums.sha256", "".join(f"{sums[n][0]}  {n}\n" for n in sorted(sums)))
        for n, (digest, size) in sums.items():
            catalogue.append("artifacts", run_id=run["id"], name=n, path=f"{folder}/{n}", sha256=digest, size_bytes=size)
        for held in (result, aside):
            held.unpersist()
        done.release()
        end = {"status": "completed", "input_rows": before["row_count"], "output_rows": rows_out, "quarantined_rows": quarantined, "duplicate_count": done.duplicate_count, "quality_before": before["quality_score"], "quality_after": after["quality_score"], "warnings": json.dumps(warnings_of(definition) + done.warnings), "metrics_json": json.dumps(jsonable(figures))}
    except RunCancelled as e:
        end = {"status": "cancelled", "errors": str(e)}
    except RunTimedOut as e:
        end = {"status": "timed_out", "errors": str(e)}
    except Exception as e:
        steps = [vars(m) for m in metrics if isinstance(m, StepMetric)]
        end = {"status": "failed", "errors": f"{type(e).__name__}: {e}"[:800], "metrics_json": json.dumps(jsonable({"steps": steps}))}
    return catalogue.append("runs", **run | end | {"finished_at": now()})


def artifact_path(catalogue: Catalogue, artifact_id: str, root: str) -> str:
    """The full path of an artifact, if it lies below the artifact root and is there."""
    path = store.contained(catalogue.spark, catalogue.get("artifacts", artifact_id)["path"], root)
    if not readers.exists(catalogue.spark, path):
        raise FileNotFoundError(path)
    return path


__all__ = ["Catalogue", "ROW", "artifact_path", "execute_run", "overview", "run_figures"]
