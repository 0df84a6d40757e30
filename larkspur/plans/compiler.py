"""Pipeline definitions to DataFrame plans.

Compilation walks the ordered steps and threads one frame through them; no job runs for it, except
that a duplicate step counts its blocks. `execute` adds metrics, and ends a run that is cancelled or over its time.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cleaning, dedup, validate
from ..operators.profile import row_hash
from ..operators.rows import ROW, dense_rows, visible
from ..session import ship_package
from .definition import Pipeline, Step
from .watch import Watch


@dataclass
class Applied:
    frame: DataFrame
    quarantined: DataFrame | None = None
    duplicates: dedup.Duplicates | None = None


def _address(f, c):
    return validate.normalize_address(f, c["street_column"], c["city_column"], c["postal_code_column"], c["country_column"])


def _coordinates(f, c):
    return validate.validate_coordinates(f, c["latitude_column"], c["longitude_column"], c["auto_swap"])


def _crs(f, c):
    return validate.transform_crs(f, c["x_column"], c["y_column"], c["source_crs"], c["target_crs"], c["output_x_column"], c["output_y_column"])


def _distance(f, c):
    return validate.calculate_distance(f, c["reference_latitude"], c["reference_longitude"], c["latitude_column"], c["longitude_column"], c["output_column"])


#: A row's hash before a step, while that step is counted.
HASH = "__row_hash"
#: Steps that turn one frame into one frame.
PLAIN: dict[str, Callable] = {
    "load_dataset": lambda f, c: f,
    "export_dataset": lambda f, c: f,
    "select_columns": lambda f, c: cleaning.select_columns(f, c["columns"]),
    "rename_columns": lambda f, c: cleaning.rename_columns(f, c["mapping"]),
    "cast_types": lambda f, c: cleaning.cast_types(f, c["mapping"], c["strict"]),
    "normalize_unicode": lambda f, c: cleaning.normalize_unicode(f, c["columns"]),
    "trim_whitespace": lambda f, c: cleaning.trim_whitespace(f, c["columns"]),
    "replace_values": lambda f, c: cleaning.replace_values(f, c["columns"], c["mapping"]),
    "parse_dates": lambda f, c: cleaning.parse_dates(f, c["columns"], c["formats"]),
    "handle_missing_values": lambda f, c: cleaning.handle_missing(f, c["columns"], c["strategy"], c["value"]),
    "normalize_address": _address,
    "validate_postal_code": lambda f, c: validate.validate_postal_code(f, c["column"], c["country"], c["output_column"]),
    "validate_coordinates": _coordinates,
    "transform_crs": _crs,
    "calculate_distance": _distance,
    "filter_rows": lambda f, c: cleaning.filter_rows(f, c["column"], c["operator"], c["value"]),
    "add_calculated_column": lambda f, c: cleaning.calculated_column(f, c["output_column"], c["operation"], c["columns"], c["separator"]),
}
#: Steps whose result for a row depends on that row alone; these run on streams too.
STATELESS = frozenset(PLAIN) - {"handle_missing_values"}


def apply_step(frame: DataFrame, step: Step) -> Applied:
    if step.type in PLAIN:
        return Applied(PLAIN[step.type](frame, step.config))
    if step.type == "detect_duplicates":
        found = dedup.detect_duplicates(frame, dedup.Matching(**step.config))
        return Applied(found.frame, duplicates=found)
    if step.type == "quarantine_invalid_rows":
        stay, aside = validate.quarantine(frame, step.config["condition"], step.config["required_columns"])
        return Applied(stay, aside)
    raise ValueError(f"Unsupported pipeline step: {step.type}")


def compile_plan(frame: DataFrame, definition: Pipeline) -> tuple[DataFrame, DataFrame]:
    """(result, quarantine) as lazy frames."""
    aside = []
    ship_package(frame.sparkSession)
    for step in definition.ordered():
        if step.enabled:
            done = apply_step(frame, step)
            frame = done.frame
            if done.quarantined is not None:
                aside.append(done.quarantined)
    return frame, quarantine_of(frame, aside)


def quarantine_of(frame: DataFrame, aside: list[DataFrame]) -> DataFrame:
    if aside:
        return validate.union_all(aside)
    return frame.withColumn("quarantine_reason", F.lit(None).cast("string")).where(F.lit(False))


@dataclass
class StepMetric:
    step_id: str
    step_type: str
    name: str
    duration_seconds: float
    input_rows: int
    output_rows: int
    changed_rows: int
    quarantined_rows: int
    warnings: list[str] = field(default_factory=list)
    error: str | None = None


@dataclass
class Outcome:
    frame: DataFrame
    quarantine: DataFrame
    metrics: list[StepMetric]
    warnings: list[str]
    duplicate_count: int
    held: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Let go of the persisted frames that the results read."""
        for frame in self.held:
            frame.unpersist()

    def metrics_payload(self) -> list[dict]:
        return [{**asdict(m), "duration_seconds": round(m.duration_seconds, 6)} for m in self.metrics]


def execute(
    frame: DataFrame,
    definition: Pipeline,
    cancelled: Callable[[], bool] | None = None,
    timeout_seconds: float = 900,
    metrics: list[StepMetric] | None = None,
) -> Outcome:
    """Step by step, with row counts after each. A frame is persisted until the next one is there, so
    a count does not run the plan again; `Outcome.release` lets go of the last ones. Rows that a step
    changed are counted in the same pass as its rows, by a hash that travels with each row. A run that
    is cancelled or over its time ends inside a step too. After an error nothing stays persisted.
    Without metrics, use compile_plan. `metrics` may be given so that they are there after an error."""
    ship_package(frame.sparkSession)
    kept: list[DataFrame] = []
    try:
        with Watch(frame.sparkSession, cancelled, timeout_seconds) as watch:
            return _execute(frame, definition, watch, [] if metrics is None else metrics, kept)
    except Exception:
        for held in kept:
            held.unpersist()
        raise


def _execute(frame: DataFrame, definition: Pipeline, watch: Watch, metrics: list[StepMetric], kept: list[DataFrame]) -> Outcome:
    """`kept` lists every frame that was persisted."""
    current = dense_rows(frame).persist()
    kept.append(current)
    height, aside, warnings, duplicates = current.count(), [], [], 0
    persisted, held = current, []
    for step in definition.ordered():
        if not step.enabled:
            continue
        watch.check()
        started, before = time.perf_counter(), persisted
        metric = StepMetric(step.id, step.type, step.name, 0.0, height, height, 0, 0)
        metrics.append(metric)
        try:
            names = visible(current)
            done = apply_step(current.withColumn(HASH, row_hash(names)) if step.type in PLAIN else current, step)
            if done.quarantined is not None:
                done.quarantined.persist()
                held.append(done.quarantined)
                kept.append(done.quarantined)
                metric.quarantined_rows = done.quarantined.count()
                if metric.quarantined_rows:
                    aside.append(done.quarantined)
            persisted = done.frame.persist()
            kept.append(persisted)
            same = [c for c in visible(persisted) if c != HASH] == names
            differs = F.count_if(F.col(HASH) != row_hash(names)) if same and HASH in persisted.columns else F.lit(0)
            metric.output_rows, changed = persisted.agg(F.count("*"), differs).first()
            metric.changed_rows = changed if same and metric.output_rows == height else max(height, metric.output_rows)
            current = persisted.drop(HASH)
            if done.duplicates is not None:
                duplicates = max(duplicates, current.where("duplicate_group_id is not null").count())
                skipped = done.duplicates.blocks.where("oversized").count()
                if skipped:
                    metric.warnings.append(f"Skipped {skipped} oversized duplicate blocks")
        except Exception as e:
            e = watch.reason or e
            metric.error = f"{type(e).__name__}: {e}"
            raise
        finally:
            metric.duration_seconds = time.perf_counter() - started
        warnings += metric.warnings
        height = metric.output_rows
        before.unpersist()
    return Outcome(current.drop(ROW), quarantine_of(current, aside).drop(ROW), metrics, warnings, duplicates, [*held, persisted])
