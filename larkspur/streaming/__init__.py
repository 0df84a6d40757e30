"""The stateless steps of a pipeline on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.compiler import STATELESS, apply_step
from ..plans.definition import Pipeline


def stream_pipeline(stream: DataFrame, definition: Pipeline) -> tuple[DataFrame, list[DataFrame]]:
    """(result, quarantined streams). Steps that need the order of rows or whole groups are refused;
    each quarantine step gives a second stream of the rows it sets aside."""
    aside = []
    for step in definition.ordered():
        if not step.enabled:
            continue
        if step.type not in STATELESS and step.type != "quarantine_invalid_rows":
            raise ValueError(f"step {step.id}: {step.type} cannot run on a stream")
        done = apply_step(stream, step)
        stream = done.frame
        if done.quarantined is not None:
            aside.append(done.quarantined)
    return stream, aside
