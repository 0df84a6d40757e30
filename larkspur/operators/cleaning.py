"""Projection, cleaning, filter and calculation steps as single projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from .rows import ROW, dense_rows, named, require, visible

#: Cast targets by name.
TARGETS = {"string": "string", "integer": "bigint", "float": "double", "boolean": "boolean", "date": "date", "datetime": "timestamp_ntz"}
#: Directives of strptime and the same in Java's pattern letters (one or two digits where both allow it).
DIRECTIVES = {"Y": "yyyy", "m": "M", "d": "d", "y": "yy", "H": "H", "M": "m", "S": "s", "b": "MMM", "B": "MMMM", "j": "DDD", "%": "%"}
#: Rows of a block of the two-pass fill.
FILL_BLOCK = 1_000_000


def select_columns(frame: DataFrame, columns: list[str]) -> DataFrame:
    require(frame, columns)
    kept = [ROW] if ROW in frame.columns else []
    return frame.select(*[named(c) for c in columns], *kept)


def rename_columns(frame: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """All at once, so that names can be swapped."""
    require(frame, mapping)
    names = [mapping.get(c, c) for c in frame.columns]
    if len(set(names)) < len(names):
        raise ValueError("Renamed columns would not be unique")
    return frame.select(*[named(c).alias(n) for c, n in zip(frame.columns, names)])


def replaced(frame: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Columns of the same names replaced in place, others added at the end."""
    return frame.select(*[new[c].alias(c) if c in new else named(c) for c in frame.columns], *[v.alias(c) for c, v in new.items() if c not in frame.columns])


def _loose(value: Column, kind: T.DataType, target: str) -> Column:
    """Null where the value has no exact form in the target type."""
    if not isinstance(kind, T.StringType):
        return value.try_cast(TARGETS[target]) if target != "string" else value.cast("string")
    shape = {"integer": "\\A[+-]?\\d+\\z", "float": "(?i)\\A(?:[+-]?(?:\\d+(?:\\.\\d*)?|\\.\\d+)(?:e[+-]?\\d+)?|[+-]?inf(?:inity)?|nan)\\z", "boolean": "\\A(?:true|false)\\z"}.get(target)
    cast = value.try_cast(TARGETS[target])
    return F.when(value.rlike(shape), cast) if shape else cast


def cast_types(frame: DataFrame, mapping: dict[str, str], strict: bool = False) -> DataFrame:
    """Not strict: null on failure. Strict: a value that fails ends the run."""
    require(frame, mapping)
    new = {}
    for column, target in mapping.items():
        value = named(column)
        cast = _loose(value, frame.schema[column].dataType, target)
        if strict:
            message = F.concat(F.lit(f"cannot cast {column} to {target}: "), value.cast("string"))
            cast = F.when(value.isNotNull() & cast.isNull(), F.raise_error(message).cast(TARGETS[target])).otherwise(cast)
        new[column] = cast
    return replaced(frame, new)


def normalize_unicode(frame: DataFrame, columns: list[str]) -> DataFrame:
    require(frame, columns)
    return replaced(frame, {c: text.normalize_unicode(named(c)) for c in columns})


def trim_whitespace(frame: DataFrame, columns: list[str]) -> DataFrame:
    require(frame, columns)
    return replaced(frame, {c: text.trim_whitespace(named(c)) for c in columns})


def replace_values(frame: DataFrame, columns: list[str], mapping: dict) -> DataFrame:
    """Exact replacement; keys are compared in the column's type, and unmapped values stay."""
    require(frame, columns)
    new = {}
    for c in columns:
        kind, value = frame.schema[c].dataType, named(c)
        result = value
        for old, fresh in reversed(mapping.items()):
            key = F.lit(str(old)).try_cast(kind)
            result = F.when(value.eqNullSafe(key) & key.isNotNull(), F.lit(fresh).cast(kind)).otherwise(result)
        new[c] = result
    return replaced(frame, new)


def java_pattern(form: str) -> str:
    """A strptime form in Java's pattern letters."""
    out, i = [], 0
    while i < len(form):
        if form[i] == "%":
            letter = form[i + 1 : i + 2]
            if letter not in DIRECTIVES:
                raise ValueError(f"Unsupported date directive: %{letter}")
            out.append(DIRECTIVES[letter])
            i += 2
        else:
            out.append(f"'{form[i]}'" if form[i].isalpha() else "''" if form[i] == "'" else form[i])
            i += 1
    return "".join(out)


def parse_dates(frame: DataFrame, columns: list[str], formats: list[str]) -> DataFrame:
    """The first form that fits wins."""
    require(frame, columns)
    patterns = [java_pattern(f) for f in formats]
    return replaced(frame, {c: F.coalesce(*[F.expr(f"try_to_date(cast(`{c}` as string), {_quoted(p)})") for p in patterns]) for c in columns})


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def handle_missing(frame: DataFrame, columns: list[str], strategy: str, value=None) -> DataFrame:
    columns = columns or visible(frame)
    require(frame, columns)
    if strategy == "drop":
        return frame.dropna(how="any", subset=[c if "." not in c else f"`{c}`" for c in columns])
    if strategy == "fill":
        return replaced(frame, {c: F.coalesce(named(c), F.lit(value).cast(frame.schema[c].dataType)) for c in columns})
    return fill_along(frame, columns, forward=strategy == "forward_fill")


def fill_along(frame: DataFrame, columns: list[str], forward: bool) -> DataFrame:
    """Unlimited fill in row order, in two passes: rows form blocks of FILL_BLOCK, each block fills
    itself, and what enters a block comes from a table with one row a block. No task holds more than
    a block, whatever the number of rows."""
    had_rows = ROW in frame.columns
    dense = frame if had_rows else dense_rows(frame)
    block = F.floor(F.col(ROW) / FILL_BLOCK) if not had_rows else F.floor(F.col(ROW) / F.lit(FILL_BLOCK))
    marked = dense.withColumn("__block", block)
    order = F.col(ROW).asc() if forward else F.col(ROW).desc()
    inside = Window.partitionBy("__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    at = F.col(ROW) if forward else -F.col(ROW)
    ends = marked.groupBy("__block").agg(*[F.max_by(named(c), F.when(named(c).isNotNull(), at)).alias(f"__end_{i}") for i, c in enumerate(columns)])
    between = Window.orderBy(F.col("__block").asc() if forward else F.col("__block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    entering = ends.select(F.col("__block").alias("__b"), *[F.last(f"__end_{i}", True).over(between).alias(f"__in_{i}") for i in range(len(columns))])
    joined = marked.join(entering, F.col("__block") == F.col("__b"), "left")
    filled = replaced(joined, {c: F.coalesce(F.last(named(c), True).over(inside), F.col(f"__in_{i}")) for i, c in enumerate(columns)})
    return filled.select(*[named(c) for c in frame.columns])


def filter_rows(frame: DataFrame, column: str, operator: str, value=None) -> DataFrame:
    """Rows for which the comparison holds; null never does, except for is_null."""
    require(frame, [column])
    left = named(column)
    if operator == "is_null":
        return frame.where(left.isNull())
    if operator == "contains":
        return frame.where(left.cast("string").contains(str(value)))
    if operator == "in":
        return frame.where(left.isin(*(value if isinstance(value, list) else [value])))
    right = F.lit(value)
    return frame.where({"eq": left == right, "ne": left != right, "gt": left > right, "gte": left >= right, "lt": left < right, "lte": left <= right}[operator])


def calculated_column(frame: DataFrame, output: str, operation: str, columns: list[str], separator: str = " ") -> DataFrame:
    require(frame, columns)
    first = named(columns[0]).cast("string")
    if operation == "concat":
        value = F.concat_ws(separator, *[named(c).cast("string") for c in columns])
    elif operation == "coalesce":
        value = F.coalesce(*[named(c) for c in columns])
    else:
        value = {"lower": F.lower(first), "upper": F.upper(first), "length": F.char_length(first).cast("long")}[operation]
    return replaced(frame, {output: value})
