"""Profile and quality score of a frame.

A fixed number of passes over the (sampled) rows, whatever the number of columns: one wide aggregation
of counts, extremes and validity, one unpivot to (column, value) whose grouped counts give distinct and
top values, up to seven for the statistics of numbers, one for identical rows, and one look at the first
rows. Only a column whose first values are rare costs another look. Only aggregates and the first rows
reach the driver.
"""

from __future__ import annotations

import datetime
import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import address, geo
from .rows import ROW, named, visible

#: Parts of a digit in radix selection, and how many values the driver takes when no more are left.
DIGITS, FEW = 4096, 20_000
#: First rows that are looked at for sample values, and how many of these a column gets.
FIRST_ROWS, SAMPLE_VALUES = 200, 5
#: Column names that hold postal codes or coordinates.
POSTAL_NAMES, LATITUDE_NAMES, LONGITUDE_NAMES = ("plz", "zip"), ("latitude", "lat"), ("longitude", "lon", "lng")


@dataclass(frozen=True)
class Options:
    sample_rows: int = 100_000
    top_values: int = 8
    #: Boolean columns named like a postal code count as invalid codes unless this is set.
    strict_names: bool = False


def sampled(frame: DataFrame, options: Options) -> DataFrame:
    """The first rows in row order."""
    if ROW in frame.columns:
        return frame.orderBy(ROW).limit(options.sample_rows)
    return frame.limit(options.sample_rows)


def invalid_flag(frame: DataFrame, name: str, options: Options) -> Column | None:
    """True where the value of a postal or latitude column is not valid."""
    low, kind = name.casefold(), frame.schema[name].dataType
    if "postal" in low or low in POSTAL_NAMES:
        if isinstance(kind, T.BooleanType):
            return None if options.strict_names else named(name).isNotNull()
        return named(name).isNotNull() & ~address.validate_postal_code(named(name), F.lit("DE"))
    if low in LATITUDE_NAMES:
        other = next((c for c in visible(frame) if c.casefold() in LONGITUDE_NAMES), None)
        if other:
            lat, lon = (geo.number_of(named(c), frame.schema[c].dataType) for c in (name, other))
            return (named(name).isNotNull() | named(other).isNotNull()) & ~geo.in_range(lat, lon)
    return None


def _plain(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))


def as_shown(frame: DataFrame, name: str) -> Column:
    """A column as text, nested values as JSON."""
    kind = frame.schema[name].dataType
    return F.to_json(named(name)) if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)) else named(name).cast("string")


def column_counts(frame: DataFrame) -> DataFrame:
    """(position, value, n): how often each value of each column occurs."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("position"), as_shown(frame, c).alias("value")) for i, c in enumerate(visible(frame))])).alias("x")
    return frame.select(each).groupBy("x.position", "x.value").agg(F.count("*").alias("n"))


def top_values(counts: DataFrame, k: int) -> DataFrame:
    """The most frequent values of each column; ties by value."""
    order = Window.partitionBy("position").orderBy(F.col("n").desc(), F.col("value").asc())
    return counts.where("value is not null").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def first_digit(v: Column) -> Column:
    """The octave of a number, with its sign: never falls as numbers grow (not a number is the largest)."""
    octave = F.floor(F.log2(F.abs(v))).cast("int") + 1100
    own = F.when(v > 0, octave).when(v < 0, -octave).otherwise(0)
    return F.when(F.isnan(v), 4000).when(v == float("inf"), 3000).when(v == float("-inf"), -3000).otherwise(own)


def selected(frame: DataFrame, value: dict[str, Column], ranks: dict[str, list[int]]) -> dict[str, list[float]]:
    """The values of each column at some ranks (from 0, in ascending order without nulls), by radix
    selection. Each pass folds all columns to one histogram, with the least and greatest value of every
    digit that occurs: first octaves, then DIGITS equal parts of the digit that a rank lies in. A rank
    is found when its digit holds one value; a digit is at most 2^52 values wide at the start, so five
    passes do. No values are sorted, listed or moved: the driver gets the histograms, and when no more
    than FEW values are left in all open digits, those."""
    names = list(value)
    found: dict[tuple[int, int], float] = {}
    want = {(i, k): k for i, c in enumerate(names) for k in ranks[c]}
    same = lambda a, b: a == b or a != a and b != b

    def settle(histogram, slots) -> tuple[list, int]:
        """Find ranks in (slot, digit, n, low, high) rows; returns the digits that are still open."""
        by_slot: dict[int, list] = {}
        for r in histogram:
            by_slot.setdefault(r["slot"], []).append(r)
        wider: dict[tuple, list] = {}
        left = 0
        for slot, keys in slots.items():
            before = 0
            for r in sorted(by_slot.get(slot, []), key=lambda r: r["digit"]):
                inside = [key for key in keys if before <= want[key] < before + r["n"]]
                if inside and same(r["low"], r["high"]):
                    found.update({key: r["low"] for key in inside})
                elif inside:
                    wider[inside[0][0], r["low"], r["high"]] = inside
                    want.update({key: want[key] - before for key in inside})
                    left += r["n"]
                before += r["n"]
        return list(wider.items()), left

    def histogram(columns: list[int], digit) -> list:
        """Of the values in the slots, a column each; the digit is one expression for all of them."""
        each = F.explode(F.array(*[F.struct(F.lit(s).alias("slot"), value[names[i]].alias("v")) for s, i in enumerate(columns)])).alias("x")
        rows = frame.select(each).select("x.slot", "x.v").where("v is not null").withColumn("digit", digit).where("digit is not null")
        return rows.groupBy("slot", "digit").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()

    some = [i for i, c in enumerate(names) if ranks[c]]
    if some:
        v = F.col("v")
        spans, left = settle(histogram(some, first_digit(v)), {s: [key for key in want if key[0] == i] for s, i in enumerate(some)})
        while spans:
            low, high = (F.get(F.lit([float(span[0][k]) for span in spans]), F.col("slot")) for k in (1, 2))
            place = v.cast("string") if left <= FEW else F.floor((v - low) / (high - low) * (DIGITS - 1)).cast("int")
            rows = histogram([i for (i, _, _), _ in spans], F.when((v >= low) & (v <= high), place))
            if left <= FEW:
                rows = [{"slot": r["slot"], "digit": r["low"], "n": r["n"], "low": r["low"], "high": r["low"]} for r in rows]
            spans, left = settle(rows, {s: keys for s, (_, keys) in enumerate(spans)})
    return {c: [found[i, k] for k in ranks[c]] for i, c in enumerate(names)}


def numeric_statistics(frame: DataFrame, columns: list[str]) -> dict[str, dict]:
    """min, max, mean, median, quartiles by nearest rank, and values outside 1.5 quartile distances."""
    if not columns:
        return {}
    value = {c: named(c).cast("double") for c in columns}
    first = frame.agg(*[x for i, c in enumerate(columns) for x in (F.count(named(c)).alias(f"n{i}"), F.min(value[c]).alias(f"min{i}"), F.max(value[c]).alias(f"max{i}"), F.avg(value[c]).alias(f"avg{i}"))]).first()
    quarter = lambda n, q: math.floor((n - 1) * q + 0.5)
    counts = {c: first[f"n{i}"] for i, c in enumerate(columns)}
    ranks = {c: [quarter(n, 0.25), quarter(n, 0.75), (n - 1) // 2, n // 2] if n else [] for c, n in counts.items()}
    at = selected(frame, value, ranks)
    bounds = {}
    for i, c in enumerate(columns):
        if first[f"n{i}"]:
            low, high = at[c][:2]
            bounds[c] = (low, high, low - 1.5 * (high - low), high + 1.5 * (high - low))
    third = frame.agg(*[F.count_if((value[c] < F.lit(b[2])) | (value[c] > F.lit(b[3]))).alias(f"o{columns.index(c)}") for c, b in bounds.items()]).first() if bounds else None
    finite = lambda x: x if x is None or math.isfinite(x) else None
    out = {}
    for i, c in enumerate(columns):
        if c in bounds:
            out[c] = {"min": finite(first[f"min{i}"]), "max": finite(first[f"max{i}"]), "mean": finite(first[f"avg{i}"]), "median": finite((at[c][2] + at[c][3]) / 2), "quantiles": {"q25": finite(bounds[c][0]), "q75": finite(bounds[c][1])}, "outlier_count": third[f"o{i}"]}
    return out


def exact_duplicates(frame: DataFrame) -> DataFrame:
    """One row: the number of rows that have an identical row."""
    keys = [as_shown(frame, c).alias(f"c{i}") for i, c in enumerate(visible(frame))]
    groups = frame.select(*keys).groupBy(*[f"c{i}" for i in range(len(keys))]).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).cast("long").alias("duplicates"))


def quality_score(rows: int, columns: int, nulls: int, invalid: int, duplicates: int) -> float:
    cells = max(rows * max(columns, 1), 1)
    complete, valid, unique = 1 - nulls / cells, 1 - min(invalid / cells, 1), 1 - duplicates / max(rows, 1)
    return round(max(0.0, 100 * (0.45 * complete + 0.35 * valid + 0.2 * unique)), 2)


#: The advice of a report, which its readers match by its words.
ADVICE = {
    "invalid": "Validate and quarantine invalid values",
    "missing": "Define a missing-value strategy",
    "repeated": "Consider categorical encoding or value normalization",
    "text": "Trim whitespace and normalize Unicode",
    "fine": "No transformation required",
}


def recommendation(null_ratio: float, unique_ratio: float, invalid: int, text: bool) -> str:
    """The first that applies: invalid values, over a fifth missing, few different texts, any text."""
    if invalid:
        return ADVICE["invalid"]
    if null_ratio > 0.2:
        return ADVICE["missing"]
    return ADVICE["fine"] if not text else ADVICE["repeated"] if unique_ratio < 0.1 else ADVICE["text"]


def jsonable(value):
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, dict):
        return {str(k): jsonable(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [jsonable(v) for v in value]
    return value


def sample_values(frame: DataFrame, there: dict[str, int]) -> dict[str, list]:
    """The first values of each column; `there` has how many each column has."""
    if not there:
        return {}
    head = frame.select(*[named(c) for c in there]).limit(FIRST_ROWS).collect()
    out = {}
    for i, c in enumerate(there):
        out[c] = [r[i] for r in head if r[i] is not None][:SAMPLE_VALUES]
        if len(out[c]) < min(SAMPLE_VALUES, there[c]):
            out[c] = [r[0] for r in frame.where(named(c).isNotNull()).select(named(c)).limit(SAMPLE_VALUES).collect()]
    return {c: [jsonable(v) for v in values] for c, values in out.items()}


def profile(frame: DataFrame, options: Options | None = None) -> dict:
    """The whole report. The sample is persisted while the passes run over it."""
    options = options or Options()
    total = frame.count()
    sample = (sampled(frame, options) if total > options.sample_rows else frame).persist()
    try:
        names = visible(sample)
        kinds = {c: sample.schema[c].dataType for c in names}
        wide = []
        flags = {c: invalid_flag(sample, c, options) for c in names}
        for i, c in enumerate(names):
            wide.append(F.count_if(named(c).isNull()).alias(f"null{i}"))
            wide.append((F.count_if(flags[c]) if flags[c] is not None else F.lit(0)).alias(f"bad{i}"))
            if _plain(kinds[c]):
                wide += [F.min(named(c)).alias(f"min{i}"), F.max(named(c)).alias(f"max{i}")]
        row = sample.agg(F.count("*").alias("rows"), *wide).first()
        rows = row["rows"]
        if names:
            counts = column_counts(sample).persist()
            distinct = {r["position"]: r["n"] for r in counts.groupBy("position").agg(F.count("*").alias("n")).collect()}
            tops: dict[int, list] = {}
            for r in top_values(counts, options.top_values).orderBy("position", "place").collect():
                tops.setdefault(r["position"], []).append({"value": r["value"], "count": r["n"]})
            counts.unpersist()
        numbers = numeric_statistics(sample, [c for c in names if isinstance(kinds[c], T.NumericType)])
        duplicates = exact_duplicates(sample).first()["duplicates"] if rows and names else 0
        columns, nulls, invalid = [], 0, 0
        firsts = sample_values(sample, {c: rows - row[f"null{i}"] for i, c in enumerate(names)})
        for i, c in enumerate(names):
            null_ratio, unique = row[f"null{i}"] / max(rows, 1), distinct.get(i, 0)
            nulls, invalid = nulls + row[f"null{i}"], invalid + row[f"bad{i}"]
            statistics = numbers.get(c, {})
            if _plain(kinds[c]) and row[f"min{i}"] is not None:
                statistics = {"min": jsonable(row[f"min{i}"]), "max": jsonable(row[f"max{i}"])}
            columns.append({
                "name": c, "dtype": kinds[c].simpleString(), "null_count": row[f"null{i}"], "null_ratio": round(null_ratio, 6),
                "unique_count": unique, "unique_ratio": round(unique / max(rows, 1), 6), "cardinality": unique, "invalid_count": row[f"bad{i}"],
                "sample_values": firsts[c], "top_values": tops.get(i, []), "statistics": statistics,
                "recommendation": recommendation(null_ratio, unique / max(rows, 1), row[f"bad{i}"], isinstance(kinds[c], T.StringType)),
            })
        size = frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        return {
            "row_count": total, "sampled_rows": rows, "column_count": len(names), "memory_bytes": int(str(size)), "exact_duplicate_count": duplicates,
            "total_null_count": nulls, "total_invalid_count": invalid, "quality_score": quality_score(rows, len(names), nulls, invalid, duplicates),
            "sampled": rows < total, "columns": columns,
        }
    finally:
        sample.unpersist()


def row_hash(names: list[str]) -> Column:
    return F.xxhash64(*[x for c in names for x in (named(c).isNull(), named(c))])


def changed_rows(before: DataFrame, after: DataFrame) -> int:
    """Rows that differ by position; if columns or heights differ, the larger height. Needs ROW in both.
    `compiler.execute` counts steps that work row by row without this join."""
    a, b = visible(before), visible(after)
    heights = before.count(), after.count()
    if a != b or heights[0] != heights[1]:
        return max(heights)
    side = lambda f, s: f.select(F.col(ROW).alias(s), row_hash(a).alias(f"h_{s}"))
    both = side(before, "x").join(side(after, "y"), F.col("x") == F.col("y"))
    return both.where("h_x <> h_y").count()


def to_json(report: dict) -> str:
    return json.dumps(jsonable(report), ensure_ascii=False, indent=2)
