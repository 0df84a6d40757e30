"""Delimited text in splits, whatever its fields hold.

A line break inside quotes is no end of a record, and a task that begins somewhere in a file cannot see
whether it begins inside quotes. What a line does is a function of two states, outside and inside
quotes: it leaves the state alone, sets it, clears it or flips it. Such functions compose, and
composing is associative, so each split is folded to one function without knowing where it begins, a
running composition over a file's splits (one row each) gives every split its first state, and a second
pass marks the lines. Lines that are a record by themselves go on as they are; only lines of records that
span lines are grouped, by the place where their record begins, in whatever split that is.

Types come from one fold over the rows: each column's kinds of value (whole number, number, truth value,
date, time, text) are bits that merge by `or`. The same expressions then cast the rows. Where no line
leaves a field open, the fold is the only read beside that of the rows: the lines are looked at for open
fields in the same pass.
"""

from __future__ import annotations

import csv
import io
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.rows import ROW, named
from ..session import ship_package

#: Fields that a record may have.
MANY_FIELDS = 20_000
#: Kinds of value, as bits.
WHOLE, NUMBER, TRUTH, DATE, TIME, TEXT = 1, 2, 4, 8, 16, 32
#: How the values of each kind are written.
FORMS = {
    WHOLE: r"^[+-]?[0-9]{1,18}$",
    NUMBER: r"^([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|NaN|-?Inf|-?Infinity)$",
    TRUTH: r"(?i)^(true|false)$",
    DATE: r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    TIME: r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,9})?)?(Z|[+-][0-9]{2}:?[0-9]{2})?$",
}


def lines(spark: SparkSession, path: str, charset: str) -> DataFrame:
    """(value, file, block): the lines, the file that they are in and where its split begins."""
    reader = spark.read.option("lineSep", "\n")
    if charset != "UTF-8":
        reader = reader.option("encoding", charset)
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def open_after(value: Column, delimiter: str) -> tuple[Column, Column]:
    """Whether a line leaves a quoted field open, if it begins outside quotes, and if inside. Repeats
    are possessive, so a line of any length takes one walk and no stack."""
    d = "\\u%04x" % ord(delimiter)
    closed = f'"[^"]*+(?:""[^"]*+)*+"[^{d}]*+'
    rest = f'(?:{d}(?:{closed}|[^"{d}][^{d}]*+|))*+\\z'
    outside = ~value.rlike(f'^(?:{closed}|[^"{d}][^{d}]*+|){rest}')
    inside = ~value.rlike(f'^[^"]*+(?:""[^"]*+)*+"[^{d}]*+{rest}')
    quoted = F.instr(value, '"') > 0
    return quoted & outside, ~quoted | inside


def running(outside: np.ndarray, inside: np.ndarray, first: bool) -> np.ndarray:
    """The state before each line and after the last, if `first` is the state at the start."""
    fixed, flips = outside == inside, outside & ~inside
    last = np.maximum.accumulate(np.concatenate([[-1], np.where(fixed, np.arange(len(fixed)), -1)]))  # the last line that sets or clears
    turned = np.concatenate([[0], np.cumsum(flips)])
    since = turned - np.where(last >= 0, turned[last + 1], 0)
    start = np.where(last >= 0, outside[np.maximum(last, 0)], first) if len(outside) else np.array([first])
    return start.astype(bool) ^ (since % 2 == 1)


def runs_of(batch: pa.RecordBatch):
    """(file, block, from, to) of the rows of each split in a batch."""
    files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
    start = 0
    for k in range(1, len(files) + 1):
        if k == len(files) or blocks[k] != blocks[start] or files[k] != files[start]:
            yield files[start], blocks[start], start, k
            start = k


def folded(batches):
    """(file, block, n, outside, inside): each split as one function of its first state."""
    now: list | None = None
    for batch in batches:
        outside, inside = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("outside", "inside"))
        for file, block, a, b in runs_of(batch):
            ends = [bool(running(outside[a:b], inside[a:b], s)[-1]) for s in (False, True)]
            if now is not None and now[:2] == [file, block]:
                now[2:] = [now[2] + b - a, ends[now[3]], ends[now[4]]]
            else:
                if now is not None:
                    yield pa.RecordBatch.from_pydict(dict(zip(SPLIT, ([x] for x in now))))
                now = [file, block, b - a, *ends]
    if now is not None:
        yield pa.RecordBatch.from_pydict(dict(zip(SPLIT, ([x] for x in now))))


SPLIT = ("file", "block", "n", "outside", "inside")


def marked(batches):
    """Lines with their place in the split, the states before and after, and the line of the split
    where the record that they belong to begins (-1: in an earlier split). `first` is the split's state."""
    now, line, state, begun = None, 0, False, -1
    for batch in batches:
        outside, inside, first = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("outside", "inside", "first"))
        at, begins, before, after = [], [], [], []
        for file, block, a, b in runs_of(batch):
            if now != (file, block):
                now, line, state, begun = (file, block), 0, bool(first[a]), -1
            states = running(outside[a:b], inside[a:b], state)
            place = np.arange(line, line + b - a)
            start = np.maximum.accumulate(np.concatenate([[begun], np.where(states[:-1], -1, place)]))[1:]
            at.append(place), begins.append(start), before.append(states[:-1]), after.append(states[1:])
            line, state, begun = line + b - a, bool(states[-1]), int(start[-1])
        if at:
            made = [pa.array(np.concatenate(x)) for x in (at, begins, before, after)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("value", "file", "block", "split")] + made, ["value", "file", "block", "split", "line", "begins", "before", "after"])


def composed(splits: DataFrame) -> DataFrame:
    """Splits with the state that each begins in, and their number in the order of the source."""
    order = Window.partitionBy("file").orderBy("block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    fixed, flip = F.col("outside") == F.col("inside"), (F.col("outside") & ~F.col("inside")).cast("int")
    turned = splits.withColumn("turned", F.sum(flip).over(order))
    last = F.last(F.when(fixed, F.struct("outside", "turned")), ignorenulls=True).over(earlier)
    before = F.coalesce(F.sum(flip).over(earlier), F.lit(0))
    states = turned.select("*", last.alias("last"), before.alias("before"))
    first = (F.coalesce(F.col("last.outside"), F.lit(False)).cast("int") + F.col("before") - F.coalesce(F.col("last.turned"), F.lit(0))) % 2 == 1
    return states.select("file", "block", "n", "outside", "inside", first.alias("first"))


def records(spark: SparkSession, path: str, charset: str, delimiter: str) -> DataFrame:
    """(value, ROW, head): the records in the order of the source; `head` marks each file's first."""
    text = lines(spark, path, charset)
    outside, inside = open_after(F.col("value"), delimiter)
    coded = text.withColumns({"outside": outside, "inside": inside})
    ship_package(spark)
    splits = coded.select("file", "block", "outside", "inside").mapInArrow(folded, "file string, block long, n long, outside boolean, inside boolean")
    # a row for each split, 128 MB by default: 800,000 for 100 TB
    splits = sorted(composed(splits).collect(), key=lambda r: (r["file"], r["block"]))
    ends: dict[str, bool] = {}
    for r in splits:
        ends[r["file"]] = r["inside"] if r["first"] else r["outside"]
    if any(ends.values()):
        raise ValueError(f"{sorted(f for f, x in ends.items() if x)[0]} ends inside a quoted field")
    rows = [(r["file"], r["block"], k, r["first"]) for k, r in enumerate(splits)]
    first = spark.createDataFrame(rows, "own_file string, own_block long, split long, first boolean")
    placed = coded.join(F.broadcast(first), (F.col("file") == F.col("own_file")) & (F.col("block") == F.col("own_block"))).select("value", "file", "block", "split", "outside", "inside", "first")
    each = placed.mapInArrow(marked, "value string, file string, block long, split long, line long, begins long, before boolean, after boolean")

    alone = each.where("not before and not after").select("value", "split", "line", "block")
    several = each.where("before or after")
    # records that go on from an earlier split: it is the last before this one in which a record begins that stays open
    tails = several.where("after and begins >= 0").groupBy("file", "split").agg(F.max(F.struct("line", "begins", "block")).alias("x"))
    sizes = spark.createDataFrame([(k, r["n"]) for k, r in enumerate(splits)], "s long, n long")
    tails = tails.join(F.broadcast(sizes), F.col("split") == F.col("s")).where("x.line = n - 1")
    heads = several.where("begins < 0").select("file", F.col("split").alias("own")).distinct()
    both = tails.select("file", F.col("split").alias("at"), F.col("x.begins").alias("from_line")).unionByName(heads.select("file", F.col("own").alias("at"), F.lit(None).cast("long").alias("from_line")))
    chain = F.last(F.when(F.col("from_line").isNotNull(), F.struct(F.col("at").alias("split"), F.col("from_line").alias("line"))), ignorenulls=True).over(Window.partitionBy("file").orderBy("at", F.col("from_line").isNotNull()).rowsBetween(Window.unboundedPreceding, -1))
    origin = both.withColumn("origin", chain).where("from_line is null").select(F.col("at").alias("own"), "origin")
    own = F.struct(F.col("split").alias("split"), F.col("begins").alias("line"))
    named_ = several.join(F.broadcast(origin), (F.col("begins") < 0) & (F.col("split") == F.col("own")), "left").withColumn("key", F.when(F.col("begins") >= 0, own).otherwise(F.col("origin")))
    stitched = named_.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("split", "line", "value", "block"))).alias("x"))  # the lines of one record
    stitched = stitched.select(F.array_join("x.value", "\n").alias("value"), F.col("key.split").alias("split"), F.col("key.line").alias("line"), F.col("x")[0]["block"].alias("block"))
    every = alone.unionByName(stitched.select(*alone.columns))
    shown = F.regexp_replace("value", "\\r\\z", "")
    head = (F.col("block") == 0) & (F.col("line") == 0)
    clean = F.when(head, F.regexp_replace(shown, "^\\uFEFF", "")).otherwise(shown)
    return every.select(clean.alias("value"), (F.shiftleft(F.col("split"), 33) + F.col("line")).alias(ROW), head.alias("head"))


def kinds_of(value: Column) -> Column:
    """The kind of a value, as a bit; 0 for null."""
    found = F.when(value.isNull(), 0)
    for kind, form in FORMS.items():
        fits = value.rlike(form)
        if kind in (DATE, TIME):
            fits = fits & value.try_cast("date" if kind == DATE else "timestamp").isNotNull()
        found = found.when(fits, kind)
    return found.otherwise(TEXT)


def type_of(kinds: int) -> T.DataType:
    """The narrowest type that holds all kinds; what mixes stays text."""
    if kinds and not kinds & ~(WHOLE | NUMBER):
        return T.DoubleType() if kinds & NUMBER else T.LongType()
    return {TRUTH: T.BooleanType(), DATE: T.DateType(), TIME: T.TimestampNTZType()}.get(kinds, T.StringType())


def cast_to(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampNTZType):
        return value.cast("timestamp").cast(kind)
    if isinstance(kind, T.DoubleType):
        return F.regexp_replace(value, "Inf$", "Infinity").cast(kind)
    return value.cast(kind)


def header_of(head: str, delimiter: str) -> list[str]:
    """The names in the first record; those that are missing or repeat get a number."""
    names = next(csv.reader(io.StringIO(head.removeprefix("﻿"), newline=""), delimiter=delimiter), [])
    seen: set[str] = set()
    out = []
    for k, name in enumerate(names):
        name = name or f"_c{k}"
        out.append(name if name.casefold() not in seen else f"{name}{k}")
        seen.add(out[-1].casefold())
    return out


def read(spark: SparkSession, path: str, delimiter: str, charset: str, head: str) -> DataFrame:
    """The rows of delimited files with a header, typed; ROW is there if records had to be put together."""
    names = header_of(head, delimiter)
    if charset != "UTF-8":
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # else Spark takes a few encodings only
    if not names:
        return spark.createDataFrame([], T.StructType([]))
    plain = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(names))])
    options = {"sep": delimiter, "quote": '"', "escape": '"', "maxCharsPerColumn": "-1"}
    shown = F.regexp_replace("value", "\\r\\z", "")
    first_line = re.split("\r?\n", head.removeprefix("﻿"), maxsplit=1)[0]

    def fold(frame: DataFrame, *more: Column):
        each = frame.select("*", F.from_csv("value", plain.simpleString()[7:-1].replace(":", " "), options).alias("x"))
        return each.agg(*[F.coalesce(F.bit_or(kinds_of(F.col(f"x.c{k}"))), F.lit(0)).alias(f"k{k}") for k in range(len(names))], *more).first()

    # one pass: the kinds of all lines, whether any leaves a field open, and how many look like the header
    text = lines(spark, path, charset)
    is_head = F.regexp_replace(shown, "^\\uFEFF", "") == F.lit(first_line)
    # a line of very many fields may be a part of a record, so it counts as open and is not parsed here
    many = F.char_length("value") - F.char_length(F.replace("value", F.lit(delimiter), F.lit(""))) >= MANY_FIELDS
    seen = text.select(F.when(~is_head & (shown != "") & ~many, shown).alias("value"), "file", is_head.alias("is_head"), (many | open_after(F.col("value"), delimiter)[0]).alias("open"))
    found = fold(seen, F.coalesce(F.bool_or("open"), F.lit(False)).alias("open"), F.count_if("is_head").alias("heads"), F.count_distinct("file").alias("files"))
    if found["open"]:
        frame = records(spark, path, charset, delimiter).where("value <> ''")
        body = frame.where("not head").drop("head")
        folded_kinds = fold(body)
        rows = body.select(ROW, F.from_csv("value", plain.simpleString()[7:-1].replace(":", " "), options | {"mode": "FAILFAST"}).alias("x"))
        value = {k: F.col(f"x.c{k}") for k in range(len(names))}
        order = [F.col(ROW)]
    else:
        folded_kinds = found
        rows = spark.read.options(**options, header="true", mode="FAILFAST", enforceSchema="false", encoding=charset).schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(path)
        value = {k: named(n) for k, n in enumerate(names)}
        order = []
    text_only = not found["open"] and found["heads"] > found["files"]  # a row that looks like the header is text
    kinds = [T.StringType() if text_only else type_of(folded_kinds[f"k{k}"]) for k in range(len(names))]
    return rows.select(*order, *[cast_to(value[k], kind).alias(n) for k, (n, kind) in enumerate(zip(names, kinds))])
