"""XLSX workbooks as DataFrames.

A sheet inside the archive can only be inflated from its beginning. One task does that and no more: it
streams the sheet and the shared texts and cuts them between elements into pieces of about a megabyte.
Other tasks parse the pieces, and shared texts are joined to the cells that name them by number, so a
text that half of the cells share is sent once to each task or split by adaptive execution. The parsed
cells are written once; header, types and rows are read from that table. The driver sees the first row
and the kinds of each column, at most 16,384 of them by the format.

Stored values are read: the last result of a formula, and the day numbers of dates. Rows are numbered
by the sheet, so rows it leaves out are null; a cell without a place follows the one before. Where a
header repeats a name, its last column has the values. The first row makes the width: cells beyond it
are left out, and missing ones null; if the sheet leaves that row out, its widest row does. The parts must be in UTF-8, without CDATA sections that hold tags.
The compressed file must fit in one task's memory (2 GB at most).
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.rows import ROW
from ..session import scratch_folder, ship_package

PIECE = 1 << 20
#: Rows of a batch that leaves a parsing task.
BATCH = 512
TEXTS = "xl/sharedStrings.xml"
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
PIECES = pa.schema([("part", pa.string()), ("start", pa.int64()), ("xml", pa.binary())])
PARSED = pa.schema([("part", pa.string()), ("number", pa.int64()), ("cells", pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())])))])
PIECES_SQL = "part string, start long, xml binary"
PARSED_SQL = "part string, number long, cells array<struct<kind: string, value: string>>"


def active_sheet(book: zipfile.ZipFile) -> str:
    """The archive's name of the sheet that is shown first."""
    top = ElementTree.fromstring(book.read("xl/workbook.xml"))
    sheets = top.findall(f"{MAIN}sheets/{MAIN}sheet")
    if not sheets:
        raise ValueError("XLSX workbook has no active worksheet")
    view = top.find(f"{MAIN}bookViews/{MAIN}workbookView")
    chosen = sheets[min(int(view.get("activeTab", "0")) if view is not None else 0, len(sheets) - 1)]
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    return posixpath.normpath(posixpath.join("/xl", targets[chosen.get(RELATION)])).lstrip("/")


def cut(stream, element: str, parent: str, piece: int = PIECE):
    """(number of the first element, whole XML) of runs of elements, about `piece` bytes each. Elements
    are counted from 1 or by their attribute r."""
    begin = re.compile(rb"<(?:[\w.-]+:)?%s(?=[\s/>])([^>]*)>" % element.encode())
    end = re.compile(rb"</(?:[\w.-]+:)?%s\s*>" % parent.encode())
    root = re.compile(rb"<((?:[\w.-]+:)?(?:worksheet|sst))(?=[\s/>])[^>]*>")
    own = re.compile(rb"""\sr\s*=\s*["'](\d+)["']""")
    held, top, number = b"", None, 0

    def numbered(starts) -> int:
        nonlocal number
        first = None
        for s in starts:
            given = own.search(s[1])
            number = int(given[1]) if given else number + 1
            first = number if first is None else first
        return first

    def whole(xml: bytes) -> bytes:
        return top[0] + xml + b"</" + top[1] + b">"

    while chunk := stream.read(piece):
        held += chunk
        top = top or root.search(held)
        if top is None:
            continue
        starts = list(begin.finditer(held))
        if len(starts) > 1:
            last = starts[-1].start()
            yield numbered(starts[:-1]), whole(held[starts[0].start() : last])
            held = held[last:]
    starts = list(begin.finditer(held))
    if starts:
        stop = end.search(held, starts[-1].end())
        if stop is None:
            raise ValueError(f"XLSX part ends inside {parent}")
        yield numbered(starts), whole(held[starts[0].start() : stop.start()])


def pieces_of(batches):
    """Batches of `content` as pieces of the active sheet and of the shared texts."""
    for batch in batches:
        for content in batch.column(0):
            with zipfile.ZipFile(io.BytesIO(content.as_py())) as book:
                parts = [("rows", active_sheet(book), "row", "sheetData")]
                if TEXTS in book.namelist():
                    parts.append(("texts", TEXTS, "si", "sst"))
                for part, name, element, parent in parts:
                    with book.open(name) as stream:
                        for start, xml in cut(stream, element, parent):
                            yield pa.RecordBatch.from_pylist([{"part": part, "start": start, "xml": xml}], PIECES)


def text_of(item) -> str:
    """The text of its runs, without reading aids."""
    return "".join(t.text or "" for t in [*item.findall(f"{MAIN}t"), *item.findall(f"{MAIN}r/{MAIN}t")])


def place_of(cell, after: int) -> int:
    letters = re.match("[A-Z]+", cell.get("r") or "")
    if not letters:
        return after
    at = 0
    for c in letters[0]:
        at = at * 26 + ord(c) - 64
    return at - 1


def value_of(cell) -> dict | None:
    """Kind (text, shared, boolean, integer, float) and value."""
    kind, stored = cell.get("t", "n"), cell.findtext(f"{MAIN}v")
    if kind == "inlineStr":
        inside = cell.find(f"{MAIN}is")
        return {"kind": "text", "value": text_of(inside) if inside is not None else ""}
    if not stored:
        return {"kind": "text", "value": ""} if kind == "str" and stored is not None else None
    if kind == "s":
        return {"kind": "shared", "value": str(int(stored))}
    if kind == "b":
        return {"kind": "boolean", "value": str(stored.strip() == "1")}
    if kind in ("str", "e", "d"):
        return {"kind": "text", "value": stored}
    number = float(stored)
    if number.is_integer() and not re.search("[.eE]", stored):
        return {"kind": "integer", "value": str(int(stored))}
    return {"kind": "float", "value": str(number)}


def parsed_rows(part: str, start: int, xml: bytes):
    number = start
    for element in ElementTree.fromstring(xml):
        if part == "texts":
            yield {"part": part, "number": number - 1, "cells": [{"kind": "text", "value": text_of(element)}]}
        else:
            number = int(element.get("r") or number)
            cells: list = []
            for cell in element.findall(f"{MAIN}c"):
                at = place_of(cell, len(cells))
                cells += [None] * (at + 1 - len(cells))
                cells[at] = value_of(cell)
            yield {"part": part, "number": number, "cells": cells}
        number += 1


def parsed_of(batches):
    for batch in batches:
        for one in batch.to_pylist():
            rows = []
            for row in parsed_rows(**one):
                rows.append(row)
                if len(rows) == BATCH:
                    yield pa.RecordBatch.from_pylist(rows, PARSED)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, PARSED)


def written(frame: DataFrame, name: str) -> DataFrame:
    path = scratch_folder(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


def sheet_cells(spark: SparkSession, path: str) -> DataFrame:
    """(number, cells) of the rows of the active sheet, shared texts in their places."""
    ship_package(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    parsed = written(files.mapInArrow(pieces_of, PIECES_SQL).repartition("part", "start").mapInArrow(parsed_of, PARSED_SQL), "workbook")
    rows = parsed.where("part = 'rows'").select("number", "cells")
    texts = parsed.where("part = 'texts'").select(F.col("number").alias("named"), F.col("cells")[0]["value"].alias("text"))
    if texts.isEmpty():
        return rows
    each = rows.select("number", F.posexplode("cells").alias("place", "cell"))
    named = F.when(F.col("cell.kind") == "shared", F.col("cell.value").cast("long"))
    # cells that name no text have keys of their own, so they are not one hot key
    found = each.withColumn("key", F.coalesce(named, -1 - F.pmod(F.xxhash64("number", "place"), F.lit(1 << 20)))).join(texts, F.col("key") == F.col("named"), "left")
    cell = F.when(named.isNull(), F.col("cell")).otherwise(F.struct(F.lit("text").alias("kind"), F.col("text").alias("value")))
    lists = found.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("place", cell.alias("cell")))).alias("x"))  # a row has 16,384 cells at most
    return written(lists.select("number", F.col("x.cell").alias("cells")), "sheet")


def type_of(kinds: set[str]) -> str:
    if kinds <= {"integer"}:
        return "long"
    if kinds <= {"integer", "float"}:
        return "double"
    return "boolean" if kinds == {"boolean"} else "string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """The active sheet below its first row, in order, with ROW. Integers are long, mixed with other
    numbers double; columns that mix kinds are text, and empty ones long. Without rows all are text."""
    cells = sheet_cells(spark, path)
    most, width = cells.agg(F.max("number"), F.max(F.size("cells"))).first()
    if not width:
        raise ValueError("XLSX worksheet is empty")
    first = cells.where("number = 1").first()
    names = [c["value"] if c else f"column_{i + 1}" for i, c in enumerate(first["cells"] if first else [None] * width)]
    places = {name: i for i, name in enumerate(names)}
    below = cells.where("number > 1")
    seen = below.select(F.posexplode("cells").alias("place", "cell")).where(F.col("cell").isNotNull() & (F.col("place") < len(names)))
    kinds = {r["place"]: set(r["kinds"]) for r in seen.groupBy("place").agg(F.collect_set("cell.kind").alias("kinds")).collect()}
    kind = {name: type_of(kinds.get(i, set())) if most > 1 else "string" for name, i in places.items()}
    numbers = spark.range(2, most + 1).withColumnRenamed("id", "number")  # rows that the sheet leaves out too
    rows = numbers.join(below, "number", "left").orderBy("number")
    return rows.select(*[F.get("cells", F.lit(i))["value"].cast(kind[name]).alias(name) for name, i in places.items()], (F.col("number") - 2).alias(ROW))
