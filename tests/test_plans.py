import csv
import datetime
import hashlib
import io
import random
import re
import time
import uuid
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur import catalog_queries
from larkspur.operators.rows import ROW
from larkspur.plans import compiler, definition, examples
from larkspur.plans.runs import Catalogue, artifact_path, execute_run, overview, run_figures
from larkspur.plans.watch import RunCancelled, RunTimedOut
from larkspur.sources import delimited, files, readers, store, writers
from larkspur.sources import workbook as workbooks
from larkspur.streaming import stream_pipeline

CSV = "record_id,street,city,postal_code,country,latitude,longitude,note\na,Hauptstr. 1,Berlin,10115,DE,52.5,13.4,=1+1\nb,Hauptstrasse 1,Berlin,10115,DE,52.5,13.4,x\nc,Weg 3,Köln,12,DE,50.9,6.9,y\n"


def test_definition_round_trip():
    for p in examples.EXAMPLES:
        again = definition.from_yaml(definition.to_yaml(p))
        assert again.checksum == p.checksum
    assert definition.warnings_of(definition.pipeline({"name": "x", "steps": [{"id": "a", "type": "load_dataset", "name": "a"}]}))


@pytest.mark.parametrize(
    "source",
    [
        "- a", "a: &x 1\nb: *x", "name: x\nsteps: []", "name: x\nsteps: [{id: a, type: nothing, name: a}]", "a: !!python/object:os.system 1",
        "name: x\nsteps: [{id: a, type: select_columns, name: a, config: {columns: []}}]", "name: x\nsteps: [{id: a, type: load_dataset, name: a, config: {code: 1}}]",
        "name: x\nsteps: [{id: a, type: load_dataset, name: a}, {id: a, type: load_dataset, name: b}]",
        "name: x\nsteps: [{id: a, type: load_dataset, name: a}]\nedges: [{id: e, source: a, target: b}]",
        "name: x\nsteps: [{id: a, type: load_dataset, name: a}, {id: b, type: load_dataset, name: b}]\nedges: [{id: e, source: a, target: b}, {id: f, source: b, target: a}]",
        "name: x\nsteps: [{id: a, type: detect_duplicates, name: a, config: {comparison_columns: [c], minimum_score: 95}}]",
        "x" * 1_000_001,
    ],
)
def test_definition_refuses(source):
    with pytest.raises(ValueError):
        definition.from_yaml(source)


def test_order_of_edges():
    steps = [{"id": x, "type": "load_dataset", "name": x} for x in "abc"]
    p = definition.pipeline({"name": "x", "steps": steps, "edges": [{"id": "1", "source": "c", "target": "a"}]})
    assert [s.id for s in p.ordered()] == ["b", "c", "a"]


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("city;value\nKöln;1\nBonn;2\n".encode("cp1252"))
    frame, encoding, delimiter = readers.read_dataset(spark, str(tmp_path / "a.csv"), "CSV")
    assert delimiter == ";" and encoding != "utf-8" and [r["city"] for r in frame.orderBy(ROW).collect()] == ["Köln", "Bonn"]
    (tmp_path / "d.csv").write_text("date,n\n2024-01-01,1\n01.02.2024,2\n")
    assert readers.read_dataset(spark, str(tmp_path / "d.csv"), "csv")[0].schema["date"].dataType.simpleString() == "string"
    (tmp_path / "r.json").write_text('{"records": [{"a": 1}, {"a": 2}]}')
    (tmp_path / "l.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "s.json").write_text("3")
    for name in ("r.json", "l.json", "l.jsonl"):
        assert readers.read_dataset(spark, str(tmp_path / name), name.split(".")[1])[0].count() == 2
    for name, kind in (("s.json", "json"), ("s.json", "xml")):
        with pytest.raises(ValueError):
            readers.read_dataset(spark, str(tmp_path / name), kind)
    assert readers.preview(readers.read_json(spark, str(tmp_path / "l.json")), 1) == [{"a": 1}]


def workbook(rows: str, texts=("name", "value")) -> bytes:
    out, space = io.BytesIO(), 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {space} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="s" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        if texts:
            z.writestr("xl/sharedStrings.xml", f"<sst {space}>{''.join(f'<si><t>{t}</t></si>' for t in texts)}</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {space}><sheetData>{rows}</sheetData><rowBreaks/></worksheet>")
    return out.getvalue()


HEADER = '<row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>'


def test_workbooks(spark, tmp_path):
    def read(data: bytes):
        path = tmp_path / f"{uuid.uuid4().hex}.xlsx"
        path.write_bytes(data)
        return readers.read_dataset(spark, str(path), "xlsx")[0]

    frame = read(workbook(HEADER + '<row><c r="A2" t="inlineStr"><is><t>x</t></is></c><c r="C2"><v>5</v></c></row>')).drop(ROW)
    assert frame.columns == ["name", "column_2", "value"] and [tuple(r) for r in frame.collect()] == [("x", None, 5)]
    empty = read(workbook(HEADER))
    assert empty.count() == 0 and empty.schema["value"].dataType.simpleString() == "string"
    with pytest.raises(ValueError, match="empty"):
        read(workbook(""))
    # a row left out, one without cells, kinds, a cell beyond the header, a name twice, a formula's empty text
    head = '<row r="1"><c t="inlineStr"><is><r><t>a</t></r><r><t>b</t></r><rPh><t>no</t></rPh></is></c><c t="s"><v>0</v></c><c t="s"><v>0</v></c><c t="str"><v>m</v></c><c t="str"><v>t</v></c></row>'
    frame = read(workbook(head + '<row r="2"><c><v>1</v></c><c><v>9</v></c><c t="b"><v>1</v></c><c><v>2</v></c><c t="str"><v></v></c><c><v>7</v></c></row><row r="4"/><row r="5"><c r="A5"><v>2.5</v></c><c r="C5" t="b"><v>0</v></c><c r="D5" t="e"><v>#N/A</v></c></row>'))
    assert [(r["ab"], r["name"], r["m"], r["t"], r[ROW]) for r in frame.collect()] == [(1.0, True, "2", "", 0), (None, None, None, None, 1), (None, None, None, None, 2), (2.5, False, "#N/A", None, 3)]
    assert frame.columns == ["ab", "name", "m", "t", ROW]
    late = read(workbook('<row r="2"><c><v>1</v></c><c><v>2</v></c></row>', texts=()))
    assert late.drop(ROW).columns == ["column_1", "column_2"] and [tuple(r) for r in late.drop(ROW).collect()] == [(1, 2)]


def test_workbook_of_several_pieces(spark, tmp_path, monkeypatch):
    """Most cells share one text; rows go through several pieces and come back in order."""
    n = 6000
    texts = ["name", "value", "hot &amp; often", *[f"t{i}" for i in range(500)]]
    rows = "".join(f'<row r="{i + 2}"><c r="A{i + 2}" t="s"><v>{2 if i % 3 else 3 + i % 500}</v></c><c r="C{i + 2}"><v>{i}</v></c><c r="B{i + 2}" t="inlineStr"><is><t>{"x" * 300}</t></is></c></row>' for i in range(n))
    path = tmp_path / "big.xlsx"
    path.write_bytes(workbook(HEADER.replace("<row>", '<row r="1">') + rows, texts))
    with zipfile.ZipFile(path) as book, book.open("xl/worksheets/sheet1.xml") as stream:
        runs = [(start, xml.count(b"<row ")) for start, xml in workbooks.cut(stream, "row", "sheetData")]
    assert len(runs) > 1 and sum(k for _, k in runs) == n + 1 and all(a[0] + a[1] == b[0] for a, b in zip(runs, runs[1:]))
    for size in (7, 64, 1000):  # cuts at any byte
        stream = io.BytesIO(b"<?xml?><x:sst xmlns:x='y'><x:si><x:t>a</x:t></x:si><x:si/><x:si>c</x:si></x:sst>")
        found = list(workbooks.cut(stream, "si", "sst", size))
        assert b"".join(re.findall(rb"<x:si.*(?=</x:sst>)", x)[0] for _, x in found) == b"<x:si><x:t>a</x:t></x:si><x:si/><x:si>c</x:si>" and found[0][0] == 1
    frame = readers.read_dataset(spark, str(path), "xlsx")[0]
    assert [(r["name"], r["value"]) for r in frame.collect()] == [("hot & often" if i % 3 else f"t{i % 500}", i) for i in range(n)]


def test_files(tmp_path):
    assert files.sanitize_filename("../a b/ü?.CSV") == "u.csv" or files.sanitize_filename("../a b/x?.CSV") == "x_.csv"
    assert files.sanitize_filename("..") == "upload"
    assert files.validate_extension("a.JSONL") == "jsonl"
    for wrong in (lambda: files.validate_extension("a.exe"), lambda: files.contained(tmp_path / ".." / "x", tmp_path)):
        with pytest.raises(ValueError):
            wrong()
    (tmp_path / "u").write_bytes(b"abc")
    assert files.sha256_file(tmp_path / "u") == files.sha256_text("abc") == hashlib.sha256(b"abc").hexdigest()


def test_store(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}"
    with pytest.raises(ValueError):
        store.put_stream(spark, io.BytesIO(b"12345"), f"{root}/a/u", 3)
    assert store.names(spark, f"{root}/a") == []
    data = bytes(range(256)) * 9000  # over two chunks
    for content in (b"old", data, b"", data):  # replaced each time
        assert store.put_stream(spark, io.BytesIO(content), f"{root}/a/u", 1 << 30) == (hashlib.sha256(content).hexdigest(), len(content))
    assert (tmp_path / "a" / "u").read_bytes() == data == b"".join(store.read_bytes(spark, f"{root}/a/u")) and store.names(spark, f"{root}/a") == ["u"]
    spark.range(50).selectExpr("id", "id % 3 AS k").repartition(4).write.partitionBy("k").parquet(f"{root}/b")
    inside = sorted(p for p in (tmp_path / "b").rglob("*.parquet") if p.name[0] not in "._")
    (inside[0].parent / "part-empty.parquet").touch()
    inside = sorted([*inside, inside[0].parent / "part-empty.parquet"])
    expected = hashlib.sha256("".join(files.sha256_file(p) for p in inside).encode()).hexdigest(), sum(p.stat().st_size for p in inside)
    assert store.checksum(spark, f"{root}/b") == store.checksum(spark, str(tmp_path / "b")) == expected
    monkeypatch.setattr(store, "PART", max(p.stat().st_size for p in inside) - 1)  # some or all through the driver
    assert store.checksum(spark, f"{root}/b") == expected
    (tmp_path / "c").mkdir()
    assert store.checksum(spark, f"{root}/c") == (hashlib.sha256(b"").hexdigest(), 0)
    assert store.contained(spark, f"{root}/a/x/../u", str(tmp_path)).endswith("/a/u")
    (tmp_path / "c" / "link").symlink_to(tmp_path / "a")
    for path in (f"{root}/c/../a/u", f"{root}/c2", f"{root}/c/link/u", "file:///etc"):
        with pytest.raises(ValueError):
            store.contained(spark, path, f"{root}/c")


def test_writers(spark, tmp_path):
    frame = spark.createDataFrame([("=1", [1, 2])], "a string, b array<int>")
    writers.write_dataset(frame, str(tmp_path / "c"), "csv")
    assert [tuple(r) for r in spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).collect()] == [("'=1", "[1,2]")]
    with pytest.raises(ValueError):
        writers.write_dataset(frame, str(tmp_path / "x"), "xml")


def test_files_of_text_are_bounded(spark, tmp_path, monkeypatch):
    """However many rows a task has, the files that it writes have a limit, and keep the order of the rows."""
    monkeypatch.setattr(writers, "ROWS_A_FILE", 10, raising=False)
    frame = spark.range(45).coalesce(1).selectExpr("id", "concat('t', id) AS t")
    for kind, own in (("csv", 11), ("jsonl", 10)):
        path = str(tmp_path / kind)
        writers.write_dataset(frame, path, kind)
        assert [len(open(p).readlines()) for p, _ in ((f.removeprefix("file:"), n) for f, n in store.parts(spark, path))] == [own] * 4 + [own - 5]
        back = readers.read_dataset(spark, path, kind)[0]
        assert sorted((r["id"], r["t"]) for r in back.collect()) == [(k, f"t{k}") for k in range(45)]


def test_documents_through_csv(spark, tmp_path):
    """Texts come back as they were: none is taken for a formula, none loses white space at its ends."""
    texts = ["+1 (389) 555", "=1", "-a\nb", "@x", "\tq", "'=x", " lead", "trail ", "\n", "a\r\nb", 'say "x", \\"', "\\", "plain", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en")).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["length"], r["digest"]) for r in catalog_queries.csv_documents(spark, str(tmp_path)).collect()}
    assert got == {k: (len(t), hashlib.md5(t.encode()).hexdigest()) for k, t in enumerate(texts) if t}


def test_fields_that_span_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note\n1,"x\ny"\n2,"say ""hi"""\n3,plain\n')
    frame = readers.read_dataset(spark, str(tmp_path / "a.csv"), "csv")[0]
    assert [(r["id"], r["note"]) for r in frame.orderBy(ROW).collect()] == [(1, "x\ny"), (2, 'say "hi"'), (3, "plain")]


@pytest.fixture
def small_splits(spark):
    """Splits of a few lines, so that records begin, go on and end in several."""
    keys = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "64"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def plain_rows(files, sep):
    """What the standard library makes of the files, without their headers."""
    return [[v or None for v in row] for data in files for row in list(csv.reader(io.StringIO(data, newline=""), delimiter=sep))[1:] if row]


@pytest.mark.parametrize("sep, end", [(",", "\n"), (";", "\r\n")])
def test_records_over_splits(spark, tmp_path, small_splits, sep, end):
    r = random.Random(ord(sep))
    piece = lambda: r.choice(["x", "ü", '"', sep, "\n", "a b", "\n\n", "1", "'"])
    files = []
    for k in range(2):
        out = io.StringIO()
        writer = csv.writer(out, delimiter=sep, lineterminator=end)
        writer.writerow(["id", "note", "long\nname"])
        for i in range(12):
            writer.writerow([k * 100 + i, "".join(piece() for _ in range(r.choice([0, 1, 6, 60]))) + "z", r.choice(["", "plain", "line\n" * 50])])
        files.append(("\ufeff" if k == 0 else "") + out.getvalue())
        (tmp_path / f"{k}.csv").write_text(files[-1], newline="")
    found, encoding, delimiter = readers.read_dataset(spark, str(tmp_path), "csv")
    assert delimiter == sep and found.columns == [ROW, "id", "note", "long\nname"] and dict(found.dtypes)["id"] == "bigint"
    rows = found.orderBy(ROW).collect()
    expected = plain_rows([f.removeprefix("\ufeff") for f in files], sep)
    assert [[str(x[1]), x[2], x[3]] for x in rows] == expected
    assert found.rdd.getNumPartitions() > 1
    splits = delimited.lines(spark, str(tmp_path), "UTF-8").select("file", "block").distinct().count()
    assert splits > 20


def test_running_states():
    r = random.Random(2)
    for n in (0, 1, 2, 50):
        outside, inside = (np.array([r.random() < 0.5 for _ in range(n)], bool) for _ in range(2))
        for first in (False, True):
            state, expected = first, [first]
            for o, i in zip(outside, inside):
                state = bool(i if state else o)
                expected.append(state)
            assert delimited.running(outside, inside, first).tolist() == expected


def test_fields_left_open(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note\n1,"x\ny\n')
    with pytest.raises(ValueError, match="inside a quoted field"):
        readers.read_dataset(spark, str(tmp_path / "a.csv"), "csv")
    (tmp_path / "b.csv").write_text('id,inch\n1,5" pipe\n2,"6"" pipe"\n')  # a quote inside a bare field is a character
    assert [tuple(r)[:2] for r in readers.read_dataset(spark, str(tmp_path / "b.csv"), "csv")[0].select("id", "inch").collect()] == [(1, '5" pipe'), (2, '6" pipe')]
    long = '"' + 'a""' * 50_000 + "\n" + "b,c" * 50_000 + '"'
    (tmp_path / "c.csv").write_text(f"id,note\n1,{long}\n")
    assert readers.read_dataset(spark, str(tmp_path / "c.csv"), "csv")[0].select(F.char_length("note")).first()[0] == 250_001


def test_types_in_one_fold(spark, tmp_path):
    columns = {
        "whole": (["1", "-20", "+3", ""], "bigint"), "big": (["123456789012345678901", "1", "2", ""], "double"), "number": (["1", "2.5", "1e3", "NaN"], "double"), "truth": (["true", "False", "", ""], "boolean"),
        "date": (["2024-02-29", "2023-01-01", "", ""], "date"), "no_date": (["2023-02-29", "2023-01-01", "", ""], "string"), "mixed": (["2023-01-01", "01.02.2023", "", ""], "string"),
        "time": (["2024-02-29T10:00:00", "2023-01-01 00:00:00.5", "", ""], "timestamp_ntz"), "both": (["2023-01-01", "2023-01-01 10:00:00", "", ""], "string"), "truth_or_one": (["true", "1", "", ""], "string"), "nothing": (["", "", "", ""], "string"), "text": (["a", "1", "2", "3"], "string"),
    }
    lines = [",".join(columns), *(",".join(c[0][k] for c in columns.values()) for k in range(4))]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    frame = readers.read_dataset(spark, str(tmp_path / "a.csv"), "csv")[0].drop(ROW)
    assert dict(frame.dtypes) == {c: kind for c, (_, kind) in columns.items()}
    assert [r["whole"] for r in frame.collect()] == [1, -20, 3, None] and frame.first()["date"] == datetime.date(2024, 2, 29)
    (tmp_path / "b.csv").write_text("\n".join([lines[0], lines[0], *lines[1:]]) + "\n")  # a row like the header is a row
    assert readers.read_dataset(spark, str(tmp_path / "b.csv"), "csv")[0].count() == 5
    (tmp_path / "c.csv").write_text("a,b\n1,2\n3\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_dataset(spark, str(tmp_path / "c.csv"), "csv")[0].collect()


def test_encodings():
    cut = b"a" + "ü".encode() * 70_000
    assert cut[readers.HEAD - 1 : readers.HEAD] == b"\xc3" and readers.detect_text_format(cut)[0] == "utf-8" and readers.detect_text_format(cut[: readers.HEAD - 2] + b"\xc3")[0] != "utf-8"
    assert readers.detect_text_format(b"\xef\xbb\xbfa;b\n1;2\n") == ("utf-8-sig", ";")
    assert [readers.java_charset(x) for x in ("utf-8", "utf-8-sig", "cp1252", "latin-1", "iso8859-15")] == ["UTF-8", "UTF-8", "windows-1252", "ISO-8859-1", "ISO-8859-15"]


def test_plain_text_is_no_anchor():
    p = definition.from_yaml("name: a &x b *y\nsteps: [{id: a, type: load_dataset, name: 'R & D *'}]")
    assert p.name == "a &x b *y"


def test_demo_data(spark, tmp_path):
    from larkspur.sources import demo

    for theme in demo.THEMES:
        frame = demo.demo_dataset(spark, theme, 400)
        assert frame.count() == 400 and frame.exceptAll(demo.demo_dataset(spark, theme, 400)).isEmpty()
        notes = {r["quality_note"] for r in frame.select("quality_note").distinct().collect()}
        assert notes == {"clean", "copy", "fault"}
    catalogue = Catalogue(spark, str(tmp_path / "catalogue"))
    made = catalogue.add_demo("base", 300)
    assert catalogue.add_demo("base", 300)["id"] == made["id"] and catalogue.profile_dataset(made["id"])["row_count"] == 300
    with pytest.raises(ValueError):
        demo.demo_dataset(spark, "nothing")


def test_run(spark, tmp_path):
    catalogue = Catalogue(spark, f"file://{tmp_path}/catalogue")
    data = catalogue.add_dataset("my data.csv", io.BytesIO(CSV.encode()))
    assert catalogue.add_dataset("copy.csv", io.BytesIO(CSV.encode()))["status"] == "duplicate"
    assert catalogue.profile_dataset(data["id"])["row_count"] == 3
    run = execute_run(catalogue, data["id"], examples.FULL_QUALITY, f"file://{tmp_path}/out")
    assert (run["status"], run["input_rows"], run["output_rows"], run["quarantined_rows"], run["duplicate_count"]) == ("completed", 3, 2, 1, 2), run.get("errors")
    names = {r["name"] for r in catalogue.table("artifacts").collect()}
    assert names == {"result.parquet", "result.csv", "result.jsonl", "quarantine.parquet", "quality-report.json", "performance-report.json", "pipeline.yaml", "audit-log.jsonl", "run-manifest.json", "checksums.sha256"}
    listed = dict(line.split("  ")[::-1] for line in (tmp_path / "out" / run["id"] / "checksums.sha256").read_text().splitlines())
    for r in catalogue.table("artifacts").collect():
        assert listed.get(r["name"], r["sha256"]) == r["sha256"] and store.checksum(spark, artifact_path(catalogue, r["id"], f"{tmp_path}/out")) == (r["sha256"], r["size_bytes"])
    assert set(listed) == names - {"checksums.sha256"}
    with pytest.raises(ValueError):
        artifact_path(catalogue, r["id"], str(tmp_path / "catalogue"))
    notes = {r["note"] for r in spark.read.option("header", True).csv(f"{tmp_path}/out/{run['id']}/result.csv").collect()}
    assert "'=1+1" in notes
    bad = definition.pipeline({"name": "x", "steps": [{"id": "s", "type": "select_columns", "name": "s", "config": {"columns": ["nope"]}}]})
    assert execute_run(catalogue, data["id"], bad, str(tmp_path / "out"))["status"] == "failed"
    assert execute_run(catalogue, data["id"], bad, str(tmp_path / "out"), cancelled=lambda: True)["status"] == "cancelled"
    assert execute_run(catalogue, data["id"], bad, str(tmp_path / "out"), timeout_seconds=-1)["status"] == "timed_out"
    seen = overview(catalogue.table("runs"))
    assert (seen["runs"], seen["by_status"]["completed"], seen["by_status"]["failed"], seen["duplicates"]) == (4, 1, 1, 2)
    catalogue.decide(run["id"], "dup-1", "accepted", "a")
    with pytest.raises(ValueError):
        catalogue.decide(run["id"], "dup-1", "maybe")
    assert run_figures(10, 7, 2, 2.0, 80.0, 90.0, 100, 50) == {"rows_per_second": 5.0, "compression_ratio": 2.0, "quality_delta": 10.0, "quality_delta_percent": 12.5, "data_loss_rows": 1}


@pytest.mark.parametrize("cause", ["cancel", "timeout", "error"])
def test_ends_inside_a_step(spark, monkeypatch, cause):
    plain, called = compiler.apply_step, []

    def slow(frame, step):
        done = plain(frame, step)
        called.append(time.perf_counter())
        done.frame = done.frame.withColumn("slept", F.expr("java_method('java.lang.Thread', 'sleep', 100L + 0 * id)"))  # 40 s
        return done

    def cancelled():
        if cause == "error" and called:
            raise LookupError("no catalogue")
        return cause == "cancel" and bool(called) and time.perf_counter() - called[0] > 1

    monkeypatch.setattr(compiler, "apply_step", slow)
    p = definition.pipeline({"name": "x", "steps": [{"id": "s", "type": "filter_rows", "name": "s", "config": {"column": "id", "operator": "gte", "value": 0}}]})
    frame, metrics, stored = spark.range(0, 1600, 1, 4), [], len(spark.sparkContext._jsc.getPersistentRDDs())
    kind = {"cancel": RunCancelled, "timeout": RunTimedOut, "error": LookupError}[cause]
    began = time.perf_counter()
    with pytest.raises(kind):
        compiler.execute(frame, p, cancelled, 6 if cause == "timeout" else 900, metrics)
    assert time.perf_counter() - (began + 6 if cause == "timeout" else called[0]) < 5
    assert len(called) == 1 and metrics[0].error.startswith(kind.__name__)
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == stored
    assert spark.range(10).count() == 10 and not spark.sparkContext.getJobTags()  # the session goes on


def test_compile_is_lazy_and_disabled_steps_are_skipped(spark):
    p = definition.pipeline({"name": "x", "steps": [{"id": "s", "type": "filter_rows", "name": "s", "enabled": False, "config": {"column": "nope", "operator": "is_null"}}]})
    result, aside = compiler.compile_plan(spark.range(3), p)
    assert (result.count(), aside.count(), aside.columns) == (3, 0, ["id", "quarantine_reason"])


def test_stream(spark, tmp_path):
    spark.createDataFrame([("Hauptstr. 1", "Berlin", "10115"), ("Weg 1", "Bonn", "1")], "street string, city string, postal_code string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("street string, city string, postal_code string").parquet(str(tmp_path / "in"))
    result, (aside,) = stream_pipeline(stream, examples.GERMAN_ADDRESSES)
    query = result.writeStream.format("memory").queryName("kept").start()
    other = aside.select("quarantine_reason").writeStream.format("memory").queryName("aside").start()
    query.processAllAvailable(), other.processAllAvailable()
    query.stop(), other.stop()
    assert [r["house_number_normalized"] for r in spark.table("kept").collect()] == ["1"] and spark.table("aside").count() == 1
    with pytest.raises(ValueError):
        stream_pipeline(stream, examples.FULL_QUALITY)


def test_registered_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_package_reaches_the_workers(tmp_path):
    """A session of the caller's own, without an import path or checkpoint folder for the workers."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
import sys; sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
from larkspur.plans import compiler, examples
frame = spark.createDataFrame([("Größe 1", "Köln", "10115")], "street string, city string, postal_code string")
print("ROWS", compiler.compile_plan(frame, examples.GERMAN_ADDRESSES)[0].count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "ROWS 1" in done.stdout, done.stderr[-2000:]
