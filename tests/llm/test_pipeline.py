"""The pipeline against a plain version, and the registered queries against their SQL."""

import random

import duckdb
import public_tokenizers
import pytest
import sentencepiece

import __spark_entry__ as entry
import corpus_pipeline
from larkspur.llm import pii, queries
from tests_llm_plain import plain_contamination, plain_groups, sentence


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top, r = tmp_path_factory.mktemp("tables"), random.Random(3)
    items = [(i, sentence(500 + i, 30)) for i in range(5)]
    texts = [sentence(i, r.randint(25, 120)) for i in range(120)]
    texts += [texts[i] + " tail" for i in range(0, 40, 2)] + [sentence(700 + i, 60) + " " + items[i % 5][1] for i in range(10)]
    texts += [" ".join(w + "###" for w in sentence(800 + i, 60).split()) for i in range(5)] + ["short one", None, "", "mail x.y@z.example.com " + sentence(900, 40), "x" * 40_000]
    rows = [(i, t, ["en", "de", None][i % 3], f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(top / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(top / "benchmark.parquet"))
    spark.createDataFrame([(1, "http://a.example.net/en/", "")], "page_id long, url string, html string").write.parquet(str(top / "pages.parquet"))
    labels = [(i, r.randint(0, 1), r.randint(0, 1)) for i in range(0, len(rows), 3)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(top / "labels.parquet"))
    return str(top), rows, items


def test_pipeline(spark, folder):
    top, rows, items = folder
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, top).collect()}
    good = {r["doc_id"] for r in queries.op5_quality_rules(spark, top).where("kept").collect()}
    docs = [(i, t or "") for i, t, *_ in rows if i in good]
    groups = plain_groups(docs)
    docs = [(i, t) for i, t in docs if groups[i][1] == i]
    docs = [d for d, p in zip(docs, plain_contamination(docs, items)) if not p[-1]]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = pii.train(frame)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert set(got) == {i for i, _ in docs} and 60 < len(got) < len(rows) - 20
    for i, t in docs:
        safe = pii.redacted(t, pii.spans_of(t, model)[1])
        assert got[i]["text"] == safe and list(got[i]["ids"]) == library.encode(safe) and got[i]["n_chars"] == len(safe)


def test_stages_keep_columns(spark, folder):
    top, *_ = folder
    docs = spark.read.parquet(f"{top}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, top)
        assert out.columns == columns, name
        assert stage(spark, docs.limit(0), top).count() == 0, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "pii", "sentencepiece"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), top).count() == 0


def test_queries_match_their_sql(spark, folder):
    top, *_ = folder
    base = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        base.execute(f"create view {t} as select * from '{top}/{t}.parquet/*.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        frame = queries.QUERIES[name](spark, top)
        cursor = base.execute(sql)
        names = [c[0] for c in cursor.description]
        assert sorted(map(repr, (tuple(r[n] for n in names) for r in frame.collect()))) == sorted(map(repr, cursor.fetchall())), name


def test_every_operator_is_registered():
    found = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in found if k.startswith("op")} and "pipeline" in found
