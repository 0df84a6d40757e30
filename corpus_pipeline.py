"""The corpus pipeline: from raw documents to piece ids, stage by stage.

Each stage gets the documents that its predecessor kept, with the columns of `documents`, and what it
decides takes effect: rejected documents go (quality rules), one document of each group of near
duplicates stays, contaminated documents go, personal data is replaced in the texts, and the last
stage returns the ids of the texts and what they decode to.

Stages keep no state: what a stage decided is a small table that its result reads, and the larger
working tables are gone when the stage returns. `run` also deletes those small tables, and each
stage's result when the next one is written.

Results in odd cases: documents without a text, or with an empty one, fail the quality rules; repeated
rows stay once; an empty table gives an empty result; other columns, whatever their names, pass
through, but for `ids` and `n_pieces`, which the last stage sets; texts of any length are handled whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import decontamination, near_duplicates, pii, quality_rules, sentencepiece_codec
from larkspur.llm.common import release, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars, if it is there, follows the text."""
    safe = pii.redact(docs)
    if "n_chars" in docs.columns:
        safe = safe.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return safe


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with `ids`, the text that these decode to, and their number."""
    carry = [docs[c] for c in docs.columns if c not in ("text", "ids", "n_pieces")]
    encoded = sentencepiece_codec.encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"), carry, back="text")
    return encoded.withColumn("n_pieces", F.size("ids").cast("long"))


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("pii", personal_data),
    ("sentencepiece", pieces),
]

#: Neither the span classifier nor the piece ids can be expressed in SQL; tests/llm has the
#: brute-force version of the whole run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept, path = stage(spark, docs, sf_dir), scratch(spark, name)
        kept.write.parquet(path)
        release(kept)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
