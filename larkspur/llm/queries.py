"""The opN queries: thin wrappers that fix each operator's production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, filter_audit, importance_sampling, language_id, license_scan, near_duplicates, oracle, pii, quality_rules, sentencepiece_codec, substring_dedup, token_counts, token_files, url_filters
from .common import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), scratch(spark, "token-files")
    token_files.write_token_files(docs, out, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.read_token_files(spark, out, docs.schema["doc_id"].dataType.simpleString())


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licences(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and whether decoding them gives the text back (null: empty)."""
    path, docs = public_tokenizers.path("piece_bpe_32k.model"), table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    encoded = sentencepiece_codec.encode_texts(docs, path, [F.col("doc_id"), F.xxhash64(text).alias("text_hash")], back="decoded")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), (F.xxhash64("decoded") == F.col("text_hash")).alias("round_trip"), "ids")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(table(spark, sf_dir, "documents"))


#: The rules of the contract.
URL_RULES = [
    url_filters.Rule("block", "net", "/"),
    url_filters.Rule("allow", "example.net", "/en/"),
    url_filters.Rule("block", "example.com", "/de/"),
    url_filters.Rule("allow", "org", "/fr/"),
]


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash", "spans")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    labelled = docs.where(F.col("doc_id").isNotNull() & ~held_out)
    return language_id.identify(docs, labelled, carry=[F.col("doc_id"), held_out.alias("held_out")])


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.drop_repeats(table(spark, sf_dir, "documents"), length=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_sampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict = {
    "op1_token_files": op1_token_files,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_license_scan": op3_license_scan,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_quality_rules": op5_quality_rules,
    "op6_url_filters": op6_url_filters,
    "op7_decontamination": op7_decontamination,
    "op8_token_counts": op8_token_counts,
    "op9_language_id": op9_language_id,
    "op10_pii": op10_pii,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_filter_audit": op12_filter_audit,
    "op13_importance_resampling": op13_importance_resampling,
}
ORACLE_SQL: dict[str, str] = {
    "op2_near_duplicates": oracle.near_duplicates_sql(),
    "op3_license_scan": oracle.licence_sql(),
    "op5_quality_rules": oracle.quality_sql(),
    "op7_decontamination": oracle.contamination_sql(),
    "op11_substring_dedup": oracle.repeats_sql(),
    "op12_filter_audit": oracle.audit_sql(),
}
