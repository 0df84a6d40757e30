"""Exact token counts without token ids (operator 8).

Pieces are counted once for each distinct pre-token of the corpus, the counts are joined to the
pre-token frequencies of every document, and the products are summed. A document's tokens are never
materialised.

Plan: (1) each task folds its pre-tokens to (pre-token, frequency) rows before the only shuffle of
pre-tokens, and the library counts the pieces of each distinct one; the counts are written as a
table. (2) The most frequent pre-tokens, at most `head_entries` of them and none longer than
LONGEST_KEY bytes, go to the workers as a dictionary of proven size; this takes the hot keys out of
the join. (3) Each document sums its head pre-tokens in place and leaves the rest as (key,
frequency) pairs, which a shuffle join resolves.

Results in odd cases: a null or empty text has no bytes and no tokens; a null id is kept; repeated
rows give one result each; an empty table gives an empty result; other columns are ignored, whatever
their names; a text of any length is handled whole.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work, small_batches, tidy

#: Pre-tokens up to this many bytes are their own join key, longer ones are known by their digest.
LONGEST_KEY = 64
#: Distinct pre-tokens that a task holds before it passes its partial counts on.
FLUSH_AT = 200_000

#: Fixed value: the public split pattern of byte-level BPE.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters on whose classes the two regular-expression libraries may differ. Texts that have
#: any of them are split by the tokenizer's own pre-tokenizer.
UNSURE = (
    r"[^\t\n\x0b\x0c\r -~¡-ɏͰ-ͳΆ-ϿЀ-ҁҊ-ԯ"
    r"‐-‧‰-⁞₠-₿ぁ-ゖァ-ヺ一-龥가-힣]"
)


class Splitter:
    """Pre-tokens of a text, as the tokenizer in the file makes them."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        if pre.get("type") != "ByteLevel" or spec.get("normalizer") or pre.get("add_prefix_space"):
            raise ValueError("token counts need a byte-level tokenizer without normalizer or prefix space")
        added = spec.get("added_tokens") or []
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in added):
            raise ValueError("added tokens that take white space or whole words are not supported")
        names = sorted((x["content"] for x in added), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.find, self.unsure = regex.compile(SPLIT).findall, regex.compile(UNSURE).search

    def plain(self, text: str) -> list[str]:
        if not self.unsure(text):
            return self.find(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def __call__(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and how many added tokens stand between them."""
        if self.added is None or not self.added.search(text):
            return self.plain(text), 0
        parts = self.added.split(text)
        return [x for part in parts if part for x in self.plain(part)], len(parts) - 1

    def pieces(self, tokens: list[str]) -> list[int]:
        return [len(x.ids) for x in self.tokenizer.encode_batch_fast(tokens, add_special_tokens=False)]


@lru_cache(maxsize=2)
def splitter(path: str) -> Splitter:
    return Splitter(path)


def key_of(token: str) -> bytes:
    raw = token.encode("utf-8", "surrogatepass")
    return raw if len(raw) <= LONGEST_KEY else b"\0" * 8 + hashlib.blake2b(raw, digest_size=32).digest() * 2


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 1024,
    head_entries: int = 200_000,
) -> DataFrame:
    """Rows of (id, n_bytes, n_tokens, over_limit)."""
    spark = docs.sparkSession
    work = Work(spark)
    small_batches(spark)
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def distinct(batches):
        split, seen = splitter(tokenizer_path), Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["token", "freq"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(split(text)[0])
                if len(seen) > FLUSH_AT:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    def pieces(batches):
        split = splitter(tokenizer_path)
        for batch in batches:
            tokens = batch.column("token").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(map(key_of, tokens), pa.binary()), pa.array(split.pieces(tokens), pa.int64()), batch.column("freq")], ["key", "pieces", "freq"])

    counted = base.select("text").mapInArrow(tidy(distinct), "token string, freq long").groupBy("token").agg(F.sum("freq").alias("freq"))
    table = work.cut(counted.mapInArrow(tidy(pieces), "key binary, pieces long, freq long"), "pieces")

    # the lowest frequency of the head: the histogram has a bounded number of rows
    level = F.when(F.col("freq") < 1024, F.col("freq")).otherwise(1024 + F.floor(F.log2(F.col("freq").cast("double")) * 16).cast("long"))
    short = table.where(F.octet_length("key") <= LONGEST_KEY).withColumn("level", level)
    least, room = None, head_entries
    for row in sorted(short.groupBy("level").count().collect(), key=lambda r: -r["level"]):
        room -= row["count"]
        if room < 0:
            break
        least = row["level"]
    head = {}
    if least is not None:
        head = {bytes(r["key"]).decode("utf-8"): r["pieces"] for r in short.where(F.col("level") >= least).select("key", "pieces").toLocalIterator()}
    shared = spark.sparkContext.broadcast(head)

    def documents(batches):
        split, known, n = splitter(tokenizer_path), shared.value, TaskContext.get().partitionId() << 33
        get = known.get
        for batch in batches:
            rows, sizes, sums, keys, freqs = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                tokens, total = split(text)
                rest = []
                for token in tokens:
                    k = get(token)
                    if k is None:
                        rest.append(token)
                    else:
                        total += k
                counts = Counter(rest)
                rows.append(n)
                n += 1
                sizes.append(len(text.encode("utf-8", "surrogatepass")))
                sums.append(total)
                keys.append([key_of(x) for x in counts])
                freqs.append(list(counts.values()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), batch.column("id"), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(keys, pa.list_(pa.binary())), pa.array(freqs, pa.list_(pa.int64()))],
                ["row", "id", "n_bytes", "head", "keys", "freqs"],
            )

    kind = base.schema["id"].dataType.simpleString()
    per_doc = work.cut(base.mapInArrow(tidy(documents), f"row long, id {kind}, n_bytes long, head long, keys array<binary>, freqs array<long>"), "doc-pieces")
    rest = per_doc.select("row", F.explode(F.arrays_zip("keys", "freqs")).alias("x")).select("row", F.col("x.keys").alias("key"), F.col("x.freqs").alias("n"))
    rest = rest.join(table.select("key", "pieces"), "key").select("row", (F.col("n") * F.col("pieces")).alias("part"))
    whole = per_doc.select("row", F.col("head").alias("part"), "id", "n_bytes", F.lit(True).alias("own"))
    both = whole.unionByName(rest, allowMissingColumns=True).groupBy("row").agg(
        F.sum("part").alias("n_tokens"), F.max("id").alias("id"), F.max("n_bytes").alias("n_bytes")
    )
    out = work.cut(both.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")), "token-counts")
    work.drop(keep=(out,))
    return out
