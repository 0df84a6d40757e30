"""Language identification by naive Bayes over hashed character n-grams (operator 9).

Features are the 1- to 3-grams of the lower-cased letters of a text (everything else is one kind of
gap), hashed to `buckets`. Training counts n-grams per language over labelled texts; `max_training`
bounds how many, chosen by a hash of their text, and is the only sampling here. The smoothed
log-probability matrix (buckets x languages) has a fixed size and is broadcast with the logarithms of
the languages' shares among the training texts, the class priors. Scoring is the product of each
batch's sparse document-by-bucket matrix with it: the rows' bucket indices and row pointers in, one
sum per document and language out.

Texts are hashed in stretches of STRETCH characters that overlap by two, so a text of any length
needs bounded memory. Results in odd cases: a null text, or one without a letter, is `und` with
score 0; without training data every text is `und`; ties go to the language that sorts first;
labels that are null are not learned; an empty table gives an empty result; repeated rows are scored
alike; columns that are not carried are ignored, and carried ones may have any name but those of the
results, which are replaced.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidy

ORDERS = (1, 2, 3)
STRETCH = 1 << 20
#: Languages up to this many may be learned; the matrix is at most buckets x this.
MOST_LANGUAGES = 256
#: Odd multipliers of the n-gram hash.
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)

#: What follows each part, so that n-grams do not reach into the next.
GAP = np.zeros(3, np.uint32)

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """True for each code point that is a letter."""
    global _letters
    if _letters is None:
        _letters = np.array([chr(i).isalpha() for i in range(0x110000)], bool)
    return _letters


def grams(codes: np.ndarray, bits: int) -> list[np.ndarray]:
    """For each order, the bucket of the n-gram that begins at each position (cut at the end)."""
    with np.errstate(over="ignore"):
        x, out, h = codes.astype(np.uint32), [], np.zeros(len(codes), np.uint32)
        for k in range(len(ORDERS)):
            h = h[: len(x) - k] * np.uint32(MULTIPLIERS[1]) + (x[k:] + np.uint32(k + 1)) * np.uint32(MULTIPLIERS[0]) if k else (x + np.uint32(1)) * np.uint32(MULTIPLIERS[0])
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(MULTIPLIERS[2])
            out.append((mixed >> np.uint32(32 - bits)).astype(np.int32))
    return out


def stretches(texts: list[str]):
    """Groups of (rows, parts, own): texts cut to parts, of which the first `own` characters begin
    n-grams and the rest only ends them."""
    rows, parts, own, size = [], [], [], 0
    for i, text in enumerate(texts):
        low = text.lower()
        for at in range(0, len(low), STRETCH):
            part = low[at : at + STRETCH + 2]
            rows.append(i)
            parts.append(np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32))
            own.append(min(len(part), STRETCH))
            size += len(part)
            if size >= STRETCH:
                yield rows, parts, own
                rows, parts, own, size = [], [], [], 0
    if rows:
        yield rows, parts, own


def sparse_batch(texts: list[str], bits: int):
    """CSR pieces of a batch: runs of (row of each part, bucket indices, starts, ends), and the
    letters of each text. What a text gives does not depend on its neighbours in the batch."""
    is_letter, n_letters = letters(), np.zeros(len(texts), np.int64)
    runs = []
    for rows, parts, own in stretches(texts):
        sizes = np.array([len(p) + len(GAP) for p in parts])
        codes = np.concatenate([x for p in parts for x in (p, GAP)])
        ok = is_letter[codes]
        codes[~ok] = 32
        starts = np.cumsum(sizes) - sizes
        ends = starts + np.array(own)
        np.add.at(n_letters, rows, np.add.reduceat(ok, np.ravel([starts, ends], "F"), dtype=np.int64)[::2])
        for index in grams(codes, bits):
            runs.append((np.array(rows), index, starts, ends))
    return runs, n_letters


Model = tuple[list[str], np.ndarray, np.ndarray]  # languages, log-probabilities, log-priors


def train(labelled: DataFrame, text_col: str, label_col: str, bits: int, max_training: int) -> Model:
    """The counts are folded in tasks, then by (language, bucket)."""
    rows = labelled.select(F.col(label_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    known = [r["lang"] for r in rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()]
    if len(known) > MOST_LANGUAGES:  # before any task holds a table for each
        raise ValueError(f"more than {MOST_LANGUAGES} languages; label fewer")
    if not known:
        return [], np.zeros((1 << bits, 0), np.float32), np.zeros(0)
    total = rows.count()
    share = min(1.0, max_training / total)
    rows = rows.where(F.pmod(F.xxhash64("text", F.lit(9)), F.lit(1_000_003)) < int(share * 1_000_003) + (share == 1.0))

    def count(batches):
        seen: dict[str, np.ndarray] = {}
        texts_of: Counter = Counter()
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            texts_of.update(langs)
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs) if x == lang]
                sums = seen.setdefault(lang, np.zeros(1 << bits, np.int64))
                for _, index, starts, ends in sparse_batch(own, bits)[0]:
                    counted = np.zeros(len(index) + 1, np.int8)
                    counted[starts], counted[ends] = 1, -1
                    sums += np.bincount(index[np.cumsum(counted, dtype=np.int8)[:-1] > 0], minlength=1 << bits)
        for lang, sums in seen.items():
            at = np.flatnonzero(sums)
            # the bucket -1 counts texts
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array([-1, *at], pa.int32()), pa.array([texts_of[lang], *sums[at]], pa.int64())], ["lang", "bucket", "n"])

    counts = rows.mapInArrow(tidy(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counts.column("lang").to_pylist()))
    if not langs:
        return [], np.zeros((1 << bits, 0), np.float32), np.zeros(0)
    at = {x: i for i, x in enumerate(langs)}
    bucket, lang, n = counts.column("bucket").to_numpy(), np.array([at[x] for x in counts.column("lang").to_pylist()]), counts.column("n").to_numpy()
    table, texts, own = np.full((1 << bits, len(langs)), 0.5), np.zeros(len(langs)), bucket >= 0
    table[bucket[own], lang[own]] += n[own]
    texts[lang[~own]] = n[~own]
    return langs, np.log(table / table.sum(axis=0)).astype(np.float32), np.log(texts / texts.sum())


def predict(docs: DataFrame, model: Model, text_col: str, carry: list[Column]) -> DataFrame:
    """The columns in `carry` with lang_pred and score."""
    spark, (langs, table, priors) = docs.sparkSession, model
    bits = int(len(table)).bit_length() - 1
    shared = spark.sparkContext.broadcast([np.ascontiguousarray(table[:, i]) for i in range(len(langs))])
    base = docs.select(F.struct(*carry).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = base.select("doc", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def score(batches):
        columns = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            runs, n_letters = sparse_batch(texts, bits)
            sums = np.zeros((len(texts), len(columns))) + priors
            for rows, index, starts, ends in runs:
                bounds = np.ravel([starts, ends], "F")
                for i, column in enumerate(columns):
                    np.add.at(sums[:, i], rows, np.add.reduceat(column[index], bounds, dtype=np.float64)[::2])
            if columns:
                best = sums.argmax(axis=1)
                share = 1 / np.exp(np.minimum(sums - sums[np.arange(len(sums)), best][:, None], 0)).sum(axis=1)
                known = n_letters > 0
            else:
                best, share, known = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts), bool)
            names = [langs[b] if k else "und" for b, k in zip(best, known)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(names, pa.string()), pa.array(np.where(known, share, 0.0))], ["doc", "lang_pred", "score"])

    return base.mapInArrow(tidy(score), schema).select("doc.*", "lang_pred", "score")


def identify(
    docs: DataFrame,
    labelled: DataFrame,
    text_col: str = "text",
    label_col: str = "lang",
    carry: list[Column] | None = None,
    bits: int = 16,
    max_training: int = 20_000,
) -> DataFrame:
    """Train on `labelled`, predict for `docs`. Without `carry`, all columns come along but those named
    like the results."""
    small_batches(docs.sparkSession)
    model = train(labelled, text_col, label_col, bits, max_training)
    return predict(docs, model, text_col, carry if carry is not None else [docs[c] for c in docs.columns if c not in ("lang_pred", "score")])
