"""Removal of passages that repeat, by level-wise doubling (operator 11).

A window is a run of `length` words; a window whose words also start anywhere else, in the same text or
another, is a repeat, and every word of a repeat goes. Windows are judged on the texts as they came.

Whether a window repeats is settled level by level, at lengths that double up to `length` (18 and 35
words for 35). A window can only repeat if the shorter runs inside it do, so at each level below the
last a window is stood for by one run inside it, the one with the least hash (the leftmost of equal
ones). Which run that is depends on the window's words alone, so equal windows have equal runs at equal
offsets; and neighbouring windows mostly share it, so only about two runs in `length - level + 2` are
looked at. Windows whose run occurs once are out. The others alone are extended to twice that length,
where the runs are fewer and longer, and at the last level each window stands for itself, by 128 bits of
hash. Runs meet in one grouped sum, which tasks fold before the shuffle; what comes back to the texts is
the places of the runs that occur once, so no run of many copies is ever joined or listed.

Texts move once: they are written in buckets by row, and each level joins its short lists to them
there. Equal texts are found first, by digest: one of them stands for all of them at every level, with
its runs counted twice, so a family of exact copies costs no more than one text.

Results in odd cases: a null or empty text has no words and keeps none; a text of fewer words than
`length` keeps all of its words; repeated rows are copies of each other, so all of a long enough text
goes in each; null ids pass through; an empty table gives an empty result; other columns, whatever their
names, are ignored; texts of any length are read whole, in memory of some 200 bytes a word.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work, small_batches, tidy

#: Runs are not halved below so many words.
SHORTEST = 16
#: Words that a task remembers the hashes of.
KNOWN_WORDS = 1 << 18
#: Odd multipliers of the hash of two runs.
FIRST, SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: A text that stands for its copies, and one of the others.
STANDS, COPY = 1, 2


def levels(length: int) -> list[int]:
    """The lengths of the runs, each at most twice the one before."""
    out = [length]
    while (out[-1] + 1) // 2 >= SHORTEST:
        out.append((out[-1] + 1) // 2)
    return out[::-1]


class Words(dict):
    """The place of each word in `low` and `high`, the halves of its hash."""

    def __init__(self):
        super().__init__()
        self.low, self.high = array("Q"), array("Q")

    def forget(self) -> None:
        self.clear()
        self.low, self.high = array("Q"), array("Q")

    def __missing__(self, word: bytes) -> int:
        import xxhash

        digest = xxhash.xxh3_128_intdigest(word)
        self.low.append(digest & 0xFFFFFFFFFFFFFFFF)
        self.high.append(digest >> 64)
        self[word] = len(self.low) - 1
        return len(self.low) - 1


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of two runs side by side."""
    x = (a ^ (a >> np.uint64(29))) * FIRST + b
    x = (x ^ (x >> np.uint64(32))) * SECOND
    return x ^ (x >> np.uint64(29))


def run_hashes(words: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """The hashes of all runs of each size, from the words' hashes, by doubling."""
    out, now, have = [], words, 1
    for size in sizes:
        while have < size:
            step = min(have, size - have)
            now = joined(now[: max(len(now) - step, 0)], now[step:])
            have += step
        out.append(now)
    return out


def least_of(values: np.ndarray, span: int) -> np.ndarray:
    """For each start, the place of the least of `span` values, the leftmost of equal ones."""
    at, have = np.arange(len(values)), 1
    while have < span:
        step = min(have, span - have)
        left, right = at[: max(len(at) - step, 0)], at[step:]
        at = np.where(values[right] < values[left], right, left)
        have += step
    return at


class Texts:
    """The words of some texts, one after the other, and which windows may repeat."""

    def __init__(self, texts: list[bytes], known: Words, length: int, sizes: list[int]):
        if len(known) > KNOWN_WORDS:
            known.forget()
        self.words = [x.split() for x in texts]
        self.counts = np.array([len(x) for x in self.words], np.int64)
        self.ends = np.cumsum(self.counts)
        self.starts = self.ends - self.counts
        place = np.fromiter((p for x in self.words for p in map(known.__getitem__, x)), np.int64, int(self.counts.sum()))
        self.length, self.sizes, self.place, self.known = length, sizes, place, known
        self.text_of = np.repeat(np.arange(len(texts)), self.counts)
        with np.errstate(over="ignore"):
            self.runs = run_hashes(np.frombuffer(known.low, np.uint64)[place] if len(place) else np.zeros(0, np.uint64), sizes)
        whole = len(self.text_of) - length + 1
        self.open = self.text_of[:whole] == self.text_of[length - 1 :] if whole > 0 else np.zeros(0, bool)

    def stands_for(self, level: int) -> np.ndarray:
        """Where the run begins that stands for each window."""
        return least_of(self.runs[level], self.length - self.sizes[level] + 1) if len(self.open) else np.zeros(0, np.int64)

    def close(self, level: int, once: list) -> None:
        """Windows whose run is one of those that occur once (places within each text) are out."""
        single = np.zeros(len(self.text_of), bool)
        for start, places in zip(self.starts, once):
            if places is not None and len(places):
                single[start + np.asarray(places)] = True
        if len(self.open):
            self.open &= ~single[self.stands_for(level)]

    def second(self) -> np.ndarray:
        """The other half of the hashes at the last level."""
        with np.errstate(over="ignore"):
            return run_hashes(np.frombuffer(self.known.high, np.uint64)[self.place], self.sizes[-1:])[0]

    def covered(self) -> np.ndarray:
        """The words inside windows that are still open."""
        edge = np.zeros(len(self.text_of) + 1, np.int64)
        at = np.flatnonzero(self.open)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + self.length, -1)
        return np.cumsum(edge[:-1]) > 0


def opened(batch: pa.RecordBatch, known: Words, length: int, sizes: list[int], done: int) -> Texts:
    """The texts of a batch with the windows that the first `done` levels leave open."""
    texts = Texts([x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()], known, length, sizes)
    for level in range(done):
        texts.close(level, batch.column(f"once{level}").to_pylist())
    return texts


def level_runs(rows: DataFrame, length: int, sizes: list[int], level: int) -> DataFrame:
    """(h, g, key, at, n): the runs that stand for the open windows; n is 2 for texts with copies."""

    def run(batches):
        known = Words()
        for batch in batches:
            texts = opened(batch, known, length, sizes, level)
            roles = np.array([x or 0 for x in batch.column("role").to_pylist()], np.int64)
            if len(texts.open):
                texts.open &= roles[texts.text_of[: len(texts.open)]] != COPY
            at = np.unique(texts.stands_for(level)[texts.open]) if texts.open.any() else np.zeros(0, np.int64)
            text = texts.text_of[at]
            h = texts.runs[level][at].view(np.int64)
            g = texts.second()[at].view(np.int64) if level == len(sizes) - 1 and len(at) else np.zeros(len(at), np.int64)
            keys = batch.column("key").to_numpy(zero_copy_only=False)[text]
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(g), pa.array(keys, pa.int64()), pa.array((at - texts.starts[text]).astype(np.int32)), pa.array(np.where(roles[text] == STANDS, 2, 1).astype(np.int32))], ["h", "g", "key", "at", "n"])

    return rows.mapInArrow(tidy(run), "h long, g long, key long, at int, n int")


def kept_words(rows: DataFrame, length: int, sizes: list[int], id_type: str) -> DataFrame:
    """(id, n_words, n_removed, kept) when all levels are done."""

    def run(batches):
        known = Words()
        for batch in batches:
            texts = opened(batch, known, length, sizes, len(sizes))
            gone = texts.covered()
            removed, kept = [], []
            for words, start, end, role in zip(texts.words, texts.starts, texts.ends, batch.column("role").to_pylist()):
                if role and len(words) >= length:
                    out = np.ones(len(words), bool)
                else:
                    out = gone[start:end]
                removed.append(int(out.sum()))
                kept.append(b" ".join(words if not removed[-1] else [w for w, x in zip(words, out) if not x]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts.counts), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept"])

    return rows.mapInArrow(tidy(run), f"id {id_type}, n_words long, n_removed long, kept string")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 35) -> DataFrame:
    """Rows of (id, n_words, n_removed, kept): `kept` has the words that stay, joined by a space. The
    result reads working tables."""
    if length < 1:
        raise ValueError("length must be at least 1")
    spark, sizes = docs.sparkSession, levels(length)
    small_batches(spark)
    work = Work(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).select("id", "text", F.unhex(F.md5(F.encode("text", "utf-8"))).alias("digest"))
    rows = work.cut(rows.withColumn("key", F.monotonically_increasing_id()), "rows")  # the keys are fixed when they are written
    same = work.cut(rows.groupBy(F.col("digest").alias("d")).agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "same-texts")
    copies = rows.select("key", "digest").join(same, F.col("digest") == F.col("d"))
    roles = work.cut(copies.select(F.col("key").alias("k"), F.when(F.col("key") == F.col("first"), STANDS).otherwise(COPY).alias("role")), "copies")
    id_type = rows.schema["id"].dataType.simpleString()
    texts = work.bucketed(rows.select("key", "id", "text"), "texts", "key")
    work.drop(rows, same)

    tables = [roles]
    joint = texts.join(roles, F.col("key") == F.col("k"), "left").drop("k")
    for level in range(len(sizes)):
        met = level_runs(joint, length, sizes, level).groupBy("h", "g").agg(F.sum("n").alias("n"), F.min("key").alias("key"), F.min("at").alias("at"))
        once = met.where("n = 1").groupBy("key").agg(F.collect_list("at").alias("once"))  # of one text, so bounded by it
        once = work.cut(once.select(F.col("key").alias("k"), F.col("once").alias(f"once{level}")), f"once-{sizes[level]}")
        tables.append(once)
        joint = joint.join(once, F.col("key") == F.col("k"), "left").drop("k")
    return kept_words(joint, length, sizes, id_type).withColumnRenamed("id", id_col)
