"""Resampling towards a target distribution by importance weights (operator 13).

Texts are bags of hashed features: runs of one and two words, each in one of BUCKETS buckets. A bucket's
gain is the logarithm of how much likelier it is in the target texts than in the documents; a document's
weight is the mean gain of its features, and documents are drawn without replacement by weight plus
Gumbel noise that follows from the id.

1. One pass over the texts writes inverted postings: for each block of documents and each of RANGES
   ranges of buckets one row, with the documents and counts of every bucket of the range that occurs.
   The table is bucketed by range and lane; a lane is a share of the blocks, as many lanes as there are
   times LANE_DOCS documents, so neither a frequent word nor a range is a hot key.
2. The counts of the documents and of the target texts are summed for each bucket, and the two corpora
   meet by range: every range's gains are made there from its own buckets.
3. Postings and gains are joined in place by range and lane, which moves no posting again, and each row
   emits one contribution for each of its documents. Those are summed by document.
4. Scores are whole numbers of a bounded range (a gain is at most 1000 ln 2^63 in size, the noise lies
   between -3,200 and 23,000), so the table of how many documents have each score is small at any
   scale. It gives the number of documents above each score; only documents of one score are ordered
   among themselves for their ranks.

Results in odd cases: a null or empty text has no features, weight 0 and is not drawn, as any text of
fewer than `least_words` words; a null id gets the noise of an empty one; rows of one id are drawn each
for itself; ties go to the smaller id, then to fewer features; without target texts all gains follow
from the documents alone; an empty table gives an empty result; other columns, whatever their names, are
ignored; texts of any length are read whole, in memory of some 200 bytes a word.
"""

from __future__ import annotations

from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Work, small_batches, tidy

BUCKETS, RANGES = 10_000, 16
#: Documents for each lane.
LANE_DOCS = 16_384
#: Bytes of words are letters, digits and what is not ASCII; capitals become small letters.
WORD_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
POSTINGS = "block long, lane int, part int, ids array<long>, n_words array<long>, n_features array<long>, buckets array<int>, sums array<long>, sizes array<int>, docs binary, counts binary"


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of words of each text, text and bucket hash of every feature)."""
    words = [x.translate(WORD_BYTES).split() for x in texts]
    n = np.array([len(x) for x in words], np.int64)
    text_of = np.repeat(np.arange(len(texts)), n)
    every = [w for x in words for w in x]
    one = list(map(crc32, every))
    two = list(map(crc32, every[1:], map(crc32, repeat(b" "), one)))  # the checksum goes on from the first word's
    inside = text_of[1:] == text_of[:-1]
    hashes = np.concatenate([np.array(one, np.uint32), np.array(two, np.uint32)[inside] if two else np.zeros(0, np.uint32)])
    return n, np.concatenate([text_of, text_of[1:][inside]]), hashes


def narrow(values: np.ndarray) -> bytes:
    """Unsigned integers in the fewest bytes that hold them all, 1, 2 or 4 each."""
    most = int(values.max(initial=0))
    return values.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32).tobytes()


def widened(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(data) // n] if n else np.uint8)


def postings(rows: DataFrame, lanes: int, buckets: int) -> DataFrame:
    """`rows` has (id, text). A row with part -1 has the documents of a block themselves."""
    width = -(-buckets // RANGES)
    schema = pa.schema([("block", pa.int64()), ("lane", pa.int32()), ("part", pa.int32()), *[(c, pa.list_(pa.int64())) for c in ("ids", "n_words", "n_features")], ("buckets", pa.list_(pa.int32())), ("sums", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("docs", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            n, text, hashes = features(texts)
            key, count = np.unique((hashes % np.uint32(buckets)).astype(np.int64) * len(texts) + text, return_counts=True)
            bucket, doc = np.divmod(key, max(len(texts), 1))
            lane = (block * 2654435761 >> 7) % lanes
            total = np.bincount(text, minlength=len(texts)).astype(np.int64)
            out = [(block, lane, -1, batch.column("id").to_pylist(), n, total, None, None, None, None, None)]
            edges = np.searchsorted(bucket, np.arange(RANGES + 1) * width)
            for part, (start, end) in enumerate(zip(edges[:-1], edges[1:])):
                if start < end:
                    own, first, sizes = np.unique(bucket[start:end], return_index=True, return_counts=True)
                    sums = np.add.reduceat(count[start:end], first)
                    out.append((block, lane, part, None, None, None, own.astype(np.int32), sums.astype(np.int64), sizes.astype(np.int32), narrow(doc[start:end]), narrow(count[start:end])))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            block += 1

    return rows.mapInArrow(tidy(run), POSTINGS)


def bucket_sums(table: DataFrame, name: str) -> DataFrame:
    """(part, bucket, name)"""
    each = table.where("part >= 0").select("part", F.explode(F.arrays_zip("buckets", "sums")).alias("x"))
    return each.groupBy("part", F.col("x.buckets").alias("bucket")).agg(F.sum("x.sums").alias(name))


def contributions(joined: DataFrame, buckets: int) -> DataFrame:
    """(block, values): what a range adds to each document of a block."""
    width = -(-buckets // RANGES)

    def run(batches):
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                gain = np.zeros(width, np.int64)
                gain[np.array(x["at"]) % width] = x["gain"]
                sizes = np.array(x["sizes"])
                docs, counts = widened(x["docs"], int(sizes.sum())), widened(x["counts"], int(sizes.sum()))
                added = np.zeros(int(docs.max()) + 1, np.int64)
                np.add.at(added, docs, counts.astype(np.int64) * np.repeat(gain[np.array(x["buckets"]) % width], sizes))
                out.append(added)
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(out, pa.list_(pa.int64()))], ["block", "sums"])

    return joined.mapInArrow(tidy(run), "block long, sums array<long>")


def noise(seed: int, id_text) -> F.Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_text, F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", buckets: int = BUCKETS, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """Every row's (id, n_features, weight, score, rank); the rank is null for what is not drawn. The
    result reads working tables."""
    spark = docs.sparkSession
    small_batches(spark)
    work = Work(spark)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text(text_col))
    wanted = target.select(F.lit(None).cast("long").alias("id"), text(target_text_col))
    lanes = max(1, -(-rows.count() // LANE_DOCS))
    table = work.bucketed(postings(rows, lanes, buckets), "postings", "part", "lane")
    here = work.cut(bucket_sums(table, "s"), "sums")
    there = work.cut(bucket_sums(work.cut(postings(wanted, 1, buckets), "target"), "t"), "target-sums")
    total = lambda frame, c: frame.agg(F.coalesce(F.sum(c), F.lit(0))).first()[0]
    s_all, t_all = total(here, "s"), total(there, "t")

    # the corpora meet by range; a bucket that no document has adds nothing
    both = here.join(there.withColumnsRenamed({"part": "part2", "bucket": "bucket2"}), (F.col("part") == F.col("part2")) & (F.col("bucket") == F.col("bucket2")), "left")
    t1, s1 = (F.coalesce("t", F.lit(0)) + 1).cast("double"), (F.col("s") + 1).cast("double")
    gain = F.floor(1000 * F.log(t1 * F.lit(float(s_all + buckets)) / (s1 * F.lit(float(t_all + buckets))))).cast("long")
    ranges = both.groupBy("part").agg(F.collect_list(F.struct("bucket", gain.alias("gain"))).alias("g"))  # buckets / RANGES at most
    ranges = ranges.select(F.col("part").alias("own_part"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("own_lane"), F.col("g.bucket").alias("at"), F.col("g.gain").alias("gain"))
    joined = table.where("part >= 0").hint("merge").join(ranges, (F.col("part") == F.col("own_part")) & (F.col("lane") == F.col("own_lane")))
    added = contributions(joined.select("block", "buckets", "sizes", "docs", "counts", "at", "gain"), buckets)
    added = added.select("block", F.posexplode("sums").alias("i", "v")).groupBy("block", "i").agg(F.sum("v").alias("v"))

    heads = table.where("part = -1").select(F.col("block").alias("b"), F.posexplode(F.arrays_zip("ids", "n_words", "n_features")).alias("j", "x")).select("b", "j", "x.*")
    n = F.col("n_features")
    v = F.coalesce("v", F.lit(0))
    weight = F.when(n == 0, 0).otherwise(F.expr("(coalesce(v, 0) - pmod(coalesce(v, 0), n_features)) div n_features")).cast("long")
    scored = heads.join(added, (F.col("b") == F.col("block")) & (F.col("j") == F.col("i")), "left").select(F.col("ids").alias("id"), "n_words", n, weight.alias("weight"))
    scored = work.cut(scored.withColumn("score", F.col("weight") + noise(seed, F.col("id").cast("string"))), "scored")
    work.drop(keep=(scored,))
    return ranked(scored, percent, least_words, work).withColumnRenamed("id", id_col)


def ranked(scored: DataFrame, percent: int, least_words: int, work: Work) -> DataFrame:
    """Dense ranks of the highest scores among documents of enough words, ties to the smaller id."""
    able = F.col("n_words") >= least_words
    scores = scored.where(able).groupBy(F.col("score").alias("s")).agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.orderBy(F.col("s").desc())) - F.col("n")  # a row a score, bounded as above
    scores = work.cut(scores.select("s", "n", above.alias("above")), "scores")
    drawn = percent * scores.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // 100
    place = F.row_number().over(Window.partitionBy("able", "score").orderBy(F.col("id").asc_nulls_last(), "n_features"))
    out = scored.withColumn("able", able).withColumn("place", place).join(F.broadcast(scores.where(F.col("above") < drawn).drop("n")), F.col("able") & (F.col("score") == F.col("s")), "left")
    rank = F.col("above") + F.col("place")
    return out.select("id", "n_features", "weight", "score", F.when(rank <= drawn, rank).cast("long").alias("rank"))
