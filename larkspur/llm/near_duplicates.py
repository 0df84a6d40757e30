"""MinHash near-duplicate groups with min-max hashing (operator 2).

A document's set holds the 64-bit hashes of its distinct 5-word shingles. Under each of `PERMUTATIONS`
hash permutations both the least and the greatest value are kept, so a signature of twice as many
values costs one evaluation per permutation and shingle. BANDS bands of ROWS values each make bucket
keys, and four bits of every value make a sketch; two documents of similarity 0.75 share none of the 64
buckets with a chance of 3e-8.

1. One pass over the texts writes (row key, id, digest of the set, size, band keys, 4-bit sketch).
2. Rows with the same set form a class, represented by one row key; only classes go on.
3. Keys that two classes or more share make the candidate buckets. Pairs within a bucket are not
   emitted: each bucket has a centre, the member that meets most others over all buckets; each class
   is compared with the centre that it meets most often, and the verified links give components. For
   buckets whose members are still in two components or more, the members outside the component of
   the centre are compared with the centre, and what is then still unresolved is compared
   exhaustively between components, except within the bucket's largest one, after two filters: an
   exact upper bound of the intersection (shingles that no other open class has cannot be shared),
   and the sketch (a pair of similarity 0.75 fails it with a chance of 2e-8). So no candidate pair is
   lost to a cap.
4. Every link is confirmed on the full sets. Sets are made again from the texts, for classes in
   candidate buckets only. A centre that very many classes are compared with has its set copied to
   as many tasks as they need, so that no task gets all of them.
5. Components come from alternating star steps. Links found later are contracted to the components
   found before, so only what is new goes through the steps again.

Results in odd cases: a text without words, or a null text, has an empty set and no link; a text of
fewer than five words has its whole sequence as its only shingle; repeated rows belong together, as
their sets are the same. In `near_duplicates` rows with the same id are one node, so different texts
of one id join their components; `keep_one` looks at texts, so of those it keeps what is no copy. A
row with a null id has no link and is kept; an empty table gives an empty result; other columns,
whatever their names, are ignored by `near_duplicates` and pass through `keep_one`. Texts of any
length are read whole, in memory of a few times their size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Work, by_size, small_batches, tidy
from .components import components, contracted

BANDS, ROWS = 64, 5
#: The bands take the values of the first half of the permutations; the sketch takes those of all.
PERMUTATIONS = BANDS * ROWS
#: Rows up to this many are broadcast to pick or remove texts (three longs each, 24 MB at most).
BROADCAST_ROWS = 1_000_000
#: Classes that a copy of a centre's set is compared with in one task.
PER_COPY = 2_000
#: Of the sketch's values as many may differ: 640 * (0.2344 + 5.5 * 0.01675).
MOST_DIFFERENT = 209

_random = np.random.RandomState(20)
#: Fixed values drawn from a fixed seed: multipliers and offsets of the permutations.
FACTORS = _random.randint(0, 1 << 31, PERMUTATIONS).astype(np.uint32) * np.uint32(2) + np.uint32(1)
OFFSETS = _random.randint(0, 1 << 32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32)
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of `width` words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(width, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = (out ^ (out >> np.uint64(29))) * MIX + h[k : len(h) - n + 1 + k]
        out = (out ^ (out >> np.uint64(32))) * MIX
    return np.unique(out ^ (out >> np.uint64(29)))


def signature(found: np.ndarray) -> np.ndarray:
    """Least and greatest value under each permutation, one after the other."""
    x = (found >> np.uint64(32)).astype(np.uint32)[:, None]
    low, high = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    for at in range(0, len(x), 256):
        values = x[at : at + 256] * FACTORS
        values += OFFSETS
        np.minimum(low, values.min(axis=0), out=low)
        np.maximum(high, values.max(axis=0), out=high)
    return np.ravel([low, high], "F")


def band_keys(values: np.ndarray) -> np.ndarray:
    values = values[: BANDS * ROWS]
    with np.errstate(over="ignore"):
        key = np.arange(1, BANDS + 1, dtype=np.uint64) * MIX
        for k in range(ROWS):
            key = (key ^ (key >> np.uint64(31))) * MIX + values[k::ROWS]
        return ((key ^ (key >> np.uint64(32))) * MIX).view(np.int64)


def sketch(values: np.ndarray) -> np.ndarray:
    """Four mixed bits of each value, in longs."""
    with np.errstate(over="ignore"):
        bits = ((values * np.uint32(0x85EBCA6B)) >> np.uint32(28)).astype(np.uint8)
    return (bits[::2] << 4 | bits[1::2]).view(np.int64)


def different_values() -> Column:
    """How many four-bit values of `sketch` and `sketch2` differ. Written as higher-order functions:
    one expression for each long would make a method that the JVM does not compile."""
    x = F.zip_with("sketch", "sketch2", lambda a, b: a.bitwiseXOR(b))
    pairs = F.transform(x, lambda v: v.bitwiseOR(F.shiftright(v, 1)))
    counts = F.transform(pairs, lambda v: F.bit_count(v.bitwiseOR(F.shiftright(v, 2)).bitwiseAND(F.lit(0x1111111111111111))))
    return F.aggregate(counts, F.lit(0), lambda total, n: total + n)


def signed_rows(rows: DataFrame, width: int) -> DataFrame:
    """`rows` has (id, text, th)."""
    import xxhash  # noqa: F401  (fails here, on the driver, if it is missing)

    def run(batches):
        import xxhash

        for batch in batches:
            d1, d2, sizes, bands, marks = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingles(text, width)
                digest = xxhash.xxh3_128_intdigest(found.tobytes())
                d1.append((digest >> 64) - (1 << 63))
                d2.append((digest & (1 << 64) - 1) - (1 << 63))
                sizes.append(len(found))
                if len(found):
                    values = signature(found)
                    bands.append(band_keys(values))
                    marks.append(sketch(values))
                else:
                    bands.append(np.zeros(0, np.int64))
                    marks.append(np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("th"), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(marks, pa.list_(pa.int64()))],
                ["id", "th", "d1", "d2", "n", "bands", "sketch"],
            )

    signed = rows.mapInArrow(tidy(run), "id long, th long, d1 long, d2 long, n long, bands array<long>, sketch array<long>")
    return signed.withColumn("row", F.monotonically_increasing_id())  # fixed when it is written


def full_sets(rows: DataFrame, width: int) -> DataFrame:
    """`rows` has (row, text)."""

    def run(batches):
        for batch in batches:
            found = [shingles(x, width).view(np.int64) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.list_(pa.int64()))], ["row", "shingles"])

    return rows.mapInArrow(tidy(run), "row long, shingles array<long>")


def side(frame: DataFrame) -> DataFrame:
    """The frame, for broadcast if it is small."""
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else frame


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar. Many pairs may have the same b."""
    copies = pairs.groupBy(F.col("b").alias("hot")).agg(F.ceil(F.count("*") / PER_COPY).cast("int").alias("copies")).where("copies > 1")
    left = sets.select(F.col("row").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("row").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    linked = 100 * both >= percent * (F.size("sa") + F.size("sb") - both)
    if copies.isEmpty():
        return pairs.join(left, "a").join(right, "b").where(linked).select("a", "b")
    few = side(copies)
    part = F.pmod(F.xxhash64("a"), F.coalesce("copies", F.lit(1))).cast("int")
    dealt = pairs.join(few, F.col("b") == F.col("hot"), "left").select("a", "b", part.alias("part"))
    each = F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("part2")
    right = right.join(few, F.col("b") == F.col("hot"), "left").select(F.col("b").alias("b2"), "sb", each)
    joined = dealt.join(left, "a").join(right, (F.col("b") == F.col("b2")) & (F.col("part") == F.col("part2")))
    return joined.where(linked).select("a", "b")


class Groups:
    """Rows and their near-duplicate components, as written tables.

    rows: (row, id, th, n, rep), one for each input row; rep is the row key of its set's class.
    labels: (rep, component) of classes in a link."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, by_id: bool):
        if percent < 75:
            raise ValueError("the bands are laid out for a similarity of 0.75 or more")
        small_batches(docs.sparkSession)
        by_size(docs.sparkSession)
        self.work, self.percent = Work(docs.sparkSession), percent
        cut = self.work.cut
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        base = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("th", F.xxhash64("text"))
        signed = cut(signed_rows(base, width), "signed")

        some = signed.where("n > 0 and id is not null")
        same = cut(some.groupBy(F.col("d1").alias("e1"), F.col("d2").alias("e2")).agg(F.min("row").alias("rep"), F.count("*").alias("rows")).where("rows > 1").drop("rows"), "same-sets")
        copies = signed.select("row", "id", "th", "n", "d1", "d2").join(same, (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")) & (F.col("n") > 0) & F.col("id").isNotNull(), "left")
        self.rows = cut(copies.select("row", "id", "th", "n", F.coalesce("rep", "row").alias("rep")), "rows")
        single = some
        if not same.isEmpty():
            single = some.join(self.rows.where("rep <> row").select("row"), "row", "left_anti")

        self.labels = None
        if by_id:  # different sets of one id are linked
            sets_of = self.rows.where("id is not null").groupBy(F.col("id").alias("i")).agg(F.min("rep").alias("r0"), F.max("rep").alias("r1")).where("r0 < r1")
            several = self.rows.join(sets_of, F.col("id") == F.col("i")).where("rep <> r0").select(F.col("rep").alias("a"), F.col("r0").alias("b")).distinct()
            self.add(cut(several, "id-links"))

        # candidate buckets: keys of two classes or more
        band_rows = single.select("row", F.explode("bands").alias("key"))
        shared = cut(band_rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "shared-keys")
        filled = cut(band_rows.join(shared, "key").select("key", "row", "size"), "bucket-members")
        # the centre of a bucket is the member that meets most others in all its buckets: what a group's
        # members were copied from meets more of them than they meet each other
        degrees = filled.groupBy(F.col("row").alias("k")).agg(F.sum(F.col("size") - 1).alias("degree"))
        ranked = cut(filled.join(degrees, F.col("row") == F.col("k")).select("key", "row", "degree"), "ranked")
        self.work.drop(shared, filled)
        # written, like other sums that are joined back: a join right above a sum cannot be split at a hot key
        centres = cut(ranked.groupBy(F.col("key").alias("k")).agg((-F.max(F.struct("degree", (-F.col("row")).alias("c")))["c"]).alias("centre")), "centres")
        self.buckets = cut(ranked.join(centres, F.col("key") == F.col("k")).select("key", "row", "centre"), "buckets")
        self.work.drop(ranked, centres)

        members = self.buckets.select("row").distinct()
        wanted = cut(signed.select("row", F.col("id").alias("wid"), F.col("th").alias("wth"), "n", "sketch").join(members, "row", "left_semi"), "wanted")
        picked = base.join(side(wanted.select("row", "wid", "wth")), (F.col("id") == F.col("wid")) & (F.col("th") == F.col("wth"))).select("row", "text")
        self.sets = cut(full_sets(picked, width), "sets")
        if self.sets.count() > wanted.count():  # rows that are there several times
            once = cut(self.sets.dropDuplicates(["row"]), "sets")
            self.work.drop(self.sets)
            self.sets = once
        self.work.drop(signed, same)
        self.link(wanted.select("row", "n", "sketch"))
        self.work.drop(keep=(self.rows, *([self.labels] if self.labels is not None else [])))

    def add(self, links: DataFrame) -> None:
        """Bring more links into the components."""
        before, self.labels = self.labels, self.work.cut(contracted(self.labels, links, self.work), "labels")
        if before is not None:
            self.work.drop(before)

    def open_buckets(self) -> DataFrame:
        """Buckets with the component of each member, only those with two components or more."""
        named = self.buckets
        if self.labels is not None:
            named = named.join(side(self.labels), F.col("row") == F.col("rep"), "left")
            named = self.work.cut(named.select("key", "row", "centre", F.coalesce("component", "row").alias("comp")), "labelled")
        else:
            named = named.withColumn("comp", F.col("row"))
        open_keys = self.work.cut(named.groupBy(F.col("key").alias("k")).agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("k"), "open-keys")
        out = self.work.cut(named.join(side(open_keys), F.col("key") == F.col("k"), "left_semi"), "open")
        self.work.drop(open_keys, *([named] if self.labels is not None else []))
        return out

    def link(self, facts: DataFrame) -> None:
        """Find and confirm links in three steps. `facts` has (row, n, sketch) of the buckets' members."""
        cut, percent, buckets = self.work.cut, self.percent, self.buckets

        # first: each class with the centre that it meets most often
        met = buckets.where("row <> centre").groupBy("row", "centre").agg(F.count("*").alias("times"))
        first = met.groupBy("row").agg(F.max(F.struct("times", (-F.col("centre")).alias("c"))).alias("x")).select(F.col("row").alias("a"), (-F.col("x.c")).alias("b"))
        tried = cut(first, "pairs")
        self.add(cut(verified(tried, self.sets, percent), "verified"))

        # second: members of other components with the centres of their buckets
        rest = self.open_buckets()
        if rest.isEmpty():
            return
        centre = rest.where("row = centre").select(F.col("key").alias("k"), F.col("comp").alias("own"))
        second = rest.join(centre, F.col("key") == F.col("k")).where("comp <> own").select(F.col("row").alias("a"), F.col("centre").alias("b")).distinct()
        second = cut(second.join(tried, ["a", "b"], "left_anti"), "pairs")
        self.add(cut(verified(second, self.sets, percent), "verified"))
        tried = tried.unionByName(second)

        # third: all that is left between components, but for pairs within a bucket's largest component
        rest = self.open_buckets()
        if rest.isEmpty():
            return
        counts = rest.groupBy("key", "comp").agg(F.count("*").alias("c"))
        largest = cut(counts.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("x")).select(F.col("key").alias("k"), F.col("x.comp").alias("largest")), "largest")
        # shingles of no other open class are in no intersection, which bounds each one from above
        open_rows = rest.select("row").distinct()
        alone = self.sets.join(open_rows, "row", "left_semi").select("row", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("c"), F.min("row").alias("k")).where("c = 1").groupBy("k").agg(F.count("*").alias("alone"))
        keys = rest.groupBy(F.col("row").alias("k2")).agg(F.collect_list("key").alias("keys"))  # BANDS at most
        bounded = facts.join(keys, F.col("row") == F.col("k2")).join(alone, F.col("row") == F.col("k"), "left").select("row", "n", "sketch", "keys", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("most"))
        full = rest.join(side(largest), F.col("key") == F.col("k")).drop("k").join(bounded, "row")
        full = cut(full.select("key", "row", "comp", "largest", "n", "sketch", "keys", "most"), "open-facts")
        few = full.where("comp <> largest").select("key", *[F.col(x).alias(f"{x}2") for x in ("row", "comp", "n", "sketch", "keys", "most")])
        near = (F.col("comp") != F.col("comp2")) & ((100 + percent) * F.least("most", "most2") >= percent * (F.col("n") + F.col("n2"))) & (different_values() <= MOST_DIFFERENT)
        near = near & (F.array_min(F.array_intersect("keys", "keys2")) == F.col("key"))  # in one of the buckets that a pair shares
        third = full.join(few, "key").where(near).select(F.greatest("row", "row2").alias("a"), F.least("row", "row2").alias("b")).distinct()
        third = cut(third.join(tried, ["a", "b"], "left_anti"), "pairs")
        self.add(cut(verified(third, self.sets, percent), "verified"))

    def named(self) -> DataFrame:
        """The rows with `comp`, the row key that names their component."""
        if self.labels is None:
            return self.rows.withColumn("comp", F.col("rep"))
        return self.rows.join(side(self.labels.withColumnRenamed("rep", "k")), F.col("rep") == F.col("k"), "left").select("row", "id", "th", "n", F.coalesce("component", "rep").alias("comp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """Rows of (id, n_shingles, component_id, kept). `percent` of at least 75 is what the bands and
    the sketch are laid out for."""
    groups = Groups(docs, id_col, text_col, width, percent, by_id=True)
    rows = groups.work.cut(groups.named(), "named")
    smallest = groups.work.cut(rows.groupBy(F.col("comp").alias("c")).agg(F.count("*").alias("size"), F.min("id").alias("smallest")).where("size > 1"), "smallest")
    out = rows.join(side(smallest), F.col("comp") == F.col("c"), "left")
    component = F.coalesce("smallest", "id")
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
    out = groups.work.cut(out, "near-duplicates")
    groups.work.drop(keep=(out,))
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """The documents that are kept, with the columns they came with: of every group of texts that are
    near copies the row with the smallest id, and of equal rows (id and text) one. Rows without words
    or without an id all stay."""
    groups = Groups(docs, id_col, text_col, width, percent, by_id=False)
    rows = groups.work.cut(groups.named().where("n > 0 and id is not null"), "named")
    chosen = rows.groupBy("comp").agg(F.count("*").alias("size"), F.min(F.struct("id", "row")).alias("x")).where("size > 1").select(F.col("comp").alias("c"), F.col("x.row").alias("chosen"))
    chosen = groups.work.cut(chosen, "chosen")
    several = rows.join(side(chosen), F.col("comp") == F.col("c")).groupBy(F.col("id").alias("i"), "th").agg(F.max(F.col("row") == F.col("chosen")).alias("stays"), F.count("*").alias("times"))
    several = groups.work.cut(several.where("not stays or times > 1"), "copies")
    groups.work.drop(keep=(several,))

    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    packed = packed.withColumns({"own_id": F.col("doc")[id_col].cast("long"), "own_th": F.xxhash64(F.coalesce(F.col("doc")[text_col].cast("string"), F.lit("")))})
    same = (F.col("own_id") == F.col("i")) & (F.col("own_th") == F.col("th"))
    marked = packed.join(side(several.select("i", "th")), same, "left_anti").select("doc")
    again = several.where("stays").select("i", "th")
    if not again.isEmpty():
        repeated = packed.join(side(again), same).groupBy("own_id", "own_th").agg(F.first("doc").alias("doc"))
        marked = marked.unionByName(repeated.select("doc"))
    return marked.select("doc.*")
