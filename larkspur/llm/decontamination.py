"""Benchmark decontamination (operator 7, DataFrame functions only).

The benchmark's windows of `size` normalised words (an item of fewer words is one window) form a
hash set that is broadcast behind a check of its size; beyond, it is looked up by a shuffle of
(document, position, key). The documents' words are scanned once: at every position the hash of the
next few words is looked up. Documents with a hit are read again, and the few words at each hit are
verified against the window. So a document's words never travel with its positions, and the work is
linear in a text's length. Per document the verified windows give the words that are hit, the items
and the verdict, by which documents, or only the words hit, are removed.

The look-up needs few passes whatever the windows' lengths: windows of five words or more are found
by their first words, as many as the shortest of them has, and shorter windows by all of theirs.

Results in odd cases: a null or empty text has no words and is never contaminated; an item without
words has no windows; repeated rows give one result each; repeated items count by their id; an empty
benchmark leaves every document clean; other columns, whatever their names, are ignored by
`contamination` and pass through `decontaminate`. Texts of any length are scanned whole, in memory of
a few times their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Work, release

#: What separates words once A-Z are lower-cased, and the letters themselves.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Windows up to this many bytes (their words, and WINDOW_BYTES each for the rest) are broadcast.
BROADCAST_BYTES, WINDOW_BYTES = 100_000_000, 150
#: Positions of hits up to this many bytes (about 32 each, and for each document) are broadcast to read
#: the documents with hits again; beyond, that join shuffles.
BROADCAST_HITS = 30_000_000
#: Documents up to this many are broadcast to be removed (16 bytes each); beyond, the join shuffles.
BROADCAST_DOCUMENTS = 500_000
#: Windows of at least this many words are found by their first words.
PREFIX = 5


def lower_ascii(text: Column) -> Column:
    return F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    parts = F.split(lower_ascii(text), f"{BETWEEN}+")
    first = F.when(F.get(parts, F.lit(0)) == "", 2).otherwise(1)
    last = F.when(F.element_at(parts, -1) == "", 1).otherwise(0)
    return F.when(F.size(parts) - last < first, F.array().cast("array<string>")).otherwise(F.slice(parts, first, F.size(parts) - last - first + 1))


def key_of(words: Column, start: Column | int, n: int) -> Column:
    return F.xxhash64(F.lit(n), F.slice(words, start, n))


def scanned(words: Column, n: int) -> Column:
    """Keys of the n words from every position on."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: key_of(words, i, n))


def windows_of(benchmark: DataFrame, size: int, item_col: str, text_col: str) -> DataFrame:
    """Distinct windows: (words, length, items); items is the sorted set of ids as strings.
    Items without an id are one item, a null in the set."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("w")).where(F.size("w") > 0)
    n = F.size("w")
    each = F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.slice("w", i, size))
    return items.select("item", F.explode(each).alias("words")).groupBy("words").agg(F.sort_array(F.transform(F.collect_set(F.struct("item")), lambda x: x["item"])).alias("items")).withColumn("length", F.size("words"))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = 13,
    min_share: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Rows of (id, n_words, n_hit, n_items, items_sha256, contaminated, text_hash, spans).

    Benchmark items with a null id count as one item in n_items, and are not in the list that is hashed.
    A document is contaminated if at least one word in `min_share` is hit. `text_hash` is the text's
    xxhash64 and `spans` has the windows' (first word, number of words)."""
    work = Work(docs.sparkSession)
    windows = work.cut(windows_of(benchmark, size, item_col, item_text_col).withColumn("items_id", F.xxhash64("items", F.exists("items", lambda x: x.isNull()))), "windows")
    sizes = windows.groupBy("length").agg(F.count("*").alias("n"), F.sum(F.octet_length(F.array_join("words", ""))).alias("bytes")).collect()  # `size` rows at most
    lengths = sorted(r["length"] for r in sizes)
    classes = [x for x in lengths if x < PREFIX] + [x for x in lengths if x >= PREFIX][:1]

    # what is looked up: (key, class, window)
    probes = windows.where(F.lit(False)).select(F.lit(0).cast("long").alias("key"), F.lit(0).alias("class"), "words", "length", "items_id")
    for k, p in enumerate(classes):
        some = windows.where(F.col("length") == p if p < PREFIX else F.col("length") >= PREFIX)
        probes = probes.unionByName(some.select(key_of(F.col("words"), 1, p).alias("key"), F.lit(k).alias("class"), "words", "length", "items_id"))

    small = sum(r["bytes"] + WINDOW_BYTES * r["n"] for r in sizes) <= BROADCAST_BYTES
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("t")).withColumn("th", F.xxhash64("t"))
    worded = base.select("id", "th", words_of(F.col("t")).alias("w")).withColumn("n", F.size("w"))  # not after the explode, which would carry w
    n = F.col("n")
    keys = [F.when(n >= p, scanned(F.col("w"), p)).otherwise(F.array().cast("array<bigint>")) for p in classes]
    known = probes.select("key", "class").distinct()
    if small:
        # one more entry that each document meets exactly once: it brings the document's own row
        own_key = F.xxhash64(F.lit("document"))
        known = known.unionByName(work.spark.range(1).select(own_key.alias("key"), F.lit(-1).alias("class")))
        met = worded.select("id", "th", "n", F.posexplode(F.concat(F.array(own_key), *keys)).alias("at", "key")).join(F.broadcast(known), "key")
        start, before = F.lit(0), F.lit(0)
        for k, p in enumerate(classes):
            start = F.when(F.col("class") == k, F.col("at") - before).otherwise(start)
            before = before + F.greatest(F.col("n") - p + 1, F.lit(0))
        met = met.withColumn("start", start).where("class < 0 and at = 0 or class >= 0 and start >= 1")
    else:
        met = worded.select("id", "th", "n", F.lit(None).cast("long").alias("key"), F.lit(-1).alias("class"), F.lit(0).alias("start"))
        for k, keys_of_class in enumerate(keys):
            some = worded.select("id", "th", F.posexplode(keys_of_class).alias("at", "key")).select("id", "th", F.lit(0).alias("n"), "key", F.lit(k).alias("class"), (F.col("at") + 1).alias("start"))
            met = met.unionByName(some.join(known, ["key", "class"], "left_semi").select("id", "th", "n", "key", "class", "start"))
    hit = F.when(F.col("class") >= 0, F.struct("class", "start", "key"))
    seen = met.groupBy("id", "th").agg(F.count_if(F.col("class") < 0).alias("copies"), F.max("n").cast("long").alias("n_words"), F.collect_set(hit).alias("hits"))
    seen = work.cut(seen, "positions")

    # verification, for documents with hits
    hits = seen.where(F.size("hits") > 0).select(F.col("id").alias("i"), F.col("th").alias("h"), "hits")
    rows, many = hits.agg(F.count("*"), F.coalesce(F.sum(F.size("hits")), F.lit(0))).first()
    there = base.join(F.broadcast(hits) if 32 * (rows + many) <= BROADCAST_HITS else hits, F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("h")))
    there = there.select("id", "th", "hits", words_of(F.col("t")).alias("w"))
    each = there.select("id", "th", F.explode(F.transform("hits", lambda x: F.struct(x["class"], x["start"], x["key"], F.slice("w", x["start"], size).alias("found")))).alias("x")).select("id", "th", "x.*")
    real = each.join(F.broadcast(probes) if small else probes, ["key", "class"]).where(F.slice("found", 1, F.col("length")) == F.col("words"))
    real = real.groupBy(F.col("id").alias("i"), F.col("th").alias("h")).agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans"), F.collect_set("items_id").alias("sets"))
    real = work.cut(real, "verified")
    found = seen.join(real, F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("h")), "left")
    none = F.array().cast(real.schema["spans"].dataType)
    found = found.select("id", "th", "copies", "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("sets", F.array().cast("array<bigint>")).alias("sets"))

    zero = F.struct(F.lit(1).alias("next"), F.lit(0).cast("long").alias("total"))
    end = lambda s: s["start"] + s["length"]
    n_hit = F.aggregate("spans", zero, lambda a, s: F.struct(F.greatest(a["next"], end(s)).alias("next"), (a["total"] + F.greatest(F.lit(0), end(s) - F.greatest(a["next"], s["start"]))).alias("total")), lambda a: a["total"])
    sets = windows.select("items_id", "items").dropDuplicates(["items_id"]).select("items_id", F.explode("items").alias("item"))
    items = (
        found.where(F.size("sets") > 0).select("id", "th", F.explode("sets").alias("items_id")).join(sets, "items_id")
        .groupBy(F.col("id").alias("id2"), F.col("th").alias("th2")).agg(F.sort_array(F.transform(F.collect_set(F.struct("item")), lambda x: x["item"])).alias("items"))
    )
    out = found.join(items, F.col("id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2")), "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    out = out.select("id", "th", "copies", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), "spans")
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (min_share * F.col("n_hit") >= F.col("n_words")))
    out = out.select(F.col("id").alias(id_col), "n_words", "n_hit", "n_items", "items_sha256", "contaminated", F.col("th").alias("text_hash"), "spans", "copies")
    out = work.cut(out, "contamination")
    work.drop(keep=(out,))
    return out.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, remove: str = "documents", id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """The documents with their columns, without contaminated ones (remove="documents"), or with the
    hit words of any document taken out of its text (remove="spans")."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove must be 'documents' or 'spans'")
    found = contamination(docs, benchmark, id_col=id_col, text_col=text_col, **options)
    hit = found.where("contaminated" if remove == "documents" else "n_hit > 0").select(F.col(id_col).alias("_id"), F.col("text_hash").alias("_th"), F.col("spans").alias("_spans")).dropDuplicates(["_id", "_th"])
    work = Work(docs.sparkSession)
    hit = work.cut(hit.drop("_spans") if remove == "documents" else hit, "contaminated")
    release(found)
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"))
    text = F.coalesce(F.col("_doc")[text_col].cast("string"), F.lit(""))
    same = F.col("_doc")[id_col].eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_th"))
    if remove == "documents":
        side = F.broadcast(hit) if hit.count() <= BROADCAST_DOCUMENTS else hit
        return packed.join(side, same, "left_anti").select("_doc.*")
    joined = packed.join(hit, same, "left")
    # words and what stands between them, in turn; the word of index k follows separator k
    word = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
    words, gaps = F.regexp_extract_all(text, F.lit(f"({word})")), F.split(text, word)
    hits = F.array_sort(F.array_distinct(F.flatten(F.transform("_spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))))
    bound = F.struct(hits.cast("array<int>").alias("hits"), gaps.alias("gaps"), F.arrays_zip(gaps.alias("g"), words.alias("w")).alias("all"))

    def walked(v):
        """What lies before each hit word, and after the last: every word is looked at once."""
        joined = lambda z: F.concat(F.coalesce(z["g"], F.lit("")), F.coalesce(z["w"], F.lit("")))

        def piece(p, i):
            last = F.coalesce(F.get(v["hits"], i - 1), F.lit(0))
            return F.concat(F.array_join(F.transform(F.slice(v["all"], last + 1, p - last - 1), joined), ""), F.coalesce(F.get(v["gaps"], p - 1), F.lit("")))

        return F.array_join(F.transform(F.concat(v["hits"], F.array(F.greatest(F.size(v["all"]), F.size(v["gaps"])))), piece), "")

    cleaned = F.get(F.transform(F.array(bound), walked), F.lit(0))
    columns = [F.when(F.col("_spans").isNull(), F.col("_doc")[c]).otherwise(cleaned).alias(c) if c == text_col else F.col("_doc")[c].alias(c) for c in docs.columns]
    return joined.select(*columns)
