"""Quality rules with adaptive thresholds (operator 5, DataFrame functions only).

Each document is measured once. Fixed base rules reject the hopeless ones; what remains is judged by
thresholds that follow the data. For every (language, source) and metric the values of the documents
that pass the base rules are folded to a quantile sketch: counts of logarithmic buckets, exact below
64 and within 1/32 above. Such sketches merge by adding counts, so tasks fold before the shuffle, the
sketches of a language are the sums of its sources' sketches, and the result does not depend on order
or partitioning. A source with fewer than `least` documents uses its language's sketch, and a language
with fewer uses the sketch of everything.

A document is an outlier if a metric lies more than `fence` widths beyond the quartiles. The width is
the quartile distance, but no less than what can be resolved: one count in the document, and one count
in a document of the group's median size (both from the data; for the mean word length, its standard
error if lengths vary by half their mean). So where most documents have no symbol at all, a short text
with two of them is no outlier. The documents are filtered by a join with the fences.

Results in odd cases: a null or empty text has no words and fails the base rules; null languages or
sources form groups of their own; repeated rows and ties are judged alike; a value on the fence stays;
an empty table gives an empty result; extra columns, whatever their names, pass through
`quality_filter` untouched and are ignored by `quality_verdicts`; texts of any length are read whole,
in memory of a few times their size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Work

#: White space between words, characters that count as symbols, and as marks.
SPACE = "[\\x20\\x09-\\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MARKS = "!?"
WINDOW = 8

#: Groups of fences up to this many are sent to all executors; beyond, the join shuffles.
BROADCAST_GROUPS = 100_000
#: Rejected documents up to this many are sent to all executors to be removed (16 bytes each).
BROADCAST_REJECTED = 1_000_000


@dataclass(frozen=True)
class Metric:
    """A share in thousandths: `count` of `size`. `low`: too little counts as well as too much."""

    name: str
    count: str
    size: str
    low: bool = False
    mean: bool = False  # a mean of `size` values instead of a share


METRICS = (
    Metric("symbols", "n_symbols", "word_chars"),
    Metric("marks", "_n_marks", "word_chars"),
    Metric("dup_lines", "n_dup_lines", "_n_lines"),
    Metric("stutter", "_n_same", "n_words"),
    Metric("word_length", "word_chars", "n_words", low=True, mean=True),
)
#: What the metrics are shares of; their medians come from sketches too.
SIZES = ("word_chars", "_n_lines", "n_words")


@dataclass(frozen=True)
class Rules:
    """min_words and repeat_pct are the base rules; `fence` is in widths; groups of fewer than
    `least` documents have no fences of their own."""

    min_words: int = 20
    repeat_pct: int = 30
    fence: int = 4
    least: int = 200


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"{SPACE}+"))


def count_of(text: Column, chars: str) -> Column:
    return F.char_length(F.regexp_replace(text, f"[^{chars}]+", ""))


def crowded(text: Column, chars: str) -> Column:
    """How many of the characters follow another of them."""
    return F.char_length(text) - F.char_length(F.regexp_replace(text, f"([{chars}])[{chars}]+", "$1"))


def repeated_words(words: Column, hashes: Column) -> Column:
    """Words that lie in windows found twice or more. `hashes` has the windows' hashes in order.

    Most documents repeat no window; only the others sort (hash, position) and add up the cover."""
    at = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(xs: Column) -> Column:
        same = lambda j, k: (k >= 0) & (k < F.size(xs)) & (F.get(xs, k)["h"] == F.get(xs, j)["h"])
        hit = F.filter(F.sequence(F.lit(0), F.size(xs) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
        return F.sort_array(F.transform(hit, lambda j: F.get(xs, j)["i"]))

    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("total"))
    # the lambda's argument is bound once, so the sorted array is not computed for every element
    covered = F.transform(
        F.array(at),
        lambda xs: F.aggregate(
            twice(xs),
            start,
            lambda acc, i: F.struct(i.alias("last"), (acc["total"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("total")),
            lambda acc: acc["total"],
        ),
    )
    some = (F.size(hashes) > 1) & (F.size(F.array_distinct(hashes)) < F.size(hashes))
    return F.when(some, F.get(covered, F.lit(0))).otherwise(F.lit(0).cast("long"))


def measure(docs: DataFrame, rules: Rules, text_col: str, lang_col: str, source_col: str, carry: list[Column]) -> DataFrame:
    """One pass over the texts: the columns in `carry`, the base counts and what the metrics need."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    f = docs.select(*carry, F.col(lang_col).cast("string").alias("_lang"), F.col(source_col).cast("string").alias("_source"), text.alias("_text"))
    names = [x for x in f.columns if x != "_text"]
    f = f.select(*names, "_text", words_of(F.col("_text")).alias("_words"), F.filter(F.split("_text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("_lines"))
    n = F.size("_words")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    f = f.select(*names, "_text", "_words", "_lines", windows.alias("_hashes"))
    long = lambda c: c.cast("long")
    f = f.select(
        *names,
        long(n).alias("n_words"),
        long(F.char_length(F.array_join("_words", ""))).alias("word_chars"),
        long(count_of(F.col("_text"), SYMBOLS.replace("$", "\\$"))).alias("n_symbols"),
        long(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        repeated_words(F.col("_words"), F.col("_hashes")).alias("n_repeat_words"),
        long(F.size("_lines")).alias("_n_lines"),
        long(crowded(F.col("_text"), MARKS)).alias("_n_marks"),
        long(F.size(F.filter("_words", lambda w, i: w == F.get("_words", i - 1)))).alias("_n_same"),
    )
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.repeat_pct * F.col("n_words"))
    return f.withColumn("base_failed", failed)


def share(m: Metric) -> Column:
    return F.expr(f"{m.count} * 1000 div greatest({m.size}, 1L)").cast("long")


def step(m: Metric, high: Column, size: Column) -> Column:
    """What a document of a size can resolve, in thousandths."""
    size = F.greatest(size, F.lit(1).cast("long"))
    found = high / (2 * F.sqrt(size.cast("double"))) if m.mean else 1000 / size
    return F.ceil(found).cast("long")


def bucket(v: Column) -> Column:
    """Index of the sketch's bucket: the value itself below 64, then 32 buckets for each power of two."""
    e = F.length(F.bin(v)) - 6
    return F.when(v < 64, v).otherwise(e * 32 + F.call_function("shiftright", v, e)).cast("long")


def lowest(b: Column) -> Column:
    """The least value of a bucket."""
    e = F.floor(b / 32).cast("int") - 1
    return F.when(b < 64, b).otherwise(F.call_function("shiftleft", b - e * 32, e)).cast("long")


def fences(measured: DataFrame, rules: Rules, work: Work) -> DataFrame:
    """For each (_lang, _source) with documents that pass the base rules: the quartiles of each metric
    (_low_, _high_) and the median of each size (_mid_)."""
    values = {m.name: share(m) for m in METRICS} | {x: F.col(x) for x in SIZES}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("what"), bucket(v).alias("bucket")) for k, v in values.items()])).alias("x")
    counts = work.cut(measured.where("not base_failed").select("_lang", "_source", each).groupBy("_lang", "_source", "x.what", "x.bucket").agg(F.count("*").alias("n")), "sketch")
    wanted = {f"low_{m.name}": (m.name, 1) for m in METRICS} | {f"high_{m.name}": (m.name, 3) for m in METRICS} | {f"mid_{x}": (x, 2) for x in SIZES}

    def quartiles(level: list[str], tag: str) -> DataFrame:
        sketch = counts.groupBy(*level, "what", "bucket").agg(F.sum("n").alias("n")).groupBy(*level, "what").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("s"), F.sum("n").alias("docs"))

        def at(q: int) -> Column:  # the least bucket up to which there are q quarters of the values
            need = F.expr(f"(docs * {q} + 3) div 4")
            zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).cast("long").alias("bucket"))
            return F.aggregate("s", zero, lambda a, x: F.struct((a["sum"] + x["n"]).alias("sum"), F.when((a["bucket"] < 0) & (a["sum"] + x["n"] >= need), x["bucket"]).otherwise(a["bucket"]).alias("bucket")), lambda a: lowest(a["bucket"]))

        wide = sketch.select(*level, "what", "docs", F.array(at(1), at(2), at(3)).alias("at"))
        return wide.groupBy(*level).agg(F.max("docs").alias(f"{tag}_docs"), *[F.max(F.when(F.col("what") == k, F.col("at")[q - 1])).alias(f"{tag}_{name}") for name, (k, q) in wanted.items()])

    own, lang, everything = quartiles(["_lang", "_source"], "own"), quartiles(["_lang"], "lang"), quartiles([], "all")
    joined = own.join(lang.withColumnRenamed("_lang", "_l"), F.col("_lang").eqNullSafe(F.col("_l")))
    total = everything.first()  # one row
    pick = lambda k: F.when(F.col("own_docs") >= rules.least, F.col(f"own_{k}")).when(F.col("lang_docs") >= rules.least, F.col(f"lang_{k}")).otherwise(F.lit(total[f"all_{k}"]).cast("long"))
    return joined.select(F.col("_lang").alias("_fl"), F.col("_source").alias("_fs"), *[pick(k).alias(f"_{k}") for k in wanted])


def judge(measured: DataFrame, rules: Rules, work: Work) -> DataFrame:
    """`measured` with kept; measured must be a written table, as it is read twice."""
    table = work.cut(fences(measured, rules, work), "fences")
    side = F.broadcast(table) if table.count() <= BROADCAST_GROUPS else table
    joined = measured.join(side, F.col("_lang").eqNullSafe(F.col("_fl")) & F.col("_source").eqNullSafe(F.col("_fs")), "left")
    inside = F.lit(True)
    for m in METRICS:
        value, low, high = share(m), F.col(f"_low_{m.name}"), F.col(f"_high_{m.name}")
        width = rules.fence * F.greatest(high - low, step(m, high, F.col(m.size)), step(m, high, F.col(f"_mid_{m.size}")))
        inside = inside & (value <= high + width)
        if m.low:
            inside = inside & (value >= low - width)
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))


def quality_verdicts(docs: DataFrame, rules: Rules | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Rows of (id, counts, base_failed, kept)."""
    rules, work = rules or Rules(), Work(docs.sparkSession)
    measured = work.cut(measure(docs, rules, text_col, lang_col, source_col, [F.col(id_col).alias("_id")]), "measured")
    out = judge(measured, rules, work).select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    work.drop(keep=(out,))
    return out


def quality_filter(docs: DataFrame, rules: Rules | None = None, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The documents that are kept, with the columns they came with. What a verdict depends on (text,
    language, source) is known by 128 bits of hashes, so no texts are written."""
    rules, work = rules or Rules(), Work(docs.sparkSession)

    def keys(field) -> list[Column]:
        parts = [F.coalesce(field(text_col).cast("string"), F.lit("")), *[x for c in (lang_col, source_col) for x in (field(c).isNull(), field(c).cast("string"))]]
        return [F.xxhash64(*parts), F.xxhash64(F.lit("second"), *parts)]

    measured = work.cut(measure(docs, rules, text_col, lang_col, source_col, [k.alias(f"_k{i}") for i, k in enumerate(keys(F.col))]), "measured")
    rejected = work.cut(judge(measured, rules, work).where("not kept").select("_k0", "_k1").distinct(), "rejected")
    work.drop(keep=(rejected,))
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"))
    own = keys(lambda c: F.col("_doc")[c])
    side = F.broadcast(rejected) if rejected.count() <= BROADCAST_REJECTED else rejected
    return packed.join(side, (own[0] == F.col("_k0")) & (own[1] == F.col("_k1")), "left_anti").select("_doc.*")
