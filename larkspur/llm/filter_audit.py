"""Audit of how filters interact (operator 12).

For every order in which the filters may be applied, each step's filter gets what it removes, what it
would have removed but for the filters before it, what it alone removes, and its share over all orders.

Documents are folded to counts by part and the filters' failure flags: at most 2^filters rows a part,
however many documents there are. A SQL CUBE over the flags and the part sums these; its rows whose
selected flags are all false hold the survivors of each subset of filters. A step is the pair of the
subset before it and the subset after it, so the table of survivors joined to itself has all that any
order needs.

A document is a later copy if a document with a smaller id has the same text. The smallest id of every
text is a grouped minimum over digests; it is joined back by id, so a text that a third of all
documents share is no hot key. `labels` may name good and toxic documents; a document is either if any
of its rows says so.

Results in odd cases: a null text is empty; a null part is the empty string; documents with a null id
have no copies before them and no labels; repeated rows count each, and rows of one id are no copies of
each other; a part whose documents all survive has zeros; an empty table gives an empty result; other
columns, whatever their names, are ignored; texts of any length are read whole, in memory of a few times
their size.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Work
from .quality_rules import words_of

#: The filters' letters; the last is the one for copies.
FILTERS = "ABCDE"


def conditions(text: Column, words: Column) -> dict[str, Column]:
    """Whether a text fails the filters that look at it alone."""
    n, upper = F.size(words), F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * n,
        "C": 100 * upper > 10 * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def folded(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str, work: Work) -> DataFrame:
    """(part, one flag a filter, n, good, toxic), one row for each combination that occurs."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    own = own.withColumn("words", words_of(F.col("text")))
    own = own.select("id", "part", F.unhex(F.md5(F.encode("text", "utf-8"))).alias("digest"), *[c.alias(k) for k, c in conditions(F.col("text"), F.col("words")).items()])
    own = work.cut(own, "flags")
    firsts = work.cut(own.where("id is not null").groupBy(F.col("digest").alias("same")).agg(F.min("id").alias("first")), "first-ids")
    named = labels.groupBy(F.col("doc_id").cast("long").alias("k")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    named = work.cut(named.where("good or toxic"), "labelled")
    joined = own.join(firsts, (F.col("id") == F.col("first")) & (F.col("digest") == F.col("same")), "left").join(named, F.col("id") == F.col("k"), "left")
    copy = (F.col("id").isNotNull() & F.col("first").isNull()).alias("E")
    flagged = joined.select("part", *FILTERS[:-1], copy, F.coalesce("good", F.lit(False)).cast("long").alias("good"), F.coalesce("toxic", F.lit(False)).cast("long").alias("toxic"))
    counts = work.cut(flagged.groupBy("part", *FILTERS).agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")), "counts")
    work.drop(keep=(counts,))
    return counts


def survivors(counts: DataFrame) -> DataFrame:
    """(part, subset, n, good, toxic): what every subset of the filters leaves; the subset is a number
    with a bit for each filter."""
    cube = counts.cube(*FILTERS, "part").agg(
        F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"), F.grouping("part").alias("all_parts"), *[F.grouping(f).alias(f"any_{f}") for f in FILTERS]
    )
    alive, subset = F.col("all_parts") == 0, F.lit(0)
    for i, f in enumerate(FILTERS):
        alive &= (F.col(f"any_{f}") == 1) | ~F.col(f)
        subset = subset + F.when(F.col(f"any_{f}") == 0, 1 << i).otherwise(0)
    found = cube.where(alive).select("part", subset.alias("subset"), "n", "good", "toxic")
    every = counts.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))).alias("subset"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n", "good", "toxic")}
    return every.join(found, ["part", "subset"], "left").withColumns(zero)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row for each part, order and step. The result reads a working table."""
    work = Work(docs.sparkSession)
    left = work.cut(survivors(folded(docs, labels, id_col, text_col, part_col, work)), "survivors")  # 2^filters rows a part
    work.drop(keep=(left,))
    full, bit = (1 << len(FILTERS)) - 1, {f: 1 << i for i, f in enumerate(FILTERS)}
    of = lambda tag, *cols: left.select(F.col("part").alias(f"{tag}_part"), F.col("subset").alias(f"{tag}_subset"), *[F.col(c).alias(f"{tag}_{c}") for c in cols])

    # a pair of subsets for each filter and subset without it
    each = F.explode(F.filter(F.array(*[F.struct(F.lit(f).alias("f"), F.lit(b).alias("b")) for f, b in bit.items()]), lambda x: F.col("subset").bitwiseAND(x["b"]) == 0)).alias("x")
    pairs = left.select("part", "subset", "n", "good", "toxic", each).select("part", "subset", "n", "good", "toxic", "x.f", "x.b")
    near = lambda tag, subset: (F.col("part") == F.col(f"{tag}_part")) & (subset == F.col(f"{tag}_subset"))
    pairs = pairs.join(of("after", "n", "good", "toxic"), near("after", F.col("subset") + F.col("b")))
    pairs = pairs.join(of("none", "n"), near("none", F.lit(0))).join(of("only", "n"), near("only", F.col("b")))
    pairs = pairs.join(of("rest", "n"), near("rest", F.lit(full) - F.col("b"))).join(of("all", "n"), near("all", F.lit(full)))
    removed = F.col("n") - F.col("after_n")
    pairs = pairs.select(
        "part", "subset", "f",
        F.col("after_n").alias("kept"),
        removed.alias("removed"),
        (F.col("none_n") - F.col("only_n") - removed).alias("redundant"),
        (F.col("rest_n") - F.col("all_n")).alias("unique_fails"),
        (F.col("good") - F.col("after_good")).alias("good_lost"),
        (F.col("toxic") - F.col("after_toxic")).alias("toxic_lost"),
    )

    steps = [("".join(order), k + 1, f, sum(bit[x] for x in order[:k])) for order in permutations(FILTERS) for k, f in enumerate(order)]
    steps = F.broadcast(docs.sparkSession.createDataFrame(steps, "filter_order string, step int, g string, before int"))  # 600 rows
    rows = pairs.join(steps, (F.col("f") == F.col("g")) & (F.col("subset") == F.col("before")))
    share = rows.groupBy(F.col("part").alias("p"), F.col("f").alias("h")).agg(F.sum("removed").alias("shapley"))
    out = rows.join(share, (F.col("part") == F.col("p")) & (F.col("f") == F.col("h")))
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
