"""Connected components of a link table by alternating large-star and small-star steps.

Every step is two aggregations and two joins over the links; no group is ever collected. Each round
is written to the shared folder. Rounds stop when a round changes no link."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links has (u, v) with u > v, once each."""
    both = links.select("u", "v")
    if large:
        both = both.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    joined = both.join(least, F.col("u") == F.col("k"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(links: DataFrame, work: Work) -> DataFrame:
    """(id, component) for every id in a link (a, b); component is the smallest id reachable. The
    result reads a working table."""
    now = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    before, written = None, None
    while True:
        now = work.cut(_star(_star(now, True), False), "links")
        if written is not None:
            work.drop(written)
        written = now
        mark = now.agg(F.count("*"), F.expr("coalesce(bit_xor(xxhash64(u, v)), 0)"), F.expr("coalesce(sum(cast(xxhash64(v, u) as decimal(38, 0))), 0)")).first()
        if mark == before or not mark[0]:
            break
        before = mark
    # a fixed point is a set of stars whose centres are the smallest ids
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def contracted(labels: DataFrame | None, links: DataFrame, work: Work) -> DataFrame:
    """(rep, component) of the ids in `labels`, the components so far, and in the new links."""
    if labels is None:
        return components(links, work).withColumnRenamed("id", "rep")
    of = lambda end: labels.select(F.col("rep").alias(f"k_{end}"), F.col("component").alias(f"c_{end}"))
    joined = links.join(of("a"), F.col("a") == F.col("k_a"), "left").join(of("b"), F.col("b") == F.col("k_b"), "left")
    between = joined.select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b")).where("a <> b").distinct()
    found = work.cut(components(between, work), "contracted").withColumnsRenamed({"id": "old", "component": "new"})
    moved = labels.join(found, F.col("component") == F.col("old"), "left").select("rep", F.coalesce("new", "component").alias("component"))
    # an end of a new link that was in no link before is its own old component
    fresh = found.join(labels.select("component").distinct(), F.col("old") == F.col("component"), "left_anti").select(F.col("old").alias("rep"), F.col("new").alias("component"))
    return moved.unionByName(fresh)
