"""Blocked duplicate detection.

Rows get a block key and comparison keys. Only rows of blocks within the size limit meet, so the number
of pairs is bounded by rows times the limit.

Keys are costly and every form needs them several times, so `stored_keys` computes them once and keeps them
in a table. It holds rows without a block too: a filter on the block would else be pushed below the
projections and compute the keys a second time.

There are two forms. The pair functions (`candidate_pairs`, `scored_pairs`) are plain joins with
built-in expressions but for the similarity of unequal keys; they serve reports. `detect_duplicates`
reads the input once, for that table: a count by block finds the blocks that are too large, and one
shuffle of the rows brings each other block together. Rows without a block, or in one that is too large,
are dealt out evenly by that shuffle and pass by. The blocks stream through Arrow, whole rows in columns;
keys alone become Python values, each pair of different keys is scored once however many rows have them,
and a pair is given up as soon as it cannot reach the least score. Nothing is joined back.

In the modes `exact` and `normalized` a column of a pair is equal or not, so a pair matches if the columns
that it agrees in are among the sets whose weights reach the least score. There every such set is one
hash grouping of the distinct values of a block: a value's best set is the best one that it shares with
another row, and the smallest sets (those with no other one inside) make the groups. With one smallest
set they are its groups as they come; with several, labels travel through the groups until none changes.
What a match adds depends on block and values alone and is joined to the rows by them. No Python
compares, and no pairs are made.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import similarity, text
from ..session import scratch_folder, ship_package
from .rows import ROW, dense_rows, named, require, visible, with_rows

#: What a match adds to a row.
MATCH = pa.schema([("group_id", pa.string()), ("canonical", pa.string()), ("score", pa.float64()), ("columns", pa.list_(pa.string()))])
MATCH_SQL = "struct<group_id: string, canonical: string, score: double, columns: array<string>>"
#: Blocks over the size limit up to this many are sent to all executors; beyond, the join shuffles.
BROADCAST_BLOCKS = 10_000
MODES = ("exact", "normalized", "fuzzy", "weighted")
#: Sets of equal columns up to this many are grouped by; with more, pairs of values are compared.
COLUMN_SETS = 64


@dataclass(frozen=True)
class Matching:
    comparison_columns: list[str]
    blocking_columns: list[str] = field(default_factory=list)
    weights: dict[str, float] = field(default_factory=dict)
    minimum_score: float = 85.0
    review_threshold: float = 93.0
    maximum_group_size: int = 500
    mode: str = "weighted"
    record_id_column: str = "record_id"
    canonical_strategy: str = "most_complete"

    def __post_init__(self) -> None:
        problems = {
            "nothing to compare: name a column": not self.comparison_columns,
            "minimum_score lies outside 0 to 100": not 0 <= self.minimum_score <= 100,
            "review_threshold lies outside minimum_score to 100": not self.minimum_score <= self.review_threshold <= 100,
            "maximum_group_size lies outside 2 to 10000": not 2 <= self.maximum_group_size <= 10_000,
            "unknown mode": self.mode not in MODES,
            "unknown canonical strategy": self.canonical_strategy not in ("first", "most_complete"),
            "the weights add up to nothing": bool(self.comparison_columns) and sum(self.weight(c) for c in self.comparison_columns) <= 0,
        }
        for message, wrong in problems.items():
            if wrong:
                raise ValueError(message)

    def weight(self, column: str) -> float:
        return float(self.weights.get(column, 1.0))


@dataclass
class Duplicates:
    frame: DataFrame
    pairs: DataFrame
    blocks: DataFrame

    def counts(self) -> tuple[int, int, int]:
        """(candidate pairs, matched pairs, blocks over the limit). Runs two small jobs."""
        r = self.blocks.agg(F.coalesce(F.sum(F.when(~F.col("oversized"), F.col("size") * (F.col("size") - 1) / 2)), F.lit(0)).cast("long").alias("c"), F.count_if("oversized").alias("o")).first()
        return r["c"], self.pairs.count(), r["o"]


def block_key(m: Matching, key) -> Column:
    """`key` gives the matching key of a column."""
    if m.blocking_columns:
        return F.concat_ws("|", *[key(c) for c in m.blocking_columns])
    return key(m.comparison_columns[0]).substr(1, 3)


def keyed(frame: DataFrame, m: Matching, *more: Column) -> DataFrame:
    """(row, block, k0.. keys, r0.. raw texts, more) of rows with a block."""
    return all_keyed(frame, m, *more).where("block <> ''")


def all_keyed(frame: DataFrame, m: Matching, *more: Column) -> DataFrame:
    """The same of all rows; those without a block have an empty one."""
    columns = list(dict.fromkeys([*m.comparison_columns, *m.blocking_columns]))
    require(frame, columns, "Deduplication columns not found")
    own = frame.select(F.col(ROW).alias("row"), *[text.matching_key(named(c)).alias(f"key_{i}") for i, c in enumerate(columns)], *[named(c).cast("string").alias(f"raw_{i}") for i, c in enumerate(columns)], *more)
    names = own.columns[1 + 2 * len(columns) :]
    place = {c: i for i, c in enumerate(columns)}
    exact = m.mode == "exact"
    return own.select(
        "row",
        block_key(m, lambda c: F.col(f"key_{place[c]}")).alias("block"),
        *[F.col(f"key_{place[c]}").alias(f"k{i}") for i, c in enumerate(m.comparison_columns)],
        *[F.coalesce(F.col(f"raw_{place[c]}"), F.lit("None")).alias(f"r{i}") for i, c in enumerate(m.comparison_columns) if exact],
        *names,
    )


def stored(rows: DataFrame) -> DataFrame:
    """The rows from a table that is written now, below the folder that all executors share; as they are if
    a column has no type, as Parquet takes none."""
    if any(isinstance(kind, T.NullType) for kind in types_in(rows.schema)):
        return rows
    path = scratch_folder(rows.sparkSession, "keys")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def types_in(kind: T.DataType):
    """The type and all those inside it."""
    yield kind
    inside = [f.dataType for f in kind] if isinstance(kind, T.StructType) else [kind.elementType] if isinstance(kind, T.ArrayType) else [kind.keyType, kind.valueType] if isinstance(kind, T.MapType) else []
    for x in inside:
        yield from types_in(x)


def stored_keys(frame: DataFrame, m: Matching) -> DataFrame:
    """What `keyed` gives, each row's keys computed once however often they are read."""
    return stored(all_keyed(frame, m)).where("block <> ''")


def block_sizes(rows: DataFrame, m: Matching) -> DataFrame:
    return rows.groupBy("block").agg(F.count("*").alias("size")).withColumn("oversized", F.col("size") > m.maximum_group_size)


def candidate_pairs(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pairs (a before b) of rows in blocks of two rows up to the limit."""
    small = blocks.where("size > 1 and not oversized").select("block")
    rows = rows.join(small, "block")
    side = lambda s: rows.select("block", *[F.col(c).alias(f"{s}_{c}") for c in rows.columns if c != "block"])
    return side("a").join(side("b"), "block").where("a_row < b_row")


def scored_pairs(pairs: DataFrame, m: Matching) -> DataFrame:
    """(block, a, b, score, columns)."""
    scores = []
    for i, _ in enumerate(m.comparison_columns):
        a, b = F.col(f"a_k{i}"), F.col(f"b_k{i}")
        if m.mode == "exact":
            value = F.when((a == "") & (b == ""), 100.0).when(F.col(f"a_r{i}") == F.col(f"b_r{i}"), 100.0).otherwise(0.0)
        elif m.mode == "normalized":
            value = F.when(a == b, 100.0).otherwise(0.0)
        else:
            value = similarity.ratio(a, b)
        scores.append(value.alias(f"s{i}"))
    weights = [m.weight(c) for c in m.comparison_columns]
    each = pairs.select("block", F.col("a_row").alias("a"), F.col("b_row").alias("b"), *scores)
    total = F.lit(0.0)
    for i, w in enumerate(weights):
        total = total + F.col(f"s{i}") * F.lit(w)
    columns = F.array_compact(F.array(*[F.when(F.col(f"s{i}") >= m.minimum_score, c) for i, c in enumerate(m.comparison_columns)]))
    return each.select("block", "a", "b", F.bround(total / F.lit(sum(weights)), 2).alias("score"), columns.alias("columns"))


def column_score(mode: str, a: tuple, b: tuple) -> float:
    """Of two (key, raw text) values."""
    if not a[0] and not b[0]:
        return 100.0
    if mode == "exact":
        return 100.0 if a[1] == b[1] else 0.0
    if mode == "normalized" or a[0] == b[0]:
        return 100.0 if a[0] == b[0] else 0.0
    return similarity.ratio_of(a[0], b[0])


def match_block(m: Matching, members: list[dict]) -> dict[int, tuple]:
    """The duplicates of one block, whose members come in row order: their place in the list, and
    (group id, canonical record, score, columns). Members with the same values are scored as one."""
    weights = [m.weight(c) for c in m.comparison_columns]
    total, least = sum(weights), m.minimum_score
    gain = [max(w, 0.0) * 100.0 for w in weights]
    places: dict[tuple, list[int]] = {}
    for i, x in enumerate(members):
        places.setdefault(x["values"], []).append(i)
    values = list(places)
    parent, best = list(range(len(values))), {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def found(x: int, mine: tuple) -> None:
        best[x] = max(best.get(x, mine), mine)

    whole = (round(sum(100.0 * w for w in weights) / total, 2), list(m.comparison_columns))
    for i, a in enumerate(values):
        if len(places[a]) > 1 and whole[0] >= least:
            found(i, whole)
        for j in range(i + 1, len(values)):
            scores, most = [], sum(gain)
            for x, y, w, g in zip(a, values[j], weights, gain):
                scores.append(column_score(m.mode, x, y))
                most += scores[-1] * w - g
                if most / total < least - 0.01:
                    break
            else:
                score = round(sum(s * w for s, w in zip(scores, weights)) / total, 2)
                if score >= least:
                    mine = (score, [c for c, s in zip(m.comparison_columns, scores) if s >= least])
                    found(i, mine), found(j, mine)
                    x, y = root(i), root(j)
                    parent[max(x, y)] = min(x, y)
    groups: dict[int, list[tuple[int, int]]] = {}
    for i in best:
        groups.setdefault(root(i), []).extend((place, i) for place in places[values[i]])
    out = {}
    for some in groups.values():
        some.sort()
        records = [members[place]["record"] for place, _ in some]
        name = "dup-" + hashlib.sha256("|".join(sorted(records)).encode("utf-8", "surrogatepass")).hexdigest()[:12]
        chosen = some[0][0] if m.canonical_strategy == "first" else max((place for place, _ in some), key=lambda k: members[k]["there"])
        out |= {place: (name, members[chosen]["record"], *best[i]) for place, i in some}
    return out


def with_matches(m: Matching, batches):
    """Batches of (block, record, there, values, doc) in block order, null blocks apart, as batches of
    doc and `__match`, what a match adds. Rows of a block that the next batch may go on with are held back."""

    def done(table: pa.Table):
        blocks = table.column("block").to_pylist()
        keys = table.select(["record", "there", "values"]).to_pylist()
        for x in keys:
            x["values"] = tuple((v["k"], v["r"]) for v in x["values"])
        rows, start = [(None, None, None, None)] * len(blocks), 0
        while start < len(blocks):
            end = start + 1
            while end < len(blocks) and blocks[end] == blocks[start]:
                end += 1
            if blocks[start] is not None and end > start + 1:
                for place, hit in match_block(m, keys[start:end]).items():
                    rows[start + place] = hit
            start = end
        match = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), MATCH)], fields=list(MATCH))
        yield from pa.Table.from_arrays([table.column("doc"), match], ["doc", "__match"]).combine_chunks().to_batches()

    held = None
    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            last, at = table.column("block")[-1].as_py(), table.num_rows
            while last is not None and at and table.column("block")[at - 1].as_py() == last:
                at -= 1
            held = table.slice(at) if at < table.num_rows else None
            if at:
                yield from done(table.slice(0, at))
    if held is not None:
        yield from done(held)


def equal_sets(m: Matching) -> list[tuple[float, list[str], tuple[int, ...]]] | None:
    """The sets of columns whose equality alone reaches the least score, as (score, names, positions)
    from the worst to the best; None where pairs must be looked at: in other modes, if every pair
    matches, if a weight adds nothing to the score, or if there are very many sets."""
    weights, n = [m.weight(c) for c in m.comparison_columns], len(m.comparison_columns)
    if m.mode not in ("exact", "normalized") or m.minimum_score <= 0 or n > 12:
        return None
    score = lambda some: round(sum((100.0 if i in some else 0.0) * w for i, w in enumerate(weights)) / sum(weights), 2)
    every = [some for k in range(1, n + 1) for some in combinations(range(n), k)]
    found = [(score(some), [m.comparison_columns[i] for i in some], some) for some in every if score(some) >= m.minimum_score]
    rising = all(score(some) > score(tuple(x for x in some if x != i)) for _, _, some in found for i in some)
    return sorted(found) if rising and len(found) <= COLUMN_SETS else None


def travelled(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id that is reached from each through groups (block, s, part). Each round
    is a small table; rounds end when no label falls."""
    spark, now, total = edges.sparkSession, None, None
    path = scratch_folder(spark, "edges")
    edges.write.parquet(path)
    edges = spark.read.parquet(path)
    over = Window.partitionBy("block", "s", "part")
    while True:
        known = edges.withColumn("label", F.col("id")) if now is None else edges.join(now, "id")
        path = scratch_folder(spark, "labels")
        known.withColumn("least", F.min("label").over(over)).groupBy("id").agg(F.min("least").alias("label")).write.parquet(path)
        now = spark.read.parquet(path)
        before, total = total, now.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if before == total:
            return now


def equal_matches(rows: DataFrame, m: Matching, sets: list) -> DataFrame:
    """(block, values, match) of the values that have a match. `rows` has (row, block, record, there,
    values) of blocks within the limit."""
    nodes = rows.groupBy("block", "values").agg(F.count("*").alias("n"), F.min("row").alias("id"), F.collect_list("record").alias("records"), F.min(F.struct("row", "record"))["record"].alias("first"), F.max(F.struct("there", (-F.col("row")).alias("r"), "record")).alias("fullest"))  # a block's rows at most
    smallest = {k for k, (_, _, a) in enumerate(sets) if not any(set(b) < set(a) for _, _, b in sets)}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("s"), F.array(*[F.col("values")[i] for i in some]).alias("part")) for k, (_, _, some) in enumerate(sets)])).alias("x")
    over = Window.partitionBy("block", "s", "part")
    shared = nodes.select("id", "n", "block", each).select("id", "n", "block", "x.s", "x.part").withColumn("rows", F.sum("n").over(over)).withColumn("least", F.min("id").over(over)).where("rows > 1")
    if len(smallest) == 1:  # it lies in every other set
        labels = shared.where(F.col("s") == min(smallest)).select("id", F.col("least").alias("label"))
    else:
        labels = travelled(shared.where(F.col("s").isin(sorted(smallest))).select("id", "block", "s", "part"))
    best = shared.groupBy("id").agg(F.max("s").alias("best")).join(labels, "id")
    own = nodes.join(best, "id")
    fullest = F.max("fullest")["record"]
    groups = own.groupBy("label").agg(
        F.concat(F.lit("dup-"), F.substring(F.sha2(F.encode(F.array_join(F.array_sort(F.flatten(F.collect_list("records"))), "|"), "utf-8"), 256), 1, 12)).alias("name"),
        (F.min(F.struct("id", "first"))["first"] if m.canonical_strategy == "first" else fullest).alias("chosen"),
    )
    scores, names = F.lit([x[0] for x in sets]), F.array(*[F.array(*[F.lit(c) for c in x[1]]) for x in sets])
    match = F.struct(F.col("name").alias("group_id"), F.col("chosen").alias("canonical"), F.get(scores, F.col("best")).alias("score"), F.get(names, F.col("best")).alias("columns"))
    return own.join(groups, "label").select(F.col("block").alias("own_block"), F.col("values").alias("own_values"), match.alias("__match"))


def as_text(value: Column, kind: T.DataType) -> Column:
    """The value as the text that names a record: null is "None", truth values are capitalised."""
    shown = F.initcap(value.cast("string")) if isinstance(kind, T.BooleanType) else value.cast("string")
    return F.coalesce(shown, F.lit("None"))


def with_match_columns(joined: DataFrame, frame: DataFrame, m: Matching, record: Column) -> DataFrame:
    """The frame's columns and those that a match adds, from rows with `__match`."""
    match = F.col("__match")
    hit = match["group_id"].isNotNull()
    new = {
        "duplicate_group_id": match["group_id"],
        "record_id": record,
        "canonical_record_id": match["canonical"],
        "match_score": match["score"],
        "match_reason": F.when(hit, f"blocked match on {', '.join(m.blocking_columns) or 'prefix'}"),
        "review_required": F.coalesce(match["score"] < m.review_threshold, F.lit(False)),
        "matched_columns": F.coalesce(match["columns"], F.array().cast("array<string>")),
    }
    order = [*[c for c in frame.columns if c not in new or c == "record_id"], *[c for c in new if c != "record_id" or c not in frame.columns]]
    return joined.select(*[new[c].alias(c) if c in new else named(c) for c in order])


def detect_duplicates(frame: DataFrame, m: Matching) -> Duplicates:
    """The frame with duplicate_group_id, record_id, canonical_record_id, match_score, match_reason,
    review_required and matched_columns; and the matched pairs and block sizes."""
    columns = visible(frame)
    ship_package(frame.sparkSession)
    if ROW in frame.columns:
        source = frame
    else:  # row numbers name the records if no column does
        source = with_rows(frame) if m.record_id_column in columns else dense_rows(frame)
    if m.record_id_column in columns:
        record = as_text(named(m.record_id_column), frame.schema[m.record_id_column].dataType)
    else:
        record = F.col(ROW).cast("string")
    there = F.lit(0)
    for c in columns:
        empty = named(c).isNull() | (F.coalesce(named(c) == "", F.lit(False)) if isinstance(frame.schema[c].dataType, T.StringType) else F.lit(False))
        there = there + F.when(empty, 0).otherwise(1)
    doc = F.struct(*[named(c).alias(c) for c in source.columns]).alias("doc")
    meeting = stored(all_keyed(source, m, record.alias("record"), there.alias("there"), doc))
    rows = meeting.where("block <> ''").drop("record", "there", "doc")
    blocks = block_sizes(rows, m)
    matched = scored_pairs(candidate_pairs(rows, blocks), m).where(F.col("score") >= m.minimum_score)
    apart = F.col("block") == ""
    big = blocks.where("oversized").select(F.col("block").alias("big"))
    large = big.limit(BROADCAST_BLOCKS + 1).collect()
    if large:
        few = F.broadcast(big.sparkSession.createDataFrame(large, "big string")) if len(large) <= BROADCAST_BLOCKS else big
        meeting, apart = meeting.join(few, F.col("block") == F.col("big"), "left"), apart | F.col("big").isNotNull()
    sets = equal_sets(m)
    if sets is not None:
        one = lambda i: F.when(F.col(f"k{i}") == "", "").otherwise(F.concat(F.lit("="), F.col(f"r{i}"))) if m.mode == "exact" else F.col(f"k{i}")
        # rows apart have a key of their own, so they are dealt out evenly
        values = F.when(apart, F.array(F.col("row").cast("string"))).otherwise(F.array(*[one(i) for i in range(len(m.comparison_columns))]))
        meeting = meeting.select(F.when(~apart, F.col("block")).otherwise("").alias("block"), "row", "record", "there", values.alias("values"), "doc")
        matches = equal_matches(meeting.where("block <> ''").drop("doc"), m, sets)
        joined = meeting.join(matches, (F.col("block") == F.col("own_block")) & (F.col("values") == F.col("own_values")), "left").select("doc.*", "__match")
        return Duplicates(with_match_columns(joined, frame, m, record), matched, blocks)
    values = F.array(*[F.struct(F.col(f"k{i}").alias("k"), (F.col(f"r{i}") if m.mode == "exact" else F.lit(None).cast("string")).alias("r")) for i in range(len(m.comparison_columns))])
    meeting = meeting.select(F.when(~apart, F.col("block")).alias("block"), "row", "record", "there", values.alias("values"), "doc")
    deal = F.when(F.col("block").isNotNull(), F.xxhash64("block")).otherwise(F.xxhash64("row", F.lit("apart")))
    meeting = meeting.repartition(deal).sortWithinPartitions("block", "row").drop("row")
    fields = meeting.select("doc", F.lit(None).cast(MATCH_SQL).alias("__match")).schema
    joined = meeting.mapInArrow(lambda batches: with_matches(m, batches), fields).select("doc.*", "__match")
    return Duplicates(with_match_columns(joined, frame, m, record), matched, blocks)


def duplicate_groups(result: DataFrame) -> DataFrame:
    """The groups of a result for review, in the order of their first row."""
    grouped = result.where("duplicate_group_id is not null")
    row = F.col(ROW) if ROW in result.columns else F.monotonically_increasing_id()
    shown = [c for c in result.columns if c != ROW]
    return (
        grouped.withColumn("__at", row).groupBy("duplicate_group_id")
        .agg(F.bool_or("review_required").alias("review_required"), F.max(F.coalesce("match_score", F.lit(100.0))).alias("score"), F.sort_array(F.collect_list(F.struct("__at", F.struct(*[named(c) for c in shown]).alias("record")))).alias("x"), F.min("__at").alias("__first"))
        .orderBy("__first").select("duplicate_group_id", "review_required", "score", F.col("x.record").alias("records"))
    )


def differences(groups: DataFrame, columns: list[str]) -> DataFrame:
    """For each group and column, whether its records differ in it."""
    exploded = groups.select("duplicate_group_id", F.explode("records").alias("r"))
    flags = exploded.groupBy("duplicate_group_id").agg(*[(F.size(F.collect_set(F.coalesce(F.col("r")[c].cast("string"), F.lit("")))) > 1).alias(c) for c in columns])
    return flags
