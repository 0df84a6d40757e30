"""URL filters (operator 6, DataFrame functions only).

Rules of (host, path) decide first. A rule fits its host and all subdomains if the URL's path starts
with the rule's; the longest fitting rule wins. What no rule decides is judged by gradient-boosted
trees over lexical features, trained on labelled URLs: lengths, path depth, digit ratio, host
entropy, parameter counts, and statistics of the host's suffix among the labelled URLs.

The suffix statistics cover all labelled URLs; only the trees are fitted to a sample. For training,
they are taken out of fold: URLs are dealt to FOLDS folds by their host, and a training URL sees only
the labels of the other folds, so that no URL's own label is among its features. Training is a
handful of small aggregations: the sample (about `max_training` distinct labelled URLs, chosen by a
hash of the URL; repeated ones are drawn together and count by their number) is folded to distinct
feature vectors with weights, and each level of each tree is one grouped sum of gradients over all
features and cuts; a split's sums are its children's leaves. Gradients are summed as integers, so the
trees do not depend on order or partitioning. A trained model is a Column expression.

Results in odd cases: a null URL, or one without `://`, has an empty host and path, no rule, and goes
to the trees; without labelled URLs of both kinds the verdict is the commoner label, or allow;
repeated rows are judged alike; a score of exactly one half allows; an empty table gives an empty
result; other columns, whatever their names, are ignored; URLs of any length are read whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Work

#: The letters that are lower-cased.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Gradients are summed in units of 1 / SCALE.
SCALE = 1_000_000
#: Folds of hosts for the suffix statistics of training URLs.
FOLDS = 5
#: Most rows, and bytes of their suffixes, of the suffix statistics that are broadcast; larger ones are shuffled.
MOST_SUFFIXES, MOST_BYTES = 20_000, 1_000_000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    def __str__(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Boosting:
    trees: int = 8
    depth: int = 3
    rate: float = 0.4
    smoothing: float = 5.0
    cuts: int = 8
    max_training: int = 20_000


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest fitting rule as text, or null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(str(r)), str(r))):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        found = F.when(fits, str(rule)).otherwise(found)
    return found


def suffix_of(host: Column) -> Column:
    """The last two labels."""
    return F.substring_index(host, ".", -2)


def count_in(text: Column, chars: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    url = F.coalesce(url, F.lit(""))
    size = F.greatest(F.char_length(host), F.lit(1))
    share = F.transform(F.array_distinct(F.split(host, "")), lambda c: F.char_length(host) - F.char_length(F.replace(host, c, F.lit(""))))
    bits = F.aggregate(share, F.lit(0.0), lambda a, n: F.when(n > 0, a - n / size * F.log2(n / size)).otherwise(a))
    return {
        "url_length": F.char_length(url),
        "host_length": F.char_length(host),
        "labels": count_in(host, "."),
        "hyphens": count_in(host, "-"),
        "depth": count_in(path, "/"),
        "digit_share": F.floor(1000 * count_in(url, "0123456789") / F.greatest(F.char_length(url), F.lit(1))),
        "entropy": F.floor(1000 * bits),
        "parameters": count_in(url, "="),
    }


@dataclass
class Trees:
    """An ensemble: `margin` over feature columns; leaves of a tree by its path."""

    base: float
    parts: list[dict] = field(default_factory=list)

    @staticmethod
    def value(node: dict) -> Column:
        if "leaf" in node:
            return F.lit(float(node["leaf"]))
        return F.when(F.col(node["feature"]) <= node["cut"], Trees.value(node["low"])).otherwise(Trees.value(node["high"]))

    def margin(self) -> Column:
        total = F.lit(float(self.base))
        for tree in self.parts:
            total = total + self.value(tree)
        return total


def grow(train: DataFrame, features: list[str], options: Boosting) -> Trees:
    """Boosted trees from rows of (features, y in 0/1, w). Each step sends a few numbers to the driver."""
    n, ones = train.agg(F.coalesce(F.sum("w"), F.lit(0)), F.coalesce(F.sum(F.col("w") * F.col("y")), F.lit(0))).first()
    if not 0 < ones < n:
        return Trees(0.0 if not n else (10.0 if ones else -10.0))
    quantiles = [i / (options.cuts + 1) for i in range(1, options.cuts + 1)]
    row = train.agg(*[F.percentile(f, F.array(*map(F.lit, quantiles)), F.col("w")).alias(f) for f in features]).first()
    cuts = {f: sorted({math.floor(x) for x in row[f]}) for f in features}
    model = Trees(math.log(ones / (n - ones)))
    leaf = lambda g, h: {"leaf": options.rate * g / (h + options.smoothing)}
    score = lambda g, h: g * g / (h + options.smoothing)
    for _ in range(options.trees):
        p = 1 / (1 + F.exp(-model.margin()))
        state = train.select(*features, (F.col("w") * F.round((F.col("y") - p) * SCALE).cast("long")).alias("g"), (F.col("w") * F.round(p * (1 - p) * SCALE).cast("long")).alias("h"))
        root: dict = {}
        open_nodes = {0: root}
        for _ in range(options.depth):
            node = Trees.value(_numbered(root, open_nodes)).cast("int").alias("node")
            sums = [F.sum("g").alias("g"), F.sum("h").alias("h")]
            for i, f in enumerate(features):
                for k, c in enumerate(cuts[f]):
                    low = F.col(f) <= c
                    sums += [F.sum(F.when(low, F.col("g"))).alias(f"g{i}_{k}"), F.sum(F.when(low, F.col("h"))).alias(f"h{i}_{k}")]
            rows = {r["node"]: r for r in state.select("*", node).groupBy("node").agg(*sums).collect()}
            following: dict = {}
            for number, target in open_nodes.items():
                r = rows[number]
                g, h = r["g"] / SCALE, r["h"] / SCALE
                best = (1e-6, None, (0.0, 0.0))
                for i, f in enumerate(features):
                    for k, c in enumerate(cuts[f]):
                        gl, hl = (r[f"g{i}_{k}"] or 0) / SCALE, (r[f"h{i}_{k}"] or 0) / SCALE
                        if hl > 0 and h - hl > 0 and (gain := score(gl, hl) + score(g - gl, h - hl) - score(g, h)) > best[0]:
                            best = (gain, (f, c), (gl, hl))
                target.clear()
                if best[1] is None:
                    target.update(leaf(g, h))
                    continue
                gl, hl = best[2]
                target |= {"feature": best[1][0], "cut": best[1][1], "low": leaf(gl, hl), "high": leaf(g - gl, h - hl)}
                following[len(following)] = target["low"]
                following[len(following)] = target["high"]
            open_nodes = following
            if not open_nodes:
                break
        model.parts.append(root)
    return model


def _numbered(node: dict, open_nodes: dict) -> dict:
    """The tree so far with the open nodes' numbers as leaves; finished leaves are -1."""
    for number, x in open_nodes.items():
        if x is node:
            return {"leaf": number}
    if "leaf" in node:
        return {"leaf": -1}
    return {"feature": node["feature"], "cut": node["cut"], "low": _numbered(node["low"], open_nodes), "high": _numbered(node["high"], open_nodes)}


def filter_urls(
    pages: DataFrame,
    rules: list[Rule],
    labelled: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    options: Boosting | None = None,
) -> DataFrame:
    """Rows of (id, host, path, rule, verdict, block_score). `labelled` has (url, verdict); without
    it the URLs that the rules decide are the labelled ones."""
    options, work = options or Boosting(), Work(pages.sparkSession)

    def read(frame: DataFrame, column: str, *more: Column) -> DataFrame:
        f = frame.select(*more, F.col(column).cast("string").alias("url"))
        f = f.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
        return f.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))

    verdict_of = F.lit(None).cast("string")
    for rule in rules:
        verdict_of = F.when(F.col("rule") == str(rule), rule.verdict).otherwise(verdict_of)
    if labelled is None:
        known = read(pages, url_col).withColumn("label", verdict_of).where("label is not null")
    else:
        known = read(labelled, "url", F.col("verdict").alias("label")).where("label is not null and url is not null")
    fold = F.pmod(F.xxhash64("host", F.lit(1)), F.lit(FOLDS))
    known = known.withColumns({"suffix": suffix_of(F.col("host")), "y": (F.col("label") == "block").cast("int"), "fold": fold})
    of_fold = [F.struct(F.count_if(F.col("fold") == k).alias("n"), F.coalesce(F.sum(F.when(F.col("fold") == k, F.col("y"))), F.lit(0)).alias("ones")) for k in range(FOLDS)]
    suffixes = work.cut(known.groupBy("suffix").agg(F.count("*").alias("n"), F.sum("y").alias("ones"), F.array(*of_fold).alias("of_fold")), "url-suffixes")
    total, rows, size = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.octet_length("suffix")), F.lit(0))).first()
    suffixes = F.broadcast(suffixes) if rows <= MOST_SUFFIXES and size <= MOST_BYTES else suffixes.hint("merge")
    rate = lambda ones, n: F.floor((ones + 1) * 1000 / (n + 2)).alias("suffix_blocked")
    own = F.col("of_fold")[F.col("fold").cast("int")]
    share = min(1.0, options.max_training / max(total, 1))
    sample = known.where(F.pmod(F.xxhash64("url", F.lit(6)), F.lit(1_000_003)) < int(share * 1_000_003) + (share == 1.0))
    sample = sample.select("suffix", "fold", "y", *[v.cast("long").alias(k) for k, v in lexical(F.col("url"), F.col("host"), F.col("path")).items()])
    names = list(lexical(F.lit(""), F.lit(""), F.lit("")))
    sample = sample.groupBy("suffix", "fold", "y", *names).agg(F.count("*").alias("w")).join(suffixes, "suffix")
    sample = work.cut(sample.select("y", "w", *names, rate(F.col("ones") - own["ones"], F.col("n") - own["n"]), (F.col("n") - own["n"]).alias("suffix_seen")), "url-training")
    model = grow(sample, [*names, "suffix_blocked", "suffix_seen"], options)
    work.drop(sample)

    every = read(pages, url_col, F.col(id_col).alias("id"))
    every = every.select("id", "host", "path", "rule", suffix_of(F.col("host")).alias("suffix"), *[v.cast("long").alias(k) for k, v in lexical(F.col("url"), F.col("host"), F.col("path")).items()])
    every = every.join(suffixes.drop("of_fold"), "suffix", "left").fillna({"n": 0, "ones": 0})
    every = every.withColumns({"suffix_blocked": rate(F.col("ones"), F.col("n")), "suffix_seen": F.col("n")})
    score = 1 / (1 + F.exp(-model.margin()))
    judged = every.select("id", "host", "path", "rule", score.alias("block_score"))
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce(verdict_of, F.when(F.col("block_score") > 0.5, "block").otherwise("allow")).alias("verdict"), "block_score")
