"""Operators 11 to 13 against plain versions, on small tables with the odd cases."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from larkspur.llm import filter_audit, importance_sampling, substring_dedup


def texts(seed: int, n: int) -> list:
    """Texts that share passages, with copies, runs of one word, short, empty, null and long ones."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["and", "The", "rivière", "río", "x1", "Zug", "#5", "ab"]) + str(rng.randrange(30))
    passages = [[word() for _ in range(rng.choice([20, 34, 35, 36, 60, 90]))] for _ in range(8)]
    out = [None, "", " \t\n", "one two", " ".join(["same"] * 80), " ".join(["a", "b"] * 40), " ".join(passages[4]) + "\n", "\x0b".join(passages[4])]
    for _ in range(n):
        parts = [[word() for _ in range(rng.randrange(50))] for _ in range(rng.randrange(1, 4))]
        for _ in range(rng.randrange(3)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(passages))
        out.append(" ".join(itertools.chain.from_iterable(parts)))
    long = [word() for _ in range(20_000)]
    return [*out, *out[-4:], " ".join(long + passages[5] + long[:40])]


def documents(spark, rows):
    """(doc_id, text, lang) with other columns whose names clash with the operators' own."""
    frame = spark.createDataFrame([(i, t, la, "x", 1, "y") for i, t, la in rows], "doc_id long, text string, lang string, key string, n long, role string")
    return frame.repartition(3)


def plain_repeats(rows, length):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in rows]
    seen = Counter(tuple(w[i : i + length]) for w in split for i in range(len(w) - length + 1))
    out = []
    for w in split:
        gone = {k for i in range(len(w) - length + 1) if seen[tuple(w[i : i + length])] > 1 for k in range(i, i + length)}
        out.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize("length", [1, 5, 35, 70])
def test_repeats(spark, length):
    rows = texts(length, 60)
    ids = [None if k == 5 else k // 2 if k > 20 else k for k in range(len(rows))]  # null ids, and ids that repeat
    found = substring_dedup.drop_repeats(documents(spark, [(i, t, "") for i, t in zip(ids, rows)]), length=length)
    expected = [(i, *x) for i, x in zip(ids, plain_repeats(rows, length))]
    assert Counter(map(tuple, found.collect())) == Counter(expected)
    assert any(x[2] for x in expected)


def test_repeats_of_nothing(spark):
    empty = documents(spark, []).where("false")
    assert substring_dedup.drop_repeats(empty).collect() == []
    with pytest.raises(ValueError):
        substring_dedup.drop_repeats(empty, length=0)


def test_runs_that_stand_for_windows():
    assert substring_dedup.levels(35) == [18, 35] and substring_dedup.levels(100) == [25, 50, 100] and substring_dedup.levels(9) == [9]
    known = substring_dedup.Words()
    texts = substring_dedup.Texts([b" ".join(b"w%d" % (k % 50) for k in range(120))], known, 35, [18, 35])
    at = texts.stands_for(0)
    offset = at - range(len(at))
    assert (offset[:36] == offset[50:86]).all() and (offset >= 0).all() and (offset <= 17).all()
    assert len(set(at)) < len(at) / 3


def plain_audit(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    parts, out = {}, []
    for i, t, la in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        parts.setdefault(la or "", []).append(({f for f in fails if fails[f]}, i in good, i in toxic))
    for part, docs in parts.items():
        rows, share = [], Counter()
        for order in itertools.permutations("ABCDE"):
            left = docs
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                share[f] += len(gone)
                rows.append((part, "".join(order), k + 1, len(left), len(gone), sum(f in d[0] for d in docs) - len(gone), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone), f))
        out += [(*r[:-1], share[r[-1]]) for r in rows]
    return out


def test_audit(spark):
    rows = texts(3, 80)
    rng = random.Random(1)
    rows = [(None if k == 9 else k // 2 if k > 60 else k, t and (t.upper() if k % 7 == 0 else t) + (" ".join(f" u{k}v{j}" for j in range(120)) if k % 3 else ""), rng.choice(["en", "de", None, ""])) for k, t in enumerate(rows)]
    rows += [(500, None, "fr"), (1, rows[1][1], "en"), (1, rows[1][1], "en"), (700, rows[30][1], "en"), (701, rows[30][1], "xx")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 90, 2)] + [(4, 1, 1), (None, 1, 1)]
    named = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("z"))
    found = filter_audit.audit(documents(spark, rows), named)
    expected = plain_audit(rows, labels)
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    assert any(r[7] for r in expected) and any(r[8] for r in expected) and all(any(r[4] for r in expected if r[1][r[2] - 1] == f) for f in "ABCDE")
    assert filter_audit.audit(documents(spark, []).where("false"), named).collect() == []


def plain_sample(rows, target, buckets, percent, least):
    def bag(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return len(w), Counter(zlib.crc32(x.encode()) % buckets for x in [*w, *map(" ".join, zip(w, w[1:]))])

    bags, wanted = [bag(t) for _, t, _ in rows], [bag(t) for t in target]
    s, t = (sum((b for _, b in x), Counter()) for x in (bags, wanted))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in s}
    out = []
    for (i, *_), (n, b) in zip(rows, bags):
        size = sum(b.values())
        weight = sum(c * gain[k] for k, c in b.items()) // size if size else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, size, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return [(*r[:4], rank.get(id(r))) for r in out]


@pytest.mark.parametrize("buckets, percent", [(10_000, 25), (37, 100), (10_000, 0)])
def test_resampling(spark, buckets, percent):
    rows = [(None if k == 11 else k, t, "") for k, t in enumerate(texts(8, 300))] + [(40, "x " * 30, ""), (40, "x " * 30, "")]
    target = [*texts(8, 5)[-6:], None, "", "Zug12 río3 " * 400]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    found = importance_sampling.resample(documents(spark, rows), bench, buckets=buckets, percent=percent)
    expected = plain_sample(rows, target, buckets, percent, 20)
    assert Counter(map(tuple, found.collect())) == Counter(expected)


def test_resampling_in_lanes(spark, monkeypatch):
    """Several lanes give what one gives; no targets and no documents are no fault."""
    monkeypatch.setattr(importance_sampling, "LANE_DOCS", 30)
    rows = [(k, t, "") for k, t in enumerate(texts(5, 200))]
    bench = spark.createDataFrame([(1, "ab1 ab2")], "item_id long, text string")
    found = importance_sampling.resample(documents(spark, rows), bench).collect()
    assert Counter(map(tuple, found)) == Counter(plain_sample(rows, ["ab1 ab2"], 10_000, 25, 20))
    assert Counter(map(tuple, importance_sampling.resample(documents(spark, rows), bench.where("false")).collect())) == Counter(plain_sample(rows, [], 10_000, 25, 20))
    assert importance_sampling.resample(documents(spark, rows).where("false"), bench).collect() == []
