"""Each operator against a brute-force version, and its behaviour in odd cases."""

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.llm import components, decontamination, language_id, license_scan, near_duplicates, pii, quality_rules, queries, sentencepiece_codec, token_counts, token_files, url_filters
from larkspur.llm.common import Work, release, scratch

WORDS = "the and of thing other ering tion ation small large blue green river mountain über straße niño élan data model train".split()
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, id string, key string, w string, _doc string"


def sentence(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (r.choice(["", "", ".", ",", "\n"])) for _ in range(n))


def upper(text: str) -> str:
    return "".join(c.upper() if c.isascii() else c for c in text)


def odd_texts() -> list:
    base = sentence(1, 60)
    return [
        None, "", " \n\t ", "one", "one two three four", base, base, upper(base), base + " more words here", sentence(2, 3000),
        "mail a.b@c.example.com or +1 (212) 555-0199, 10.0.0.1, 4111 1111 1111 1111", 'token = "0123456789abcdef0123456789abcdef01234567" here',
        "x" * 5000, "日本語のテキスト🙂 mixed ﬁ \x00 <|endoftext|> end", "a\u0085b\u00a0c d\x1ce", "Released under the MIT License.\n" + sentence(3, 40), sentence(4, 13), "!!! ??? ###",
    ]


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with odd texts, a null id, repeated rows, and columns whose names clash with the operators'."""
    texts = odd_texts()
    rows = [(i if i != 4 else None, t, ["en", None, "de"][i % 3], ["s", None][i % 2], 1, 0.5, True, "x", "k", "w", "d") for i, t in enumerate(texts)]
    rows.append(rows[5])
    return spark.createDataFrame(rows, EXTRA).repartition(3).persist()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], EXTRA)


def pairs_of(frame):
    return [(r["doc_id"], r["text"] or "") for r in frame.select("doc_id", "text").collect()]


def bag(rows):
    return Counter(map(repr, rows))


# --- 1 -----------------------------------------------------------------------------------------


def test_token_files(spark, odd, nothing):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, out = Tokenizer.from_file(path), scratch(spark, "test-files")
    manifest = token_files.write_token_files(odd, out, path, end_id=1, seq_len=64)
    assert manifest == token_files.read_manifest(out)
    got = token_files.read_token_files(spark, out).collect()
    want = Counter()
    for doc, text in pairs_of(odd):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [1]
        want[doc, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    got.sort(key=lambda r: r["start"])
    assert [r["start"] for r in got] == list(np.cumsum([0] + [r["n_tokens"] for r in got])[:-1])
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert ids == sorted(ids)
    shard = token_files.Shard(out, manifest[0][0])
    assert len(shard.sequence(0)) == 64 and isinstance(shard.seq.schema.field("ids").type, pa.FixedSizeListType)
    last = -(-manifest[0][2] // 64) - 1
    assert sum(shard.mask(last).to_pylist()) == manifest[0][2] - 64 * last
    # another run into the same folder replaces the files
    again = token_files.write_token_files(odd.where("doc_id < 3").coalesce(1), out, path)
    names = {x.name for x in Path(out).iterdir() if not x.name.startswith(".")}
    assert names == {"manifest.json"} | {f"{m[0]}.{x}.arrow" for m in again for x in ("seq", "doc")} and token_files.read_token_files(spark, out).count() == 3
    empty = scratch(spark, "test-files")
    assert token_files.write_token_files(nothing, empty, path) == [] and token_files.read_token_files(spark, empty).count() == 0


def test_memo_is_only_a_cache(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [t for t in odd_texts() if t]
    whole = token_files.WordEncoder(path)(texts)
    monkeypatch.setattr(token_files, "MEMO_WORDS", 3)
    encoder = token_files.WordEncoder(path)
    assert encoder(texts) == whole
    encoder(["y" * 10_000, "z" * 65, "short"])
    assert max(map(len, encoder.words)) <= token_files.LONGEST_WORD and b"short" in encoder.words


# --- 2 -----------------------------------------------------------------------------------------


def plain_groups(docs):
    sets = {}
    for doc, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        sets[doc] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


def variants(seed: int, n: int) -> list[str]:
    """Families of copies with slips around the threshold, chains, exact copies and loners."""
    r, out = random.Random(seed), []
    for f in range(n):
        base = [r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(r.choice([6, 40, 120]))]
        out.append(" ".join(base))
        for _ in range(r.randint(0, 12)):
            words = list(r.choice([base, base, out[-1].split()]))
            for _ in range(r.randint(0, max(1, len(words) // 25))):
                words[r.randrange(len(words))] = f"slip{r.randint(0, 999)}"
            out.append(" ".join(words) if r.random() < 0.8 else " ".join(words).upper())
    return out


def test_near_duplicates(spark):
    texts = variants(7, 40)
    docs = list(enumerate(texts))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates.near_duplicates(frame).collect()}
    assert got == plain_groups(docs)
    assert {r["doc_id"] for r in near_duplicates.keep_one(frame).collect()} == {d for d, (_, c) in got.items() if d == c}


def test_near_duplicates_odd(odd, nothing):
    rows = near_duplicates.near_duplicates(odd).collect()
    assert len(rows) == odd.count() and near_duplicates.near_duplicates(nothing).count() == 0
    null = [r for r in rows if r["doc_id"] is None]
    assert [(r["component_id"], r["kept"]) for r in null] == [(None, True)]
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[0]["n_shingles"] == by[1]["n_shingles"] == by[2]["n_shingles"] == 0 and by[0]["component_id"] == 0 and by[1]["kept"] and by[2]["kept"]
    assert by[3]["n_shingles"] == 1 and by[6]["component_id"] == by[5]["component_id"] == 5
    kept = near_duplicates.keep_one(odd)
    counts = Counter(r["doc_id"] for r in kept.collect())
    assert kept.columns == odd.columns and counts[5] == 1 and not counts[6] and not counts[7] and all(counts[i] == 1 for i in (0, 1, 2, 3))
    with pytest.raises(ValueError):
        near_duplicates.near_duplicates(odd, percent=50)


def test_repeated_ids(spark):
    a, b, c = sentence(41, 60), sentence(42, 60), sentence(43, 60)
    rows = [(1, a), (5, a), (5, b), (9, b + " two more"), (7, c), (7, c), (8, upper(c)), (None, a), (3, ""), (3, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_gone": F.lit(1), "th": F.lit("x"), "i": F.lit(2), "own_id": F.lit(3)}).repartition(3)
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates.near_duplicates(frame).collect())
    assert got == Counter({(1, 1, True): 1, (5, 1, False): 2, (9, 1, False): 1, (7, 7, True): 2, (8, 7, False): 1, (None, None, True): 1, (3, 3, True): 2})
    kept = near_duplicates.keep_one(frame)
    assert kept.columns == frame.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(1, a), (5, b), (7, c), (None, a), (3, ""), (3, "")])


def test_busy_centres_are_dealt_out(spark, monkeypatch):
    r = random.Random(12)
    base = [f"w{i}" for i in range(80)]
    docs = [(i, " ".join(x if r.random() > 0.012 else f"slip{r.randint(0, 99)}" for x in base)) for i in range(150)] + [(200 + i, sentence(i, 50)) for i in range(20)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(near_duplicates, "PER_COPY", 7)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_duplicates.near_duplicates(frame).collect()}
    assert got == plain_groups(docs)
    monkeypatch.setattr(near_duplicates, "BROADCAST_ROWS", 3)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_duplicates.near_duplicates(frame).collect()}
    assert got == plain_groups(docs)
    assert {x["doc_id"] for x in near_duplicates.keep_one(frame).collect()} == {d for d, (_, c) in got.items() if d == c}


def test_min_max_signatures_estimate():
    r = random.Random(5)
    a = np.array([r.getrandbits(64) for _ in range(600)], np.uint64)
    b = np.concatenate([a[:480], np.array([r.getrandbits(64) for _ in range(120)], np.uint64)])
    same = np.mean(near_duplicates.signature(a) == near_duplicates.signature(b))
    assert abs(same - 480 / 720) < 0.1 and len(near_duplicates.band_keys(near_duplicates.signature(a))) == near_duplicates.BANDS


def test_components(spark):
    r = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(r.randint(100, 160), r.randint(100, 160)) for _ in range(30)] + [(500, k) for k in range(501, 530)] + [(7, 7)]
    graph = defaultdict(set)
    for a, b in links:
        graph[a].add(b), graph[b].add(a)
    want, seen = {}, set()
    for node in sorted(graph):
        if node not in seen:
            stack, group = [node], set()
            while stack:
                x = stack.pop()
                if x not in group:
                    group.add(x)
                    stack += graph[x]
            seen |= group
            if len(group) > 1:
                want |= dict.fromkeys(group, min(group))
    work = Work(spark)
    def frame(some): return spark.createDataFrame(some, "a long, b long")
    got = {r["id"]: r["component"] for r in components.components(frame(links), work).collect()}
    assert got == want
    # bit by bit, with earlier links contracted
    labels = None
    for k in range(4):
        labels = work.cut(components.contracted(labels, frame(links[k::4]), work), "labels")
    assert {r["rep"]: r["component"] for r in labels.collect()} == want and labels.count() == len(want)
    assert components.components(frame(links).limit(0), work).count() == 0


# --- 3 -----------------------------------------------------------------------------------------


def test_licences(spark, odd, nothing):
    texts = ["x\nReleased under the MIT License.\ny", "Licensed under the Apache License, Version 2.0", "All rights\nreserved.", "no licence", license_scan.TEMPLATES["MIT"][3].replace("WHETHER IN AN ACTION", "IN AN ACTION"), None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["licences"], r["best_dice"]) for r in license_scan.scan_licences(frame).collect()}
    assert [got[i][0] for i in range(6)] == ["MIT", "Apache-2.0", "proprietary", "", "MIT", ""] and got[0][1] == 1.0 and 0.9 < got[4][1] < 1
    assert license_scan.scan_licences(odd).count() == odd.count() and license_scan.scan_licences(nothing).count() == 0
    # the size bounds lose nothing
    for name, grams, low, high in license_scan.prepared(license_scan.TEMPLATES, 80):
        n = len(grams)
        for size in range(1, 3 * n + 3):
            if 2 * min(size, n) * 100 >= 80 * (size + n):
                assert low <= size <= high, name


def plain_runs(text, percent=80):
    """(template number, line or None for a run, coefficient): distinct lines and the whole text, and for the other templates the best of all runs of lines up to the limit."""
    grams_of = lambda w: {f"{a} {b}" for a, b in zip(w, w[1:])}
    lines = [re.findall("[a-z0-9]+", x) for x in text.lower().split("\n")]
    out = []
    for k, (_, grams, _, high) in enumerate(license_scan.prepared(license_scan.TEMPLATES, percent)):
        dice = lambda w: 2 * len(grams_of(w) & set(grams)) / (len(grams_of(w)) + len(grams))  # noqa: E731, B023
        own = [(k, x, dice(w)) for x in {*text.lower().split("\n"), text.lower()} if dice(w := re.findall("[a-z0-9]+", x)) >= percent / 100]
        best = 0
        for i in range(len(lines)):
            run: list = []
            for line in lines[i:]:
                run = run + line
                if len(run) > 2 * high:
                    break
                if (d := dice(run)) >= percent / 100:
                    best = max(best, d)
        out += own or [(k, None, best)] * (best > 0)
    return out


def test_wrapped_licences(spark):
    r, parts = random.Random(8), [t for x in license_scan.TEMPLATES.values() for t in x]
    def wrap(text, size): return "\n".join(" ".join(text.split()[i : i + size]) for i in range(0, len(text.split()), size))
    def around(text): return f"{sentence(r.randint(0, 99), 150)}\nstart\n{text}\nend of it\n{sentence(r.randint(0, 99), 150)}"
    texts = [around(wrap(parts[3], 12)), around("# " + wrap(parts[5], 7).replace("\n", "\n\n# ")), around("All rights\nreserved."), around("all rights and\nreserved."), around(wrap(" ".join(parts[6].split()[:12]), 6)), None, "\n\n"]
    texts += [around(wrap(parts[r.choice([3, 5, 6, 9, 17])], r.randint(3, 15)).replace("the", r.choice(["the", "a"]))) for _ in range(12)] + [around(wrap(parts[9], 6) + "\n" + wrap(parts[3], 10) + "\n" + wrap(parts[9], 5))]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x for x in license_scan.scan_licences(frame).collect()}
    assert [got[i]["licences"] for i in range(7)] == ["MIT", "Apache-2.0", "proprietary", "", "", "", ""] and got[0]["n_matches"] == 1 and got[0]["best_dice"] > 0.95
    known = license_scan.prepared(license_scan.TEMPLATES, 80)
    for i, text in enumerate(texts):
        want = plain_runs(text or "")
        assert got[i]["n_matches"] == len(want) and got[i]["best_dice"] == round(max([d for *_, d in want], default=0), 6) and got[i]["licences"] == ",".join(sorted({known[k][0] for k, *_ in want})), (i, text)
    assert sum(x is None for t in texts for _, x, _ in plain_runs(t or "")) > 12


# --- 4 -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    return sentencepiece_codec.codec(public_tokenizers.path("piece_bpe_32k.model"))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aehinort 0=-_.\n日🙂▁é")), max_size=300), st.integers(20, 60))
def test_scan_is_the_library(codec, text, size):
    assert sentencepiece_codec.encode_chunked(codec, text, size) == codec.library.encode(text)


def test_scan_of_texts_without_spaces(codec):
    r = random.Random(1)
    inside = 0
    for i in range(60):
        text = "".join(r.choice(["er", "re", "in", "the", "ent", "on", "an", "tion"] if i % 2 else ["a", "aa", "=", "==", "0", "00", "-"]) for _ in range(300))
        states = sentencepiece_codec.settle_blocks([codec.matrix(*list(x.values())[1:]) for x in sentencepiece_codec.chunks_of(codec, text, 40)])
        inside += sum(offset > 0 for offset, _ in states)
        assert sentencepiece_codec.encode_chunked(codec, text, 40) == codec.library.encode(text)
    assert inside > 100


def plain_matrix(codec, text, start, stop, first, last):
    """Every state at both cuts, and the library's encoding between them."""
    ends = [stop] if last else range(stop, min(len(text), stop + codec.longest - 1) + 1)
    found = set()
    for offset, token in [sentencepiece_codec.SURE] if first else codec.states(text, start):
        for end in ends:
            between = codec.tokens(text[start + offset : end])
            if start + offset > end or (token and between and codec.ids(token + between[0]) != codec.ids(token) + codec.ids(between[0])):
                continue
            closes = between[-1] if between else token
            if last:
                found.add(((offset, token), sentencepiece_codec.SURE))
            elif end - len(closes) < stop:
                found.add(((offset, token), (end - stop, closes)))
    return found


def test_spliced_matrices(codec):
    r = random.Random(4)
    for kind in (["er", "re", "in", "the", "ent", "on", "an", "tion"], ["a", "aa", "=", "==", "0"], ["the ", "and ", "of", " 日", "é"]):
        text = "".join(r.choice(kind) for _ in range(900))
        for x in sentencepiece_codec.chunks_of(codec, text, 500):
            chunk = list(x.values())[1:]
            assert set(codec.matrix(*chunk)) == plain_matrix(codec, *chunk)


def test_products_are_associative(codec):
    text = codec.normal("erentheintionaner" * 30)
    a, b, c, *_ = [codec.matrix(*list(x.values())[1:]) for x in sentencepiece_codec.chunks_of(codec, text, 40)]
    product = sentencepiece_codec.product
    assert product(product(a, b), c) == product(a, product(b, c))


def test_blocks_are_the_chain(codec):
    r = random.Random(3)
    for _ in range(6):
        text = "".join(r.choice(["er", "re", "in", "the", "ent", "on"]) for _ in range(400))
        for block in (2, 3, 64):
            assert sentencepiece_codec.encode_chunked(codec, text, 40, block) == codec.library.encode(text)


def test_sentencepiece(spark, odd, nothing, codec, monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    r = random.Random(5)
    unsure = "".join(r.choice(["er", "re", "in", "the", "ent", "on"]) for _ in range(2000))  # no sure cut
    frame = odd.unionByName(spark.createDataFrame([(77, unsure), (78, unsure + " and " + unsure[:900])], "doc_id long, text string"), allowMissingColumns=True)
    monkeypatch.setattr(sentencepiece_codec, "BLOCK", 4)
    for size in (sentencepiece_codec.CHUNK, 100):
        encoded = sentencepiece_codec.encode_texts(frame, path, [F.col("doc_id"), F.col("text"), F.lit(1).alias("giant"), F.lit(2).alias("row"), F.lit(3).alias("doc")], size=size, back="back")
        rows = encoded.collect()
        assert bag((x["doc_id"], list(x["ids"])) for x in rows) == bag((d, codec.library.encode(t)) for d, t in pairs_of(frame))
        assert all(x["back"] == (x["text"] or "") and (x["giant"], x["row"], x["doc"]) == (1, 2, 3) for x in rows)
        plain = sentencepiece_codec.encode_texts(frame, path, [F.col("doc_id")], size=size)
        assert plain.columns == ["doc_id", "ids"] and bag(map(tuple, plain.collect())) == bag((x["doc_id"], x["ids"]) for x in rows)
        assert bag((x["doc_id"], x["again"]) for x in sentencepiece_codec.decode_ids(plain, path, out_col="again").collect()) == bag(pairs_of(frame))
    assert sentencepiece_codec.encode_texts(nothing, path, [F.col("doc_id")]).count() == 0
    with pytest.raises(ValueError):
        sentencepiece_codec.encode_texts(odd, path, [F.col("id").alias("ids")])


def test_other_models_are_refused(codec, tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    def changed(change):
        proto = pb.ModelProto()
        proto.CopyFrom(codec.proto)
        change(proto)
        path = tmp_path / "other.model"
        path.write_bytes(proto.SerializeToString())
        return sentencepiece_codec.Codec(str(path))

    changed(lambda p: None).check()
    for change in (lambda p: setattr(p.trainer_spec, "model_type", 1), lambda p: setattr(p.trainer_spec, "byte_fallback", False), lambda p: setattr(p.pieces[500], "type", 4), lambda p: setattr(p.normalizer_spec, "remove_extra_whitespaces", True)):
        with pytest.raises(ValueError):
            changed(change).check()


# --- 5 -----------------------------------------------------------------------------------------


def plain_quality(text):
    words, lines = re.findall(r"[^\x20\x09-\x0D]+", text), [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed


def test_quality(spark, odd, nothing):
    texts = odd_texts() + ["a b c d e f g h " * 6, "line one here\nline two\nline one here\n" + sentence(9, 50), " ".join(f"{w}###" for w in WORDS * 3), "\ud7ff x|y " * 12]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(1000 + i, sentence(1000 + i, 80), "en", "s") for i in range(250)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality_rules.quality_verdicts(frame).collect()}
    for i, t, *_ in rows:
        assert tuple(got[i][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == plain_quality(t or ""), i
    assert not got[len(odd_texts()) + 2]["kept"] and sum(got[1000 + i]["kept"] for i in range(250)) > 240
    kept = quality_rules.quality_filter(odd)
    stay = [(r["doc_id"], r["n_words"]) for r in quality_rules.quality_verdicts(odd).where("kept").collect()]
    assert kept.columns == odd.columns and bag((r["doc_id"], plain_quality(r["text"] or "")[0]) for r in kept.collect()) == bag(stay)
    assert quality_rules.quality_verdicts(odd).count() == odd.count() and quality_rules.quality_verdicts(nothing).count() == 0 and quality_rules.quality_filter(nothing).count() == 0


def test_fences_follow_the_data(spark):
    """The same document is an outlier where texts are even, and none where they spread."""
    r = random.Random(14)
    def text(size, symbols): return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(*size))) + "#" * (r.random() < symbols) for _ in range(200))
    rows = [(i, text((5, 5), 0), "en", "s") for i in range(300)] + [(1000 + i, text((3 + i % 5, 6 + i % 5), (i % 10) / 20), "de", "s") for i in range(300)]
    odd = [text((9, 9), 0), text((5, 5), 0.3), text((5, 5), 0)]
    rows += [(5000 + 10 * k + j, t, lang, "s") for k, lang in enumerate(("en", "de")) for j, t in enumerate(odd)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {x["doc_id"]: x["kept"] for x in quality_rules.quality_verdicts(frame).collect()}
    assert [got[5000 + j] for j in range(3)] == [False, False, True] and all(got[5010 + j] for j in range(3))
    assert all(v for k, v in got.items() if k < 5000)
    # too few documents of a language: the fences of everything
    few = frame.withColumn("lang", F.when(F.col("doc_id") < 5000, F.col("lang")).otherwise("fr"))
    got = {x["doc_id"]: x["kept"] for x in quality_rules.quality_verdicts(few).collect()}
    assert got[5002] and got[5012]


def test_sketch_buckets(spark):
    values = list(range(300)) + [2**k + d for k in range(9, 40) for d in (-1, 0, 1)]
    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality_rules.bucket(F.col("v")).alias("b")).select("v", "b", quality_rules.lowest(F.col("b")).alias("low")).collect()
    assert all(r["low"] <= r["v"] <= r["low"] * 33 / 32 + 1 for r in got) and all(r["b"] == r["v"] for r in got if r["v"] < 64)
    order = sorted((r["v"], r["b"]) for r in got)
    assert [b for _, b in order] == sorted(b for _, b in order)


# --- 6 -----------------------------------------------------------------------------------------


def test_urls(spark):
    urls = ["http://a.example.net/en/1", "http://EXAMPLE.net/de/2?x=/en/", "https://b.org/fr/", "https://org/fr/x#y", "https://x.example.com/de/3", "http://notnet/", "http://a.net", "net/", None, "ftp://u@h.net/x://y", "http://example.com/deal", "http://h.netx/en/"]
    frame = spark.createDataFrame([(i, u, 1.0) for i, u in enumerate(urls)], "page_id long, url string, host double")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.filter_urls(frame, queries.URL_RULES).collect()}
    expected = [
        ("a.example.net", "/en/1", "example.net/en/", "allow"), ("example.net", "/de/2", "net/", "block"), ("b.org", "/fr/", "org/fr/", "allow"), ("org", "/fr/x", "org/fr/", "allow"),
        ("x.example.com", "/de/3", "example.com/de/", "block"), ("notnet", "/", None), ("a.net", "", None), ("", "", None), ("", "", None), ("u@h.net", "/x://y", "net/", "block"), ("example.com", "/deal", None), ("h.netx", "/en/", None),
    ]
    for i, want in enumerate(expected):
        assert got[i][: len(want)] == want and got[i][3] in ("allow", "block")
    assert url_filters.filter_urls(frame.limit(0), queries.URL_RULES).count() == 0


def test_trees_learn(spark):
    r = random.Random(4)
    def url(bad): return f"http://{'x9-' * 4 if bad else 'news'}{r.randint(0, 99)}.example.org/{'q?a=1&b=2&c=3' if bad else 'en/story'}/{r.randint(0, 9)}"
    rows = [(i, url(i % 3 == 0), "block" if i % 3 == 0 else "allow") for i in range(600)]
    frame = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    labelled, rest = frame.where("page_id < 400"), frame.where("page_id >= 400")
    got = {x["page_id"]: x["verdict"] for x in url_filters.filter_urls(rest, [], labelled).collect()}
    assert np.mean([got[i] == v for i, _, v in rows[400:]]) > 0.97


def test_suffix_statistics_cover_all_labelled_urls(spark, monkeypatch):
    labelled = spark.createDataFrame([(f"http://h{k}.d{i:03d}.com/x{k}", "block" if i % 2 else "allow") for i in range(300) for k in range(6)], "url string, verdict string")
    pages = spark.createDataFrame([(i, f"http://b.d{i:03d}.com/y") for i in range(300)], "page_id long, url string")
    def judged(): return {r["page_id"]: (r["verdict"], r["block_score"]) for r in url_filters.filter_urls(pages, [], labelled, options=url_filters.Boosting(max_training=300)).collect()}
    got = judged()
    assert all(got[i][0] == ("block" if i % 2 else "allow") for i in range(300))
    monkeypatch.setattr(url_filters, "MOST_SUFFIXES", 10)
    assert judged() == got


def plain_features(url):
    found = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url)
    host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in found[1]), found[2]) if found else ("", "")
    bits = 0.0
    for c in dict.fromkeys(host):
        p = host.count(c) / max(len(host), 1)
        bits = bits - p * math.log2(p)
    return host, [len(url), len(host), host.count("."), host.count("-"), path.count("/"), 1000 * sum(c in "0123456789" for c in url) // max(len(url), 1), math.floor(1000 * bits), url.count("=")]


def plain_boosting(rows, y, options):
    """Scores of rows by trees grown one row at a time: rows are (features, training or not)."""
    train = [i for i, (_, t) in enumerate(rows) if t]
    cuts = []
    for f in range(len(rows[0][0])):
        values = sorted(rows[i][0][f] for i in train)
        cuts.append(sorted({math.floor(np.percentile(values, 100 * k / (options.cuts + 1))) for k in range(1, options.cuts + 1)}))
    ones = sum(y[i] for i in train)
    margin = [math.log(ones / (len(train) - ones))] * len(rows)
    for _ in range(options.trees):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g, h = [round((a - b) * 1e6) / 1e6 for a, b in zip(y, p)], [round(b * (1 - b) * 1e6) / 1e6 for b in p]
        score = lambda some: sum(g[i] for i in some) ** 2 / (sum(h[i] for i in some) + options.smoothing)  # noqa: E731, B023

        def grow(some, every, depth):
            best = (1e-6, None)
            for f in range(len(cuts)) if depth else ():
                for c in cuts[f]:
                    low, high = [i for i in some if rows[i][0][f] <= c], [i for i in some if rows[i][0][f] > c]
                    if low and high and (gain := score(low) + score(high) - score(some)) > best[0] + 1e-12:  # noqa: B023
                        best = (gain, (f, c, low, high))
            if best[1] is None:
                for i in every:
                    margin[i] += options.rate * sum(g[j] for j in some) / (sum(h[j] for j in some) + options.smoothing)  # noqa: B023
                return
            f, c, low, high = best[1]
            grow(low, [i for i in every if rows[i][0][f] <= c], depth - 1)
            grow(high, [i for i in every if rows[i][0][f] > c], depth - 1)

        grow(train, range(len(rows)), options.depth)
    return [1 / (1 + math.exp(-m)) for m in margin]


def test_urls_against_plain_trees(spark):
    r = random.Random(21)
    def url(bad): return f"http{'s' * r.randint(0, 1)}://{r.choice(['www.', 'm.', ''])}{'ads-' * (bad and r.random() < 0.7)}n{r.randint(0, 30)}.{r.choice(['alpha', 'beta', 'gamma'])}.{r.choice(['com', 'org'])}/{'7' * r.randint(0, 4) + '/x' * r.randint(0, 3)}{'?a=1&b=2' if bad and r.random() < 0.6 else ''}"
    labelled = [(u, bad) for i in range(300) for bad in [i % 3 == 0] for u in [url(bad)]]
    pages = [url(i % 2) for i in range(80)] + ["http://never.seen.example/1", "no scheme"]
    options = url_filters.Boosting(trees=4)
    frame = spark.createDataFrame([(u, "block" if bad else "allow") for u, bad in labelled], "url string, verdict string")
    got = {x["page_id"]: x for x in url_filters.filter_urls(spark.createDataFrame(list(enumerate(pages)), "page_id long, url string"), [], frame, options=options).collect()}
    hosts = sorted({plain_features(u)[0] for u, _ in labelled})
    fold = dict(spark.createDataFrame([(h,) for h in hosts], "h string").select("h", F.pmod(F.xxhash64("h", F.lit(1)), F.lit(url_filters.FOLDS))).collect())
    def suffix(host): return ".".join(host.split(".")[-2:])
    def stats(host, out):
        own = [bad for u, bad in labelled for x in [plain_features(u)[0]] if suffix(x) == suffix(host) and (out is None or fold[x] != out)]
        return [(sum(own) + 1) * 1000 // (len(own) + 2), len(own)]
    rows = [(x + stats(h, fold[h]), True) for u, _ in labelled for h, x in [plain_features(u)]] + [(x + stats(h, None), False) for u in pages for h, x in [plain_features(u)]]
    want = plain_boosting(rows, [int(bad) for _, bad in labelled] + [0] * len(pages), options)[len(labelled):]
    assert all(abs(got[i]["block_score"] - w) < 1e-4 and got[i]["verdict"] == ("block" if w > 0.5 else "allow") for i, w in enumerate(want))
    assert 10 < sum(w > 0.5 for w in want) < 70
    assert url_filters.filter_urls(spark.createDataFrame([], "page_id long, url string"), queries.URL_RULES).count() == 0


# --- 7 -----------------------------------------------------------------------------------------


def plain_contamination(docs, items, size=13):
    def words(t): return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1)) if w else ():
            windows[tuple(w[i : i + size])].add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(g) for g in windows}:
            for i in range(len(w) - n + 1):
                g = tuple(w[i : i + n])
                if g in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[g]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_decontamination(spark, odd, nothing):
    r = random.Random(8)
    long = [sentence(100 + i, 30) for i in range(4)]
    items = [(1, long[0]), (2, long[1]), (10, long[0]), (3, "short item of five words"), (4, "tiny"), (5, None), (6, "..."), (7, "two words"), (8, " ".join(long[2].split()[:20]))]
    texts = [long[0], "intro " + long[1].upper() + " outro", sentence(5, 400) + " " + long[2], "a tiny thing", "short item of five words", "x y z", None, long[0] + " " + long[0], "two words two words tiny", sentence(6, 300) + " two\nwords"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(50 + i, " ".join(r.choice(WORDS) for _ in range(50))) for i in range(20)] + [(0, texts[0]), (None, long[1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    got = decontamination.contamination(frame, bench).select(*columns).collect()
    assert bag(map(tuple, got)) == bag(plain_contamination(docs, items))
    clean = decontamination.decontaminate(frame, bench)
    assert bag(tuple(x) for x in clean.collect()) == bag(d for d, p in zip(docs, plain_contamination(docs, items)) if not p[-1])
    spans = {x["doc_id"]: x["text"] for x in decontamination.decontaminate(frame, bench, remove="spans").where("doc_id is not null").collect()}
    assert spans[3] == "a  thing" and spans[5] == "x y z" and spans[6] is None and "intro " in spans[1] and not re.search("[a-z]", spans[0])
    assert not decontamination.contamination(odd, bench.limit(0)).where("contaminated").count() and decontamination.contamination(odd, bench).count() == odd.count()
    assert decontamination.contamination(nothing, bench).count() == 0 and decontamination.decontaminate(odd, bench).columns == odd.columns
    with pytest.raises(ValueError):
        decontamination.decontaminate(odd, bench, remove="lines")


def test_decontamination_without_broadcast(spark, odd, monkeypatch):
    r = random.Random(15)
    items = [(i, sentence(300 + i, 25)) for i in range(6)] + [(7, "tiny"), (8, "short item of five words"), (None, sentence(310, 20))]
    docs = [(i, f"{sentence(i, 60)} {items[i % 9][1]} {sentence(i + 50, 40)}") for i in range(18)] + [(30, sentence(99, 200)), (31, None), (0, f"{sentence(0, 60)} {items[0][1]} {sentence(50, 40)}"), (None, items[1][1])]
    docs.append((40, " ".join(r.choice(WORDS) for _ in range(1_000_000)) + " " + items[2][1] + " " + " ".join(r.choice(WORDS) for _ in range(100_000))))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans")
    want = bag(map(tuple, decontamination.contamination(frame, bench).select(*columns).collect()))
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(decontamination, "BROADCAST_DOCUMENTS", 0)
    monkeypatch.setattr(decontamination, "BROADCAST_HITS", 0)
    found = decontamination.contamination(frame, bench)
    assert bag(map(tuple, found.select(*columns).collect())) == want
    big = found.where("doc_id = 40").first()
    assert big["n_words"] > 1_100_000 and 20 <= big["n_hit"] < 2000 and not big["contaminated"]
    clean = decontamination.decontaminate(frame, bench)
    assert clean.count() == sum(n for x, n in want.items() if "False" in x)
    assert decontamination.contamination(odd, bench).count() == odd.count()


def test_benchmark_items_without_id(spark, tmp_path):
    import duckdb

    passages = [sentence(900 + i, 20) for i in range(3)]
    spark.createDataFrame([(None, passages[0]), (7, passages[1]), (None, passages[2]), (8, passages[2])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = [passages[0], passages[0] + " x " + passages[1], passages[2], passages[1], passages[0] + " y " + passages[2], "nothing of it", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op7_decontamination(spark, str(tmp_path)).collect()}
    assert [got[i]["n_items"] for i in range(7)] == [1, 2, 2, 1, 2, 0, 0] and [got[i]["contaminated"] for i in range(7)] == [True] * 5 + [False] * 2
    assert got[0]["items_sha256"] == hashlib.sha256(b"").hexdigest() and got[2]["items_sha256"] == hashlib.sha256(b"8").hexdigest()
    base = duckdb.connect()
    for t in ("documents", "benchmark"):
        base.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    cursor = base.execute(queries.ORACLE_SQL["op7_decontamination"])
    names = [c[0] for c in cursor.description]
    assert bag(tuple(r[n] for n in names) for r in got.values()) == bag(cursor.fetchall())


# --- 8 -----------------------------------------------------------------------------------------


def test_token_counts(spark, odd, nothing):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    want = bag((d, len(t.encode()), n := len(tokenizer.encode(t, add_special_tokens=False).ids), n > 20) for d, t in pairs_of(odd))
    for head in (200_000, 20, 0):
        got = token_counts.count_tokens(odd, path, limit=20, head_entries=head).collect()
        assert bag(map(tuple, got)) == want
    assert token_counts.count_tokens(nothing, path).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_pre_tokens_are_the_librarys(text):
    split = token_counts.splitter(public_tokenizers.path("byte_bpe_50k.json"))
    tokens, added = split(text)
    assert sum(split.pieces(tokens)) + added == len(split.tokenizer.encode(text, add_special_tokens=False).ids)


# --- 9 -----------------------------------------------------------------------------------------


def test_language(spark, odd, nothing):
    r = random.Random(6)
    vocabulary = {"en": "the and of with from this that river water".split(), "de": "der und nicht über straße mit für eine schön".split(), "es": "el y los niños está por para agua señor".split()}
    rows = [(i, " ".join(r.choice(vocabulary[x]) for _ in range(30)), x) for i in range(300) for x in [r.choice(list(vocabulary))]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = spark.createDataFrame([*rows[200:], (900, None, "en"), (901, "12 34 !!", "en"), (902, "", "en")], "doc_id long, text string, lang string")
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in language_id.identify(held, frame.where("doc_id < 200"), carry=[F.col("doc_id")]).collect()}
    assert np.mean([got[i][0] == x for i, _, x in rows[200:]]) > 0.97
    assert all(got[i] == ("und", 0.0) for i in (900, 901, 902)) and all(0 <= s <= 1 for _, s in got.values())
    assert language_id.identify(odd, odd, carry=[F.col("doc_id"), F.col("score").alias("given")]).count() == odd.count()
    named = odd.withColumns({"lang_pred": F.lit(1), "_nb_text": F.lit(2)})
    out = language_id.identify(named, odd)
    assert out.count() == odd.count() and out.columns == [c for c in named.columns if c not in ("lang_pred", "score")] + ["lang_pred", "score"]
    assert {x["lang_pred"] for x in language_id.identify(odd, nothing, carry=[F.col("doc_id")]).collect()} == {"und"}
    assert language_id.identify(nothing, odd, carry=[F.col("doc_id")]).count() == 0


def plain_bayes(docs, labelled, bits=16):
    """Language and share of each text, one character at a time."""
    def buckets(text):
        low = [ord(c) if c.isalpha() else 32 for c in text.lower()] + [32, 32, 32]
        for i in range(len(low) - 3):
            h = 0
            for k in range(3):
                h = (h * 0x85EBCA77 * (k > 0) + (low[i + k] + k + 1) * 0x9E3779B1) % 2**32
                yield ((h ^ h >> 15) * 0xC2B2AE3D) % 2**32 >> 32 - bits

    counts, texts = defaultdict(Counter), Counter()
    for text, lang in labelled:
        counts[lang].update(buckets(text))
        texts[lang] += 1
    out = []
    for text in docs:
        if not any(c.isalpha() for c in text):
            out.append(("und", 0.0))
            continue
        sums = {}
        for lang in sorted(counts):
            total = sum(counts[lang].values()) + 0.5 * 2**bits
            sums[lang] = math.log(texts[lang] / sum(texts.values())) + sum(math.log((counts[lang][b] + 0.5) / total) for b in buckets(text))
        best = max(sums, key=sums.get)
        out.append((best, 1 / sum(math.exp(max(x - sums[best], -700)) for x in sums.values())))
    return out


def test_language_against_plain_bayes(spark, nothing):
    r = random.Random(16)
    words = {"en": "the and of with river".split(), "de": "der und über straße mit".split(), "fr": "les dans être garçon où".split()}
    def text(lang, n): return " ".join(r.choice(words[lang]) for _ in range(n))
    labelled = [(text(x, 12), x) for x, n in (("en", 30), ("de", 12), ("fr", 6)) for _ in range(n)]
    docs = [text(x, n) for x in words for n in (1, 2, 5)] + ["und le the", "x", "", "12 !?", "É", "Straße 7\nthe", "de " * 400, "日本 the", "a" * 3]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    train = spark.createDataFrame(labelled, "text string, lang string").repartition(3)
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in language_id.identify(frame, train).collect()}
    for i, (lang, share) in enumerate(plain_bayes(docs, labelled)):
        assert got[i][0] == lang and abs(got[i][1] - share) < 1e-3, docs[i]
    assert language_id.identify(nothing, train).count() == 0
    many = spark.range(300).select(F.lit("x").alias("text"), F.col("id").cast("string").alias("lang"))
    with pytest.raises(ValueError):
        language_id.identify(frame, many)


def test_language_stretches(monkeypatch):
    texts = [sentence(i, 40) for i in range(5)] + ["", "a", "Straße " * 50]
    sums = lambda: [sum(zlib.crc32(np.asarray(index[a:b]).tobytes()) if k == 0 else int(index[a:b].sum()) for k in (1,) for (rows, index, starts, ends) in language_id.sparse_batch([t], 16)[0] for a, b in zip(starts, ends)) for t in texts]
    whole = sums()
    monkeypatch.setattr(language_id, "STRETCH", 7)
    assert sums() == whole


# --- 10 ----------------------------------------------------------------------------------------


def plain_base(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(digits) <= 19 and sum(sum(divmod(d * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aZ09.@+-() 125\n%_é,")), max_size=80))
def test_base_spans(text):
    assert pii.base_spans(text) == plain_base(text)


def test_base_spans_are_linear():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" * 100_000, "a@" * 100_000, "1 " * 100_000, "A1 " * 60_000, "=a" * 100_000):
        pii.spans_of(text, {(0,): 1.0})


def test_pii(spark, odd, nothing):
    texts = odd_texts() + [f'api {i} token = "{hashlib.sha1(str(i).encode()).hexdigest()}" and (212) 555-01{i:02d}' for i in range(30)] + ["plain = value and 12:30 here"] * 10
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in pii.find_pii(frame).collect()}
    for i, t in enumerate(texts):
        base = plain_base(t or "")
        assert tuple(got[i][f"n_{k}"] for k in pii.KINDS[:4]) == tuple(sum(x[1] == k for x in base) for k in range(4))
        assert got[i]["base_sha256"] == hashlib.sha256(pii.listed(base).encode()).hexdigest()
        assert set(filter(None, pii.listed(base).split(","))) <= set(got[i]["spans"].split(","))
    n = len(odd_texts())
    assert "secret:" in got[n]["spans"] and got[len(texts) - 1]["spans"] == ""
    safe = pii.redact(odd)
    assert safe.columns == odd.columns and any("[EMAIL]" in (r["text"] or "") for r in safe.collect()) and safe.where("text is null").count() == 1
    assert pii.find_pii(odd).count() == odd.count() and pii.find_pii(nothing).count() == 0 and pii.redact(nothing).count() == 0


def test_expectation_maximisation_finds_reliable_labelers():
    r = random.Random(9)
    groups = Counter()
    for _ in range(4000):
        y = r.random() < 0.4
        vote = lambda right: (1 if y else -1) if r.random() < right else (-1 if y else 1)
        groups[(int(y),), (vote(0.95), vote(0.9), vote(0.55))] += 1
    p, tables = pii.maximise([(f, v, n) for (f, v), n in sorted(groups.items())])
    right = [tables[j, 1, 2] for j in range(3)]
    assert right[0] > 0.88 and right[1] > 0.82 and right[2] < 0.7
    model = pii.fit([(f, v, n) for (f, v), n in sorted(groups.items())])
    assert model[1,] > 0.8 and model[0,] < 0.2 and not math.isnan(model[1,])


def test_overlapping_candidates_are_all_judged():
    for text, kind, span in (("SSN: 123-45-6789", 6, "123-45-6789"), ("name: Jonathan Miller", 8, "Jonathan Miller"), ("iban=DE89370400440532013000", 7, "DE89370400440532013000")):
        found = {(k, text[a:b]): f for a, k, b, f, _ in pii.candidates(text, [])}
        assert (kind, span) in found and any(k == 4 for k, _ in found)
        model = {f: 0.9 if k == kind else 0.1 for (k, _), f in found.items()}
        a = text.index(span)
        assert pii.spans_of(text, model)[1] == [(a, kind, a + len(span))]
        assert pii.spans_of(text, {f: 0.9 if k == kind else 0.6 for (k, _), f in found.items()})[1] == [(a, kind, a + len(span))]
        # a less probable candidate that is longer is covered too
        assert pii.spans_of(text, {f: 0.6 if k == kind else 0.9 for (k, _), f in found.items()})[1] == [(a, 4, a + len(span))]
    text = "key=10.0.0.1/abcdefgh or +1 (212) 555-0199"
    base = pii.base_spans(text)
    assert len(base) == 2 and [(k, text[a:b]) for a, k, b, *_ in pii.candidates(text, base)] == [(4, "10.0.0.1/abcdefgh")]


def test_announced_spans_are_found(spark):
    texts = [f"SSN: {100 + i}-45-{6000 + i}" for i in range(40)] + [f"iban=DE89370400440532013000 no {i}" for i in range(40)] + [f"see: something{i % 3} there" for i in range(80)]
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(got[i] == "ssn:5:16" for i in range(40)) and all(got[i] == "iban:5:27" for i in range(40, 80)) and not any(got[i] for i in range(80, 160))


def test_candidates_are_whole():
    def found(text, kind):
        return [text[a:b] for a, k, b, *_ in pii.candidates(text, pii.base_spans(text)) if k == kind]

    key = "".join(hashlib.sha1(str(i).encode()).hexdigest() for i in range(23))[:900]
    assert found(f"token = {key} end", 4) == [key]
    assert found(f"Authorization: Bearer eyJ{key[:40]}.x-y", 4) == [f"eyJ{key[:40]}.x-y"] == found(f"send bearer  eyJ{key[:40]}.x-y", 4)
    assert found('curl -H "authorization:bearer abcdefgh12"', 4) == ["abcdefgh12"] and found("forbearer abcdefgh12 Bearer short", 4) == []
    assert found("Jürgen Klein und Lucía García, Élise Noël", 8) == ["Jürgen Klein", "Lucía García", "Élise Noël"]
    assert found("Frau Anna Müller", 8) == ["Frau Anna", "Anna Müller"] and found("Ju\u0308rgen Klein", 8) == ["Ju\u0308rgen Klein"]
    assert found("Hans-Peter Meyer-Schmidt x", 8) == ["Hans-Peter Meyer-Schmidt"] and found("iPhone Anna", 8) == []
    for text in ("DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "DE89\u00a03704\u00a00044\u00a00532\u00a00130\u00a000", "DE89370400440532013000", "NO93 8601 1117 947"):
        assert found(f"IBAN {text} 2024 WORD.", 7) == [text] and found(f"x{text}", 7) == []
    told = {text: f for text in ("mit Lucía García", "mit Ornella García") for *_, f, _ in pii.candidates(text, [])}
    assert [f[6] for f in told.values()] == [1, 0]
    model = {f: 0.9 for *_, f, _ in pii.candidates("Frau Anna Müller", [])}
    assert pii.redacted("Frau Anna Müller!", pii.spans_of("Frau Anna Müller!", model)[1]) == "[NAME]!"


def planted_pii(seed, n):
    """Texts with (start, kind, end) of what was put in, and look-alikes that are none."""
    r = random.Random(seed)
    hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    b64 = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(k))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    first, last = sorted(pii.FIRST_NAMES), "Miller Schmidt Garcia Dubois Klein Weber Moreau Torres Fischer Brown Lefèvre Núñez Großmann".split()
    def iban():
        body = digits(18)
        check = 98 - int(body + "131400") % 97
        text = f"DE{check:02d}{body}"
        return text if r.random() < 0.5 else " ".join(text[i:i + 4] for i in range(0, 22, 4))
    real = {
        4: lambda: (r.choice(["api_key = ", "token: ", "password=", 'secret = "', "Authorization: Bearer ", "access_key="]), r.choice([hexa(40), b64(32) + "1", b64(60) + "7", hexa(r.choice([900, 4000]))])),
        5: lambda: (r.choice(["phone ", "call ", "Tel: ", "", "mobile "]), f"({digits(3)}) {digits(3)}-{digits(4)}"),
        6: lambda: (r.choice(["SSN ", "SSN: ", "social security number "]), f"{digits(3)}-{digits(2)}-{digits(4)}"),
        7: lambda: (r.choice(["IBAN ", "account ", "IBAN: ", ""]), iban()),
        8: lambda: (r.choice(["Herr ", "Mr. ", "Dear ", "by ", "name: ", "Frau ", ""]), f"{r.choice(first)} {r.choice(last)}"),
    }
    decoy = [lambda: f"commit {hexa(40)}", lambda: f"see: something{r.randint(0, 9)}", lambda: f"at 12:{digits(2)}:{digits(2)}", lambda: "Big River", lambda: f"Chapter {r.choice(['Two', 'Three', 'Four'])}", lambda: "New York", lambda: f"part {digits(3)}-{digits(2)}-{digits(3)}", lambda: f"AB12 CDEF {digits(4)} {digits(4)} {digits(3)}", lambda: "value=enabled", lambda: "url=https://example.org/path/to/page", lambda: f"ratio={digits(1)}.{digits(6)}"]
    words = "the small house near a river was painted blue and green before they moved further away".split()
    out = []
    for _ in range(n):
        text, truth = "", []
        for _ in range(r.randint(1, 5)):
            text += " ".join(r.choice(words) for _ in range(r.randint(4, 12))) + " "
            x = r.random()
            if x < 0.4:
                kind = r.choice(list(real))
                lead, value = real[kind]()
                text += lead
                truth.append((len(text), kind, len(text) + len(value)))
                text += value + ('"' if lead.endswith('"') else "") + r.choice([" ", ", ", ". "])
            elif x < 0.8:
                text += r.choice(decoy)() + r.choice([" ", ", "])
        out.append((text, truth))
    return out


def model_of(texts):
    seen = Counter((f, v) for t in texts for *_, f, v in pii.candidates(t, pii.base_spans(t)))
    return pii.fit(sorted((f, v, n) for (f, v), n in seen.items()))


def test_recall_and_precision():
    """Against planted truth: a span is found if it is covered whole."""
    docs = planted_pii(1, 2000)
    model, want, hit, got = model_of([t for t, _ in docs]), Counter(), Counter(), Counter()
    for text, truth in docs:
        base, spans = pii.spans_of(text, model)
        for a, k, b in truth:
            want[k] += 1
            hit[k] += any(x <= a and b <= y for x, _, y in spans)
        for a, k, b in spans:
            if (a, k, b) not in base:
                got[k, any(a < y and b > x for x, _, y in truth)] += 1
    for k in range(4, 9):
        assert want[k] > 200 and hit[k] >= 0.97 * want[k] and got[k, True] >= 0.97 * (got[k, True] + got[k, False]), pii.KINDS[k]


def plain_candidates(text):
    """Every span that a kind's description fits, tried at every position."""
    out = []
    letter = lambda c: unicodedata.category(c) in ("Lu", "Lt", "Ll", "Lm", "Lo", "Mn")
    at = lambda i: text[i] if 0 <= i < len(text) else " "
    free = 0  # the next name begins with the last one's second word at the earliest
    for i in range(len(text)):
        if (m := re.match(r"\([0-9]{3}\)[ -]?[0-9]{3}[ -][0-9]{4}(?![0-9])", text[i:])):
            out.append((i, 5, i + m.end()))
        if (m := re.match(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", text[i:])) and at(i - 1) not in "0123456789-":
            out.append((i, 6, i + m.end()))
        if i >= free and unicodedata.category(text[i]) in ("Lu", "Lt") and not letter(at(i - 1)):
            words = re.match(r"(\S+) (\S+)", text[i:])
            def name(part, least):
                n = 1
                while n < len(part) and unicodedata.category(part[n]) in ("Ll", "Lm", "Lo", "Mn"):
                    n += 1
                return n if part and unicodedata.category(part[0]) in ("Lu", "Lt") and n > least else 0
            def double(part, least):
                n = name(part, least)
                more = name(part[n + 1 :], 1) if n and part[n : n + 1] == "-" else 0
                return n + 1 + more if more else n
            if words and (n := double(words[1], 1)) == len(words[1]):
                # a second part that a letter follows is no part of the name, which may end before it
                ends = [k for k in (double(words[2], 2), name(words[2], 2)) if k and not letter(at(i + n + 1 + k))]
                if ends:
                    out.append((i, 8, i + n + 1 + ends[0]))
                    free = i + n + 1
    return sorted(out)


@settings(max_examples=300, deadline=None)
@example("Anna Anna-AnnaAnna")
@given(st.lists(st.sampled_from(["Anna", "Müller", "Hans-Peter", "X", "von", "É", "Élise", " ", " ", "-", "123-45-6789", "(212) 555-0199", "1", "(", "A\u0308nne", ".", "Jo"]), max_size=14).map("".join))
def test_candidates_against_a_plain_version(text):
    assert [(a, k, b) for a, k, b, *_ in pii.candidates(text, []) if k in (5, 6, 8)] == plain_candidates(text)


def test_spans_against_a_plain_version():
    """Base spans, and accepted candidates with those that touch them merged, character by character."""
    texts = [t for t, _ in planted_pii(3, 300)] + ["SSN: 123-45-6789 token=" + "a1" * 2000, "key=10.0.0.1/abcdefgh", "", "by Anna Maria Weber"]
    model = model_of(texts)
    for text in texts:
        base = plain_base(text)
        judged = [(a, k, b, model[f]) for a, k, b, f, _ in pii.candidates(text, base) if model[f] >= 0.5]
        owner = [0] * (len(text) + 1)
        for a, _, b, _ in judged:
            for i in range(a, b):
                owner[i] |= 1 | 2 * any(x < i < y for x, _, y, _ in judged)  # in a span; not at the first character of all its spans
        want, i = list(base), 0
        while i < len(text):
            if owner[i] and not owner[i] & 2:
                end = i + 1
                while end < len(text) and owner[end] & 2:
                    end += 1
                inside = [(p, b - a, k) for a, k, b, p in judged if i <= a < end]
                want.append((i, max(inside)[2], end))
                i = end
            else:
                i += 1
        assert pii.spans_of(text, model) == (base, sorted(want))
        safe, cover = pii.redacted(text, sorted(want)), [any(a <= i < b for a, _, b in want) for i in range(len(text))]
        left = re.sub("|".join(rf"\[{k.upper()}\]" for k in pii.KINDS), "", safe)
        assert left == "".join(c for c, hidden in zip(text, cover) if not hidden)


def test_candidates_are_linear():
    for text in ("=" + "a" * 400_000, "Bearer " * 60_000, "bearer" * 60_000, "Ab " * 100_000, "Äb-" * 100_000, "DE89 " + "1234 " * 80_000, "AB12 CD34 " * 40_000, ":bearer " * 50_000):
        pii.spans_of(text, {(0,): 1.0})


# --- very long texts ---------------------------------------------------------------------------


def test_very_long_texts(spark, codec):
    """A text of two million characters, and its near copy, go through every operator whole."""
    from tokenizers import Tokenizer

    r = random.Random(17)
    words = [r.choice(WORDS) + str(r.randint(0, 99_999)) for _ in range(200_000)]
    long = " ".join(words) + "\nmail a.b@example.org\nReleased under the MIT License."
    near = " ".join(w if i % 400 else "other" for i, w in enumerate(words))
    docs = [(1, long, "en", "s"), (2, near, "en", "s"), (3, sentence(1, 50), "en", "s")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    assert len(long) > 1_900_000
    got = {x["doc_id"]: x["component_id"] for x in near_duplicates.near_duplicates(frame).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    quality = {x["doc_id"]: x for x in quality_rules.quality_verdicts(frame).collect()}
    assert all(tuple(quality[i][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == plain_quality(t) for i, t, *_ in docs)
    byte = public_tokenizers.path("byte_bpe_50k.json")
    counts = {x["doc_id"]: x["n_tokens"] for x in token_counts.count_tokens(frame, byte).collect()}
    assert counts[1] == len(Tokenizer.from_file(byte).encode(long, add_special_tokens=False).ids)
    encoded = {x["doc_id"]: x for x in sentencepiece_codec.encode_texts(frame, codec.path, [F.col("doc_id")], back="back").collect()}
    assert all(list(encoded[i]["ids"]) == codec.library.encode(t) and encoded[i]["back"] == t for i, t, *_ in docs)
    spans = {x["doc_id"]: x for x in pii.find_pii(frame).collect()}
    at = long.index("a.b@")
    assert spans[1]["n_email"] == 1 and f"email:{at}:{at + 15}" in spans[1]["spans"]
    found = {x["doc_id"]: x["licences"] for x in license_scan.scan_licences(frame.where("doc_id <> 2")).collect()}
    assert "MIT" in found[1] and found[3] == "" and language_id.identify(frame, frame).where("lang_pred = 'en'").count() == 3
    out = scratch(spark, "test-files")
    token_files.write_token_files(frame, out, public_tokenizers.path("word_bpe_49k.json"))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start = 0
    for x in token_files.read_token_files(spark, out).orderBy("doc_id").collect():
        ids = [*library.encode(docs[x["doc_id"] - 1][1], add_special_tokens=False).ids, 1]
        assert (x["start"], x["n_tokens"], x["ids_crc32"]) == (start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        start += len(ids)
    bench = spark.createDataFrame([(7, " ".join(words[1000:1040])), (8, words[5] + " " + words[6])], "item_id long, text string")
    dirty = {x["doc_id"]: x for x in decontamination.contamination(frame, bench).collect()}
    assert [(dirty[i]["n_hit"], dirty[i]["n_items"], dirty[i]["contaminated"]) for i in (1, 2, 3)] == [(42, 2, False), (42, 2, False), (0, 0, False)]
    cut = {x["doc_id"]: x["text"] for x in decontamination.decontaminate(frame, bench, remove="spans").collect()}
    bare = " ".join("" if k in (5, 6) or 1000 <= k < 1040 else w for k, w in enumerate(words))
    assert cut[1] == bare + long[len(" ".join(words)) :] and cut[3] == docs[2][1]


def test_order_of_shards():
    shards = [("shard-100000-b", 5, 1), ("shard-99999-a", 7, 2), ("shard-00002-c", 1, 1)]
    assert token_files.in_order(shards) == [("shard-00002-c", 0, 1, 1), ("shard-99999-a", 1, 7, 2), ("shard-100000-b", 8, 5, 1)]


# --- plumbing ----------------------------------------------------------------------------------


def test_working_tables_go(spark):
    work, other = Work(spark), Work(spark)
    a, b, c = work.cut(spark.range(3).toDF("x"), "a"), work.cut(spark.range(4).toDF("x"), "b"), other.cut(spark.range(5).toDF("x"), "c")
    path = a.inputFiles()[0]
    work.drop(keep=(b,))
    assert b.count() == 4 and c.count() == 5
    with pytest.raises(Exception):
        spark.read.parquet(path).count()
    release(b.join(c, "x"))
    assert not Path(c.inputFiles()[0].removeprefix("file:")).exists()


def left_by(spark, make):
    """Folders that an operator leaves, when its result is there and when it is released."""
    top = Path(scratch(spark, "x")).parent
    before = set(top.iterdir()) if top.exists() else set()
    frame = make()
    frame.count()
    after = set(top.iterdir()) - before
    release(frame)
    return len(after), len(set(top.iterdir()) - before)


def test_operators_clean_up(spark, odd):
    bench = spark.createDataFrame([(1, sentence(1, 60))], "item_id long, text string")
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://b.org/fr/1"), (3, "http://c.com")], "page_id long, url string")
    piece, byte = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
    for make in (
        lambda: near_duplicates.near_duplicates(odd), lambda: near_duplicates.keep_one(odd), lambda: quality_rules.quality_verdicts(odd), lambda: quality_rules.quality_filter(odd),
        lambda: decontamination.contamination(odd, bench), lambda: decontamination.decontaminate(odd, bench), lambda: token_counts.count_tokens(odd, byte),
        lambda: sentencepiece_codec.encode_texts(odd, piece, [F.col("doc_id")], size=100), lambda: url_filters.filter_urls(pages, queries.URL_RULES),
    ):
        there, rest = left_by(spark, make)
        assert there <= 2 and rest == 0
