"""Personal data by weak supervision (operator 10).

Base spans come from fixed patterns and checks and always stay. Further candidates (assigned secrets,
local phone numbers, social security numbers, IBANs, names) are voted on by labelers: a shape
labeler, a gazetteer labeler, a context labeler and a variety labeler, each for, against or silent.
Expectation-maximisation over the counts of vote patterns in the whole corpus estimates how reliable
each labeler is; the posteriors are the soft labels of a logistic span classifier over discrete span
features, and that classifier decides which candidates become spans. Vote patterns and features have
few values, so all that reaches the driver is one table of counts, of at most MOST_GROUPS rows,
whatever the corpus.

Texts of any length are scanned whole, in time linear in their length. Ties (two accepted candidates
of one probability) go to the longer span, then the later kind. Results in odd cases: a null or empty text has no
spans; repeated rows are judged alike; an empty table gives an empty result; without candidates
there is no classifier and only base spans; extra columns pass through `redact` and are ignored by
`find_pii`; candidates within a base span are dropped. Others may overlap base spans, which stay, and
each other: every one is counted and judged, and accepted ones that overlap become one span over all
of them, of the most probable one's kind.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidy

#: Kinds in the order in which spans of one start are listed; the first four are base kinds.
KINDS = ("email", "ip", "card", "phone", "secret", "local_phone", "ssn", "iban", "name")
#: Most rows of the table of (features, votes) counts.
MOST_GROUPS = 200_000

#: The base patterns. They are written so that no position is tried twice, and find
#: what the plain forms find.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
SPACE = re.compile("[ \u00a0]")


def letters(*categories: str) -> str:
    """The characters of the basic plane of some Unicode categories, as ranges of a pattern's class."""
    out: list[list[int]] = []
    for c in range(0x10000):
        if unicodedata.category(chr(c)) in categories:
            if out and out[-1][1] == c - 1:
                out[-1][1] = c
            else:
                out.append([c, c])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in out)


#: Letters of names; marks are with the small letters, for texts in decomposed form.
CAPITAL, SMALL = letters("Lu", "Lt"), letters("Ll", "Lm", "Lo", "Mn")
#: Candidate patterns, words that announce personal data, and common first names.
#: Secrets and names are read to their end, however long.
SECRET = re.compile(r"[:=Bb](?:(?<=[:=])[ \t]{0,3}[\"']?(?:(?i:bearer)[ \t]{1,3})?|(?<=[Bb])(?<![A-Za-z0-9_][Bb])(?i:earer)[ \t]{1,3})[\"']?([A-Za-z0-9_+/.~-]{8,}+={0,2})")
LOCAL_PHONE = re.compile(r"\([0-9]{3}\)[ -]?[0-9]{3}[ -][0-9]{4}(?![0-9])")
SSN = re.compile(r"[0-9](?<![0-9-][0-9])[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-])")
IBAN = re.compile(r"[A-Z](?<![A-Za-z0-9][A-Z])[A-Z][0-9]{2}(?:[A-Z0-9]{11,30}|(?:[ \u00a0][A-Z0-9]{4}){2,7}(?:[ \u00a0][A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
NAME = re.compile(f"[{CAPITAL}](?<![{CAPITAL}{SMALL}][{CAPITAL}])[{SMALL}]++(?:-[{CAPITAL}][{SMALL}]++)? ([{CAPITAL}][{SMALL}]{{2,}}+(?:-[{CAPITAL}][{SMALL}]++)?)(?![{CAPITAL}{SMALL}])")
ANNOUNCE = {
    "secret": ("token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "api key", "access_key", "private_key", "bearer", "credential"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax", "+1"),
    "ssn": ("ssn", "social security", "tax id"),
    "iban": ("iban", "account", "konto", "cuenta", "compte"),
    "name": ("mr.", "mrs.", "ms.", "dr.", "herr", "frau", "mme", "sr.", "sra.", "name:", "by ", "dear "),
}
FIRST_NAMES = frozenset(
    "Adam Alice Amy Andrea Andrew Anna Anne Anthony Antonio Barbara Ben Carlos Carmen Charles Charlotte Christian Christine Claire Claudia Daniel David "
    "Diego Elena Elizabeth Emily Emma Eva Felix Francisco Frank Friedrich George Hannah Hans Helen Henry Isabel Jack James Jan Jane Javier Jean Jennifer "
    "Jessica Joan Johann John Jonas Jorge Jose Joseph Juan Julia Julie Karen Karl Katharina Kevin Klaus Laura Lena Linda Lisa Louis Lucas Lucia Luis Manuel "
    "Maria Marie Mark Martin Mary Matthew Max Michael Miguel Monika Nicolas Nicole Oliver Pablo Patricia Paul Pedro Peter Philipp Pierre Rachel Richard "
    "Robert Rosa Ruth Sandra Sarah Sofia Sophie Stefan Stephen Susan Sven Thomas Ursula Victor Walter William Wolfgang".split()
)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        if k % 2:
            x = x * 2 - 9 * (x > 4)
        total += x
    return total % 10 == 0


def emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(x := part.lstrip("0")) < 3 or len(x) == 3 and x <= "255" for part in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def iban_holds(text: str) -> bool:
    text = SPACE.sub("", text)
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def ibans(text: str):
    """(start, end). Words after a number in groups of four can look like more groups, so it ends with
    the first group with which the check digits hold, or else with the last."""
    for m in IBAN.finditer(text):
        ends = [m.start() + x.start() for x in SPACE.finditer(m[0])] + [m.end()]
        yield m.start(), next((b for b in ends if b - m.start() >= 15 and iban_holds(text[m.start() : b])), m.end())


def names(text: str):
    """(start, end) of any two words that can be a name; the second of one can be the first of the next."""
    m = NAME.search(text)
    while m:
        yield m.start(), m.end()
        m = NAME.search(text, m.start(1))


def unmarked(word: str) -> str:
    """Without accents, as first names are listed."""
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def candidates(text: str, base: list[tuple[int, int, int]]):
    """(start, kind, end, features, votes) in order, but for those within a base span. They may overlap
    base spans (a long secret can hold what reads like a card number) and each other."""
    found = [(m.start(1), 4, m.end(1)) for m in SECRET.finditer(text)]
    for kind, pattern in ((5, LOCAL_PHONE), (6, SSN)):
        found += [(m.start(), kind, m.end()) for m in pattern.finditer(text)]
    for kind, spans in ((7, ibans(text)), (8, names(text))):
        found += [(a, kind, b) for a, b in spans]
    if not found:
        return
    k = reach = 0  # of the base spans that begin by then, the farthest end
    for start, kind, end in sorted(found):
        while k < len(base) and base[k][0] <= start:
            reach = max(reach, base[k][2])
            k += 1
        if end > reach:
            yield start, kind, end, *described(text, start, kind, end)


def described(text: str, start: int, kind: int, end: int) -> tuple[tuple, tuple]:
    """Discrete features of a candidate, and the labelers' votes."""
    span, left = text[start:end], text[max(0, start - 40) : start]
    if kind == 7:
        span = SPACE.sub("", span)
    size, digits = len(span), sum(c.isdigit() for c in span)
    letters = sum(c.isalpha() for c in span)
    variety = len(set(span))
    quoted = left[-1:] in ("'", '"') and text[end : end + 1] == left[-1:]
    told = any(x in left.lower() for x in ANNOUNCE[KINDS[kind]])
    first = kind == 8 and unmarked(re.split("[ -]", span, maxsplit=1)[0]) in FIRST_NAMES
    shape = 0
    if kind == 4:
        shape = 1 if size >= 20 and digits and letters else -1 if not digits or size < 12 else 0
    elif kind == 7:
        shape = 1 if iban_holds(span) else -1
    elif kind in (5, 6):
        shape = 1
    gazetteer = 1 if told or first else -1 if kind == 8 else 0
    if kind == 4:
        context = 1 if quoted else -1 if left[-3:] in ("://", "p:/") or "://" in span else 0
    else:
        context = -1 if text[end : end + 1].isalnum() else 1 if told else 0
    various = 0 if kind == 8 else 1 if variety >= 10 and digits * 5 >= size else -1 if variety < 6 else 0
    features = (kind, min(size // 8, 5), min(digits * 4 // size, 3), min(variety // 5, 3), int(quoted), int(told), int(first), shape)
    return features, (shape, gazetteer, context, various)


def maximise(groups: list[tuple[tuple, tuple, int]], rounds: int = 50):
    """Posterior of each group, and the labelers' tables P(vote | class), by expectation-maximisation."""
    votes = np.array([v for _, v, _ in groups]) + 1
    weight = np.array([n for *_, n in groups], float)
    p = np.clip(0.5 + 0.2 * (votes - 1).sum(axis=1), 0.05, 0.95)
    tables = None
    for _ in range(rounds):
        prior = (weight @ p + 1) / (weight.sum() + 2)
        tables = np.ones((votes.shape[1], 2, 3))
        for j in range(votes.shape[1]):
            for v in range(3):
                at = votes[:, j] == v
                tables[j, 1, v] += weight[at] @ p[at]
                tables[j, 0, v] += weight[at] @ (1 - p[at])
        tables /= tables.sum(axis=2, keepdims=True)
        log = np.log([1 - prior, prior])[None, :] + sum(np.log(tables[j][:, votes[:, j]]).T for j in range(votes.shape[1]))
        p = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
    return p, tables


def fit(groups: list[tuple[tuple, tuple, int]], steps: int = 300):
    """The span classifier: {feature tuple: probability}, by logistic regression on one-hot features."""
    if not groups:
        return {}
    posterior, _ = maximise(groups)
    names = sorted({(i, x) for f, _, _ in groups for i, x in enumerate(f)})
    at = {x: k for k, x in enumerate(names)}
    x = np.zeros((len(groups), len(names) + 1))
    x[:, -1] = 1
    for row, (f, _, _) in enumerate(groups):
        x[row, [at[i, v] for i, v in enumerate(f)]] = 1
    weight = np.array([n for *_, n in groups], float)
    weight /= weight.sum()
    w = np.zeros(x.shape[1])
    for _ in range(steps):  # damped Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (posterior - p)) - 1e-4 * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += step * min(1.0, 2 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return {f: float(v) for (f, _, _), v in zip(groups, p)}


def train(docs: DataFrame, text_col: str = "text") -> dict:
    """Counts of (features, votes) over every text, and the classifier that they give."""

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                for _, _, _, features, votes in candidates(text, base_spans(text)):
                    seen[features, votes] += 1
        rows = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([list(f) for f, _ in rows], pa.list_(pa.int32())), pa.array([list(v) for _, v in rows], pa.list_(pa.int32())), pa.array([seen[r] for r in rows], pa.int64())], ["features", "votes", "n"])

    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    table = texts.mapInArrow(tidy(count), "features array<int>, votes array<int>, n long").groupBy("features", "votes").agg(F.sum("n").alias("n")).limit(MOST_GROUPS + 1).collect()
    if len(table) > MOST_GROUPS:
        raise ValueError("more groups of features and votes than the features can have")
    return fit(sorted((tuple(r["features"]), tuple(r["votes"]), r["n"]) for r in table))


def merged(accepted: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of accepted (start, kind, end, probability) in order of start: those that
    overlap are one span, of the most probable one's kind (of equal ones the longest, then the later kind)."""
    out: list = []
    for start, kind, end, p in accepted:
        rank = (p, end - start, kind)
        if out and start < out[-1][1]:
            out[-1][1], out[-1][2] = max(out[-1][1], end), max(out[-1][2], rank)
        else:
            out.append([start, end, rank])
    return [(start, rank[2], end) for start, end, rank in out]


def spans_of(text: str, model: dict, least: float = 0.5) -> tuple[list, list]:
    """(base spans, all spans), each a list of (start, kind, end) in order."""
    base = base_spans(text)
    more = merged([(a, k, b, p) for a, k, b, f, _ in candidates(text, base) if (p := model.get(f, 0.0)) >= least]) if model else []
    return base, sorted(base + more) if more else base


def listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_pii(docs: DataFrame, model: dict | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of (id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans)."""
    small_batches(docs.sparkSession)
    model = train(docs, text_col) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches):
        known = shared.value
        for batch in batches:
            counts, sums, every, totals = [[] for _ in range(4)], [], [], []
            for text in batch.column("text").to_pylist():
                own, spans = spans_of(text, known)
                for k in range(4):
                    counts[k].append(sum(x[1] == k for x in own))
                sums.append(hashlib.sha256(listed(own).encode()).hexdigest())
                every.append(listed(spans))
                totals.append(len(spans))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(sums, pa.string()), pa.array(every, pa.string()), pa.array(totals, pa.int64())], [id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    kind = base.schema["id"].dataType.simpleString()
    return base.mapInArrow(tidy(run), f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans are one."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: dict | None = None, text_col: str = "text") -> DataFrame:
    """The documents with their columns; personal data in the text is replaced. A null text stays null."""
    small_batches(docs.sparkSession)
    model = train(docs, text_col) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        known = shared.value
        for batch in batches:
            texts = [None if x is None else redacted(x, spans_of(x, known)[1]) for x in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(tidy(run), docs.schema)
