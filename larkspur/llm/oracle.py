"""DuckDB SQL for those opN queries that SQL can express."""

from __future__ import annotations

from .license_scan import TEMPLATES, prepared
from .quality_rules import METRICS, SIZES, Rules


def quality_sql(rules: Rules = Rules(), documents: str = "documents", final: str | None = None) -> str:
    """op5: counts, sketches, fences and verdicts. `final` replaces the last SELECT (over `judged`)."""
    space = r"[^\x20\x09-\x0D]"
    column = lambda x: x.removeprefix("_")
    value = {m.name: f"{column(m.count)} * 1000 // greatest({column(m.size)}, 1)" for m in METRICS}
    sketched = value | {x: column(x) for x in SIZES}
    at = lambda q: f"min(CASE WHEN run >= (docs * {q} + 3) // 4 THEN lo END) AS q{q}"

    def quartiles(tag: str, *level: str) -> str:
        cols, part = "".join(f"{x}, " for x in level), ", ".join([*level, "what"])
        return f"""
{tag} AS (
  SELECT {cols}what, max(docs) AS docs, {at(1)}, {at(2)}, {at(3)}
  FROM (
    SELECT {cols}what, bucket, sum(n) OVER (PARTITION BY {part} ORDER BY bucket) AS run, sum(n) OVER (PARTITION BY {part}) AS docs,
      CASE WHEN bucket < 64 THEN bucket ELSE (bucket - (bucket // 32 - 1) * 32) << (bucket // 32 - 1) END AS lo
    FROM (SELECT {cols}what, bucket, sum(n)::BIGINT AS n FROM hist GROUP BY ALL)
  ) GROUP BY {part}
)"""

    chosen = lambda q: f"CASE WHEN own.docs >= {rules.least} THEN own.{q} WHEN per_lang.docs >= {rules.least} THEN per_lang.{q} ELSE everything.{q} END"
    pick = lambda what, q, name: f"max(CASE WHEN own.what = '{what}' THEN {chosen(q)} END) AS {name}"
    picked = [x for m in METRICS for x in (pick(m.name, "q1", f"low_{m.name}"), pick(m.name, "q3", f"high_{m.name}"))] + [pick(x, "q2", f"mid_{column(x)}") for x in SIZES]
    inside = []
    for m in METRICS:
        low, high, v = f"low_{m.name}", f"high_{m.name}", f"({value[m.name]})"
        step = lambda size: f"ceil({high} / (2 * sqrt(greatest({size}, 1)::DOUBLE)))::BIGINT" if m.mean else f"ceil(1000 / greatest({size}, 1))::BIGINT"  # noqa: B023, E731
        width = f"{rules.fence} * greatest({high} - {low}, {step(column(m.size))}, {step('mid_' + column(m.size))})"
        inside.append(f"{v} <= {high} + {width}" + (f" AND {v} >= {low} - {width}" if m.low else ""))
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM {documents}),
w AS MATERIALIZED (
  SELECT r, regexp_extract_all(t, '{space}+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{space}')) AS l FROM d
),
win AS (SELECT r, unnest(range(1, len(w) - 6)) AS i, w FROM w WHERE len(w) >= 8),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w[i:i+7]) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM dup) GROUP BY r),
m0 AS (
  SELECT d.r, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines, (length(t) - length(regexp_replace(t, '([!?])[!?]+', '\1', 'g')))::BIGINT AS n_marks,
    len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1]))::BIGINT AS n_same
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r)
),
m AS MATERIALIZED (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.repeat_pct} * n_words AS base_failed FROM m0),
hist AS MATERIALIZED (
  SELECT lang, source, what, CASE WHEN v < 64 THEN v ELSE (length(bin(v)) - 6) * 32 + (v >> (length(bin(v)) - 6)) END AS bucket, count(*) AS n
  FROM ({" UNION ALL ".join(f"SELECT lang, source, '{k}' AS what, {v} AS v FROM m WHERE NOT base_failed" for k, v in sketched.items())}) GROUP BY ALL
),{quartiles("own", "lang", "source")},{quartiles("per_lang", "lang")},{quartiles("everything")},
j AS (
  SELECT own.lang, own.source, {", ".join(picked)}
  FROM own JOIN per_lang ON own.lang IS NOT DISTINCT FROM per_lang.lang AND own.what = per_lang.what JOIN everything ON own.what = everything.what
  GROUP BY own.lang, own.source
),
judged AS (
  SELECT m.*, NOT base_failed AND coalesce({" AND ".join(inside)}, true) AS kept
  FROM m LEFT JOIN j ON m.lang IS NOT DISTINCT FROM j.lang AND m.source IS NOT DISTINCT FROM j.source
)
{final or "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"}
"""


def contamination_sql(size: int = 13, min_share: int = 20) -> str:
    """op7."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({lower}, '{word}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({lower}, '{word}') AS w FROM benchmark),
win AS MATERIALIZED (SELECT DISTINCT item_id, w[i:i+{size - 1}] AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {size - 2}, 2))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) AS k FROM win),
pos AS (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k),
hit AS MATERIALIZED (SELECT r, i, k, item_id FROM (SELECT r, i, k, w[i:i+k-1] AS g FROM pos) JOIN win USING (g)),
words AS (SELECT r, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND {min_share} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


def near_duplicates_sql(documents: str = "documents", final: str | None = None) -> str:
    """op2. `final` replaces the last SELECT (over `groups`)."""
    return rf"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {documents}
),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, w[i:i+4] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*)::BIGINT AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
groups AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
{final or "SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN sizes USING (doc_id) JOIN groups USING (doc_id)"}
"""


def licence_sql(percent: int = 80) -> str:
    """op3: distinct sets of lines and of the whole text, then runs of lines for templates without a match."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({k}, {quoted(name)}, [{', '.join(map(quoted, found))}], {-(-percent * (low + len(found)) // 200)}, {2 * high})" for k, (name, found, low, high) in enumerate(prepared(TEMPLATES, percent)))
    every = sorted({g for _, found, _, _ in prepared(TEMPLATES, percent) for g in found})
    dice = "2.0 * len(list_intersect(g, bigrams)) / (len(g) + len(bigrams))"
    fits = f"200 * len(list_intersect(g, bigrams)) >= {percent} * (len(g) + len(bigrams))"
    return rf"""
WITH t(k, name, bigrams, need, most) AS (VALUES {rows}),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
seg AS (SELECT DISTINCT r, unnest(list_append(string_split(x, chr(10)), x)) AS s FROM d),
w AS (SELECT r, regexp_extract_all(s, '[a-z0-9]+') AS w FROM seg),
b AS (SELECT DISTINCT r, list_sort(list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) AS g FROM w WHERE len(w) > 1),
hit AS MATERIALIZED (SELECT r, k, name, {dice} AS dice FROM b, t WHERE {fits}),
whole AS MATERIALIZED (SELECT r, x, w, list_intersect(list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]), [{', '.join(map(quoted, every))}]) AS here FROM (SELECT r, x, regexp_extract_all(x, '[a-z0-9]+') AS w FROM d WHERE contains(x, chr(10)))),
tried AS MATERIALIZED (SELECT r, k, name, bigrams, most FROM whole, t WHERE need > 0 AND len(here) >= need AND len(list_intersect(here, bigrams)) >= need AND NOT EXISTS (SELECT 1 FROM hit WHERE hit.r = whole.r AND hit.k = t.k)),
lines AS (SELECT r, unnest(range(1, len(l) + 1)) AS n, len(regexp_extract_all(unnest(l), '[a-z0-9]+')) AS c FROM (SELECT r, string_split(x, chr(10)) AS l FROM whole WHERE r IN (SELECT r FROM tried))),
ends AS MATERIALIZED (SELECT r, n, c, sum(c) OVER (PARTITION BY r ORDER BY n)::BIGINT AS e FROM lines),
runs AS (SELECT DISTINCT tried.r, k, name, bigrams, a.e - a.c + 1 AS i, z.e AS j FROM tried JOIN ends a ON a.r = tried.r AND a.c > 0 JOIN ends z ON z.r = a.r AND z.c > 0 AND z.n >= a.n AND z.e - (a.e - a.c) <= most),
best AS (SELECT r, k, name, max({dice}) AS dice FROM (SELECT r, k, name, bigrams, list_distinct([w[p] || ' ' || w[p + 1] for p in range(i, j)]) AS g FROM runs JOIN whole USING (r)) WHERE {fits} GROUP BY ALL),
per AS (SELECT r, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS licences, max(dice) AS best FROM (SELECT * FROM hit UNION ALL SELECT * FROM best) GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_matches, coalesce(licences, '') AS licences, round(coalesce(best, 0)::DOUBLE, 6) AS best_dice FROM d LEFT JOIN per USING (r)
"""


def repeats_sql(length: int = 35) -> str:
    """op11."""
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS MATERIALIZED (SELECT r, i, md5(array_to_string(w[i:i+{length - 1}], ' ')) AS g FROM (SELECT r, w, unnest(range(1, len(w) - {length - 2})) AS i FROM d WHERE len(w) >= {length})),
rep AS (SELECT r, i FROM win JOIN (SELECT g FROM win GROUP BY g HAVING count(*) > 1) USING (g)),
gone AS MATERIALIZED (SELECT DISTINCT r, unnest(range(i, i + {length})) AS p FROM rep),
word AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""


def audit_sql() -> str:
    """op12, document by document: every step of every order looks at the flags of each."""
    letters = "['A', 'B', 'C', 'D', 'E']"
    return rf"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS MATERIALIZED (
  SELECT part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t), regexp_matches(t, '[#$%&*|]'),
      coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails,
    coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL), false) AS good, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL), false) AS toxic
  FROM d
),
l AS (SELECT unnest({letters}) AS x),
orders AS (SELECT a.x || b.x || c.x || e.x || g.x AS o FROM l a, l b, l c, l e, l g WHERE len(list_distinct([a.x, b.x, c.x, e.x, g.x])) = 5),
steps AS (SELECT o, k::INT AS step, o[k] AS x, ascii(o[k]) - 64 AS own, [ascii(y) - 64 for y in string_split(o[:k - 1], '')] AS earlier FROM (SELECT o, unnest(range(1, 6)) AS k FROM orders)),
hit AS (SELECT part, o, step, x, fails[own] AS failing, len(list_filter(earlier, lambda j: fails[j])) > 0 AS gone, len(list_filter(fails, lambda y: y)) AS failed, good, toxic FROM f, steps),
per AS (
  SELECT part, o AS filter_order, step, x, count(*) FILTER (NOT gone AND NOT failing) AS kept, count(*) FILTER (NOT gone AND failing) AS removed, count(*) FILTER (gone AND failing) AS redundant,
    count(*) FILTER (failing AND failed = 1) AS unique_fails, count(*) FILTER (NOT gone AND failing AND good) AS good_lost, count(*) FILTER (NOT gone AND failing AND toxic) AS toxic_lost
  FROM hit GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM per
"""
