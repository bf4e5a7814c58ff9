"""DuckDB SQL for the queries that SQL can express: plain comparisons of all windows, runs and spans."""

from __future__ import annotations

from choicemeter.llm import line_runs, phrases, secrets
from choicemeter.llm.decontamination import LOWER, UPPER, WINDOW

WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
bi AS (SELECT item_id, w, least(len(w), {WINDOW}) AS n, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM bi),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM di),
h AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, k)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS s FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw ON d.doc_id = hw.doc_id LEFT JOIN hi ON d.doc_id = hi.doc_id
"""

LINE_RUNS = rf"""
WITH raw AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
marked AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> '' AS solid FROM raw),
l AS (
  SELECT doc_id, line, k, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i,
    sum(length(line)) OVER (PARTITION BY doc_id ORDER BY k) AS upto
  FROM marked WHERE solid),
ahead AS (
  SELECT a.doc_id, a.i AS a, min(b.i) AS b FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.i >= a.i
  AND b.upto - a.upto + length(a.line) >= {line_runs.MIN_CHARS} GROUP BY ALL),
back AS (
  SELECT b.doc_id, max(a.i) AS a, b.i AS b FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.i >= a.i
  AND b.upto - a.upto + length(a.line) >= {line_runs.MIN_CHARS} GROUP BY b.doc_id, b.i),
runs AS (SELECT * FROM ahead UNION SELECT * FROM back),
keys AS (
  SELECT r.doc_id, r.a, r.b, string_agg(l.line, chr(10) ORDER BY l.i) AS k
  FROM runs r JOIN l ON l.doc_id = r.doc_id AND l.i BETWEEN r.a AND r.b GROUP BY r.doc_id, r.a, r.b),
later AS (SELECT doc_id, a, b FROM (SELECT *, row_number() OVER (PARTITION BY k, b - a ORDER BY doc_id, a) AS nth FROM keys) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM later),
state AS (
  SELECT m.doc_id, m.line, m.k, m.solid, g.i IS NOT NULL AS removed
  FROM marked m LEFT JOIN l ON m.doc_id = l.doc_id AND m.k = l.k LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i),
whole AS (
  SELECT doc_id, count(*) FILTER (solid) AS n_lines, count(*) FILTER (removed) AS n_removed,
    CASE WHEN count(*) FILTER (removed) > 0 AND count(*) FILTER (removed) = count(*) FILTER (solid) THEN ''
    ELSE coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT removed), '') END AS kept
  FROM state GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, length(kept)::BIGINT AS kept_chars, sha256(kept) AS kept_sha256 FROM whole
"""


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def found(kind: str) -> str:
    pattern = quoted((secrets.BASE | secrets.WEAK)[kind])
    ok = {
        "assign": f"length(regexp_extract(m[i], {pattern}, 2)) >= 6",
        "access": "length(m[i]) >= 20",
        "opaque": "regexp_matches(m[i], '[A-Z]') AND regexp_matches(m[i], '[a-z]') AND regexp_matches(m[i], '[0-9]')",
    }.get(kind, "true")
    total = lambda part: f"coalesce(list_sum(list_transform({part}, lambda x: length(x))), 0)"
    return f"""
SELECT doc_id, {secrets.KINDS.index(kind)} AS kind, (s)::BIGINT AS a, (s + length(m[i]))::BIGINT AS b FROM (
  SELECT doc_id, m, i, {total("p[1:i]")} + {total("m[1:i - 1]")} AS s FROM (
    SELECT doc_id, m, p, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(coalesce(text, ''), {pattern}) AS m, string_split_regex(coalesce(text, ''), {pattern}) AS p FROM documents)))
WHERE {ok}"""


ROLE = "CASE kind " + " ".join(f"WHEN {i} THEN '{secrets.ROLES[k]}'" for i, k in enumerate(secrets.KINDS)) + " END"
NAME = "CASE kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(secrets.KINDS)) + " END"
NEEDS = " OR ".join(f"(kind = {secrets.KINDS.index(k)} AND " + " AND ".join(f"has_{n}" for n in needs) + ")" for k, needs in secrets.NEEDS.items())

SECRETS = f"""
WITH s AS ({" UNION ALL ".join(map(found, secrets.KINDS))}),
r AS (SELECT *, {ROLE} AS role FROM s),
w AS (
  SELECT x.doc_id, x.kind, x.a, x.b,
    bool_or(y.role = 'identifier' AND NOT (y.a < x.b AND y.b > x.a)) AS has_identifier,
    bool_or(y.role = 'secret' AND NOT (y.a < x.b AND y.b > x.a)) AS has_secret,
    bool_or(y.kind < 3 AND y.a < x.b AND y.b > x.a) AS covered
  FROM r x JOIN r y ON x.doc_id = y.doc_id AND y.a <= x.b + {secrets.SCOPE} AND y.b >= x.a - {secrets.SCOPE}
  WHERE x.kind >= 3 GROUP BY ALL),
o AS (SELECT doc_id, kind, a, b FROM s WHERE kind < 3 UNION ALL SELECT doc_id, kind, a, b FROM w WHERE NOT covered AND ({NEEDS})),
t AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg({NAME} || ':' || a || ':' || b, ',' ORDER BY a, kind) FILTER (kind < 3) AS base,
    string_agg({NAME} || ':' || a || ':' || b, ',' ORDER BY a, kind) AS spans
  FROM o GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id
"""

PHRASES = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, size, unnest(range(1, len(w) - size + 2)) AS i, w FROM w, (SELECT unnest(range(1, {phrases.MOST + 1})) AS size)),
f AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS c FROM g GROUP BY ALL),
n AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, c, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND c >= {phrases.LEAST}),
cut AS (SELECT lang, phrase, c AS a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
s AS (
  SELECT cut.lang, cut.phrase, a, k, l.c AS l, r.c AS r, ((1000000::HUGEINT * a * a) // (l.c::HUGEINT * r.c))::BIGINT AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = x JOIN f r ON r.lang = cut.lang AND r.phrase = y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, w, c, unnest(range(2, size)) AS m, size FROM c),
o AS (SELECT lang, array_to_string(w[j:j + m - 1], ' ') AS phrase, max(c) AS c FROM (SELECT *, unnest(range(1, size - m + 2)) AS j FROM i) GROUP BY ALL),
k AS (SELECT b.* FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.c IS NULL OR 100 * o.c < {phrases.COVER} * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM k JOIN n USING (lang) QUALIFY rank <= {phrases.TOP}
"""

SQL = {"op13_phrases": PHRASES, "op3_decontamination": CONTAMINATION, "op5_secrets": SECRETS, "op6_line_runs": LINE_RUNS}
