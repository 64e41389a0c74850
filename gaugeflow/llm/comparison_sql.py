"""SQL that the registered queries are compared with, where SQL can express them."""

from __future__ import annotations

from gaugeflow.llm.common import LOWER, UPPER
from gaugeflow.llm.pii import iban_pattern

LOW = f"translate({{}}, '{UPPER}', '{LOWER}')"

# Personal data: the plain patterns, with positions from what lies between the matches.
_LUHN = """(list_sum(list_transform(string_split(reverse(digits), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT
  WHEN c::INT > 4 THEN c::INT * 2 - 9 ELSE c::INT * 2 END)) % 10 = 0 AND length(digits) BETWEEN 12 AND 19)"""
_OCTETS = "list_bool_and(list_transform(string_split(x, '.'), lambda p: regexp_matches(p, '^0*([0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$')))"
_MOD97 = """(list_reduce(list_concat([0], list_transform(string_split(substr(replace(x, ' ', ''), 5) || substr(replace(x, ' ', ''), 1, 4), ''),
  lambda c: CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END)),
  lambda a, c: (CASE WHEN c > 9 THEN a * 100 + c ELSE a * 10 + c END) % 97) = 1)"""
_GROUP = "[0-9A-Fa-f]{1,4}"
_IPV6 = f"""(regexp_matches(x, '[0-9]') AND (regexp_matches(x, '^({_GROUP}:){{7}}{_GROUP}$')
  OR (regexp_matches(x, '^({_GROUP}(:{_GROUP})*)?::({_GROUP}(:{_GROUP})*)?$') AND length(x) - length(replace(x, ':', '')) BETWEEN 3 AND 7)))"""
_KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true", 90, "mail|contact|write", 10, 0),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", _OCTETS, 60, "ip|address|host|server", 30, 0),
    ("card", r"[0-9]([\x20-]?[0-9])+", _LUHN, 80, "card|visa|credit|payment", 20, 0),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(digits) BETWEEN 9 AND 15", 70, "phone|call|tel|mobile", 30, 0),
    ("iban", iban_pattern(), _MOD97, 90, "iban|account|bank", 10, 50),
    ("ssn", r"[0-9]+-[0-9]+-[0-9]+", "regexp_matches(x, '^[0-9]{3}-[0-9]{2}-[0-9]{4}$')", 30, "ssn|social security|taxpayer", 60, 50),
    ("ipv6", r"[0-9A-Fa-f]*:[0-9A-Fa-f:]{3,}", _IPV6, 60, "ip|address|host|server", 30, 50),
    ("key", r"A[KS]IA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36}|xox[abp]-[0-9]+-[A-Za-z0-9-]{10,}", "true", 90, "key|token|secret", 10, 50),
    ("secret", r"[A-Za-z0-9_-]{32,}", "regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Za-z]')", 30,
     "token|secret|password|passwd|apikey|key|credential|credentials", 60, 50),
]


def _kind_sql(i: int, name: str, pattern: str, valid: str, score: int, words: str, bonus: int, least: int) -> str:
    around = LOW.format("substr(t, greatest(s - 40, 0)::BIGINT + 1, (s - greatest(s - 40, 0))::BIGINT) || ' ' || substr(t, s + length(x) + 1, 40)")
    return f"""SELECT * FROM (SELECT doc_id, s, {i} AS k, s + length(x) AS e, '{name}' AS kind,
      {score} + CASE WHEN regexp_matches({around}, '(^|[^a-z0-9])({words})([^a-z0-9]|$)') THEN {bonus} ELSE 0 END AS score
    FROM (SELECT doc_id, t, p.s::BIGINT AS s, p.x AS x, regexp_replace(p.x, '[^0-9]', '', 'g') AS digits
      FROM (SELECT doc_id, t, unnest(list_transform(m, lambda x, i: {{'x': x, 's': list_sum(list_transform(list_slice(g, 1, i), lambda y: length(y)))
          + coalesce(list_sum(list_transform(list_slice(m, 1, i - 1), lambda y: length(y))), 0)}})) AS p
        FROM (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM d WHERE regexp_matches(t, '{pattern}'))))
    WHERE {valid}) WHERE score >= {least}"""


PII = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(_kind_sql(i, *kind) for i, kind in enumerate(_KINDS))})
SELECT d.doc_id, {", ".join(f"count(*) FILTER (k = {i}) AS n_{_KINDS[i][0]}" for i in range(4))},
  sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) FILTER (k < 4), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e), '') AS spans,
  coalesce(string_agg(score::VARCHAR, ',' ORDER BY s, k, e), '') AS scores
FROM d LEFT JOIN found USING (doc_id) GROUP BY d.doc_id"""

_HOST = LOW.format("regexp_extract(rest, '^([^/?#]*)', 1)")
URLS = f"""WITH r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, {_HOST} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
j AS (SELECT s.*, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST) AS n
  FROM s LEFT JOIN r ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM j WHERE n = 1"""

TOPK = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
t AS (SELECT vec_id, unnest(v) AS w, generate_subscripts(v, 1) AS d FROM e),
s AS (SELECT q.vec_id AS query_id, c.vec_id, sum(q.w * c.w)::BIGINT AS score FROM t q JOIN t c ON q.d = c.d AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0 GROUP BY 1, 2)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 5"""

_WORDS = "regexp_extract_all(" + LOW.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
LEAKS = f"""WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 9), ' ') AS x, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
place AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
hit AS (SELECT doc_id, i, n, item_id FROM (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS x FROM place) JOIN win USING (n, x)),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)"""

LINES = r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS no FROM documents),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS at FROM l WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]')),
w AS (SELECT a.doc_id, a.at, a.no AS n1, b.no AS n2, row_number() OVER (PARTITION BY a.line, b.line ORDER BY a.doc_id, a.at) AS copy
  FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.at = a.at + 1),
gone AS (SELECT doc_id, n1 AS no FROM w WHERE copy > 1 UNION SELECT doc_id, n2 FROM w WHERE copy > 1),
j AS (SELECT l.*, gone.no AS g FROM l LEFT JOIN gone USING (doc_id, no))
SELECT d.doc_id, CASE WHEN max(d.text) IS NULL THEN 0 ELSE count(*) END AS n_lines, count(g) AS n_removed,
  coalesce(string_agg(g::VARCHAR, ',' ORDER BY g), '') AS removed_lines,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY j.no) FILTER (g IS NULL), '')) AS text_sha256
FROM documents d JOIN j USING (doc_id) GROUP BY d.doc_id"""

_TOKENS = "regexp_extract_all(" + LOW.format("coalesce(text, '')") + r", '[^\x20\x09-\x0D]+')"
JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = d.doc_id GROUP BY d.doc_id"""


# Similar vectors: every pair's cosine, and what links reach.
VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda c: c::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda c: c IS NOT NULL AND isfinite(c))) AND list_bool_or(list_transform(embedding, lambda c: c <> 0))),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other),
groups AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
counts AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN groups USING (vec_id) LEFT JOIN counts USING (vec_id)
"""

# Word use of sources: every kept term in every group, in whole numbers.
SOURCES = f"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {LOW.format("coalesce(text, '')")} AS text FROM documents),
words AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS lang_total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
used AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM groups g LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source GROUP BY g.lang, g.source),
shares AS (SELECT t.lang, t.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (total + 2 * v) AS p,
    1 + (1000000000::HUGEINT * (lang_n + 2)) // (lang_total + 2 * v) AS q
  FROM totals t JOIN langs USING (lang) JOIN kept k USING (lang) LEFT JOIN used u ON u.lang = t.lang AND u.source = t.source AND u.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS place FROM rows)
SELECT lang, source, part, item, value::BIGINT AS value, place::INT AS rank FROM ranked WHERE part = 'pair' OR place <= 10
"""

# Spelling variants: words that are the same after one letter is taken out or left open.
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"
SPELLING = f"""
WITH RECURSIVE crc AS (SELECT {_CRC_TABLE} AS t),
runs AS (SELECT doc_id, {LOW.format("unnest(regexp_extract_all(text, '[A-Za-z\\x{00C0}-\\x{00FF}]+'))")} AS run FROM documents WHERE text IS NOT NULL),
own AS (SELECT doc_id, run, count(*) AS n, hex(encode(doc_id || ':' || run)) AS h FROM runs GROUP BY doc_id, run),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295::BIGINT) AS crc FROM own, crc),
cut AS (SELECT CASE WHEN crc % 31 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
gaps AS (SELECT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS short, i FROM places),
links AS (SELECT a.word, b.word AS other, b.n AS other_n FROM gaps a JOIN gaps b ON a.short = b.short AND a.i = b.i AND a.word <> b.word
  UNION SELECT g.word, w.word, w.n FROM gaps g JOIN words w ON g.short = w.word
  UNION SELECT w.word, g.word, g.n FROM gaps g JOIN words w ON g.short = w.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS best, max(other_n) AS best_n FROM links GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word),
steps AS (SELECT word, word AS root FROM words UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON f.word = s.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, s.root, f.n, f.n_near, f.form_n::BIGINT AS form_n FROM forms f JOIN steps s ON s.word = f.word JOIN forms l ON l.word = s.root WHERE l.form IS NULL
"""
