"""DuckDB texts of the queries that SQL can express, written independently of the operators."""

from __future__ import annotations

from .license_texts import KNOWN_TEXTS

WORD_GAP = r"[\x20\x09-\x0D]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def url_rules(block: list[str], allow: list[str]) -> str:
    rows = ", ".join(f"({_quoted(r)}, {_quoted(r[: r.index('/')])}, {_quoted(r[r.index('/') :])}, {_quoted(a)})" for a, rs in (("block", block), ("allow", allow)) for r in rs)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH rules(rule, rhost, rpath, action) AS (VALUES {rows}),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, {lower.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
ranked AS (SELECT p.page_id, p.host, p.path, r.rule, r.action,
  row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.rule) DESC NULLS LAST) AS rn
  FROM parts p LEFT JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM ranked WHERE rn = 1"""


def _canonical(expr: str) -> str:
    out = f"regexp_replace(translate({expr}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?m)^[^a-z0-9\\n]*(?:copyright\\b(?:[^\\n]*(?:\\(c\\)|©|[0-9]{{4}}))|\\(c\\)|©|all rights reserved)[^\\n]*$', ' ', 'g')"
    out = f"regexp_replace({out}, '[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+', ' ', 'g')"
    for a, b in (
        (r"licence(s|d)?\b", r"license\1"),
        (r"\bsub license\b", "sublicense"),
        (r"\bnon infringement\b", "noninfringement"),
        (r"\bnon commercial\b", "noncommercial"),
        (r"\bper cent\b", "percent"),
        (r"\backnowledgement\b", "acknowledgment"),
        (r"\bfavour\b", "favor"),
        (r"\bhttps\b", "http"),
    ):
        out = f"regexp_replace({out}, '{a}', '{b}', 'g')"
    return f"trim({out})"


def license_scan() -> str:
    rows = ", ".join(f"({i}, {_quoted(n)}, {_quoted(b)})" for i, (n, b) in enumerate(KNOWN_TEXTS))
    return f"""
WITH texts(rank, license_id, body) AS (VALUES {rows}),
known AS (SELECT sha256({_canonical("body")}) AS digest, arg_min(license_id, rank) AS license_id FROM texts GROUP BY 1),
whole AS (SELECT doc_id, coalesce(text, '') AS t, sha256({_canonical("coalesce(text, '')")}) AS digest FROM documents),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
found AS (SELECT doc_id, list_sort(list(DISTINCT license_id)) AS notice_ids
  FROM (SELECT doc_id, sha256({_canonical("line")}) AS digest FROM lines) JOIN known USING (digest) GROUP BY doc_id)
SELECT w.doc_id, w.digest, k.license_id, coalesce(f.notice_ids, CAST([] AS VARCHAR[])) AS notice_ids
FROM whole w LEFT JOIN known k ON w.digest = k.digest LEFT JOIN found f ON f.doc_id = w.doc_id"""


def line_frequency() -> str:
    norm = f"trim(regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD_GAP}', ' ', 'g'), '[0-9]+', '0', 'g'))"
    split = f"list_filter(string_split_regex(%s, '{WORD_GAP}'), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, host, t, {split % "t"} AS ws FROM d),
toks AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
tri AS (SELECT doc_id, pos, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM toks WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
rep AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri WHERE c IS NOT NULL),
cov AS (SELECT doc_id, count(DISTINCT pos + k) AS n_repeat_words FROM rep, (VALUES (0), (1), (2)) AS s(k) WHERE n > 1 GROUP BY doc_id),
ls AS (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS line FROM d),
lw AS (SELECT doc_id, host, line, {norm} AS norm, len({split % "line"}) AS nw FROM ls WHERE len({split % "line"}) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lw GROUP BY doc_id),
sizes AS (SELECT host, count(DISTINCT doc_id) AS docs FROM d GROUP BY host),
freq AS (SELECT l.host, norm FROM lw l JOIN sizes s ON l.host = s.host GROUP BY l.host, norm, docs HAVING count(DISTINCT doc_id) > 20 AND count(DISTINCT doc_id) > docs * 0.01),
gone AS (SELECT doc_id, sum(nw) AS n FROM lw JOIN freq ON lw.host = freq.host AND lw.norm = freq.norm GROUP BY doc_id),
f AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{WORD_GAP}', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, coalesce(dup.n_dup_lines, 0) AS n_dup_lines,
  coalesce(cov.n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_frequent_words
  FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_frequent_words >= n_words * 0.5) AS kept, n_frequent_words
FROM f"""


def hard_negatives() -> str:
    return """
WITH u AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor, r.id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score FROM u a JOIN u r ON a.id % 50 = 0 AND a.id <> r.id),
p AS (SELECT anchor, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor, p.id AS positive, s.id AS negative, p.score AS ps, s.score AS ns, row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) AS nth
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor AS anchor_id, positive AS positive_id, CAST(nth AS INTEGER) AS rank, negative AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE nth <= 3"""


def prefix_trie() -> str:
    step = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda c, i: {step})), 4294967295)"
    return f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS i FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, CAST({crc} AS BIGINT) % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
b AS (SELECT c.conv_id, 0 AS own, o.i, role, text FROM c JOIN o ON o.conv_id = c.base AND o.i <= c.h UNION ALL SELECT c.conv_id, 1, o.i, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND o.i > c.h),
r AS (SELECT conv_id, row_number() OVER w AS depth, length(text) AS n, string_agg(md5(length(role) || ':' || role || text), '') OVER w AS path FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY own, i ROWS UNBOUNDED PRECEDING)),
m AS (SELECT conv_id, depth, n, md5(path) AS node, coalesce(lag(md5(path)) OVER (PARTITION BY conv_id ORDER BY depth), '') AS up FROM r UNION ALL SELECT conv_id, 0, 0, '', NULL FROM c),
e AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM m),
v AS (SELECT node, depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n) AS saved, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM e GROUP BY node, depth),
k AS (SELECT up, depth - 1 AS depth, count(*) AS n FROM v WHERE depth > 0 GROUP BY ALL),
f AS (SELECT v.*, p.conv_id AS parent, coalesce(k.n, 0) AS n_children FROM v LEFT JOIN v p ON p.node = v.up AND p.depth = v.depth - 1 LEFT JOIN k ON k.up = v.node AND k.depth = v.depth),
a AS (SELECT DISTINCT x.node, x.depth, y.node AS below, y.depth AS below_depth FROM e x JOIN e y ON x.conv_id = y.conv_id AND x.depth <= y.depth),
s AS (SELECT a.node, a.depth, sum(f.saved) AS saved, count(*) FILTER (WHERE f.n_children = 0) AS leaves FROM a JOIN f ON f.node = a.below AND f.depth = a.below_depth GROUP BY a.node, a.depth)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, parent AS parent_conv_id, n_convs, n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, ends_sha256 FROM f JOIN s ON s.node = f.node AND s.depth = f.depth"""


def source_mix(seed: int = 13) -> str:
    split = f"len(list_filter(string_split_regex(coalesce(text, ''), '{WORD_GAP}'), lambda x: x <> ''))"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST({split} AS BIGINT) AS size, md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS draw FROM documents),
src AS (SELECT source, sum(size) AS n, 3 * sum(size) AS cap, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2 ELSE 1 END AS w FROM d GROUP BY source),
pass AS (SELECT 0 AS i, CAST(sum(n) AS DOUBLE) / sum(w) AS lam, CAST(sum(n) AS DOUBLE) AS whole FROM src
  UNION ALL SELECT any_value(i) + 1, any_value(whole - coalesce(stopped, 0)) / sum(w), any_value(whole) FROM (SELECT pass.*, src.*, sum(CASE WHEN cap <= lam * w THEN cap END) OVER () AS stopped FROM pass, src WHERE i < 30) WHERE cap > lam * w HAVING count(*) > 0),
lev AS (SELECT max(lam) AS lam FROM pass),
tg AS (SELECT source, CAST(n AS BIGINT) AS n, CASE WHEN cap <= lam * w THEN CAST(cap AS DOUBLE) ELSE w * lam END AS target FROM src, lev),
x AS (SELECT d.doc_id, d.size, tg.n, target, CAST(round(target) AS BIGINT) AS budget, sum(d.size) OVER (PARTITION BY d.source ORDER BY draw, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size AS before FROM d JOIN tg ON d.source IS NOT DISTINCT FROM tg.source)
SELECT doc_id, size, n AS source_size, target, CAST(CASE WHEN n = 0 THEN 0 ELSE budget // n * size + greatest(0, least(size, budget % n - before)) END AS BIGINT) AS taken FROM x"""
