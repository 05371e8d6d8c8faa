"""The same results in DuckDB SQL, for the operators that SQL can express."""

from __future__ import annotations


def _words(column: str) -> str:
    return rf"regexp_extract_all({column}, '[^\x20\x09-\x0D]+')"


_FOLDED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATE = rf"""
WITH d AS (SELECT doc_id, unnest(l) w, generate_subscripts(l, 1) p FROM (
       SELECT doc_id, {_words("regexp_replace(" + _FOLDED.format("text") + r", '[!-/:-@\[-`{-~]', '', 'g')")} l FROM documents)),
b AS (SELECT item_id, unnest(l) w, generate_subscripts(l, 1) p, len(l) n FROM (
       SELECT item_id, {_words("regexp_replace(" + _FOLDED.format("text") + r", '[!-/:-@\[-`{-~]', '', 'g')")} l FROM benchmark)),
m AS (SELECT d.doc_id, b.item_id, d.p - b.p AS shift, d.p, least(b.n, 10) AS need, CASE WHEN b.n >= 10 THEN 13 ELSE b.n END AS span
      FROM d JOIN b ON d.w = b.w WHERE b.n >= 6),
few AS (SELECT doc_id, item_id, shift FROM m GROUP BY ALL HAVING count(*) >= 6),
o AS (SELECT doc_id, item_id, p, lead(p, need - 1) OVER (PARTITION BY doc_id, item_id, shift ORDER BY p) AS q, span
      FROM m JOIN few USING (doc_id, item_id, shift)),
hit AS (SELECT doc_id, item_id, p, q FROM o WHERE q - p < span),
covered AS (SELECT doc_id, count(DISTINCT x) n FROM (SELECT doc_id, unnest(range(p, q + 1)) x FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) items
          FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, f.n IS NOT NULL AS contaminated, coalesce(f.n, 0) AS n_items, coalesce(f.items, '') AS items,
       coalesce(c.n, 0) AS n_words_hit
FROM documents d LEFT JOIN found f USING (doc_id) LEFT JOIN covered c USING (doc_id)
"""

LM_SCORE = rf"""
WITH w AS (SELECT doc_id, unnest(l) w, generate_subscripts(l, 1) p FROM (
       SELECT doc_id, {_words(_FOLDED.format("text"))} l FROM documents)),
u AS (SELECT w, count(*) c FROM w GROUP BY w), t AS (SELECT count(*) AS n FROM w),
b AS (SELECT a.doc_id, a.w AS v, b.w AS w, count(*) n FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.p = a.p + 1 GROUP BY ALL),
c AS (SELECT v, w, sum(n) c FROM b GROUP BY v, w),
s AS (SELECT b.doc_id, b.n, c.c - b.n AS others, CASE WHEN c.c > b.n THEN floor(ln((c.c - b.n) / uv.c) * 1e6 + 0.5)
             ELSE floor(ln(0.4::DOUBLE * uw.c / t.n) * 1e6 + 0.5) END AS micro
      FROM b JOIN c USING (v, w) JOIN u uv ON uv.w = b.v JOIN u uw ON uw.w = b.w CROSS JOIN t),
f AS (SELECT w.doc_id, floor(ln(u.c / t.n) * 1e6 + 0.5) AS micro FROM w JOIN u USING (w) CROSS JOIN t WHERE p = 1),
x AS (SELECT doc_id, sum(n * micro) AS micro, sum(CASE WHEN others <= 0 THEN n ELSE 0 END) AS n_backoff FROM s GROUP BY doc_id),
k AS (SELECT doc_id, count(*) n FROM w GROUP BY doc_id)
SELECT d.doc_id, coalesce(k.n, 0) AS n_words, CAST(coalesce(x.n_backoff, 0) AS BIGINT) AS n_backoff,
       CAST((coalesce(x.micro, 0) + coalesce(f.micro, 0)) / 1e6 AS DOUBLE) AS log_score,
       CAST((coalesce(x.micro, 0) + coalesce(f.micro, 0)) / 1e6 / k.n AS DOUBLE) AS mean_log_score
FROM documents d LEFT JOIN k USING (doc_id) LEFT JOIN x USING (doc_id) LEFT JOIN f USING (doc_id)
"""

CHAT_FORMAT = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
s AS (SELECT *, coalesce(lag(role) OVER w, chr(1)) <> role AS begins, coalesce(lead(role) OVER w, chr(1)) <> role AS ends,
             replace(replace(replace(text, '\', '\b'), '<', '\l'), '>', '\g') AS e,
             replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g') AS r
      FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum(CASE WHEN begins THEN 7 + length(r) ELSE 6 END + length(e) + CASE WHEN ends THEN 8 ELSE 0 END) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
QUALITY_RULES = rf"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {_words("coalesce(text, '')")} AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: translate(x, {_BLANKS}, '') <> '') AS l FROM t),
g AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (
      SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM g) WHERE k > 1) GROUP BY doc_id),
m AS (SELECT t.doc_id, lang, source, len(w) AS n_words, length(translate(text, {_BLANKS}, '')) AS word_chars,
             length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
             coalesce(r.n, 0) AS n_repeat_words, len(l) AS n_lines FROM t JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
s AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             CASE WHEN word_chars > 0 THEN (10000 * n_symbols) // word_chars ELSE 0 END AS symbol_share,
             CASE WHEN n_lines > 0 THEN (10000 * n_dup_lines) // n_lines ELSE 0 END AS dup_line_share,
             CASE WHEN n_words > 0 THEN (10000 * n_repeat_words) // n_words ELSE 0 END AS repeat_share FROM m),
u AS (SELECT doc_id, lang, source, unnest([{{'rule': 'symbol_share', 'v': symbol_share, 'least': 800}}, {{'rule': 'dup_line_share', 'v': dup_line_share, 'least': 2000}},
             {{'rule': 'repeat_share', 'v': repeat_share, 'least': 2500}}]) AS x FROM s WHERE NOT base_failed),
b AS (SELECT lang, source, x.rule AS rule, x.least AS least, (x.v >> greatest(length(bin(x.v)) - 6, 0)) << greatest(length(bin(x.v)) - 6, 0) AS b FROM u),
own AS (SELECT lang, source, rule, least, count(*) n, quantile_disc(b, 0.25) q1, quantile_disc(b, 0.75) q3 FROM b GROUP BY ALL),
bylang AS (SELECT lang, rule, count(*) n, quantile_disc(b, 0.25) q1, quantile_disc(b, 0.75) q3 FROM b GROUP BY ALL),
every AS (SELECT rule, quantile_disc(b, 0.25) q1, quantile_disc(b, 0.75) q3 FROM b GROUP BY ALL),
f AS (SELECT o.lang, o.source, o.rule, o.least, CASE WHEN o.n >= 100 THEN o.q1 WHEN p.n >= 100 THEN p.q1 ELSE e.q1 END AS q1,
             CASE WHEN o.n >= 100 THEN o.q3 WHEN p.n >= 100 THEN p.q3 ELSE e.q3 END AS q3
      FROM own o JOIN bylang p ON p.lang IS NOT DISTINCT FROM o.lang AND p.rule = o.rule JOIN every e ON e.rule = o.rule),
x AS (SELECT doc_id, string_agg(u.x.rule, ',' ORDER BY list_position(['symbol_share', 'dup_line_share', 'repeat_share'], u.x.rule)) AS failed
      FROM u JOIN f ON f.lang IS NOT DISTINCT FROM u.lang AND f.source IS NOT DISTINCT FROM u.source AND f.rule = u.x.rule
      WHERE u.x.v > f.q3 + greatest(6 * (f.q3 - f.q1), f.least) GROUP BY doc_id)
SELECT s.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND x.failed IS NULL AS kept, coalesce(x.failed, '') AS failed
FROM s LEFT JOIN x USING (doc_id)
"""

NEAR_DEDUP = rf"""
WITH RECURSIVE t AS (SELECT doc_id, {_words(_FOLDED.format("text"))} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM t WHERE len(w) > 0)),
k AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN k x ON x.doc_id = a JOIN k y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached)
SELECT d.doc_id, coalesce(k.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) m USING (doc_id) LEFT JOIN k USING (doc_id)
"""

SUBSTRING_DEDUP = rf"""
WITH t AS (SELECT doc_id, coalesce({_words("text")}, []) AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM t)),
h AS (SELECT doc_id, i, first FROM (SELECT *, min(doc_id) OVER (PARTITION BY s) AS first FROM g) WHERE first < doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM h),
f AS (SELECT doc_id, count(*) AS n FROM (SELECT *, lag(i) OVER o AS before, lag(first) OVER o AS source FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY i))
      WHERE before IS NULL OR before <> i - 1 OR source <> first GROUP BY doc_id),
x AS (SELECT doc_id, w[i] AS word, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t)),
y AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.p = x.i WHERE c.p IS NULL GROUP BY x.doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(y.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(y.kept, '')) AS kept_sha256, coalesce(f.n, 0) AS n_factors
FROM t LEFT JOIN y USING (doc_id) LEFT JOIN f USING (doc_id)
"""


def _crc32(values: str) -> str:
    """The unsigned crc32 of a list of bytes."""
    bits = "list_reduce(list_concat([xor(c, b)], range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return f"xor(list_reduce(list_concat([4294967295], {values}), lambda c, b: {bits}), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


_LEAF = "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
_DIGITS = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
MERKLE_MANIFEST = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {_LEAF.format(text="text")} AS leaf,
       CASE WHEN {_crc32(_DIGITS)} % 2 = 0 THEN {_LEAF.format(text="replace(text, chr(10), '')")} ELSE {_LEAF.format(text="text")} END AS current FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
n(source, level, i, h, total) AS (SELECT source, 0, i, leaf, count(*) OVER (PARTITION BY source) FROM l
      UNION ALL SELECT source, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(total) + 2) // 3 FROM n WHERE total > 1 GROUP BY source, level, i // 3),
s AS (SELECT source, level AS depth, h AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS place FROM n WHERE total = 1),
m(level, i, h, total) AS (SELECT 0, place, subroot, count(*) OVER () FROM s
      UNION ALL SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(total) + 2) // 3 FROM m WHERE total > 1 GROUP BY level, i // 3),
a AS (SELECT source, level, i, coalesce(string_agg(h, '' ORDER BY i) OVER (PARTITION BY source, level, i // 3 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
             coalesce(string_agg(h, '' ORDER BY i) OVER (PARTITION BY source, level, i // 3 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM n WHERE total > 1),
b AS (SELECT level, i, coalesce(string_agg(h, '' ORDER BY i) OVER (PARTITION BY level, i // 3 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
             coalesce(string_agg(h, '' ORDER BY i) OVER (PARTITION BY level, i // 3 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM m WHERE total > 1),
u AS (SELECT 'row' AS kind, source, level, i, l, r FROM a UNION ALL SELECT 'source', NULL, level, i, l, r FROM b),
f(doc_id, leaf, source, kind, level, i, h, proof) AS (SELECT doc_id, leaf, source, 'row', 0, i, current, '' FROM l
      UNION ALL SELECT f.doc_id, f.leaf, f.source, CASE WHEN u.kind IS NULL THEN 'source' ELSE f.kind END, CASE WHEN u.kind IS NULL THEN 0 ELSE f.level + 1 END,
             CASE WHEN u.kind IS NULL THEN s.place ELSE f.i // 3 END, CASE WHEN u.kind IS NULL THEN f.h ELSE sha256(u.l || f.h || u.r) END, f.proof || coalesce(u.l || u.r, '')
      FROM f JOIN s ON s.source IS NOT DISTINCT FROM f.source
      LEFT JOIN u ON u.kind = f.kind AND u.level = f.level AND u.i = f.i AND (f.kind = 'source' OR u.source IS NOT DISTINCT FROM f.source)
      WHERE u.kind IS NOT NULL OR f.kind = 'row'),
e AS (SELECT * FROM f WHERE kind = 'source' QUALIFY row_number() OVER (PARTITION BY doc_id, leaf ORDER BY level DESC) = 1),
t AS (SELECT h AS root FROM m WHERE total = 1)
SELECT e.doc_id, e.leaf, s.subroot, t.root, sha256(e.proof) AS proof_sha256, e.h AS folded_root, e.h = t.root AS verified
FROM e JOIN s ON s.source IS NOT DISTINCT FROM e.source CROSS JOIN t
"""

_BYTES = ("flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda x: CASE WHEN unicode(x) >= 192 "
          "THEN [CAST(195 AS BIGINT), unicode(x) - 64] ELSE [CAST(unicode(x) AS BIGINT)] END))")
SPELLING_VARIANTS = f"""
WITH RECURSIVE t AS (SELECT doc_id, {_FOLDED.format("unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+'))")} AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS n, {_crc32(_BYTES)} AS h FROM t WHERE length(run) >= 6 GROUP BY doc_id, run),
c AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM d),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM c WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
k AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word, b.word AS near, b.n AS m FROM k a JOIN k b ON a.less = b.less AND a.i = b.i AND a.word <> b.word AND length(a.word) = length(b.word)
      UNION SELECT k.word, v.word, v.n FROM k JOIN v ON v.word = k.less UNION SELECT v.word, k.word, k.n FROM k JOIN v ON v.word = k.less),
b AS (SELECT word, count(*) AS n_near, arg_min(near, (-m, near)) AS best, max(m) AS most FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * v.n THEN best END AS form, CASE WHEN most >= 5 * v.n THEN most END AS form_n FROM v LEFT JOIN b USING (word)),
r(word, i) AS (SELECT word, word FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.i WHERE f.form IS NOT NULL),
e AS (SELECT r.word, r.i AS root FROM r JOIN f ON f.word = r.i WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN e USING (word)
"""
