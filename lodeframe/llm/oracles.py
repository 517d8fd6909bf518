"""DuckDB SQL for the queries of this subpackage that SQL can express."""

WORD = r"[^\x20\x09-\x0D]+"

_OP2 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0) AS x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM both_ JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id
FROM documents AS d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id
"""

_OP3 = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20) AS x),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM win) AS x WHERE k > 1),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
judged AS (
  SELECT doc_id, word, p, coalesce(max(i) OVER (PARTITION BY doc_id ORDER BY p) >= p - 19, false) AS removed
  FROM (SELECT word.doc_id, word, p, i FROM word LEFT JOIN later ON later.doc_id = word.doc_id AND later.i = word.p) AS x),
kept AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE removed) AS n_removed,
         string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT removed) AS t
  FROM judged GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM documents AS d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

_OP5 = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, sum(size) AS source_size, 3 * sum(size) AS lim FROM d GROUP BY 1),
t AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
u AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(lim) OVER k, 0) AS rest_words, sum(weight) OVER () - coalesce(sum(weight) OVER k, 0) AS rest_weight,
         row_number() OVER (ORDER BY lim / weight, source NULLS LAST) AS place
  FROM t WINDOW k AS (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT place, CAST(rest_words AS DOUBLE) / CAST(rest_weight AS DOUBLE) AS rate FROM u WHERE lim / weight >= rest_words / rest_weight ORDER BY place LIMIT 1),
g AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size, CASE WHEN f.place IS NULL OR u.place < f.place THEN CAST(lim AS DOUBLE) ELSE weight * rate END AS target
  FROM u LEFT JOIN f ON true),
z AS (SELECT CAST(greatest(1, least(256, sum(source_size) // count(*) // 4096)) AS BIGINT) AS width, CAST(sum(source_size) AS BIGINT) AS total, count(*) AS sources FROM g),
e AS (
  SELECT *, CAST(round(sum(target) OVER w / sum(target) OVER () * 2147483648) AS BIGINT) AS hi, row_number() OVER w - 1 AS turn
  FROM g WINDOW w AS (ORDER BY source NULLS LAST)),
b AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY source NULLS LAST), 0) AS lo, CAST(ceil(target / width) AS BIGINT) AS need FROM e, z),
point AS (SELECT i AS slot, ((i % 2147483648) * 1327217885) % 2147483648 AS x FROM (SELECT unnest(range(CAST(ceil(total / width) AS BIGINT))) AS i FROM z) AS q),
given AS (SELECT source, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM point JOIN b ON x >= lo AND x < hi),
n AS (SELECT source, count(*) AS given FROM given GROUP BY 1),
missing AS (
  SELECT b.source, unnest(range(coalesce(given, 0), need)) AS rank, CAST(ceil(total / width) AS BIGINT) AS start, sources, turn
  FROM b LEFT JOIN n ON n.source IS NOT DISTINCT FROM b.source WHERE coalesce(given, 0) < need),
slots AS (
  SELECT given.source, rank, slot FROM given JOIN b ON b.source IS NOT DISTINCT FROM given.source WHERE rank < need
  UNION ALL SELECT source, rank, start + rank * sources + turn FROM missing),
p AS (
  SELECT d.doc_id, d.source, size, source_size, target,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
  FROM d JOIN g ON g.source IS NOT DISTINCT FROM d.source),
v AS (SELECT p.*, k * source_size + a AS f1, least(k * source_size + a + size, CAST(floor(target) AS BIGINT)) AS f2 FROM p, (SELECT unnest([0, 1, 2]) AS k) AS x),
c AS (SELECT doc_id, source, f1, f2, width, unnest(range(CAST(f1 // width AS BIGINT), CAST((f2 - 1) // width AS BIGINT) + 1)) AS rank FROM v, z WHERE f1 < f2),
m AS (
  SELECT c.doc_id, c.source, sum(least(f2, (c.rank + 1) * width) - greatest(f1, c.rank * width)) AS taken, min(slot) AS first_slot, max(slot) AS last_slot
  FROM c JOIN slots ON slots.source IS NOT DISTINCT FROM c.source AND slots.rank = c.rank GROUP BY 1, 2)
SELECT p.doc_id, p.source, CAST(size AS BIGINT) AS size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, first_slot, last_slot
FROM p LEFT JOIN m ON m.doc_id = p.doc_id AND m.source IS NOT DISTINCT FROM p.source
"""

_OP6 = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS c, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t FROM documents),
k AS (
  SELECT doc_id, sha256(t) AS text_sha256, first_value(doc_id) OVER (PARTITION BY t ORDER BY c DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY t) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""

_OP9 = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLES: dict[str, str] = {
    "op2_ngram_jaccard_join": _OP2,
    "op3_substring_dedup": _OP3,
    "op5_source_mixing": _OP5,
    "op6_exact_dedup": _OP6,
    "op9_exact_topk": _OP9,
}

ORACLES["op8_line_dedup"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (
  SELECT doc_id, text, CAST(no AS INTEGER) AS no, w, md5(concat_ws(' ', CAST(len(w) AS VARCHAR), array_to_string(w[1:3], ' '))) AS leaf, md5(m) AS form, line
  FROM (SELECT *, string_split(m, ' ') AS w
        FROM (SELECT *, trim(regexp_replace(regexp_replace(line, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS m
              FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS no FROM d WHERE text <> '') AS x) AS y) AS z),
r AS (SELECT * FROM l WHERE len([x FOR x IN w IF x <> '' AND x <> '<*>']) > 0),
f AS (SELECT leaf, form, any_value(w) AS w, count(DISTINCT doc_id) AS docs FROM r GROUP BY 1, 2),
b AS (SELECT leaf, w AS best FROM (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY docs DESC, form DESC) AS k FROM f) AS x WHERE k = 1),
g AS (SELECT f.leaf, form, w, len([p FOR p IN list_zip(w, best) IF p[1] = p[2]]) AS n FROM f JOIN b ON b.leaf = f.leaf),
alike AS (SELECT leaf, form FROM g WHERE 100 * n >= 60 * len(w) AND (len(w) <= 3 OR n > 3)),
bl AS (SELECT r.leaf FROM r JOIN alike AS a ON a.leaf = r.leaf AND a.form = r.form GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5),
p AS (SELECT DISTINCT leaf, form, doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS place FROM r),
c AS (SELECT leaf, place, word FROM p WHERE place >= 3 GROUP BY 1, 2, 3 HAVING count(DISTINCT doc_id) >= 5),
kept AS (
  SELECT p.leaf, p.form, string_agg(p.place || ' ' || p.word, ' ' ORDER BY p.place) AS template, count(*) AS n
  FROM (SELECT DISTINCT leaf, form, place, word FROM p) AS p JOIN c ON c.leaf = p.leaf AND c.place = p.place AND c.word = p.word GROUP BY 1, 2),
t AS (SELECT kept.leaf, kept.form, template FROM kept JOIN f ON f.leaf = kept.leaf AND f.form = kept.form WHERE 100 * (n + 3) >= 60 * len(w)),
rt AS (SELECT t.leaf, template FROM t JOIN r ON r.leaf = t.leaf AND r.form = t.form GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 5),
gone AS (
  SELECT leaf, form FROM alike WHERE leaf IN (SELECT leaf FROM bl)
  UNION SELECT t.leaf, t.form FROM t JOIN rt ON rt.leaf = t.leaf AND rt.template = t.template
  UNION SELECT leaf, form FROM f WHERE len(w) <= 3 AND docs >= 5),
k AS (
  SELECT l.doc_id, count(*) AS n_lines, count(gone.form) AS n_dropped, string_agg(line, chr(10) ORDER BY l.no) FILTER (WHERE gone.form IS NULL) AS kept_text
  FROM l LEFT JOIN gone ON gone.leaf = l.leaf AND gone.form = l.form GROUP BY 1)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(coalesce(kept_text, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""

ORACLES["op11_secret_scan"] = r"""
WITH rule AS (
  SELECT * FROM (VALUES
    (0, 'assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?', '[A-Za-z0-9+/_.=-]+', 6),
    (1, 'access', '(AKIA)', '[A-Z0-9]+', 16), (2, 'hex', '()', '[0-9a-f]+', 24), (3, 'pem', '(-----BEGIN [A-Z ]*PRIVATE KEY-----)', '', 0),
    (4, 'host', '(gh[oprsu]_)', '[A-Za-z0-9]+', 36), (5, 'chat', '(xox[abprs]-)', '[A-Za-z0-9-]+', 10)) AS t(k, kind, head, tail, least)),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
part AS (
  SELECT doc_id, k, kind, head, tail, least, unnest(p) AS part, unnest(range(len(p))) AS i
  FROM (SELECT *, string_split(regexp_replace(text, '(' || head || tail || ')', chr(57344) || '\1' || chr(57345), 'g'), chr(57344)) AS p FROM d, rule) AS x),
found AS (
  SELECT doc_id, k, kind, head, tail, least, m, s, s + length(m) AS e
  FROM (SELECT *, string_split(part, chr(57345))[1] AS m, coalesce(sum(length(part) - CAST(i > 0 AS INTEGER)) OVER (PARTITION BY doc_id, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM part) AS y
  WHERE i > 0),
kept AS (
  SELECT doc_id, k, kind, s, concat_ws(':', kind, CAST(CAST(s AS BIGINT) AS VARCHAR), CAST(CAST(e AS BIGINT) AS VARCHAR)) AS w
  FROM found WHERE length(m) - length(regexp_extract(m, '^' || head)) >= least),
r AS (
  SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
         string_agg(w, ',' ORDER BY s, k) FILTER (WHERE k < 3) AS base, string_agg(w, ',' ORDER BY s, k) AS spans
  FROM kept GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN r ON r.doc_id = d.doc_id
"""

ORACLES["op13_fill_in_middle"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
n AS (SELECT *, CAST(len(w) AS BIGINT) AS n, [CAST('0x' || h[8 * i + 1 : 8 * i + 8] AS BIGINT) FOR i IN range(4)] AS x FROM d),
f AS (
  SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR x[3] % 100 >= 90 THEN 'plain' WHEN x[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM n),
t AS (SELECT *, array_to_string(w[1 : a], '') AS p, array_to_string(w[a + 1 : b], '') AS m, array_to_string(w[b + 1 : n], '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM t
"""
