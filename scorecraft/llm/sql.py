"""DuckDB SQL of the queries that SQL can express, written from the contracts and not from the operators."""

from __future__ import annotations

OP6 = """
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
         len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS n_tokens,
         coalesce(TRY_CAST(right(regexp_extract(source, '([0-9]+)$', 1), 9) AS BIGINT), 0) % 4 AS k
  FROM documents),
b AS (
  SELECT *, CASE k WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'code' ELSE 'news' END AS domain FROM d),
leaf AS (
  SELECT domain, lang, source, sum(n_tokens)::BIGINT AS avail, 3 * sum(n_tokens)::DOUBLE AS room,
         CASE source WHEN 'src0' THEN 2.0 ELSE 1.0 END::DOUBLE AS w
  FROM b GROUP BY ALL),
langs AS (
  SELECT domain, lang, sum(room) AS room, CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END::DOUBLE AS w
  FROM leaf GROUP BY domain, lang),
doms AS (
  SELECT domain, sum(room) AS room, CASE domain WHEN 'web' THEN 4 WHEN 'books' THEN 3 WHEN 'code' THEN 2 ELSE 1 END::DOUBLE AS w
  FROM langs GROUP BY domain),
root AS (SELECT floor(coalesce(sum(avail), 0) * 60 / 100)::DOUBLE AS budget FROM leaf),
a0 AS (SELECT doms.*, budget, budget - coalesce(sum(room) OVER p, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER p, 0) AS open_w
  FROM doms, root WINDOW p AS (ORDER BY room / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a1 AS (SELECT *, min(CASE WHEN room * open_w > rest * w THEN rest / open_w END) OVER () AS share,
       min(CASE WHEN room * open_w > rest * w THEN room / w END) OVER () AS from_ratio FROM a0),
top AS (SELECT domain, CASE WHEN room * open_w <= rest * w AND (from_ratio IS NULL OR room / w <= from_ratio) THEN room
        ELSE floor(first_value(rest) OVER q * w / first_value(open_w) OVER q) END AS budget
  FROM a1 WINDOW q AS (ORDER BY (room * open_w <= rest * w), room / w, domain)),
b0 AS (SELECT l.*, t.budget, t.budget - coalesce(sum(room) OVER p, 0) AS rest,
       sum(w) OVER (PARTITION BY l.domain) - coalesce(sum(w) OVER p, 0) AS open_w
  FROM langs l JOIN top t ON l.domain IS NOT DISTINCT FROM t.domain
  WINDOW p AS (PARTITION BY l.domain ORDER BY room / w, lang NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
mid AS (SELECT domain, lang, CASE WHEN room * open_w <= rest * w THEN room
        ELSE floor(first_value(rest) OVER q * w / first_value(open_w) OVER q) END AS budget
  FROM b0 WINDOW q AS (PARTITION BY domain ORDER BY (room * open_w <= rest * w), room / w, lang NULLS FIRST)),
c0 AS (SELECT l.*, m.budget, m.budget - coalesce(sum(room) OVER p, 0) AS rest,
       sum(w) OVER (PARTITION BY l.domain, l.lang) - coalesce(sum(w) OVER p, 0) AS open_w
  FROM leaf l JOIN mid m ON l.domain IS NOT DISTINCT FROM m.domain AND l.lang IS NOT DISTINCT FROM m.lang
  WINDOW p AS (PARTITION BY l.domain, l.lang ORDER BY room / w, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
low AS (SELECT domain, lang, source, avail, CASE WHEN room * open_w <= rest * w THEN room
        ELSE floor(first_value(rest) OVER q * w / first_value(open_w) OVER q) END::BIGINT AS budget
  FROM c0 WINDOW q AS (PARTITION BY domain, lang ORDER BY (room * open_w <= rest * w), room / w, source NULLS FIRST)),
plan AS (SELECT *, budget // greatest(avail, 1) AS epochs_full, budget % greatest(avail, 1) AS part FROM low),
rows AS (
  SELECT b.doc_id, b.domain, b.lang, b.source, b.n_tokens, p.epochs_full, p.part,
         ('0x' || substr(md5('11|' || (p.epochs_full + 1) || '|' || coalesce(b.doc_id::VARCHAR, '') || '|' || md5(b.t)), 1, 15))::BIGINT AS h
  FROM b JOIN plan p ON b.domain IS NOT DISTINCT FROM p.domain AND b.lang IS NOT DISTINCT FROM p.lang AND b.source IS NOT DISTINCT FROM p.source),
cum AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - n_tokens AS before_ FROM rows)
SELECT doc_id, domain, lang, source, n_tokens::BIGINT AS n_tokens, epochs_full::BIGINT AS epochs_full,
       greatest(0, least(n_tokens, part - before_))::BIGINT AS part_tokens,
       (epochs_full * n_tokens + greatest(0, least(n_tokens, part - before_)))::BIGINT AS used_tokens
FROM cum
"""

OP8 = """
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
f AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM u)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN list_has_any(regexp_split_to_array(host || '//' || path, '[./?#&=:_\\s-]+'),
    ['adult', 'betting', 'casino', 'escort', 'gambling', 'porn', 'sex', 'slots', 'viagra', 'xxx']) THEN 'block'
  ELSE 'allow' END AS verdict
FROM f
"""

OP9 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""

OP7 = """
WITH w AS (
  SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws
  FROM documents),
n AS (
  SELECT doc_id, len(ws) AS k, ws FROM w),
g AS (
  SELECT DISTINCT doc_id, CASE WHEN k < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i+4], ' ') END AS s
  FROM (SELECT doc_id, k, ws, unnest(range(1, greatest(k - 4, 1) + 1)) AS i FROM n WHERE k > 0)),
c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * both_ >= 80 * (x.n + y.n - both_)),
reach AS (
  WITH RECURSIVE r(doc_id, other) AS (
    SELECT doc_id, doc_id FROM c UNION
    SELECT r.doc_id, l.b FROM r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON r.other = l.a)
  SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, coalesce(reach.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN reach USING (doc_id)
"""

OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, md5(coalesce(text, '')) AS h FROM documents),
o AS (
  SELECT doc_id, t, length(t) AS n, row_number() OVER w AS pos, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nxt, count(*) OVER () AS total
  FROM d WINDOW w AS (ORDER BY doc_id NULLS FIRST, h ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, substr(t, 1, n - n // 2) || substr(nxt, 1, n // 2) AS ed FROM o),
texts AS (SELECT pos, 'own' AS kind, t AS txt FROM e UNION ALL SELECT pos, 'new', ed FROM e),
words AS (
  SELECT pos, kind, unnest(list_distinct(list_filter(regexp_split_to_array(
    translate(txt, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> ''))) AS term FROM texts),
df AS (SELECT term, count(*) AS df FROM words WHERE kind = 'own' GROUP BY term),
lex AS (SELECT term FROM df, (SELECT count(*) AS n FROM documents) WHERE CASE WHEN n > 1 THEN ln(n / df) / ln(n) ELSE 0 END BETWEEN 0.1 AND 0.9),
subsets AS (SELECT k, CASE WHEN k < 1 THEN 1 WHEN k < 7 THEN 2 WHEN k < 13 THEN 8 WHEN k < 19 THEN 32 WHEN k < 25 THEN 128 WHEN k < 31 THEN 512 ELSE 2048 END AS rate FROM range(37) r(k)),
held AS (SELECT term, k FROM lex, subsets WHERE rate = 1 OR ('0x' || substr(md5(k || '|' || term), 1, 8))::BIGINT % rate = 0),
has AS (SELECT pos, kind, bool_or(term IN (SELECT term FROM lex)) AS any_, substr(md5(string_agg(term, ' ' ORDER BY term)), 1, 8) AS bare FROM words GROUP BY pos, kind),
hashed AS (SELECT pos, kind, k, substr(md5(string_agg(term, ' ' ORDER BY term)), 1, 8) AS x FROM words JOIN held USING (term) GROUP BY pos, kind, k),
full_ AS (
  SELECT t.pos, t.kind, list(CASE WHEN has.any_ THEN coalesce(x, '') ELSE coalesce(bare, substr(md5(''), 1, 8)) END ORDER BY s.k) AS fp
  FROM texts t CROSS JOIN subsets s LEFT JOIN has ON has.pos = t.pos AND has.kind = t.kind
  LEFT JOIN hashed ON hashed.pos = t.pos AND hashed.kind = t.kind AND hashed.k = s.k GROUP BY t.pos, t.kind),
m AS (
  SELECT e.doc_id, e.n, sha256(e.ed) AS edited_sha256, a.fp AS a, b.fp AS b, c.fp AS c
  FROM e JOIN full_ a ON a.pos = e.pos AND a.kind = 'own' JOIN full_ b ON b.pos = e.pos AND b.kind = 'new'
  JOIN full_ c ON c.pos = e.pos % e.total + 1 AND c.kind = 'own')
SELECT doc_id, n::BIGINT AS n_chars, edited_sha256, array_to_string(a, '-') AS fingerprint, array_to_string(b, '-') AS edited_fingerprint,
  len(list_filter(list_zip(a, b), lambda z: z[1] = z[2] AND z[1] <> '')) / greatest(len(list_filter(list_zip(a, b), lambda z: z[1] <> '' OR z[2] <> '')), 1)::DOUBLE AS near_edited,
  len(list_filter(list_zip(a, c), lambda z: z[1] = z[2] AND z[1] <> '')) / greatest(len(list_filter(list_zip(a, c), lambda z: z[1] <> '' OR z[2] <> '')), 1)::DOUBLE AS near_next
FROM m
"""

OP12 = r"""
WITH crc AS (
  SELECT list(list_reduce(range(9), lambda c, i: CASE WHEN i = 0 THEN c WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, b) ORDER BY b) AS t
  FROM range(256) r(b)),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
each AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
bytes AS (SELECT *, hex(encode(id || ':' || run)) AS x FROM each),
hashed AS (
  SELECT id, run, n, xor(4294967295, list_reduce(
    list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT),
    lambda c, b: xor(t[xor(c % 256, b) + 1], c // 256), 4294967295)) AS h FROM bytes, crc),
words AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1),
v AS (SELECT word, n, length(word) AS l FROM words WHERE length(word) >= 6 AND n >= 5),
cut AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM v, unnest(range(l)) u(i)),
pairs AS (
  SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, v.word FROM cut a JOIN v ON a.rest = v.word
  UNION SELECT v.word, a.word FROM cut a JOIN v ON a.rest = v.word),
best AS (
  SELECT p.word, v.word AS near, v.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near,
         row_number() OVER (PARTITION BY p.word ORDER BY v.n DESC, v.word) AS r
  FROM pairs p JOIN v ON v.word = p.near),
f AS (
  SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 5 * v.n THEN near END AS form,
         CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n
  FROM v LEFT JOIN best ON best.word = v.word AND r = 1),
chain AS (
  WITH RECURSIVE c(word, tip) AS (
    SELECT word, word FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.tip WHERE f.form IS NOT NULL)
  SELECT c.word, c.tip AS root FROM c JOIN f ON f.word = c.tip WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN chain USING (word)
"""

OP13 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id,
         coalesce(list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM v a, v c WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same AND vec_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank,
         vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

#: Query -> SQL. op5 is approximate, op1 sampled, op2 and op3 library-defined, op10 learned.
ORACLE_SQL: dict[str, str] = {
    "op6_source_mixing": OP6, "op7_jaccard_join": OP7, "op8_url_filter": OP8, "op9_exact_topk": OP9,
    "op11_document_fingerprints": OP11, "op12_spelling_variants": OP12, "op13_hard_negatives": OP13}
