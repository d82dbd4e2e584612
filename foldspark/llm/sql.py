"""DuckDB SQL of the queries that SQL can express, over whole tables."""

from __future__ import annotations

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
frequent AS (
  SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id <> f.holder, false) AS dropped
  FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(dropped AS INTEGER)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

QUALITY_RULES = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT doc_id, source, text,
         list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM base),
windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM words WHERE len(ws) >= 8)),
again AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) >= 2),
covered AS (
  SELECT doc_id, CAST(sum(least(8, coalesce(nxt - i, 8))) AS BIGINT) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM again) GROUP BY doc_id),
counts AS (
  SELECT w.doc_id, w.source, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words
  FROM words w LEFT JOIN covered c USING (doc_id)),
failed AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts),
hosts AS (
  SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CAST(base_failed AS INTEGER)) AS DOUBLE) AS f
  FROM failed WHERE source IS NOT NULL GROUP BY source),
sums AS (
  SELECT sum(f) / sum(n) AS m, sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS room,
         sum(f * f / n) - sum(f) * sum(f) / sum(n) AS spread, count(*) - 1 AS k1 FROM hosts),
moments AS (
  SELECT m, CASE WHEN m > 0 AND m < 1 AND room > 1e-9 THEN (spread / (m * (1 - m)) - k1) / room END AS r FROM sums),
prior AS (
  SELECT m, CASE WHEN r IS NULL THEN 10.0 WHEN r > 1e-6 THEN least(greatest(1 / r - 1, 1.0), 1e6) ELSE 1e6 END AS s FROM moments),
rates AS (
  SELECT source, (f + m * s) / (n + s) AS rate FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(rate <= 0.5, true) AS kept
FROM failed LEFT JOIN rates USING (source)
"""

SUBSTRING_DEDUP = r"""
WITH base AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
  FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM base WHERE len(ws) >= 13)),
hit AS (
  SELECT doc_id, i FROM windows QUALIFY doc_id > min(doc_id) OVER (PARTITION BY win)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM hit),
placed AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM base),
judged AS (
  SELECT a.doc_id, a.w, a.p, g.p IS NOT NULL AS removed
  FROM placed a LEFT JOIN gone g ON a.doc_id = g.doc_id AND a.p = g.p),
digest AS (
  SELECT doc_id, count(*) AS n_words, CAST(sum(CAST(removed AS INTEGER)) AS BIGINT) AS n_removed,
         string_agg(w, ' ' ORDER BY p) FILTER (WHERE NOT removed) AS kept
  FROM judged GROUP BY doc_id)
SELECT b.doc_id, coalesce(d.n_words, 0) AS n_words, coalesce(d.n_removed, 0) AS n_removed,
       sha256(coalesce(d.kept, '')) AS kept_sha256
FROM base b LEFT JOIN digest d USING (doc_id)
"""

NGRAM_JOIN = r"""
WITH RECURSIVE base AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
  FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS shingle
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM base WHERE len(ws) > 0)),
sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i
  FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * i >= 85 * (p.n + q.n - i)),
both_ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(r.y), d.doc_id)) AS component_id
FROM base d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN reach r ON r.x = d.doc_id
GROUP BY d.doc_id
"""

EMBEDDING_DEDUP = """
WITH RECURSIVE usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b
  ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (
  SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
counted AS (
  SELECT x, count(*) AS n FROM links GROUP BY x),
least_of AS (
  SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, least(e.vec_id, coalesce(l.m, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(l.m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN counted c ON c.x = e.vec_id LEFT JOIN least_of l ON l.x = e.vec_id
"""

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM sized GROUP BY source),
weighed AS (
  SELECT *, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 3 * source_size AS cap FROM sources),
filled AS (
  SELECT *, CAST((sum(source_size) OVER ()) - coalesce(sum(cap) OVER up, 0) AS DOUBLE)
              / CAST((sum(w) OVER ()) - coalesce(sum(w) OVER up, 0) AS DOUBLE) AS level
  FROM weighed WINDOW up AS (ORDER BY cap / CAST(w AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (
  SELECT (SELECT arg_min(level, cap / CAST(w AS DOUBLE)) FROM filled WHERE cap > w * level) AS level),
targets AS (
  SELECT f.source, source_size, n, least(CAST(cap AS DOUBLE), coalesce(w * final.level, CAST(cap AS DOUBLE))) AS target FROM filled f, final),
drawn AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target,
         CAST('0x' || substr(md5('11:' || CAST(s.doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS draw,
         CAST(greatest(1, ceil(n / greatest(128, least(65536, floor(sqrt(n)))))) AS BIGINT) AS parts
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY (draw >> 20) % parts, draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         floor(target / greatest(source_size, 1)) AS whole
  FROM drawn)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size > 0 THEN CAST(whole * size AS BIGINT) + greatest(0, least(size,
         greatest(0, CAST(floor(target + 0.5) AS BIGINT) - CAST(whole * source_size AS BIGINT)) - CAST(before AS BIGINT))) ELSE 0 END AS taken
FROM placed
"""

SPELLING_VARIANTS = r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce(
           list_prepend(CAST(b AS BIGINT), [CAST(i AS BIGINT) FOR i IN range(8)]),
           lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (
  SELECT CAST(doc_id AS VARCHAR) AS id,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
  FROM documents),
counted AS (
  SELECT id, run, count(*) AS n, hex(encode(coalesce(id, '') || ':' || run)) AS bytes
  FROM runs WHERE length(run) >= 7 GROUP BY id, run),
hashed AS (
  SELECT run, n, xor(list_reduce(
           list_prepend(CAST(4294967295 AS BIGINT), [CAST('0x' || substr(bytes, CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT) FOR i IN range(length(bytes) // 2)]),
           lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295) AS h
  FROM counted, crc_table),
edited AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n
  FROM hashed),
vocabulary AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM edited WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
deleted AS (
  SELECT word, n, word AS key FROM vocabulary
  UNION SELECT word, n, left(word, i - 1) || substr(word, i + 1) FROM (SELECT word, n, CAST(unnest(range(1, length(word) + 1)) AS INTEGER) AS i FROM vocabulary)),
near AS (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n
  FROM deleted a JOIN deleted b ON a.key = b.key AND a.word <> b.word
  WHERE a.key = b.word OR b.key = a.word OR (length(a.word) = length(b.word) AND list_sum([
          CAST(substr(a.word, CAST(i AS INTEGER), 1) <> substr(b.word, CAST(i AS INTEGER), 1) AS INTEGER) FOR i IN range(1, length(a.word) + 1)]) = 1)),
best AS (
  SELECT word, any_value(n) AS n, count(*) AS n_near, first(other ORDER BY other_n DESC, hex(encode(other))) AS form, max(other_n) AS form_n
  FROM near GROUP BY word),
told AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN form_n >= 10 * v.n THEN form END AS form, CASE WHEN form_n >= 10 * v.n THEN form_n END AS form_n
  FROM vocabulary v LEFT JOIN best b ON v.word = b.word),
follow AS (
  SELECT word, word AS root FROM told
  UNION ALL SELECT f.word, t.form FROM follow f JOIN told t ON t.word = f.root WHERE t.form IS NOT NULL)
SELECT t.word, t.n, t.n_near, t.form, t.form_n, f.root
FROM told t JOIN follow f ON f.word = t.word JOIN told e ON e.word = f.root AND e.form IS NULL
"""

FILTER_AUDIT = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
  FROM documents),
judged AS (
  SELECT part, len(ws) < 100 AS a, 100 * len(list_distinct(ws)) < 80 * len(ws) AS b,
         100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) AS c,
         regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e,
         coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
  FROM split LEFT JOIN labels USING (doc_id)),
fails AS (
  SELECT part, good, toxic, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS f, count(*) AS n FROM judged GROUP BY ALL),
orders AS (
  SELECT '' AS o UNION ALL
  SELECT o || x FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE length(o) < 5 AND NOT contains(o, x)),
steps AS (
  SELECT o, CAST(k AS INTEGER) AS step, CAST(1 << strpos('ABCDE', o[k]) - 1 AS INTEGER) AS own,
         CAST(coalesce(list_sum([1 << strpos('ABCDE', o[CAST(j AS INTEGER)]) - 1 FOR j IN range(1, k)]), 0) AS INTEGER) AS earlier
  FROM (SELECT o, CAST(unnest(range(1, 6)) AS INTEGER) AS k FROM orders WHERE length(o) = 5)),
told AS (
  SELECT part, o AS filter_order, step, own,
         sum(CASE WHEN f & (earlier | own) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN f & earlier = 0 AND f & own > 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN f & earlier > 0 AND f & own > 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN f = own THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN f & earlier = 0 AND f & own > 0 AND good THEN n ELSE 0 END) AS good_lost,
         sum(CASE WHEN f & earlier = 0 AND f & own > 0 AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM fails, steps GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM told
"""

SUFFIX_DEDUP = r"""
WITH base AS (
  SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
strings AS (
  SELECT doc_id, CAST(i AS INTEGER) AS i, substr(h, CAST(2 * i + 1 AS INTEGER), 100) AS s
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM base WHERE length(h) >= 100)),
hit AS (
  SELECT doc_id, i FROM strings QUALIFY doc_id > min(doc_id) OVER (PARTITION BY s)),
begun AS (
  SELECT doc_id, i, max(i + 50) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM hit),
spans AS (
  SELECT doc_id, i AS a, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next_a,
         lead(reach) OVER (PARTITION BY doc_id ORDER BY i) AS b, max(i + 50) OVER (PARTITION BY doc_id) AS last_b,
         coalesce(max(i + 50) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, reach
  FROM begun WHERE reach IS NULL OR i > reach),
ends AS (
  SELECT s.doc_id, s.a, (SELECT max(h.i + 50) FROM hit h WHERE h.doc_id = s.doc_id AND (s.next_a IS NULL OR h.i < s.next_a)) AS b, s.next_a FROM spans s),
kept AS (
  SELECT e.doc_id, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed,
         string_agg(substr(h, CAST(2 * b + 1 AS INTEGER), CAST(2 * (coalesce(next_a, length(h) // 2) - b) AS INTEGER)), '' ORDER BY a) AS rest, min(a) AS first_a
  FROM ends e JOIN base USING (doc_id) GROUP BY e.doc_id)
SELECT b.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN k.doc_id IS NULL THEN h ELSE left(h, CAST(2 * first_a AS INTEGER)) || rest END)) AS kept_sha256
FROM base b LEFT JOIN kept k USING (doc_id)
"""
