"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLE: dict[str, str] = {}

# Lines: document frequency and largest document of each long key.
ORACLE["op7_line_runs"] = r"""
WITH lines AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM documents, generate_series(1, len(string_split(coalesce(text, ''), chr(10)))) AS g(i)),
keyed AS (
  SELECT doc_id, i, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
frequent AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT keyed.*, coalesce(frequent.keeper <> doc_id, FALSE) AS gone
  FROM keyed LEFT JOIN frequent USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

# Windows of benchmark words as joined strings against the same windows of the documents.
ORACLE["op6_decontaminate"] = rf"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM benchmark),
pats AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS p
  FROM iw, generate_series(1, greatest(1, len(w) - 9)) AS g(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM pats),
wins AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS p
  FROM dw, sizes, generate_series(1, len(w) - n + 1) AS g(i) WHERE len(w) >= n),
found AS (SELECT doc_id, wins.n, i, item FROM wins JOIN pats ON wins.p = pats.p AND wins.n = pats.n),
hits AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit
  FROM (SELECT DISTINCT doc_id, n, i FROM found) f, generate_series(f.i, f.i + f.n - 1) AS g(j)
  GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)"""

# Near-duplicates: all pairs that share a shingle, then the smallest document reached.
ORACLE["op5_dart_minhash"] = rf"""
WITH RECURSIVE dw AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
sh AS (
  SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS s, count(*) AS c
  FROM dw, generate_series(1, greatest(1, len(w) - 4)) AS g(i) WHERE len(w) > 0 GROUP BY ALL
  UNION ALL SELECT doc_id, chr(1) || t, 1 FROM dw WHERE len(w) = 0 AND t <> ''),
n AS (SELECT doc_id, sum(c) AS n FROM sh GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.c, b.c)) AS shared
  FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE shared * 18 >= (x.n + y.n) * 8),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT dw.doc_id, least(dw.doc_id, coalesce(m, dw.doc_id)) AS class_id,
       CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles
FROM dw LEFT JOIN n USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) USING (doc_id)"""

# Base 32 of a SHA-1: five bits at a time, from the two hexadecimal digits that hold them.
ORACLE["op3_arc_to_warc"] = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) || '0' AS x FROM pages),
d AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS top,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((
      ((strpos('0123456789abcdef', substr(x, CAST(5 * i // 4 + 1 AS BIGINT), 1)) - 1) * 16
       + strpos('0123456789abcdef', substr(x, CAST(5 * i // 4 + 2 AS BIGINT), 1)) - 1)
      // CAST(pow(2, 3 - (5 * i) % 4) AS BIGINT)) % 32), 1)), '') AS digest
  FROM p)
SELECT page_id, octet_length(encode(h)) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id < top THEN top END AS refers_to
FROM d"""

# Every repeated 400-byte window as hexadecimal text (800 digits), then the runs they cover.
ORACLE["op10_radix_windows"] = """
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
blocks AS (  -- of 512 windows: a substring of a short text is found sooner
  SELECT r, 512 * b AS base, substring(h, 1024 * b + 1, 2 * 911) AS x
  FROM docs, generate_series(0, (length(h) // 2 - 400) // 512) AS g(b) WHERE length(h) >= 800),
windows AS (
  SELECT r, base + i AS i, md5_number(substring(x, 2 * i + 1, 800)) AS m
  FROM blocks, generate_series(0, length(x) // 2 - 400) AS g(i)),
again AS (SELECT m FROM windows GROUP BY m HAVING count(*) > 1),
hits AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM windows SEMI JOIN again USING (m)),
runs AS (
  SELECT r, min(i) AS a, max(i) + 400 AS b
  FROM (SELECT r, i, sum(CASE WHEN p IS NULL OR i > p + 400 THEN 1 ELSE 0 END)
          OVER (PARTITION BY r ORDER BY i) AS k FROM hits)
  GROUP BY r, k),
gaps AS (  -- what stays: before each run, and behind the last
  SELECT r, coalesce(lag(b) OVER w, 0) AS a, runs.a AS b FROM runs WINDOW w AS (PARTITION BY r ORDER BY runs.a)
  UNION ALL SELECT r, max(b), 1000000000 FROM runs GROUP BY r),
kept AS (
  SELECT r, string_agg(substring(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS k
  FROM gaps JOIN docs USING (r) GROUP BY r),
sums AS (SELECT r, sum(b - a) AS n, count(*) AS spans FROM runs GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM docs LEFT JOIN sums USING (r) LEFT JOIN kept USING (r)"""

# Integer scores of all documents that share a term with an item.
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ORACLE["op11_ball_tree"] = rf"""
WITH dw AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}') AS w FROM documents),
total AS (SELECT count(*) FILTER (len(w) > 0) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM dw),
iw AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS t FROM benchmark),
tf AS (
  SELECT doc_id, r, n, t, count(*) AS tf
  FROM (SELECT doc_id, r, len(w) AS n, unnest(w) AS t FROM dw) SEMI JOIN iw USING (t) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
weights AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, total),
scores AS (
  SELECT item_id, r, doc_id,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms)))) AS BIGINT) AS score
  FROM iw JOIN tf USING (t) JOIN weights USING (t), total GROUP BY ALL),
ranked AS (
  SELECT item_id, doc_id, score,
    row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10"""

# crc32 by its table, words that share a deletion or a hole, and forms followed to the last.
ORACLE["op13_spelling_variants"] = """
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents WHERE text IS NOT NULL)
  GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)],
      flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
        lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)]
                       ELSE [195, CAST(unicode(c) AS BIGINT) - 64] END))),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM runs, crc),
altered AS (
  SELECT CASE WHEN h % 97 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2)
              ELSE run END AS word, n FROM hashed),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM altered WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
holes AS (
  SELECT word, n, i, substring(word, 1, i - 1) AS a, substring(word, i + 1) AS b
  FROM words, generate_series(1, length(word)) AS g(i)),
pairs AS (
  SELECT x.word, y.word AS other FROM holes x JOIN holes y USING (i, a, b) WHERE x.word <> y.word
  UNION SELECT h.word, w.word FROM holes h JOIN words w ON w.word = h.a || h.b
  UNION SELECT w.word, h.word FROM holes h JOIN words w ON w.word = h.a || h.b),
best AS (
  SELECT p.word, count(*) AS n_near, arg_min(other, struct_pack(m := -w.n, o := other)) AS other, max(w.n) AS m
  FROM pairs p JOIN words w ON w.word = p.other GROUP BY p.word),
judged AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN other END AS form,
    CASE WHEN m >= 2 * n THEN m END AS form_n FROM words LEFT JOIN best USING (word)),
steps AS (
  SELECT word, word AS at FROM judged
  UNION ALL SELECT s.word, j.form FROM steps s JOIN judged j ON j.word = s.at WHERE j.form IS NOT NULL)
SELECT j.word, j.form, s.at AS root, j.n, j.n_near, j.form_n
FROM judged j JOIN steps s USING (word) JOIN judged e ON e.word = s.at WHERE e.form IS NULL"""
