"""SQL of the queries that SQL can express."""

# crc32 of a text, bit by bit over its UTF-8 bytes; each byte enters before the first of its eight shifts.
_CRC32 = """
  CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, octet_length({0}) + 1),
    lambda i: [('0x' || substr(hex({0}), 2 * i - 1, 2))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1))), 4294967295::BIGINT) AS BIGINT)"""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

VARIANTS = f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, {_LOWER.format("unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+'))")} AS run FROM documents),
counted AS (SELECT id, run, count(*) AS times FROM runs WHERE length(run) >= 5 GROUP BY ALL),
hashed AS (SELECT run, times, {_CRC32.format("encode(id || ':' || run)")} AS h FROM counted),
results AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, times FROM hashed),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM results WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
skips AS (SELECT word, n, i, substr(word, 1, i) || '*' || substr(word, i + 2) AS mask, substr(word, 1, i) || substr(word, i + 2) AS rest
          FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM skips a JOIN skips b ON a.mask = b.mask AND a.word <> b.word
  UNION SELECT s.word, w.word, w.n FROM skips s JOIN words w ON s.rest = w.word
  UNION SELECT w.word, s.word, s.n FROM skips s JOIN words w ON s.rest = w.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS best_n, (list(other ORDER BY n DESC, other))[1] AS best_word FROM near GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
         CASE WHEN b.best_n >= 2 * w.n THEN b.best_word END AS form, CASE WHEN b.best_n >= 2 * w.n THEN b.best_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
chains AS (
  SELECT word, word AS root, form AS next FROM formed
  UNION ALL SELECT c.word, c.next, f.form FROM chains c JOIN formed f ON f.word = c.next)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN chains c ON c.word = f.word AND c.next IS NULL"""

CODES = """
WITH usable AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
numbered AS (SELECT *, row_number() OVER (ORDER BY vec_id) AS rid FROM usable),
parts AS (
  SELECT rid, p AS part, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x
  FROM numbered, (SELECT unnest(range(16)) AS p)),
book0 AS (SELECT part, rid - 1 AS entry, x AS e FROM parts WHERE rid <= 64),
{rounds}
coded AS (
  SELECT rid, string_agg(printf('%02x', entry::INTEGER), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM near2 GROUP BY rid),
digest AS (
  SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book2),
labelled AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM numbered JOIN coded USING (rid) GROUP BY label)
SELECT n.vec_id, c.code, c.error, l.label_error, d.codebooks_sha256
FROM numbered n JOIN coded c USING (rid) JOIN labelled l ON l.label IS NOT DISTINCT FROM n.label, digest d"""

_ASSIGN = """near{0} AS (
  SELECT part, rid, any_value(x) AS x, min(d) AS d, arg_min(entry, [d, entry]) AS entry
  FROM (SELECT p.part, p.rid, p.x, b.entry,
               CAST(list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.e[i]) * (p.x[i] - b.e[i]))) AS BIGINT) AS d
        FROM parts p JOIN book{0} b USING (part))
  GROUP BY part, rid),"""

_REPLACE = """sums{0} AS (
  SELECT part, entry, list(mean ORDER BY i) AS e
  FROM (SELECT part, entry, i, CAST(floor(CAST(sum(x[i]) AS DOUBLE) / count(*)) AS BIGINT) AS mean
        FROM near{1}, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM parts))) AS i) GROUP BY part, entry, i)
  GROUP BY part, entry),
book{0} AS (SELECT b.part, b.entry, coalesce(s.e, b.e) AS e FROM book{1} b LEFT JOIN sums{0} s USING (part, entry)),"""

CODES = CODES.format(
    rounds="\n".join([_ASSIGN.format(0), _REPLACE.format(1, 0), _ASSIGN.format(1), _REPLACE.format(2, 1), _ASSIGN.format(2)])
)

ARCHIVE = """
WITH payloads AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS bytes, sha256(coalesce(html, '')) AS digest FROM pages),
ranked AS (
  SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id, row_number() OVER (PARTITION BY digest ORDER BY page_id) AS place FROM payloads)
SELECT page_id, CAST(bytes AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN bytes >= 100 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN bytes >= 100 AND place > 1 THEN first_id END AS refers_to
FROM ranked"""
