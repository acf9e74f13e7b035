"""DuckDB SQL for the queries that SQL can express; written from what each result is, not from its Spark plan."""
from __future__ import annotations

_FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP1 = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '')), 1, 5))::BIGINT AS bucket
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM docs GROUP BY source),
ranked AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap,
         row_number() OVER (ORDER BY source_size / weight::DOUBLE, source NULLS LAST) AS k FROM sources),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
chosen AS (SELECT arg_min(level, k) AS level FROM levels WHERE weight * level <= cap),
targets AS (
  SELECT source, source_size, least(cap, weight * (SELECT level FROM chosen)) AS target FROM ranked),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
buckets AS (
  SELECT source, bucket, sum(size)::BIGINT AS words FROM docs GROUP BY ALL),
running AS (
  SELECT b.*, greatest(0, p.target - p.whole * p.source_size) AS need,
         sum(words) OVER (PARTITION BY b.source ORDER BY b.bucket) AS upto
  FROM buckets b JOIN plan p ON b.source IS NOT DISTINCT FROM p.source),
first_above AS (
  SELECT source, min(bucket) AS bucket FROM running WHERE upto > need GROUP BY source),
cuts AS (
  SELECT r.source, r.bucket + CASE WHEN r.need - (r.upto - r.words) >= r.words / 2.0 THEN 1 ELSE 0 END AS cut
  FROM running r JOIN first_above f ON r.source IS NOT DISTINCT FROM f.source AND r.bucket = f.bucket)
SELECT d.doc_id, d.size, p.source_size, p.target,
       d.size * (p.whole + CASE WHEN d.bucket < coalesce(c.cut, 0) THEN 1 ELSE 0 END)::BIGINT AS taken,
       (p.whole + CASE WHEN d.bucket < coalesce(c.cut, 0) THEN 1 ELSE 0 END)::BIGINT AS repeats
FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
LEFT JOIN cuts c ON d.source IS NOT DISTINCT FROM c.source
"""

OP5 = rf"""
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), {_FOLD}), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules AS (
  SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                        ('net', '/es/', 'block'), ('net', '/fr/', 'block')) AS r(rule_host, rule_path, verdict)),
labels AS (
  SELECT * FROM (VALUES ('ads-track'), ('spam-farm'), ('casino-win'), ('adult-x'), ('cheap-pills'), ('free-bets')) AS l(label)),
fits AS (
  SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts) p JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path)
SELECT p.page_id, p.host, p.path, f.rule,
       coalesce(f.verdict, CASE WHEN EXISTS (SELECT 1 FROM labels WHERE list_contains(string_split(p.host, '.'), label))
                                THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN fits f ON p.host = f.host AND p.path = f.path
"""

OP2 = rf"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, {_FOLD}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
item AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, {_FOLD}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k,
         array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM item WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT k FROM windows),
grams AS (
  SELECT r, s, k, array_to_string(w[s:s + k - 1], ' ') AS g
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM doc, lengths WHERE len(w) >= k)),
found AS (SELECT r, s, windows.k, item_id FROM grams JOIN windows ON grams.k = windows.k AND grams.g = windows.g),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS p FROM found) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id::VARCHAR) AS n_items,
                 list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM found GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""

OP6 = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT * FROM (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
  FROM scored)
WHERE rank <= 5
"""

# CRC-32 as its definition has it: the table of the reversed polynomial 0xEDB88320, then one step per byte.
_CRC_TABLE = """crc_table AS (
  SELECT list(c ORDER BY i) AS t
  FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c
        FROM range(256) AS r(i)))"""


def _crc32(text: str) -> str:
    """Of a not-null text; the query has crc_table among its sources."""
    return f"""xor(list_reduce(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT),
                lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295)"""


OP11 = rf"""
WITH {_CRC_TABLE},
raw AS (
  SELECT row_number() OVER () AS r, doc_id, {_crc32("doc_id::VARCHAR")} AS h,
         coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents, crc_table),
placed AS (
  SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a,
         3 + (h // 10) % 8 AS k FROM raw),
doc AS (
  SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE
         list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // k) END]) END AS w
  FROM placed),
word AS (SELECT r, n, unnest(w) AS x, unnest(range(n)) AS i FROM doc),
equal AS (
  SELECT f.r, f.i, s.i - f.i AS q FROM word f JOIN word s ON f.r = s.r AND f.x = s.x AND s.i > f.i AND (s.i - f.i) * 4 <= f.n),
islands AS (
  SELECT r, q, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island, i FROM equal),
stretches AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY r, q, island),
run AS (
  SELECT r, start, length, min(q) AS period FROM stretches WHERE length >= greatest(6, 4 * q) GROUP BY r, start, length),
dropped AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM run),
summary AS (
  SELECT r, count(*) AS n_runs, arg_min(start, (-(length * 1.0::DOUBLE / period), start, period)) AS start,
         arg_min(length, (-(length * 1.0::DOUBLE / period), start, period)) AS length,
         arg_min(period, (-(length * 1.0::DOUBLE / period), start, period)) AS period,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM run GROUP BY r),
kept AS (
  SELECT r, string_agg(x, ' ' ORDER BY i) AS text FROM word ANTI JOIN dropped USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
       (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
       sha256(coalesce(text, '')) AS collapsed_sha256, n::BIGINT AS n_words
FROM doc LEFT JOIN summary USING (r) LEFT JOIN kept USING (r)
"""

# Near words by definition: a word and what is left of it without one letter; two words of one length that leave the same
# with the same letter gone differ by a replacement there.
OP12 = rf"""
WITH RECURSIVE {_CRC_TABLE},
found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, {_FOLD}), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM found GROUP BY ALL),
hashed AS (
  SELECT run, n, CASE WHEN doc_id IS NULL THEN 1 ELSE {_crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} END AS h
  FROM counted, crc_table),
words AS (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (
  SELECT word, i, word[:i] || word[i + 2:] AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word FROM cut c JOIN words w ON c.rest = w.word),
best AS (
  SELECT near.word, count(*) AS n_near, arg_min(other, (-words.n, other)) AS other, max(words.n) AS other_n
  FROM near JOIN words ON words.word = near.other GROUP BY near.word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form,
         CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
way AS (
  SELECT word, word AS at FROM words
  UNION ALL SELECT way.word, f.form FROM way JOIN formed f ON way.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, way.at AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN way ON way.word = f.word JOIN formed l ON l.word = way.at AND l.form IS NULL
"""

OP13 = rf"""
WITH {_CRC_TABLE},
docs AS (
  SELECT doc_id, coalesce('=' || doc_id::VARCHAR, 'null') AS key, (strlen(coalesce(text, '')) + 8)::BIGINT AS size,
         coalesce({_crc32("coalesce(text, '')")}, 0) AS text_crc32
  FROM documents, crc_table),
keys AS (SELECT DISTINCT key FROM docs),
bids AS (
  SELECT key, s, -ln((('0x' || substr(md5('42:' || s || ':' || key), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) AS bid
  FROM keys, range(25) AS g(s)),
dealt AS (
  SELECT key, arg_min(s, (bid, s)) FILTER (s < 24) AS shard, arg_min(s, (bid, s)) AS grown_shard FROM bids GROUP BY key)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5('42:' || key), doc_id, size, text_crc32) - 1 AS slot,
       grown_shard::INTEGER AS grown_shard
FROM docs JOIN dealt USING (key)
"""

ORACLES = {"op1_mix": OP1, "op2_decontaminate": OP2, "op5_url_filter": OP5, "op6_top_k": OP6, "op11_periodic_runs": OP11,
           "op12_spelling": OP12, "op13_sharding": OP13}
