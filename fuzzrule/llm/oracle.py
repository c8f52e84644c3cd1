"""DuckDB SQL of the training-data queries, written apart from the operators
(nothing is imported from them)."""

LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
shared AS (
  SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.doc_id, k.pos, k.line, s.keep IS NOT NULL AND s.keep <> k.doc_id AS gone
  FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

EXACT_TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS code FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) = 64),
d AS (SELECT q.vec_id AS query_id, v.vec_id AS neighbour_id,
             len(list_filter(list_zip(q.code, v.code), lambda p: p[1] <> p[2])) AS distance
      FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM d)
SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbour_id, CAST(distance AS INTEGER) AS distance
FROM r WHERE rank <= 10
"""

# The chain of jumps as a recursive table; CRC-32 byte by byte.  A shard's rows
# are numbered by (hash modulo the bucket count, doc_id).
JUMP_SHARDING = """
WITH RECURSIVE start AS (
  SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 16) AS UBIGINT) AS h FROM documents),
chain AS (
  SELECT doc_id, h, CAST(h AS HUGEINT) AS k, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j FROM start
  UNION ALL
  SELECT doc_id, h, k2, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / CAST((k2 // 8589934592) + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT *, (k * 2862933555777941757 + 1) % 18446744073709551616::HUGEINT AS k2 FROM chain WHERE j < 40)),
shards AS (SELECT doc_id, h, CAST(b AS INTEGER) AS shard, CAST(CASE WHEN j = 40 THEN 40 ELSE b END AS INTEGER) AS grown_shard
           FROM chain WHERE j >= 40),
crc_table AS (
  SELECT list(list_reduce(list_concat([CAST(i AS BIGINT)], range(8)),
              lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
bytes AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS x FROM documents),
crc AS (
  SELECT doc_id, n, xor(list_reduce(list_concat([4294967295::BIGINT],
           list_transform(range(n), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
           lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM bytes, crc_table),
buckets AS (SELECT greatest(1, count(*) // (40 * 2000)) AS n FROM documents)
SELECT s.doc_id, CAST(c.n + 16 AS BIGINT) AS size, c.text_crc32, 'key' AS law, s.shard,
       row_number() OVER (PARTITION BY s.shard ORDER BY s.h % (SELECT n FROM buckets), s.doc_id) - 1 AS slot, s.grown_shard
FROM shards s JOIN crc c ON s.doc_id = c.doc_id
"""

HARD_NEGATIVES = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
WHERE 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) <= 3
"""

# CRC-32 byte by byte; near words meet on a pattern with one place open, or on
# the word left after a deletion
SPELLING_FORMS = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_concat([CAST(i AS BIGINT)], range(8)),
              lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) GROUP BY ALL),
coded AS (
  SELECT run, n, hex(encode(d || ':' || run)) AS x, octet_length(encode(d || ':' || run)) AS b FROM runs),
summed AS (
  SELECT run, n, xor(list_reduce(list_concat([4294967295::BIGINT],
           list_transform(range(b), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
           lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295::BIGINT) AS h
  FROM coded, crc_table),
words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM summed)
  GROUP BY word HAVING length(word) >= 6 AND sum(n) >= 5),
cuts AS MATERIALIZED (
  SELECT word, i, substr(word, 1, i) AS a, substr(word, i + 2) AS b FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
near AS MATERIALIZED (
  SELECT x.word, y.word AS other FROM cuts x JOIN cuts y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT c.word, w.word FROM cuts c JOIN words w ON c.a || c.b = w.word
  UNION SELECT w.word, c.word FROM cuts c JOIN words w ON c.a || c.b = w.word),
best AS (
  SELECT near.word, count(*) AS n_near, arg_min(near.other, struct_pack(a := -w.n, b := near.other)) AS other, max(w.n) AS other_n
  FROM near JOIN words w ON near.other = w.word GROUP BY near.word),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= 5 * w.n THEN b.other END AS form,
         CASE WHEN b.other_n >= 5 * w.n THEN b.other_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
chain AS (
  SELECT word, word AS at FROM forms
  UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON c.at = f.word WHERE f.form IS NOT NULL),
roots AS (SELECT c.word, c.at AS root FROM chain c JOIN forms f ON c.at = f.word WHERE f.form IS NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN roots r ON f.word = r.word
"""

WARC_ARCHIVE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
SELECT p.page_id, CAST(n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN f.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest
"""


def _mixing(groups: int = 6, cycles: int = 4, rate: float = 0.5) -> str:
    """Groups of cycles; a group changes nothing once the marginals have settled."""
    targets = [("source", 0.5), ("lang", 0.7), ("topic", 0.7)]
    steps, feasible, last = [], [f"{rate}"], "g0"
    for dim, power in targets:
        steps.append(f"""t_{dim} AS MATERIALIZED (
  SELECT {dim}, t, pow(CAST(t AS DOUBLE), {power}) * (SELECT sum(tokens) FROM cells)
         / sum(pow(CAST(t AS DOUBLE), {power})) OVER () AS target
  FROM (SELECT {dim}, sum(tokens) AS t FROM cells GROUP BY {dim}) WHERE t > 0)""")
        feasible.append(f"coalesce((SELECT 0.95::DOUBLE * min(t / target) FROM t_{dim} WHERE target > 0), 1)")
    steps.append(f"rate AS MATERIALIZED (SELECT least({', '.join(feasible)}) AS rate)")
    steps.append("""g0 AS MATERIALIZED (SELECT source, lang, topic, tokens, CAST(tokens AS DOUBLE) AS w,
  tokens / CAST(rate AS DOUBLE) AS most, false AS settled FROM cells, rate)""")
    for g in range(1, groups + 1):
        start = last
        for c in range(cycles):
            for dim, _ in targets:
                name = f"w{g}_{c}_{dim}"
                steps.append(f"""{name} AS MATERIALIZED (
  SELECT x.source, x.lang, x.topic, x.tokens, x.most, x.settled, least(x.most,
         CASE WHEN s.held + s.free <= 0 THEN 0 WHEN coalesce(t.target, 0) / (s.held + s.free) < 1 THEN x.w * (coalesce(t.target, 0) / (s.held + s.free))
              WHEN x.w >= x.most * (1 - 1e-9) THEN x.w
              WHEN s.free > 0 THEN x.w * (greatest(t.target - s.held, 0) / s.free) ELSE x.w END) AS w
  FROM {last} x JOIN (SELECT {dim}, coalesce(sum(w) FILTER (w >= most * (1 - 1e-9)), 0) AS held,
                             coalesce(sum(w) FILTER (w < most * (1 - 1e-9)), 0) AS free FROM {last} GROUP BY {dim}) s ON x.{dim} = s.{dim}
  LEFT JOIN t_{dim} t ON x.{dim} = t.{dim})""")
                last = name
        off = " UNION ALL ".join(f"SELECT abs(sum(w) / any_value(target) - 1) AS off FROM n{g} JOIN t_{dim} USING ({dim}) WHERE target > 0 GROUP BY {dim}"
                                 for dim, _ in targets)
        steps.append(f"""n{g} AS MATERIALIZED (
  SELECT a.source, a.lang, a.topic, a.tokens, a.most, CASE WHEN a.settled THEN a.w ELSE b.w END AS w
  FROM {start} a JOIN {last} b ON a.source = b.source AND a.lang = b.lang AND a.topic = b.topic)""")
        steps.append(f"g{g} AS MATERIALIZED (SELECT *, coalesce((SELECT max(off) FROM ({off})), 0) <= 0.005 AS settled FROM n{g})")
        last = f"g{g}"
    chain = ",\n".join(steps)
    return f"""
WITH light AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
         CASE WHEN text IS NULL THEN '(none)' WHEN contains(text, ' | ') THEN 'table'
              WHEN contains(text, 'icense') THEN 'notice' WHEN contains(text, '@') THEN 'contact'
              WHEN contains(text, ' = ') THEN 'assignment' ELSE 'prose' END AS topic,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens
  FROM documents),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens) AS tokens FROM light GROUP BY ALL),
{chain},
p AS (SELECT source, lang, topic,
             CASE WHEN tokens > 0 THEN least(1.0, rate * w / tokens) ELSE rate END AS probability FROM {last}, rate)
SELECT l.doc_id, l.topic, l.n_tokens, round(p.probability, 6) AS probability,
       CAST(CAST('0x' || substr(md5('mix-1:' || l.doc_id), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0
         < p.probability AS selected
FROM light l JOIN p ON l.source = p.source AND l.lang = p.lang AND l.topic = p.topic
"""


SOURCE_MIXING = _mixing()
