"""DuckDB SQL of the training-data queries that SQL can restate."""

OP9 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  ('0x' || substr(md5('curriculum:' || doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
  row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(i % 3) + 1] AS w, [0.5::DOUBLE, 0.0, -0.5][(i % 3) + 1] AS slope, 3 * source_size AS cap FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w WINDOW o AS (ORDER BY cap::DOUBLE / w, i)),
f AS (SELECT arg_min(level, cap::DOUBLE / w + i * 1e-9) AS level FROM l WHERE level * w < cap),
t AS (SELECT source, source_size, slope, CASE WHEN f.level IS NULL OR f.level * w >= cap THEN cap::DOUBLE
  ELSE f.level * w END AS target FROM l, f),
r AS (SELECT d.doc_id, d.size, d.h, t.*, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, doc_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
  CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r0 AS (SELECT *, target - passes * source_size AS rest, before + size / 2.0::DOUBLE < target - passes * source_size AS chosen FROM r),
o0 AS (SELECT *, rest - sum(CASE WHEN chosen THEN size ELSE 0 END) OVER (PARTITION BY source) AS off FROM r0),
w0 AS (SELECT *, CASE WHEN chosen = (off < 0) AND size > 0 AND size * 2 <= abs(off) THEN size ELSE 0 END AS w FROM o0),
b0 AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM w0),
r1 AS (SELECT doc_id, size, h, source, source_size, slope, target, before, passes, rest,
  chosen <> (w > 0 AND b + w / 2.0::DOUBLE < abs(off)) AS chosen FROM b0),
o1 AS (SELECT *, rest - sum(CASE WHEN chosen THEN size ELSE 0 END) OVER (PARTITION BY source) AS off FROM r1),
w1 AS (SELECT *, CASE WHEN chosen = (off < 0) AND size > 0 AND size * 2 <= abs(off) THEN size ELSE 0 END AS w FROM o1),
b1 AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM w1),
c AS (SELECT *, passes + CASE WHEN chosen <> (w > 0 AND b + w / 2.0::DOUBLE < abs(off)) THEN 1 ELSE 0 END AS copies,
  before + size / 2.0::DOUBLE AS middle FROM b1),
p AS (SELECT *, least(CASE WHEN passes > 0 THEN middle WHEN rest > 0 THEN middle - rest * floor(middle / rest) ELSE 0 END
  / greatest(target, 1.0), 1.0) AS q FROM c)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::INTEGER AS copies,
  CASE WHEN copies > 0 THEN round(CASE WHEN slope = 0 THEN q ELSE 2 * q / ((1 + slope) + sqrt(greatest(0.0, (1 + slope) * (1 + slope) - 4 * slope * q))) END, 6) END AS first_position
FROM p
"""

OP8 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM
  (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
g AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM p, ns WHERE i + n - 1 <= len(w)),
m AS (SELECT doc_id, i, n, item_id FROM g JOIN bw USING (n, phrase)),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM m) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)
"""


OP1 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS d FROM pages),
w AS (SELECT d, max(page_id) AS m FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN m <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN m <> page_id THEN m END AS refers_to, 'ok' AS status
FROM p LEFT JOIN w USING (d)
"""

#: Smallest id reachable over the links ``e`` (a, b), both ways; ``r`` has (id, component) of every id with a link.
REACH = """e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a AS id, a AS seen FROM e2 UNION SELECT reach.id, e2.b FROM reach JOIN e2 ON e2.a = reach.seen),
r AS (SELECT id, min(seen) AS component FROM reach GROUP BY id)"""

OP2 = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL
  AND list_sum(list_transform(embedding, lambda y: y::DOUBLE * y)) > 0),
e AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id < q.vec_id
  WHERE list_cosine_similarity(p.x, q.x) >= 0.98),
{REACH},
n AS (SELECT a AS id, count(*) AS n_links FROM e2 GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component, vec_id) AS component_id,
  coalesce(component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN r ON r.id = vec_id LEFT JOIN n ON n.id = vec_id
"""

OP3 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM d),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s),
e AS (SELECT p.doc_id AS a, q.doc_id AS b FROM x p JOIN x q ON p.t = q.t AND p.doc_id < q.doc_id
  GROUP BY p.doc_id, q.doc_id, p.n, q.n HAVING 100 * count(*) >= 90 * (p.n + q.n - count(*))),
{REACH}
SELECT doc_id, len(g)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id FROM s LEFT JOIN r ON r.id = doc_id
"""

OP11 = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
p AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM p, (VALUES (1), (2), (3), (4)) v(k)
  WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
x AS (SELECT lang, phrase, a, k, w, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT x.lang, x.phrase, x.a, x.k, cut, l.f AS l, r.f AS r, (2000000::HUGEINT * x.a) // (l.f::HUGEINT + r.f) AS score FROM x
  JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1:cut], ' ')
  JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[cut + 1:x.k], ' ')),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
y AS (SELECT lang, a, k, w, m, unnest(range(1, k - m + 2)) AS i FROM c, (VALUES (2), (3)) v(m) WHERE m < k),
z AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM y GROUP BY ALL)
SELECT m.lang, row_number() OVER (PARTITION BY m.lang ORDER BY m.score DESC, m.a DESC, m.phrase) AS rank, m.phrase, m.a, m.l, m.r, t.n,
  m.score::BIGINT AS score
FROM m JOIN t ON t.lang = m.lang LEFT JOIN z ON z.lang = m.lang AND z.phrase = m.phrase
WHERE NOT coalesce(100 * z.longer >= 80 * m.a, false)
QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_reassembly": OP1, "op2_pruned_graph": OP2, "op3_ngram_jaccard_join": OP3,
            "op8_positional_index": OP8, "op9_curriculum_mixing": OP9,
            "op11_partitioned_phrases": OP11}
