"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest FROM p),
g AS (SELECT payload_digest, max(page_id) AS original FROM d WHERE payload_bytes >= 1000 GROUP BY 1),
j AS (SELECT d.*, CASE WHEN g.original IS NOT NULL AND (d.page_id IS NULL OR d.page_id < g.original) THEN g.original END AS refers_to
      FROM d LEFT JOIN g ON d.payload_digest = g.payload_digest AND d.payload_bytes >= 1000)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM j
"""

_MIX = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                     md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS no FROM s),
w AS (SELECT *, no % 3 + 1 AS weight, 3.0::DOUBLE * source_size AS cap FROM r),
-- each round shares what is left by weight and closes the sources that reach their cap
f AS (
  SELECT 0 AS round, no, (sum(source_size) OVER ())::DOUBLE * weight / sum(weight) OVER () AS share, false AS closed FROM w
  UNION ALL
  SELECT round + 1, no, share, closed FROM (
    SELECT f.round, f.no, f.closed OR f.share > w.cap AS closed,
           CASE WHEN f.closed OR f.share > w.cap THEN w.cap
                ELSE ((sum(w.source_size) OVER ()) - sum(CASE WHEN f.closed OR f.share > w.cap THEN w.cap ELSE 0 END) OVER ()) * w.weight
                     / sum(CASE WHEN f.closed OR f.share > w.cap THEN 0 ELSE w.weight END) OVER () END AS share
    FROM f JOIN w USING (no)) WHERE round < 60
),
t AS (SELECT w.*, f.share AS target FROM w JOIN f USING (no) WHERE f.round = 60),
q AS (SELECT d.*, t.no, t.source_size, t.target, sum(d.size) OVER (PARTITION BY t.no ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (e * source_size + upto) / target AS finish FROM q, range(3) AS x(e) WHERE size > 0 AND target > 0),
o AS (SELECT *, sum(size) OVER (ORDER BY finish, no, k, size ROWS UNBOUNDED PRECEDING) AS total FROM c),
n AS (SELECT no, k, doc_id, upto, count(*) AS copies FROM o WHERE total <= (SELECT sum(size) FROM d) GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, round(q.target, 6) AS target, (coalesce(n.copies, 0) * q.size)::BIGINT AS taken
FROM q LEFT JOIN n ON q.no = n.no AND q.k = n.k AND q.upto = n.upto AND q.size > 0
"""


_PHRASES = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, len(g) AS size, array_to_string(g, ' ') AS phrase, any_value(g) AS ws, count(*) AS f
      FROM (SELECT lang, unnest(list_transform(range(1, len(ws) - s + 2), lambda i: ws[i : i + s - 1])) AS g FROM w, range(1, 5) AS x(s) WHERE len(ws) >= s) GROUP BY 1, 2, 3 HAVING count(*) >= 30),
k AS (SELECT *, unnest(range(1, size)) AS k FROM g WHERE size > 1),
c AS (SELECT k.lang, k.phrase, k.k, k.f AS a, l.f AS l, r.f AS r, (2000000::HUGEINT * k.f) // (l.f + r.f) AS score
      FROM k JOIN g l ON l.lang = k.lang AND l.phrase = array_to_string(k.ws[:k.k], ' ') JOIN g r ON r.lang = k.lang AND r.phrase = array_to_string(k.ws[k.k + 1 :], ' ')),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
h AS (SELECT lang, inner_phrase, max(f) AS f FROM (
        SELECT lang, f, unnest(list_transform(range(1, size - s + 2), lambda i: array_to_string(ws[i : i + s - 1], ' '))) AS inner_phrase FROM g, range(2, 4) AS x(s) WHERE size > s) GROUP BY 1, 2),
o AS (SELECT b.* FROM b LEFT JOIN h ON h.lang = b.lang AND h.inner_phrase = b.phrase WHERE h.f IS NULL OR 100 * h.f < 80 * b.a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o) JOIN t USING (lang) WHERE rank <= 2000
"""

_TOPK = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.rid <> c.rid WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": _WARC, "op7_mixing": _MIX, "op11_phrases": _PHRASES, "op13_topk": _TOPK}
