"""SQL of the queries that SQL can express: over whole tables, written without regard to scale."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT item_id, least(len(w), 13) AS n, w, unnest(range(1, greatest(len(w) - 11, 2))) AS i FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM bw),
sizes AS (SELECT DISTINCT n FROM windows),
dw AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT doc_id, i, h.n, item_id FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM dw) h JOIN windows USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

SUBSTRINGS = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
words AS (SELECT r, doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
starts AS (SELECT r, doc_id, p, string_agg(x, ' ') OVER n AS s, count(*) OVER n AS n FROM words WINDOW n AS (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
firsts AS (SELECT s, min(doc_id) AS first FROM starts WHERE n = 50 GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT r, p FROM starts JOIN firsts USING (s) WHERE n = 50 AND first < doc_id),
each AS (SELECT e.r, e.p, x, h.p IS NOT NULL AS hit FROM words e LEFT JOIN hit h ON e.r = h.r AND e.p = h.p),
marks AS (SELECT r, p, x, bool_or(hit) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS cut FROM each),
kept AS (SELECT r, count(*) FILTER (WHERE cut) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY p) FILTER (WHERE NOT cut), '') AS k FROM marks GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""

_NIBBLE = "(strpos('0123456789abcdef', substr(h, {at}, 1)) - 1)"
_BASE32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((" + _NIBBLE.format(at="1 + (5 * i) // 4") + " * 16 + " + _NIBBLE.format(at="2 + (5 * i) // 4") + ") >> (3 - (5 * i) % 4)) & 31), 1)), '')"

ARCHIVES = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY 1)
SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN first < page_id THEN first END AS refers_to, CASE WHEN url <> '' THEN regexp_replace(url, '\\s+', '', 'g') END AS url
FROM p JOIN f USING (h)"""

TOP_K = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CASE WHEN len(q.e) <> len(c.e) THEN NULL WHEN len(q.e) = 0 THEN 0 ELSE list_dot_product(q.e, c.e) END::BIGINT AS score
    FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.r <> q.r)
SELECT query_id, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s WHERE score IS NOT NULL QUALIFY rank <= 20"""

#: Windows of 50 bytes, as hexadecimal pairs; a byte goes if one of the 50 windows that may cover it is a repeat.
SUFFIXES = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS w FROM documents),
bytes AS (SELECT r, doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
starts AS (SELECT r, doc_id, p, string_agg(x, '') OVER n AS s, count(*) OVER n AS n FROM bytes WINDOW n AS (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
firsts AS (SELECT s, min(doc_id) AS first FROM starts WHERE n = 50 GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT r, p FROM starts JOIN firsts USING (s) WHERE n = 50 AND first < doc_id),
each AS (SELECT e.r, e.p, x, h.p IS NOT NULL AS hit FROM bytes e LEFT JOIN hit h ON e.r = h.r AND e.p = h.p),
marks AS (SELECT r, p, x, bool_or(hit) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS cut FROM each),
runs AS (SELECT *, cut AND NOT coalesce(lag(cut) OVER (PARTITION BY r ORDER BY p), false) AS opens FROM marks),
kept AS (SELECT r, count(*) FILTER (WHERE cut) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans, coalesce(string_agg(x, '' ORDER BY p) FILTER (WHERE NOT cut), '') AS k FROM runs GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, ''))) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""

SCORES = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL), false) AS t FROM documents),
p AS (SELECT r, t, w[i] AS b, CASE WHEN i > 1 THEN w[i - 1] ELSE '' END AS a FROM (SELECT r, t, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
v AS (SELECT count(DISTINCT b) + 1 AS size, count(*) AS n, count(*) FILTER (WHERE t) AS nt FROM p),
pairs AS (SELECT a, b, count(*) AS pn, count(*) FILTER (WHERE t) AS pt FROM p GROUP BY ALL),
words AS (SELECT b, count(*) AS wn, count(*) FILTER (WHERE t) AS wt FROM p GROUP BY ALL),
contexts AS (SELECT a, count(*) AS cn, count(*) FILTER (WHERE t) AS ct FROM p GROUP BY ALL),
own AS (SELECT r, t, a, b, count(*) OVER (PARTITION BY r, a, b) AS po, count(*) OVER (PARTITION BY r, b) AS wo, count(*) OVER (PARTITION BY r, a) AS co, count(*) OVER (PARTITION BY r) AS o FROM p),
each AS (SELECT r, -ln((pn - po + 100 * (wn - wo + 1) / (n - o + size)) / (cn - co + 100)) AS lb,
    -ln((pt - po * t::INT + 100 * (wt - wo * t::INT + 1) / (nt - o * t::INT + size)) / (ct - co * t::INT + 100)) AS lt FROM own JOIN pairs USING (a, b) JOIN words USING (b) JOIN contexts USING (a), v),
s AS (SELECT r, avg(lt) AS lt, avg(lb) AS lb FROM each GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, round(lt, 8) AS loss_target, round(lb, 8) AS loss_background, round(lt - lb, 8) AS score FROM d LEFT JOIN s USING (r)"""
