"""DuckDB equivalents of the queries that SQL can state."""

from __future__ import annotations

# The words of a text, A-Z in lower case or as they stand, and the contract's windows of them.
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM_WORDS = f"regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_PLAIN_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

ORACLES: dict[str, str] = {}

ORACLES["op2_substring_dedup"] = f"""
WITH w AS (SELECT doc_id, {_PLAIN_WORDS} AS words FROM documents),
win AS (SELECT doc_id, p, array_to_string(words[p:p + 12], ' ') AS s FROM w, unnest(range(1, len(words) - 11)) AS u(p)),
least AS (SELECT s, min(doc_id) AS first_id FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, p + k AS at FROM win JOIN least USING (s), range(0, 13) AS r(k) WHERE first_id < doc_id),
kept AS (SELECT doc_id, string_agg(words[a], ' ' ORDER BY a) AS text, count(*) AS n FROM w, unnest(range(1, len(words) + 1)) AS u(a)
 WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = w.doc_id AND gone.at = a) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
 sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

ORACLES["op8_embedding_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT * FROM v WHERE len(e) > 0 AND list_count(e) = len(e) AND isfinite(list_sum(e)) AND (list_min(e) <> 0 OR list_max(e) <> 0)),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
label AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE link.a = v.vec_id) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN label USING (vec_id)"""

ORACLES["op9_decontaminate"] = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM_WORDS} AS words FROM benchmark),
d AS (SELECT doc_id, {_ALNUM_WORDS} AS words FROM documents),
item_win AS (SELECT DISTINCT item, least(10, len(words)) AS k, array_to_string(words[p:p + least(10, len(words)) - 1], ' ') AS s
 FROM i, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS u(p) WHERE len(words) > 0),
sizes AS (SELECT DISTINCT k FROM item_win),
doc_win AS (SELECT doc_id, k, p, array_to_string(words[p:p + k - 1], ' ') AS s FROM d, sizes, unnest(range(1, len(words) - k + 2)) AS u(p)),
hit AS (SELECT doc_id, p, k, item FROM doc_win JOIN item_win USING (k, s)),
place AS (SELECT DISTINCT doc_id, p + o AS at FROM hit, unnest(range(0, k)) AS u(o)),
counted AS (SELECT doc_id, count(*) AS n FROM place GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(counted.n, 0) AS BIGINT) AS n_hit,
 CAST(coalesce(named.n, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(counted.n, 0) > 0 AS contaminated
FROM d LEFT JOIN counted USING (doc_id) LEFT JOIN named USING (doc_id)"""

ORACLES["op12_topk_search"] = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT row_number() OVER () AS own, vec_id, list_transform(e, lambda x: floor(256 * x)) AS e FROM v
 WHERE len(e) > 0 AND list_count(e) = len(e) AND isfinite(list_sum(e))),
pair AS (SELECT a.own, a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
 FROM good a JOIN good b ON a.own <> b.own AND len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS place FROM pair)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 5"""

ORACLES["op13_lexical_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS own, doc_id, {_ALNUM_WORDS} AS words FROM documents),
total AS (SELECT count(*) FILTER (WHERE len(words) > 0) AS docs, CAST(sum(len(words)) AS BIGINT) AS terms FROM d),
wanted AS (SELECT DISTINCT item_id, unnest({_ALNUM_WORDS}) AS term FROM benchmark),
tf AS (SELECT own, doc_id, len(words) AS n, term, count(*) AS tf FROM d, unnest(words) AS u(term)
 WHERE term IN (SELECT term FROM wanted) GROUP BY own, doc_id, len(words), term),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
 FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
gain AS (SELECT own, doc_id, tf.term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // terms)))) AS g
 FROM tf JOIN weight USING (term), total),
scored AS (SELECT item_id, own, doc_id, CAST(sum(g) AS BIGINT) AS score FROM wanted JOIN gain USING (term) GROUP BY item_id, own, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scored WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 50"""
