"""DuckDB SQL for the operators that SQL can express. Tables are those of the tests: doc_id, page_id and vec_id are keys."""

from __future__ import annotations

from . import centroids, variants
from .mixing import ORACLE_SQL as MIXING

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WALK = "walk AS (SELECT id, id AS reached FROM nodes UNION SELECT walk.id, l.b FROM walk JOIN near l ON walk.reached = l.a), comp AS (SELECT id, min(reached) AS component_id FROM walk GROUP BY id)"

SUBSTRINGS = f"""
WITH w AS (SELECT doc_id, coalesce({_WORDS.format('text')}, []) AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS k FROM w, unnest(generate_series(1, len(ws) - 34)) t(i)),
dup AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY k) > 1),
cov AS (SELECT DISTINCT doc_id, i + j AS p FROM dup, range(35) r(j)),
gone AS (SELECT doc_id, count(*) AS n FROM cov GROUP BY doc_id),
word AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM word ANTI JOIN cov USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

NGRAMS = f"""
WITH RECURSIVE w AS (SELECT doc_id AS id, coalesce({_WORDS.format(_LOWER)}, []) AS ws FROM documents),
s AS (SELECT DISTINCT id, array_to_string(ws[i:i + 2], ' ') AS g FROM w, unnest(generate_series(1, greatest(len(ws) - 2, least(len(ws), 1)))) t(i)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
pairs AS (SELECT x.id AS a, y.id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.id <> y.id GROUP BY ALL),
near AS (SELECT a, b FROM pairs JOIN n p ON a = p.id JOIN n q ON b = q.id WHERE 100 * o >= 90 * (p.n + q.n - o)),
nodes AS (SELECT id FROM w), {_WALK}
SELECT id AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM comp LEFT JOIN n USING (id)
"""

WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) || '00' AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS largest FROM pages)
SELECT page_id, payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * k // 4 + 1, 3))::INT >> (7 - 5 * k % 4)) & 31) + 1, 1) FOR k IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> largest THEN largest END AS refers_to FROM p
"""

EMBEDDINGS = f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
near AS (SELECT x.id AS a, y.id AS b FROM ok x JOIN ok y ON x.id <> y.id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.9),
n AS (SELECT a AS id, count(*) AS n FROM near GROUP BY a), nodes AS (SELECT id FROM v), {_WALK}
SELECT id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, id = component_id AS kept FROM comp LEFT JOIN n USING (id)
"""

ORACLE_SQL = {"op2_substring_dedup": SUBSTRINGS, "op3_ngram_jaccard": NGRAMS, "op5_source_mixing": MIXING, "op8_warc": WARC, "op9_embedding_near_dedup": EMBEDDINGS, "op11_centroid_clustering": centroids.oracle_sql(), "op13_spelling_variants": variants.ORACLE_SQL}
