"""DuckDB statements of the rows of those queries that SQL can express on whole tables."""

from __future__ import annotations

ORACLE_SQL: dict[str, str] = {
    "op7_substring_dedup": r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 win AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w)),
 rep AS (SELECT doc_id, s FROM win QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, s) > 1),
 cov AS (SELECT DISTINCT doc_id, s + k AS pos FROM rep, (SELECT unnest(range(0, 20)) AS k)),
 word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
 kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM word ANTI JOIN cov USING (doc_id, pos) GROUP BY doc_id)
 SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op10_minmax_near_dedup": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 sets AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) > 1 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS g FROM w),
 each AS (SELECT doc_id, unnest(g) AS s FROM sets), ids AS (SELECT s, dense_rank() OVER (ORDER BY s) AS sid, doc_id FROM each),
 pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM ids a JOIN ids b ON a.sid = b.sid AND a.doc_id < b.doc_id GROUP BY ALL),
 link AS (SELECT a, b FROM pair JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * c >= 80 * (len(x.g) + len(y.g) - c)),
 edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
 reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b)
 SELECT doc_id, len(g)::BIGINT AS n_shingles, min(b) AS component_id, min(b) = doc_id AS kept FROM sets JOIN reach ON reach.a = doc_id GROUP BY doc_id, g""",
    "op2_nn_descent_dedup": r"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), ok AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
 edge AS (SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.95),
 reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b), n AS (SELECT a, count(*) AS n FROM edge GROUP BY a)
 SELECT vec_id, coalesce(any_value(n.n), 0)::BIGINT AS n_links, min(r.b) AS component_id, min(r.b) = vec_id AS kept FROM v JOIN reach r ON r.a = vec_id LEFT JOIN n ON n.a = vec_id GROUP BY vec_id""",
}
