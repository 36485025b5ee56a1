"""DuckDB SQL for the queries that SQL can express whole."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_WARC = """
WITH payload AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), seen AS (
    SELECT *, payload_bytes >= 100 AND page_id > min(page_id) OVER same AS again, min(page_id) OVER same AS first_id
    FROM payload WINDOW same AS (PARTITION BY payload_digest)
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first_id END AS refers_to
FROM seen
"""

_REPEATS = f"""
WITH docs AS (
    SELECT doc_id, {_WORDS} AS w FROM documents
), word AS (
    SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs
), windows AS (
    SELECT doc_id, i, sha256(array_to_string(w[i : i + 49], ' ')) AS h
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM docs)
), repeated AS (
    SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS first_id FROM windows) WHERE doc_id > first_id
), judged AS (
    SELECT doc_id, word, i, max(r.i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS removed
    FROM word LEFT JOIN repeated AS r USING (doc_id, i)
), by_doc AS (
    SELECT doc_id, count(*) FILTER (WHERE removed) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT removed) AS kept FROM judged GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs AS d LEFT JOIN by_doc USING (doc_id)
"""

_RULES = rf"""
WITH docs AS (
    SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
        [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
    FROM documents
), word AS (
    SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs
), top_word AS (
    SELECT doc_id, max(n) AS top FROM (SELECT doc_id, word, count(*) AS n FROM word GROUP BY ALL) GROUP BY doc_id
), windows AS (
    SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM docs)
), often AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows) WHERE n > 1
), covered AS (
    SELECT doc_id, count(DISTINCT i + apart) AS n_repeat_words FROM often, (SELECT unnest([0, 1, 2]) AS apart) GROUP BY doc_id
), counted AS (
    SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
        len(lines) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, coalesce(top, 0) AS top
    FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN top_word USING (doc_id)
), failed AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines OR word_chars NOT BETWEEN 2 * n_words AND 14 * n_words
        OR 2 * n_upper > word_chars OR top::DOUBLE / greatest(n_words, 1) > 0.3::DOUBLE) AS kept
FROM failed
"""

_VECTORS = """
WITH RECURSIVE usable AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0
), link AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM usable AS a JOIN usable AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reached AS (
    SELECT vec_id AS node, vec_id AS other FROM embeddings UNION SELECT node, b FROM reached JOIN link ON other = a
), component AS (
    SELECT node AS vec_id, min(other) AS component_id FROM reached GROUP BY node
), counted AS (
    SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM component LEFT JOIN counted USING (vec_id)
"""

ORACLES: dict[str, str] = {"op2_warc_index": _WARC, "op5_substring_dedup": _REPEATS, "op6_quality_rules": _RULES, "op10_embeddings": _VECTORS}
