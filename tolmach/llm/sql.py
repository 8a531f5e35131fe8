"""DuckDB SQL of the queries that SQL can say, over whole tables.

That of p3 says the rules for characters and for words of two scripts; words that are
wholly another script's letters are beyond it, and the tables hold none. The rest (p4,
p7, p9) is tested against brute force and case by case in ``tests/llm``.
"""

_WORDS = "list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+'))"

_CANON = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_COPIES = f"""
WITH records AS (
    SELECT 'segments' AS tbl, id, {_CANON.format("source_text")} AS k FROM segments
    UNION ALL SELECT 'tm_entries', id, {_CANON.format("source_text")} FROM tm_entries
), feed AS (
    SELECT 'tm_feed' AS tbl, feed_id AS id,
           array_to_string(list_sort(list_transform(json_keys(payload), lambda f: lower(f) || chr(31) || {_CANON.format("(payload ->> f)")})), chr(30)) AS k
    FROM tm_feed WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'
), groups AS (
    SELECT DISTINCT tbl, id, min(id) OVER (PARTITION BY tbl, k) AS rep FROM (SELECT * FROM records WHERE length(k) >= 40 UNION ALL SELECT * FROM feed)
)"""
_LATIN, _OTHER = r"[A-Za-z\x{c0}-\x{24f}]", r"[\x{370}-\x{52f}]"
_GREEK, _CYRILLIC = r"[\x{370}-\x{3ff}]", r"[\x{400}-\x{52f}]"
_HIDDEN = r"[\p{Cf}\x{34f}\x{115f}\x{1160}\x{3164}\x{fe00}-\x{fe0f}\x{ffa0}]"

SQL = {
    "p3_found": rf"""
WITH t AS (
    SELECT 'segments' AS tbl, id, target_text AS x FROM segments UNION ALL SELECT 'glossary_terms', id, target_term FROM glossary_terms
), c AS (SELECT tbl, id, x, regexp_replace(x, '([\x{{1f000}}-\x{{1ffff}}\x{{2600}}-\x{{27bf}}])\x{{200d}}([\x{{1f000}}-\x{{1ffff}}\x{{2600}}-\x{{27bf}}])', '\1\2', 'g') AS y FROM t)
SELECT DISTINCT tbl, id FROM c
WHERE regexp_matches(x, '[\x{{ff01}}-\x{{ff5e}}\x{{ffe0}}-\x{{ffe6}}\x{{fb00}}-\x{{fb06}}]') OR regexp_matches(y, '{_HIDDEN}')
   OR regexp_matches(x, '[\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x{{85}}\x{{b}}\x{{c}}]')
   OR nfc_normalize(x) <> x
   OR regexp_matches(regexp_replace(y, '{_HIDDEN}', '', 'g'), '{_LATIN}{_OTHER}|{_OTHER}{_LATIN}|{_GREEK}{_CYRILLIC}|{_CYRILLIC}{_GREEK}')
""",
    "p5_found": f"{_COPIES} SELECT tbl, rep AS id_a, id AS id_b FROM groups WHERE rep <> id",
    "p5_counts": f"{_COPIES} SELECT tbl, rep AS id, count(*) AS copies FROM groups GROUP BY 1, 2 HAVING count(*) > 1",
    "p1_found": f"""
WITH rows_of AS (
    SELECT DISTINCT 'segments' AS tbl, id, {_WORDS.format("source_text")} AS ws FROM segments
    UNION ALL
    SELECT DISTINCT 'tm_entries', id, {_WORDS.format("source_text")} FROM tm_entries
), long_rows AS (SELECT * FROM rows_of WHERE len(ws) >= 8),
each AS (SELECT tbl, id, len(ws) AS n, unnest(ws) AS w FROM long_rows),
shared AS (
    SELECT a.tbl, a.id AS id_a, b.id AS id_b, a.n AS na, b.n AS nb, count(*) AS s
    FROM each a JOIN each b ON a.tbl = b.tbl AND a.w = b.w AND a.id < b.id
    WHERE a.n >= 0.7 * b.n AND b.n >= 0.7 * a.n
    GROUP BY ALL
)
SELECT tbl, id_a, id_b FROM shared WHERE s >= 0.7 * (na + nb - s) - 1e-9
""",
    "p1_classes": f"""
WITH rows_of AS (
    SELECT DISTINCT 'segments' AS tbl, id, list_sort({_WORDS.format("source_text")}) AS ws FROM segments
    UNION ALL
    SELECT DISTINCT 'tm_entries', id, list_sort({_WORDS.format("source_text")}) FROM tm_entries
), sets AS (SELECT tbl, ws, min(id) AS rep, count(*) AS copies FROM rows_of WHERE len(ws) >= 8 GROUP BY 1, 2),
each AS (SELECT tbl, rep, len(ws) AS n, unnest(ws) AS w FROM sets),
shared AS (
    SELECT a.tbl, a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS s
    FROM each a JOIN each b ON a.tbl = b.tbl AND a.w = b.w AND a.rep <> b.rep
    WHERE a.n >= 0.7 * b.n AND b.n >= 0.7 * a.n
    GROUP BY ALL
), links AS (SELECT tbl, a AS rep, count(*) AS links FROM shared WHERE s >= 0.7 * (na + nb - s) - 1e-9 GROUP BY 1, 2)
SELECT r.tbl, r.id, s.rep, s.copies, coalesce(l.links, 0) AS links
FROM rows_of r JOIN sets s ON s.tbl = r.tbl AND s.ws = r.ws LEFT JOIN links l ON l.tbl = s.tbl AND l.rep = s.rep
WHERE s.copies > 1 OR l.links > 0
""",
    "p2_found": """
WITH v AS (
    SELECT DISTINCT id, embedding::DOUBLE[] AS e FROM tm_entries
    WHERE len(embedding) = 384 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0
), pairs AS (
    SELECT a.id, b.id AS other, round(list_cosine_similarity(a.e, b.e), 9) AS cos
    FROM v a JOIN v b ON a.id <> b.id
), best AS (
    SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY cos DESC, other) AS place FROM pairs WHERE cos >= 0.8
)
SELECT DISTINCT least(id, other) AS id_a, greatest(id, other) AS id_b FROM best WHERE place <= 5
""",
    "p6_found": r"""
WITH marked AS (
    SELECT *,
           coalesce(regexp_replace(target_text, '[\s\p{Z}\p{Cf}\p{Cc}\x{34f}\x{115f}\x{1160}\x{3164}\x{fe00}-\x{fe0f}\x{ffa0}]+', '', 'g') <> '', false) AS filled,
           coalesce(lower(trim(status)) = 'approved', false)::INT AS appr,
           lower(regexp_replace(coalesce(reviewed_by, ''), '[^\p{L}\p{N}]', '', 'g')) AS who
    FROM segments
), several AS (
    SELECT file_id, unit_key, form_index FROM segments GROUP BY ALL HAVING count(DISTINCT id) > 1
), target AS (
    SELECT file_id, unit_key, form_index, 'target_text' AS field, id,
           row_number() OVER (PARTITION BY file_id, unit_key, form_index ORDER BY appr DESC, updated_at DESC NULLS LAST, id DESC) AS r
    FROM marked WHERE filled
), review AS (
    SELECT file_id, unit_key, form_index, 'review' AS field, id,
           row_number() OVER (PARTITION BY file_id, unit_key, form_index ORDER BY reviewed_at DESC, id DESC) AS r
    FROM marked
    WHERE who NOT IN ('', 'na', 'none', 'null', 'nil', 'unknown', 'nobody', 'noone', 'tbd', 'todo', 'anonymous', 'unassigned')
      AND reviewed_at >= TIMESTAMP '2015-01-01' AND reviewed_at < TIMESTAMP '2026-07-01'
)
SELECT file_id, unit_key, form_index, field, id
FROM (SELECT * FROM target UNION ALL SELECT * FROM review) x JOIN several USING (file_id, unit_key, form_index)
WHERE r = 1
""",
    "p8_found": r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents
), i AS (
    SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM eval_items
), dg AS (
    SELECT doc_id, array_to_string(ws[k:k + 11], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 10)) AS k FROM d WHERE len(ws) >= 12)
), ig AS (
    SELECT item_id, array_to_string(ws[k:k + 11], ' ') AS g FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 10)) AS k FROM i WHERE len(ws) >= 12)
)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
""",
}
