"""DuckDB SQL of the catalogue's queries, where SQL can say them."""

from __future__ import annotations

from ..functions.text import _KNOWN, ALLOWANCE, ASKING_STATES, LEAST_BUDGET, LONGEST_ALLOWANCE
from ..kernels.markup import PERCENT
from ..schema import STATUSES
from .fixtures import QTTS, XLIFF

#: White space of any kind, in RE2.
_WS = r"[\s\v\x{85}\p{Z}]"
_SEG = "SELECT DISTINCT * FROM segments"
_APPROVED = "SELECT s.*, f.project_id FROM seg s JOIN files f ON f.id = s.file_id WHERE s.status = 'approved' AND s.target_text <> ''"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _blank(x: str) -> str:
    return f"coalesce({_trim(x)} = '', true)"


def _normal(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'))"


def _quote(x: str) -> str:
    """A text in double quotes; what is not printable is escaped."""
    code = "lower(to_hex(ord(c)))"
    named = " ".join(f"WHEN {n} THEN '\\{c}'" for n, c in ((7, "a"), (8, "b"), (9, "t"), (10, "n"), (11, "v"), (12, "f"), (13, "r")))
    odd = f"CASE ord(c) {named} ELSE CASE WHEN ord(c) < 128 THEN '\\x' || lpad({code}, 2, '0') WHEN ord(c) < 65536 THEN '\\u' || lpad({code}, 4, '0') ELSE '\\U' || lpad({code}, 8, '0') END END"
    each = f"list_transform(string_split({x}, ''), lambda c: CASE WHEN c IN ('\"', '\\') THEN '\\' || c WHEN regexp_matches(c, '[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{P}}\\p{{S}} ]') THEN {odd} ELSE c END)"
    return f"""'"' || array_to_string({each}, '') || '"'"""


_ATTRS = r"""(?:\s+[A-Za-z_:][\w:.-]*\s*=\s*(?:"[^"<]*"|''[^''<]*''))*\s*"""


def _broken(x: str) -> str:
    """Markup that is not well-formed, as far as the tables hold any: bad tags, unpaired elements, bare ampersands."""
    rest = f"regexp_replace({x}, '<[A-Za-z]+{_ATTRS}/?>|</[A-Za-z]+\\s*>', '', 'g')"
    opened = f"list_sort(regexp_extract_all({x}, '<([A-Za-z]+){_ATTRS}>', 1))"
    closed = f"list_sort(regexp_extract_all({x}, '</([A-Za-z]+)\\s*>', 1))"
    return f"(contains({rest}, '<') OR {opened} <> {closed} OR contains(regexp_replace({x}, '&(?:#[0-9]+|#x[0-9a-fA-F]+|{_KNOWN});', '', 'g'), '&'))"


def _plain(x: str) -> str:
    bare = f"replace(replace(regexp_replace({x}, '<[^<>]*>', '', 'g'), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    for name, c in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("nbsp", "\u00a0"), ("amp", "&")):
        bare = f"replace({bare}, '&{name};', '{c}')"
    return f"CASE WHEN {_broken(x)} THEN {x} ELSE {bare} END"


#: A group of braces: doubled, or closed at the same depth (up to three deep, as the tables hold them).
_GROUP = r"\{\{.*?\}\}|\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}"


def _percent(x: str) -> str:
    return f"list_filter(regexp_extract_all({x}, '({PERCENT['generic']})', 1), lambda v: v <> '%%')"


def _named(g: str) -> str:
    """The placeholder that a brace group stands for, or an empty text."""
    return rf"""CASE
        WHEN starts_with({g}, '{{{{') THEN CASE WHEN regexp_matches({g}, '^\{{\{{\s*[A-Za-z_][A-Za-z0-9_.]*\s*\}}\}}$') THEN '{{{{' || {_trim(f"{g}[3:-3]")} || '}}}}' ELSE '' END
        WHEN regexp_matches({g}, '^\{{(?:[A-Za-z_][A-Za-z0-9_.]*|[0-9]+)\}}$') THEN {g}
        WHEN regexp_matches({g}, '^\{{\s*[A-Za-z_][A-Za-z0-9_.]*\s*,') THEN '{{' || regexp_extract({g}, '([A-Za-z_][A-Za-z0-9_.]*)', 1) || '}}' ELSE '' END"""


def _text_names(plain: str, dialect: str) -> str:
    """Placeholders of visible text in order: groups of braces and the percent family in one pass."""
    found = f"regexp_extract_all({plain}, '(?s)({_GROUP}|{PERCENT[dialect]})', 1)"
    return f"list_filter(list_transform({found}, lambda g: CASE WHEN starts_with(g, '{{') THEN {_named('g')} WHEN g = '%%' THEN '' ELSE g END), lambda g: g <> '')"


def _inline(x: str) -> str:
    """Inline elements in order; of malformed markup those before the first bare ampersand or bad tag."""
    good = rf"""regexp_extract({x}, '(?s)^(?:[^<&]|&(?:#[0-9]+|#x[0-9a-fA-F]+|{_KNOWN});|<[A-Za-z]+{_ATTRS}/?>|</[A-Za-z]+\s*>)*')"""
    tags = rf"regexp_extract_all({good}, '<(?:x|bx|ex|g|ph|bpt|ept|it)(?:\s[^<>]*)?/?>')"
    name = "'<' || regexp_extract(t, '^<([a-z]+)', 1)"
    return rf"""list_transform({tags}, lambda t: CASE WHEN regexp_matches(t, '\sid="[^"]+"') THEN {name} || ' id="' || regexp_extract(t, '\sid="([^"]+)"', 1) || '">' ELSE {name} || '>' END)"""


def _placeholders(x: str, dialect: str) -> str:
    return f"list_concat({_inline(x)}, {_text_names(_plain(x), dialect)})"


def _key(*parts: str) -> str:
    return f"substr(sha256(concat_ws(chr(31), {', '.join(parts)})), 1, 24)"


def _literal(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _rewritten(text: str, *changes: tuple[str, str]) -> str:
    """A file's text with each part replaced."""
    made = _literal(text)
    for old, new in changes:
        made = f"replace({made}, {_literal(old)}, {_literal(new)})"
    return made


def _minus(a: str, b: str) -> str:
    return f"flatten(list_transform(list_sort(list_distinct({a})), lambda v: list_resize([]::VARCHAR[], greatest(0, len(list_filter({a}, lambda w: w = v)) - len(list_filter({b}, lambda w: w = v))), v)))"


_STATS = f"""
stats AS (
    SELECT file_id, count(*) AS total, {", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in STATUSES)},
           coalesce(sum(e), 0)::BIGINT AS errors, coalesce(sum(w), 0)::BIGINT AS warnings
    FROM seg LEFT JOIN (
        SELECT segment_id, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS w FROM qa_issues GROUP BY 1
    ) q ON q.segment_id = seg.id GROUP BY 1
)"""
_COUNTS = ["total", *STATUSES, "errors", "warnings"]
_ALLOW = "CASE " + " ".join(f"WHEN m <= {n} THEN {f}::DOUBLE" for n, f in ALLOWANCE) + f" ELSE {LONGEST_ALLOWANCE}::DOUBLE END"
_NATIVE = str(ASKING_STATES)
_LATEST_SEG = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id, unit_key, form_index ORDER BY updated_at DESC, id DESC) AS r FROM (SELECT DISTINCT * FROM segments)) WHERE r = 1)"
_SEMANTIC = """
q AS (SELECT id AS query_id, project_id, target_locale, source_hash, embedding FROM tm_entries WHERE id % 50 = 0),
usable AS (SELECT *, embedding::DOUBLE[] AS e FROM tm_entries WHERE len(embedding) = 384 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
    SELECT q.query_id, u.id, u.target_text, round(list_cosine_similarity(q.embedding::DOUBLE[], u.e), 9) AS score
    FROM q JOIN usable u USING (project_id, target_locale)
    WHERE len(q.embedding) = 384 AND len(list_filter(q.embedding, lambda x: x <> 0)) > 0 AND q.source_hash IS DISTINCT FROM u.source_hash
),
semantic AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM scored) WHERE place <= 5 AND score >= 0.6),
exact AS (
    SELECT * FROM (
        SELECT q.query_id, t.id, t.target_text, 1.0::DOUBLE AS score, row_number() OVER (PARTITION BY q.query_id ORDER BY t.created_at DESC, t.id DESC) AS place
        FROM q JOIN tm_entries t USING (project_id, target_locale, source_hash)
    ) WHERE place <= 5
)"""

_DIFF = f"""
p AS (
    SELECT s.id, f.id IS NOT NULL AS known, CASE WHEN f.format = 'qtts' THEN {_placeholders("source_text", "qt")} ELSE {_placeholders("source_text", "generic")} END AS a,
           CASE WHEN f.format = 'qtts' THEN {_placeholders("target_text", "qt")} ELSE {_placeholders("target_text", "generic")} END AS b
    FROM seg s LEFT JOIN files f ON f.id = s.file_id WHERE NOT {_blank("target_text")}
), d AS (SELECT id, known, array_to_string({_minus("a", "b")}, ' ') AS missing, array_to_string({_minus("b", "a")}, ' ') AS extra FROM p)"""
_LONG = f"""
sizes AS (
    SELECT s.id, length({_plain("s.source_text")}) AS m, length({_plain("s.target_text")}) AS n, coalesce(s.max_width, 0) AS w, coalesce(p.length_tolerance::DOUBLE, 1) AS tol
    FROM seg s JOIN files f ON f.id = s.file_id JOIN projects p ON p.id = f.project_id WHERE NOT {_blank("s.target_text")}
), budgets AS (SELECT *, trunc(greatest(m * {_ALLOW}, {LEAST_BUDGET}::DOUBLE) * tol)::INT AS budget FROM sizes), long AS (
    SELECT id, CASE WHEN w > 0 THEN 'error' ELSE 'warning' END AS severity,
           CASE WHEN w > 0 THEN 'over the ' || w || ' character budget declared for this string (' || n || ' characters)'
                ELSE n || ' characters against a ' || budget || ' character budget for a ' || m || ' character source' END AS message
    FROM budgets WHERE (w > 0 AND n > w) OR (w <= 0 AND tol > 0 AND n > budget)
)"""
_TERMS = rf"""
seen AS (
    SELECT s.id, f.project_id, {_plain("s.source_text")} AS source, {_plain("s.target_text")} AS target FROM seg s JOIN files f ON f.id = s.file_id WHERE NOT {_blank("target_text")}
), c AS (
    SELECT seen.id, g.source_term AS st, g.target_term AS tt, CASE WHEN g.case_sensitive THEN source ELSE lower(source) END AS s, CASE WHEN g.case_sensitive THEN target ELSE lower(target) END AS t,
           CASE WHEN g.case_sensitive THEN g.source_term ELSE lower(g.source_term) END AS a, CASE WHEN g.case_sensitive THEN g.target_term ELSE lower(g.target_term) END AS b
    FROM seen JOIN glossary_terms g USING (project_id) WHERE g.source_term <> '' AND g.target_term <> ''
), unmet AS (
    SELECT id, 'glossary: ' || {_quote("st")} || ' should be translated as ' || {_quote("tt")} AS message FROM c
    WHERE contains(s, a) AND regexp_matches(s, '(^|[^\p{{L}}\p{{Nd}}_])' || regexp_escape(a))
      AND NOT (contains(t, b) AND regexp_matches(t, '(^|[^\p{{L}}\p{{Nd}}_])' || regexp_escape(b)))
)"""
_OTHERS = f"""
a AS ({_APPROVED}), v AS (SELECT DISTINCT project_id, source_text, target_text FROM a),
o AS (
    SELECT s.id, {_trim("v.target_text")} AS t FROM seg s JOIN files f ON f.id = s.file_id JOIN v ON v.project_id = f.project_id AND v.source_text = s.source_text
    WHERE NOT {_blank("s.target_text")} AND NOT {_blank("v.target_text")} AND {_trim("v.target_text")} <> {_trim("s.target_text")}
), l AS (SELECT id, list_sort(list(t)) AS ts FROM o GROUP BY 1), others AS (
    SELECT id, 'the same source string is approved elsewhere as ' || array_to_string(list_transform(ts[1:3], lambda x: {_quote("x")}), ', ')
           || CASE WHEN len(ts) > 3 THEN ' and ' || (len(ts) - 3) || ' more' ELSE '' END AS message FROM l
)"""
_KEYS = {"open": _key("'xliff'", "'app.ui'", "'open'"), "zoom": _key("'xliff'", "'app.ui'", "'zoom'"), "later": _key("'xliff'", "'app.ui'", "'later'"), "count": _key("'ts'", "'Main'", "'%n file(s)'", "'count'"), "quit": _key("'ts'", "'Main'", "'Quit'", "''"), "about": _key("'ts'", "'Main'", "'untouched'", "''")}
_LATER = """Add &amp; <g id="1">close</g>"""
_WRITTEN = {  # the parts of the two files that the updates of the fixtures change, and into what
    1: (XLIFF, [('<target state="new"/>', '<target state="needs-review-translation">%1 von %2 öffnen</target>'), (' id="later"', ' id="later" approved="yes"'),
                (f"<source>{_LATER}</source>", f'<source>{_LATER}</source>\n        <target state="translated">Hinzufügen &amp; <g id="1">schließen</g></target>')]),
    2: (QTTS, [('<translation type="unfinished"><numerusform>%n Datei</numerusform><numerusform>%n Dateien</numerusform></translation>', "<translation><numerusform>eine Datei</numerusform><numerusform>%n Dateien</numerusform></translation>"),
               ("<source>About &lt;b&gt;us&lt;/b&gt;</source>", '<source>About &lt;b&gt;us&lt;/b&gt;</source>\n        <translation type="unfinished">Über</translation>')]),
}


def _span(file: int, part: str, offset: int, old: str, new: str) -> str:
    """The bytes (start, end, new_length) that a change of ``old`` into ``new`` covers, ``offset`` characters into ``part``."""
    before = f"strlen(substr({_literal(_WRITTEN[file][0])}, 1, instr({_literal(_WRITTEN[file][0])}, {_literal(part)}) + {offset - 1}))"
    return f"SELECT {file}::BIGINT AS file_id, {before}::INT AS start, ({before} + strlen({_literal(old)}))::INT AS \"end\", strlen({_literal(new)})::INT AS new_length"


_SPANS = " UNION ALL ".join([
    _span(1, _WRITTEN[1][1][0][0], 0, *_WRITTEN[1][1][0]), _span(1, ' id="later"', 0, *_WRITTEN[1][1][1]), _span(1, _WRITTEN[1][1][2][0], len(_WRITTEN[1][1][2][0]), "", _WRITTEN[1][1][2][1][len(_WRITTEN[1][1][2][0]) :]),
    _span(2, _WRITTEN[2][1][0][0], 0, *_WRITTEN[2][1][0]), _span(2, _WRITTEN[2][1][1][0], len(_WRITTEN[2][1][1][0]), "", _WRITTEN[2][1][1][1][len(_WRITTEN[2][1][1][0]) :]),
])

SQL: dict[str, str] = {
    "q_file_stats": f"WITH seg AS ({_SEG}), {_STATS} SELECT * FROM stats",
    "q_files_with_stats": f"WITH seg AS ({_SEG}), {_STATS} SELECT f.id AS file_id, f.project_id, f.name, {', '.join(f'coalesce({c}, 0)::BIGINT AS {c}' for c in _COUNTS)} FROM files f LEFT JOIN stats s ON s.file_id = f.id",
    "q_segments_page": f"WITH seg AS ({_SEG}) SELECT id, file_id, source_text FROM seg WHERE status = 'approved' AND (source_text ILIKE '%the file%' OR target_text ILIKE '%the file%') ORDER BY id LIMIT 50 OFFSET 10",
    "q_segments_literal_search": f"WITH seg AS ({_SEG}) SELECT count(*) AS total FROM seg WHERE contains(lower(source_text), '100%') OR contains(lower(target_text), '100%')",
    "q_segments_with_issues": f"WITH seg AS ({_SEG}) SELECT id, file_id, status FROM seg WHERE EXISTS (SELECT 1 FROM qa_issues q WHERE q.segment_id = seg.id)",
    "q_segment_issue_lists": f"""
WITH seg AS ({_SEG}), l AS (
    SELECT segment_id, count(*) AS n, string_agg(kind || '|' || message, ' / ' ORDER BY ordinal, kind, severity, message) AS listed FROM qa_issues GROUP BY 1
) SELECT id, coalesce(n, 0)::INT AS n, coalesce(listed, '') AS listed FROM seg LEFT JOIN l ON l.segment_id = seg.id""",
    "q_approved_by_source": f"WITH seg AS ({_SEG}), a AS ({_APPROVED}) SELECT project_id, source_text, array_to_string(list_sort(list(DISTINCT target_text)), chr(10)) AS variants FROM a GROUP BY 1, 2",
    "q_inconsistent_sources": f"""
WITH seg AS ({_SEG}), a AS ({_APPROVED}), g AS (SELECT project_id, source_text, list_sort(list(DISTINCT target_text)) AS v FROM a GROUP BY 1, 2)
SELECT project_id, {_plain("source_text")} AS source_plain, len(v)::INT AS n, array_to_string(v, chr(10)) AS variants FROM g WHERE len(v) > 1""",
    "q_plain_text": f"WITH seg AS ({_SEG}) SELECT id, {_plain('source_text')} AS plain FROM seg",
    "q_fragment_errors": f"WITH seg AS ({_SEG}) SELECT id, {_broken('target_text')} AS broken FROM seg WHERE target_text IS NOT NULL",
    "q_inline_placeholders": f"WITH seg AS ({_SEG}) SELECT id, coalesce(array_to_string({_inline('target_text')}, ' '), '') AS found FROM seg",
    "q_brace_placeholders": rf"""
WITH seg AS ({_SEG}), e AS (SELECT id, {_text_names(_plain("source_text"), "generic")} AS names FROM seg)
SELECT id, array_to_string(list_filter(names, lambda x: starts_with(x, '{{')), ' ') AS found FROM e""",
    "q_placeholders": f"""
WITH seg AS ({_SEG}) SELECT id, array_to_string({_placeholders("source_text", "generic")}, ' ') AS generic, array_to_string({_placeholders("source_text", "qt")}, ' ') AS qt FROM seg""",
    "q_first_inconsistent_sources": f"WITH seg AS ({_SEG}), a AS ({_APPROVED}) SELECT project_id, source_text, count(DISTINCT target_text)::INT AS n FROM a GROUP BY 1, 2 HAVING n > 1 ORDER BY source_text, project_id LIMIT 20",
    "q_other_approved": f"""
WITH seg AS ({_SEG}), a AS ({_APPROVED}), every AS (SELECT s.id, f.project_id, s.source_text FROM seg s JOIN files f ON f.id = s.file_id)
SELECT DISTINCT e.id, a.target_text FROM every e JOIN a ON a.project_id = e.project_id AND a.source_text = e.source_text AND a.id <> e.id""",
    "q_issue_totals": "SELECT kind, severity, count(*) AS n FROM qa_issues GROUP BY 1, 2",
    "q_project_tm_counts": "SELECT p.id, p.name, count(t.id) AS entries FROM projects p LEFT JOIN tm_entries t ON t.project_id = p.id GROUP BY 1, 2",
    "q_tm_by_locale": "SELECT project_id, target_locale, count(*) AS entries, count(DISTINCT source_hash) AS sources FROM tm_entries GROUP BY 1, 2",
    "q_normalize_hash": f"SELECT doc_id, sha256({_normal('text')}) AS h FROM documents",
    "q_normalize_fragment": rf"""
WITH seg AS ({_SEG})
SELECT id, replace(regexp_replace(replace(source_text, '&', chr(1)), '\x01((?:#[0-9]+|#x[0-9a-fA-F]+|{_KNOWN});)', '&\1', 'g'), chr(1), '&amp;') AS fixed FROM seg""",
    "q_unit_keys": f"""
WITH seg AS ({_SEG}), k AS (
    SELECT id, file_id, substr(sha256(concat_ws(chr(31), 'ts', coalesce(context, ''), coalesce(source_text, ''), '')), 1, 24) AS k FROM seg
), n AS (SELECT id, k, row_number() OVER (PARTITION BY file_id, k ORDER BY id) - 1 AS n FROM k)
SELECT id, CASE WHEN n > 0 THEN k || '-' || n ELSE k END AS unit_key FROM n""",
    "q_percent_placeholders": f"WITH seg AS ({_SEG}) SELECT id, array_to_string({_percent(_plain('source_text'))}, ' ') AS found FROM seg",
    "q_placeholder_kinds": f"""
WITH seg AS ({_SEG}), e AS (SELECT unnest({_percent(_plain("source_text"))}) AS name FROM seg)
SELECT name, CASE WHEN regexp_matches(name, '^%(L?[0-9]{{1,2}}|n)$') THEN 'qt' ELSE 'printf' END AS kind, count(*) AS n FROM e GROUP BY 1, 2""",
    "q_placeholder_diff": f"WITH seg AS ({_SEG}), {_DIFF} SELECT id, missing, extra FROM d WHERE missing <> '' OR extra <> ''",
    "q_length_check": f"WITH seg AS ({_SEG}), {_LONG} SELECT id, severity, message FROM long",
    "q_terminology": f"WITH seg AS ({_SEG}), {_TERMS} SELECT id, count(*) AS n, min(message) AS first_message FROM unmet GROUP BY 1",
    "q_consistency_warnings": f"WITH seg AS ({_SEG}), {_OTHERS} SELECT id, message FROM others",
    "q_recheck": f"""
WITH seg AS ({_SEG}), {_DIFF}, {_LONG}, {_TERMS}, {_OTHERS}, every AS (
    SELECT 'placeholder' AS kind, 'error' AS severity FROM d WHERE known AND (missing <> '' OR extra <> '')
    UNION ALL SELECT 'length', severity FROM long
    UNION ALL SELECT 'terminology', 'warning' FROM unmet
    UNION ALL SELECT 'inconsistency', 'warning' FROM others
) SELECT kind, severity, count(*) AS n FROM every GROUP BY 1, 2""",
    "q_blocked_segments": f"""
WITH seg AS ({_SEG}), e AS (SELECT segment_id, message, row_number() OVER (PARTITION BY segment_id ORDER BY ordinal, kind, severity, message) AS r FROM qa_issues WHERE severity = 'error')
SELECT seg.id, e.message AS reason FROM seg JOIN e ON e.segment_id = seg.id WHERE r = 1""",
    "q_exact_matches": f"WITH {_SEMANTIC} SELECT query_id, id, target_text, place FROM exact",
    "q_semantic_matches": f"WITH {_SEMANTIC} SELECT query_id, id, place, round(score, 6) AS score FROM semantic",
    "q_suggest_merge": f"""
WITH {_SEMANTIC}, joined AS (
    SELECT query_id, id, target_text, 'exact' AS kind, score, place, 0 AS grp FROM exact
    UNION ALL SELECT query_id, id, target_text, 'semantic', score, place, 1 FROM semantic
), once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, target_text ORDER BY grp, score DESC, place, id) AS n FROM joined) WHERE n = 1)
SELECT query_id, rank, id, kind, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grp, score DESC, place, id) AS rank FROM once) WHERE rank <= 5""",
    "q_first_per_pair": f"""
WITH seg AS ({_SEG}), h AS (SELECT id, unit_key, form_index, target_text, sha256({_normal("source_text")}) AS h FROM seg WHERE status = 'approved' AND form_index = 0 AND target_text <> '')
SELECT id, h FROM (SELECT *, row_number() OVER (PARTITION BY h, target_text ORDER BY unit_key, form_index, id) AS n FROM h) WHERE n = 1""",
    "q_upsert_latest": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "q_tm_upsert": "SELECT id, project_id, approved_by FROM (SELECT *, row_number() OVER (PARTITION BY project_id, target_locale, source_hash, target_text ORDER BY created_at DESC, id DESC) AS n FROM tm_entries) WHERE n = 1",
    "q_glossary_upsert": "SELECT project_id, trim(source_term) AS term, id, target_term FROM (SELECT *, row_number() OVER (PARTITION BY project_id, trim(source_term) ORDER BY id DESC) AS n FROM glossary_terms) WHERE n = 1",
    "q_reimport_kept": f"""
WITH {_LATEST_SEG}
SELECT file_id, count(*) AS total, count(*) FILTER (id % 7 <> 0 AND source_text IS NOT NULL AND target_text IS NOT NULL) AS kept,
       count(*) FILTER (id % 7 <> 0 AND source_text IS NOT NULL AND target_text IS NOT NULL AND status = 'approved') AS approved
FROM latest GROUP BY 1""",
    "q_import_counts": f"""
WITH u AS (
    SELECT file_id, len(targets) AS forms, len(list_filter(targets, lambda t: {_blank("t")})) AS blank,
           ({_blank("regexp_replace(source, '<[^<>]*>', '', 'g')")} OR coalesce(native_state IN ('vanished', 'obsolete'), false)) AS skipped FROM units
)
SELECT file_id, coalesce(sum(forms) FILTER (NOT skipped), 0)::BIGINT AS segments, coalesce(sum(forms - blank) FILTER (NOT skipped), 0)::BIGINT AS translated,
       coalesce(sum(blank) FILTER (NOT skipped), 0)::BIGINT AS untranslated, count(*) FILTER (skipped) AS skipped FROM u GROUP BY 1""",
    "q_unit_forms": f"""
WITH f AS (SELECT file_id, unit_key, ordinal, native_state, unnest(targets) AS t, generate_subscripts(targets, 1) - 1 AS form_index FROM units)
SELECT file_id, unit_key, ordinal, form_index::INT AS form_index,
       CASE WHEN {_blank("t")} THEN 'untranslated' WHEN native_state IN {_NATIVE} THEN 'needs_review' ELSE 'draft' END AS status FROM f""",
    "q_export_worked": f"""
WITH {_LATEST_SEG}, g AS (
    SELECT file_id, unit_key, list(form_index) AS fs, list(coalesce(target_text, '')) AS ts, arg_min(status, form_index) AS state,
           arg_min(origin IS DISTINCT FROM 'import' AND origin IS NOT NULL OR reviewed_by IS NOT NULL, form_index) AS worked
    FROM latest GROUP BY 1, 2
), u AS (SELECT DISTINCT ON (file_id, unit_key) file_id, unit_key, targets, native_state FROM units ORDER BY file_id, unit_key, ordinal, source, targets),
n AS (
    SELECT u.*, g.state, g.worked, list_transform(targets, lambda t, i: coalesce(ts[list_position(fs, i - 1)], t)) AS new
    FROM u JOIN g USING (file_id, unit_key)
)
SELECT file_id, unit_key, array_to_string(new, chr(10)) AS targets, state FROM n
WHERE (worked OR new <> targets) AND NOT coalesce(native_state IN ('vanished', 'obsolete'), false)""",
    "q_orphans_cascade": """
SELECT 'issues' AS what, count(*) AS n FROM qa_issues WHERE segment_id IN (SELECT id FROM segments)
UNION ALL SELECT 'memory', count(*) FROM tm_entries WHERE segment_id IN (SELECT id FROM segments)""",
    "q_index_rows": rf"""
WITH seg AS ({_SEG}), h AS (
    SELECT f.project_id, p.target_locale, {_normal(_plain("s.source_text"))} AS plain, s.target_text
    FROM seg s JOIN files f ON f.id = s.file_id JOIN projects p ON p.id = f.project_id WHERE s.status = 'approved' AND s.target_text <> '' AND s.form_index = 0
), k AS (SELECT DISTINCT project_id, target_locale, sha256(plain) AS h, target_text FROM h WHERE plain <> '')
SELECT project_id, count(*) AS entries, count(*) AS vectors FROM k GROUP BY 1""",
    "q_parse_units": f"""
SELECT file_id::BIGINT AS file_id, ordinal::INT AS ordinal, unit_key, context, source, targets, plural, notes, max_width::INT AS max_width, native_state FROM (VALUES
    (1, 0, {_KEYS["open"]}, 'app.ui / open', 'Open %1 of %2', '', false, 'in the menu', 0, 'new'),
    (1, 1, {_KEYS["zoom"]}, 'app.ui / zoom', 'Zoom in', 'Vergrößern', false, '', 14, 'translated'),
    (1, 2, {_KEYS["later"]}, 'app.ui / later', {_literal(_LATER)}, '', false, '', 0, ''),
    (2, 0, {_KEYS["count"]}, 'Main', '%n file(s)', '%n Datei|%n Dateien', true, 'count', 0, 'unfinished'),
    (2, 1, {_KEYS["quit"]}, 'Main', 'Quit', 'Beenden', false, '', 0, ''),
    (2, 2, {_KEYS["quit"]} || '-1', 'Main', 'Quit', 'Ende', false, 'second', 0, 'vanished'),
    (2, 3, {_KEYS["about"]}, 'Main', 'About &lt;b&gt;us&lt;/b&gt;', '', false, '', 0, '')
) AS t(file_id, ordinal, unit_key, context, source, targets, plural, notes, max_width, native_state)""",
    "q_parse_segments": f"""
SELECT file_id::BIGINT AS file_id, unit_key, form_index::INT AS form_index, source_text, target_text, status FROM (VALUES
    (1, {_KEYS["open"]}, 0, 'Open %1 of %2', '', 'untranslated'), (1, {_KEYS["zoom"]}, 0, 'Zoom in', 'Vergrößern', 'draft'), (1, {_KEYS["later"]}, 0, {_literal(_LATER)}, '', 'untranslated'),
    (2, {_KEYS["count"]}, 0, '%n file(s)', '%n Datei', 'needs_review'), (2, {_KEYS["count"]}, 1, '%n file(s)', '%n Dateien', 'needs_review'),
    (2, {_KEYS["quit"]}, 0, 'Quit', 'Beenden', 'draft'), (2, {_KEYS["about"]}, 0, 'About &lt;b&gt;us&lt;/b&gt;', '', 'untranslated')
) AS t(file_id, unit_key, form_index, source_text, target_text, status)""",
    "q_export_bytes": f"SELECT 1::BIGINT AS id, 'app.xlf' AS name, {_rewritten(XLIFF, *_WRITTEN[1][1])} AS content UNION ALL SELECT 2, 'main.ts', {_rewritten(QTTS, *_WRITTEN[2][1])}",
    "q_changed_spans": _SPANS,
}
