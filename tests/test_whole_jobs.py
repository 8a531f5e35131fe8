"""Queries over rows with markup and braces too, against the kernels row by row."""

from collections import Counter

import pytest

from test_queries import oracle, table_of
from tolmach.kernels import markup
from tolmach.plans.catalogue import QUERIES
from tolmach.plans.sql import _blank, _percent, _plain

#: (id, file_id, source, target, max_width); file 1 is generic, file 2 is Qt, file 3 is not among the files.
SEGMENTS = [
    (1, 1, "Copy %d files", "Kopiere %s Dateien", None),
    (2, 1, 'Press <g id="1">OK</g>', "OK drücken", None),
    (3, 1, "Hello {name}, %s &amp; co", "Hallo {nom}, %s &amp; Co", None),
    (4, 2, "<b>%1</b> of %L2", "<b>%1</b> von %2", None),
    (5, 2, "100%% of %n", "100%% von %n", None),
    (6, 1, "{{ user }} has <x id=\"2\"/>", "{{user}} hat <x id=\"2\"/>", None),
    (7, 1, "Broken <b %s", "Kaputt &lt;b %d", None),
    (8, 1, "Keep %s", "  ", None),
    (9, 1, "Keep <x id=\"1\"/>", None, None),
    (10, 3, "%1 left {n}", "noch {n}", None),
    (11, 1, "%(n)d &#37;s", "%(n)d", None),
    (12, 1, "<g id=\"1\">Save</g>", "<g id=\"1\">Speichern</g>", 9),
    (13, 1, "<g id=\"1\">Save</g>", "<g id=\"1\">Speichern &amp; Ende</g>", 12),
    (14, 1, "Go", "<b>" + "weiter " * 5 + "</b>", None),
    (15, 1, "Go\r\n", "Los\r\n" * 7, None),
    (16, 1, "Tag&nbsp;%n", "Tag&nbsp;%n", 6),
]
FORMATS = {1: "xliff", 2: "qtts"}


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(i, f, s, t, w) for i, f, s, t, w in SEGMENTS]
    spark.createDataFrame(rows, "id long, file_id long, source_text string, target_text string, max_width int").write.parquet(f"{tmp_path}/segments.parquet")
    spark.createDataFrame([(f, 1, k) for f, k in FORMATS.items()], "id long, project_id long, format string").write.parquet(f"{tmp_path}/files.parquet")
    spark.createDataFrame([(1, 1.0, "de")], "id long, length_tolerance double, target_locale string").write.parquet(f"{tmp_path}/projects.parquet")
    return str(tmp_path)


def test_placeholder_diff_compares_every_placeholder_of_every_segment(spark, folder):
    wanted = {}
    for i, f, s, t, _ in SEGMENTS:
        if t and t.strip():
            a, b = (Counter(markup.placeholders(x, "qt" if FORMATS.get(f) == "qtts" else "generic")) for x in (s, t))
            if a != b:
                wanted[i] = (" ".join(sorted((a - b).elements())), " ".join(sorted((b - a).elements())))
    got = {r["id"]: (r["missing"], r["extra"]) for r in QUERIES["q_placeholder_diff"](spark, folder).collect()}
    assert got == wanted
    assert got[2] == ('<g id="1">', "")
    assert got[3] == ("{name}", "{nom}") and got[4] == ("%L2", "%2") and got[10] == ("%1", "")


def _same_as_sql(spark, data, name, sql):
    """The query gives what this SQL over all segments gives."""
    df = QUERIES[name](spark, data)
    found = oracle(data).execute(sql)
    assert table_of(df.collect(), df.columns) == table_of(found.fetchall(), [c[0] for c in found.description])


def test_length_check_counts_visible_characters_of_every_segment(spark, folder, data):
    got = {r["id"]: (r["severity"], r["message"]) for r in QUERIES["q_length_check"](spark, folder).collect()}
    assert got == {
        13: ("error", "over the 12 character budget declared for this string (16 characters)"),
        14: ("warning", "35 characters against a 25 character budget for a 2 character source"),
        15: ("warning", "28 characters against a 25 character budget for a 3 character source"),
    }
    steps = "CASE WHEN m <= 10 THEN 3.0 WHEN m <= 20 THEN 2.2 WHEN m <= 30 THEN 1.8 WHEN m <= 50 THEN 1.6 WHEN m <= 70 THEN 1.4 ELSE 1.3 END::DOUBLE"
    _same_as_sql(spark, data, "q_length_check", f"""
WITH seg AS (SELECT DISTINCT * FROM segments), p AS (
    SELECT s.id, length({_plain("s.source_text")}) AS m, length({_plain("s.target_text")}) AS n, coalesce(s.max_width, 0) AS w, coalesce(p.length_tolerance::DOUBLE, 1) AS tol
    FROM seg s JOIN files f ON f.id = s.file_id JOIN projects p ON p.id = f.project_id WHERE NOT {_blank("s.target_text")}
), b AS (SELECT *, trunc(greatest(m * {steps}, 25::DOUBLE) * tol)::INT AS budget FROM p)
SELECT id, CASE WHEN w > 0 THEN 'error' ELSE 'warning' END AS severity,
       CASE WHEN w > 0 THEN 'over the ' || w || ' character budget declared for this string (' || n || ' characters)'
            ELSE n || ' characters against a ' || budget || ' character budget for a ' || m || ' character source' END AS message
FROM b WHERE (w > 0 AND n > w) OR (w <= 0 AND tol > 0 AND n > budget)""")


def test_percent_placeholders_of_every_source(spark, folder, data):
    wanted = {i: [x for x in markup.text_placeholders(markup.plain_text(s)) if x.startswith("%")] for i, _, s, _, _ in SEGMENTS}
    assert {r["id"]: r["found"] for r in QUERIES["q_percent_placeholders"](spark, folder).collect()} == {i: " ".join(x) for i, x in wanted.items()}
    counts = {(r["name"], r["kind"]): r["n"] for r in QUERIES["q_placeholder_kinds"](spark, folder).collect()}
    assert counts == Counter((x, markup.percent_kind(x)) for found in wanted.values() for x in found)
    each = f"SELECT id, {_percent(_plain('source_text'))} AS l FROM (SELECT DISTINCT * FROM segments)"
    _same_as_sql(spark, data, "q_percent_placeholders", f"SELECT id, array_to_string(l, ' ') AS found FROM ({each})")
    _same_as_sql(spark, data, "q_placeholder_kinds", f"""
SELECT name, CASE WHEN regexp_matches(name, '^%(L?[0-9]{{1,2}}|n)$') THEN 'qt' ELSE 'printf' END AS kind, count(*) AS n
FROM (SELECT unnest(l) AS name FROM ({each})) GROUP BY 1, 2""")
