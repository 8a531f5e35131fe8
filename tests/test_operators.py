"""Checks, memory, reports and changes on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tolmach import schema
from tolmach.operators import changes, checks, memory, reports

T = [dt.datetime(2024, 1, d) for d in range(1, 10)]


def issues(spark, source, target, width=0, tolerance=1.0, glossary=(), variants=(), dialect="generic"):
    df = spark.createDataFrame(
        [(source, target, width, tolerance, [*glossary], [*variants], dialect)],
        "source_text string, target_text string, max_width int, tolerance float, glossary array<struct<source:string,target:string,cased:boolean>>, variants array<string>, dialect string",
    )
    return [(i["kind"], i["severity"], i["message"]) for i in checks.run_checks(df).first()["issues"]]


def test_placeholder_message(spark):
    found = issues(spark, 'Copy %1 to %2 <x id="A"/>', "Kopiere %1 %3", dialect="qt", tolerance=0.0)
    assert found == [("placeholder", "error", 'placeholder mismatch: missing "%2", "<x id=\\"A\\">"; unexpected "%3"')]
    assert issues(spark, "%1$@ in %2$@", "%2$@ dans %1$@") == []
    assert issues(spark, "%@ and %@", "%@", tolerance=0.0)[0][2] == 'placeholder mismatch: missing "%@"'


@pytest.mark.parametrize(
    ("source", "target", "width", "tolerance", "severity"),
    [
        ("Save", "Speichern unter ...", 10, 1.0, "error"), ("Save", "Speichern", 10, 1.0, None),
        ('Delete <x id="B"/>', 'L<x id="B"/>&#246;schen', 8, 1.0, None), ('Delete <x id="B"/>', 'L<x id="B"/>&#246;schen', 6, 1.0, "error"),
        ("Please choose a destination folder", "a" * 54, 0, 1.0, None), ("Please choose a destination folder", "a" * 55, 0, 1.0, "warning"),
        ("OK", "Einverstanden", 0, 1.0, None), ("Save", "Diese Datei irgendwo abspeichern", 0, 1.0, "warning"),
        ("Please choose a destination folder", "a" * 900, 0, 0.0, None), ("Save", "Diese Datei irgendwo abspeichern", 0, None, "warning"),
    ],
)
def test_length(spark, source, target, width, tolerance, severity):
    found = issues(spark, source, target, width, tolerance)
    assert [(k, s) for k, s, _ in found] == ([("length", severity)] if severity else [])


def test_terminology(spark):
    terms = [("bookmark", "Lesezeichen", False), ("Size", "Größe", False), ("", "x", False)]
    assert issues(spark, "Add bookmark", "Favorit hinzufügen", glossary=terms, tolerance=0.0) == [("terminology", "warning", 'glossary: "bookmark" should be translated as "Lesezeichen"')]
    assert issues(spark, "Add bookmark", "Lesezeichen hinzufügen", glossary=terms) == []
    assert issues(spark, "Size on disk", "Größe auf der Platte", glossary=terms) == []


def test_nothing_is_checked_while_the_target_is_blank(spark):
    assert issues(spark, "Open %1", " \n", width=1, glossary=[("Open", "x", False)], variants=["y"]) == []


def test_consistency(spark):
    assert issues(spark, "Cancel", "Abbrechen", variants=["Abbrechen", " Abbrechen "]) == []
    assert issues(spark, "Cancel", "x", variants=["d", "a", "c", "b", ""])[0] == ("inconsistency", "warning", 'the same source string is approved elsewhere as "a", "b", "c" and 1 more')


def test_recheck_ordinals_follow_the_checks(spark):
    seg = spark.createDataFrame([(1, 1, "Open %1 file", "y" * 90, "draft", 0), (2, 1, "Open %1 file", "offen %1", "approved", 0)], "id long, file_id long, source_text string, target_text string, status string, max_width int")
    files = spark.createDataFrame([(1, 1, "qtts")], "id long, project_id long, format string")
    projects = spark.createDataFrame([(1, None)], "id long, length_tolerance float")
    terms = spark.createDataFrame([(1, "file", "Datei", None)], "project_id long, source_term string, target_term string, case_sensitive boolean")
    found = [(r["segment_id"], r["ordinal"], r["kind"]) for r in checks.recheck(seg, files, projects, terms).orderBy("segment_id", "ordinal").collect()]
    assert found == [(1, 0, "placeholder"), (1, 1, "length"), (1, 2, "terminology"), (1, 3, "inconsistency"), (2, 0, "terminology")]


def test_blocking_findings(spark):
    df = spark.createDataFrame([
        (1, [("length", "warning", "a"), ("placeholder", "error", "b"), ("length", "error", "c")]), (2, [("length", "warning", "a")]), (3, []),
        (4, [("length", None, "a"), ("length", "error", None)]), (5, None),
    ], f"id long, issues {checks.ISSUES}")
    got = {r["id"]: (r["blocked"], r["reason"]) for r in df.select("id", checks.blocking(F.col("issues")).alias("blocked"), checks.first_blocking(F.col("issues")).alias("reason")).collect()}
    assert got == {1: (True, "b"), 2: (False, None), 3: (False, None), 4: (True, None), 5: (None, None)}


def test_reason_of_a_block_is_that_of_its_sql(spark, tmp_path):
    from test_queries import oracle, table_of
    from tolmach.plans.catalogue import QUERIES, SQL

    found = [
        (1, "length", "error", "later", None), (1, "length", "error", "b", 1), (1, "length", "error", "a", 1), (1, "length", "warning", "w", 0),
        (2, None, "error", "no kind", 0), (2, "length", "error", "kind", 0), (3, "length", "error", None, 0), (3, "length", "error", "z", 0),
        (4, "length", None, "x", 0), (5, "length", "Error", "x", 0), (None, "length", "error", "x", 0), (9, "length", "error", "x", 0), (1, "length", "error", "a", 1),
    ]
    spark.createDataFrame(found, "segment_id long, kind string, severity string, message string, ordinal int").coalesce(1).write.parquet(f"{tmp_path}/issues")
    spark.createDataFrame([(i, 1) for i in (1, 1, 2, 3, 4, 5, 6)], "id long, file_id long").coalesce(1).write.parquet(f"{tmp_path}/rows")
    for name, made in (("qa_issues", "issues"), ("segments", "rows")):
        next((tmp_path / made).glob("*.parquet")).rename(tmp_path / f"{name}.parquet")
    df = QUERIES["q_blocked_segments"](spark, str(tmp_path))
    rows = oracle(tmp_path).execute(SQL["q_blocked_segments"])
    assert table_of(df.collect(), df.columns) == table_of(rows.fetchall(), [c[0] for c in rows.description])
    assert {r["id"]: r["reason"] for r in df.collect()} == {1: "a", 2: "kind", 3: "z"}


def tm(spark, rows):
    return spark.createDataFrame(rows, "id long, project_id long, target_locale string, source_hash string, target_text string, embedding array<float>, created_at timestamp")


def test_suggestions(spark):
    entries = tm(spark, [
        (1, 1, "de", "h", "Speichern", [1.0, 0.0], T[0]), (2, 1, "de", "h", "Sichern", [1.0, 0.0], T[1]), (3, 1, "de", "g", "Speichern", [1.0, 0.1], T[0]),
        (4, 1, "de", "k", "Ablegen", [1.0, 0.5], T[0]), (5, 1, "de", "k", "Weg", [0.0, 1.0], T[0]), (6, 2, "de", "h", "anders", [1.0, 0.0], T[0]), (7, 1, "de", "z", "null", None, T[0]),
    ])
    queries = spark.createDataFrame([(9, 1, "de", "h", [1.0, 0.0])], "query_id long, project_id long, target_locale string, source_hash string, embedding array<float>")
    exact = memory.exact_matches(queries, entries)
    assert [r["id"] for r in exact.orderBy("place").collect()] == [2, 1]
    near = memory.semantic_matches(queries, entries, width=2)
    assert [r["id"] for r in near.orderBy("place").collect()] == [3, 4]
    merged = memory.merge_matches(exact, near).orderBy("rank").collect()
    assert [(r["target_text"], r["kind"]) for r in merged] == [("Sichern", "exact"), ("Speichern", "exact"), ("Ablegen", "semantic")]
    assert memory.merge_matches(exact, near, limit=2).count() == 2
    assert memory.merge_matches(exact.limit(0), near.limit(0)).count() == 0


def test_reworded_texts_are_near_under_the_stand_in_embedder(spark):
    made = memory.HashingEmbedder(128)
    a, b, c = made.embed(["Delete the selected files", "Delete all selected files", "Network unavailable"])
    dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
    assert dot(a, b) > 0.6 > dot(a, c)
    df = memory.embed(spark.createDataFrame([("x",), (None,)], "t string"), "t", made, batch=1)
    assert [len(r["embedding"]) for r in df.collect()] == [128, 128]


def test_index_rows_keeps_the_first_pair_of_form_0(spark):
    rows = [(3, 1, "de", "b", 0, "Save  it", "x"), (2, 1, "de", "a", 0, "<b>Save</b> it", "x"), (4, 1, "de", "c", 1, "Other", "y"), (5, 1, "de", "d", 0, "<x/>", "z")]
    df = spark.createDataFrame(rows, "id long, project_id long, target_locale string, unit_key string, form_index int, source_text string, target_text string")
    assert [r["id"] for r in memory.index_rows(df, memory.HashingEmbedder(8)).collect()] == [2]


def test_drafts_are_checked(spark):
    class Upper:
        def translate(self, texts, source, target):
            assert len(texts) <= 2
            return [t.upper() if t != "bad" else "<g>" for t in texts]

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bad", "c"])], "id long, source_text string").coalesce(1)
    assert [r["draft"] for r in memory.draft(df, Upper(), "en", "de", batch=2).orderBy("id").collect()] == ["A", None, "C"]


def seg(spark, rows):
    return spark.createDataFrame(rows, "id long, file_id long, status string, source_text string, target_text string")


def test_reports(spark):
    rows = seg(spark, [(1, 1, "approved", "s", "a"), (1, 1, "approved", "s", "a"), (2, 1, "approved", "s", "b"), (3, 1, "draft", "s", "c"), (4, 2, "rejected", None, None), (5, 1, "approved", "s", "a")])
    rows = reports.once(rows)
    found = spark.createDataFrame([(1, "k", "error", "m1", 0), (1, "k", "warning", "m2", 1), (9, "k", "error", "m", 0)], "segment_id long, kind string, severity string, message string, ordinal int")
    stats = {r["file_id"]: r for r in reports.file_stats(rows, found).collect()}
    assert (stats[1]["total"], stats[1]["approved"], stats[1]["draft"], stats[1]["errors"], stats[1]["warnings"]) == (4, 3, 1, 1, 1)
    assert (stats[2]["total"], stats[2]["rejected"], stats[2]["errors"]) == (1, 1, 0)
    files = spark.createDataFrame([(1, 7, "a.ts"), (2, 7, "b.ts"), (3, 7, "c.ts")], "id long, project_id long, name string")
    assert {r["file_id"]: r["total"] for r in reports.files_with_stats(files, reports.file_stats(rows, found)).collect()} == {1: 4, 2: 1, 3: 0}
    assert [(r["source_text"], r["variants"]) for r in reports.inconsistent_sources(rows, files, limit=0).collect()] == [("s", ["a", "b"])]
    others = {(r["id"], r["target_text"]) for r in reports.other_approved(rows, files).collect()}
    assert others == {(1, "a"), (1, "b"), (2, "a"), (3, "a"), (3, "b"), (5, "a"), (5, "b")}
    lists = {r["id"]: [i["message"] for i in r["issues"]] for r in reports.with_issue_lists(rows, found).collect()}
    assert lists[1] == ["m1", "m2"] and lists[2] == []
    assert [r["id"] for r in reports.segments_page(rows, found, with_issue=True).collect()] == [1]
    assert [r["id"] for r in reports.segments_page(rows, status="approved", search="B", limit=1, offset=0).collect()] == [2]
    assert reports.segments_page(rows, search="_").count() == 4 and reports.segments_page(rows, search="_", literal=True).count() == 0


def test_latest_and_upsert(spark):
    log = spark.createDataFrame([("k", 1, T[0], False), ("k", 2, T[2], False), ("k", 3, T[1], False), ("j", 4, T[0], False), ("j", 5, T[1], True), ("n", None, None, None)], "key string, v int, at timestamp, gone boolean")
    assert {(r["key"], r["v"]) for r in changes.latest(log, ["key"], ["at"], deleted="gone").collect()} == {("k", 2), ("n", None)}
    table = log.select("key", "v", "at").limit(1)
    new = spark.createDataFrame([("k", 9, T[0])], "key string, v int, at timestamp")
    assert [r["v"] for r in changes.upsert(table, new, ["key"], ["at"]).collect()] == [9]


def test_carry_over_is_idempotent(spark):
    s = "file_id long, unit_key string, form_index int, source_text string, target_text string, status string, reviewed_by string"
    prior = spark.createDataFrame([(1, "a", 0, "s", "t", "approved", "me"), (1, "b", 0, "s", "t", "approved", "me"), (1, "c", 0, "s", None, "draft", None)], s)
    new = spark.createDataFrame([(1, "a", 0, "s", "t", "draft", None), (1, "b", 0, "s2", "t", "draft", None), (1, "d", 0, "s", "t", "draft", None)], s)
    once = changes.carry_over(new, prior, ["status", "reviewed_by"])
    assert {(r["unit_key"], r["status"], r["was_kept"]) for r in once.collect()} == {("a", "approved", True), ("b", "draft", False), ("d", "draft", False)}
    again = changes.carry_over(once.drop("was_kept"), once.drop("was_kept"), ["status", "reviewed_by"])
    assert {(r["unit_key"], r["status"]) for r in again.collect()} == {(r["unit_key"], r["status"]) for r in once.collect()}


def test_cascade_and_replace(spark):
    child = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "segment_id long, x string")
    parents = spark.createDataFrame([(1,)], "id long")
    assert [r["x"] for r in changes.cascade(child, "segment_id", parents).collect()] == ["a"]
    assert {(r["segment_id"], r["x"]) for r in changes.cascade(child, "segment_id", parents, null_out=True).collect()} == {(1, "a"), (None, "b"), (None, "c")}
    new = spark.createDataFrame([(2, "z")], "segment_id long, x string")
    assert {r["x"] for r in changes.replace_rows(child, new, ["segment_id"]).collect()} == {"a", "z", "c"}


def test_schema_guards(spark):
    rows = spark.createDataFrame([(1, "approved", None, None), (2, "approved", "me", T[0]), (3, "draft", "me", None), (4, "odd", None, None)], "id long, status string, reviewed_by string, reviewed_at timestamp")
    assert {(r["id"], r["rule"]) for r in schema.violations(rows).collect()} == {(1, "approved_needs_a_reviewer"), (3, "reviewer_implies_timestamp"), (4, "status_domain")}
    with pytest.raises(schema.NotFound):
        schema.get(rows, 99)
    assert schema.empty(spark, "segments").columns[:2] == ["id", "file_id"]
    with pytest.raises(Exception, match="unknown value odd"):
        rows.select(schema.in_domain(F.col("status"), schema.STATUSES, "status")).collect()


def test_inconsistent_names_three_others_whatever_the_own_wording(spark):
    s = "id long, project_id long, source_text string, target_text string, status string"
    rows = [(i, 1, "s", t, "approved") for i, t in enumerate(["a", "b", " b", "c", "d", "e", "e", " ", ""])] + [(20, 1, "s", "b ", "draft"), (21, 1, "s", "z", "draft"), (22, 2, "s", "z", "draft"), (23, 1, "s", None, "draft"), (24, 1, None, "a", "approved")]
    df = spark.createDataFrame(rows, s)
    got = {r["id"]: r["others"] for r in checks.with_others(df).collect()}
    known = ["a", "b", " b", "c", "d", "e", " ", ""]
    for i, p, source, t, _ in rows:
        one = spark.createDataFrame([(t, known if (p, source) == (1, "s") else [])], "t string, v array<string>").select(checks.consistency_issues(F.col("t"), F.col("v")).alias("i")).first()["i"]
        assert got[i] == (one[0]["message"] if one else None), i
    assert "and 1 more" in got[20] and "and 3 more" in got[21]


def test_recheck_of_one_file_equals_that_part_of_all(spark):
    seg = spark.createDataFrame([(i, i % 3, "Open %1 file", f"offen {i}", "approved" if i % 2 else "draft", 0) for i in range(12)], "id long, file_id long, source_text string, target_text string, status string, max_width int")
    files = spark.createDataFrame([(f, 1, "qtts") for f in range(3)], "id long, project_id long, format string")
    projects = spark.createDataFrame([(1, None)], "id long, length_tolerance float")
    terms = spark.createDataFrame([(1, "file", "Datei\u00a0x", None)], "project_id long, source_term string, target_term string, case_sensitive boolean")
    whole = {tuple(r) for r in checks.recheck(seg, files, projects, terms).collect() if r["segment_id"] % 3 == 1}
    part = {tuple(r) for r in checks.recheck(seg, files, projects, terms, spark.createDataFrame([(1,)], "file_id long")).collect()}
    assert part == whole and any("\\u00a0" in r[3] for r in part)
