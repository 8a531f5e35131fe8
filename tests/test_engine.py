"""The engine end to end: import, edit, check, remember, search, export, import again."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tolmach import __main__ as cli
from tolmach.engine import Engine
from tolmach.operators.memory import HashingEmbedder
from tolmach.plans import fixtures
from tolmach.schema import NotFound
from tolmach.sources.tables import current_version

EDIT = "id long, target_text string, status string, origin string, reviewed_by string, at timestamp"


def test_a_project_from_import_to_export(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "app.xlf").write_text(fixtures.XLIFF)
    (tmp_path / "in" / "main.ts").write_text(fixtures.QTTS)
    engine = Engine(spark, str(tmp_path / "tables"), HashingEmbedder(64))
    with pytest.raises(NotFound):
        engine.import_files(str(tmp_path / "in"), 1)
    project = engine.add_project("App", "en", "de")
    counts = {(r["segments"], r["translated"], r["skipped"], r["kept"]) for r in engine.import_files(str(tmp_path / "in"), project).collect()}
    assert counts == {(3, 1, 0, 0), (4, 3, 1, 0)}
    assert {bytes(r["content"]) for r in engine.export().collect()} == {fixtures.XLIFF.encode(), fixtures.QTTS.encode()}

    ids = {(r["source_text"], r["form_index"]): r["id"] for r in engine.table("segments").collect()}
    at = dt.datetime(2025, 1, 1)
    edits = [
        (ids["Zoom in", 0], "Sichern & mehr als zehn", "draft", "human", None, at),
        (ids["Quit", 0], "<g>", "draft", "human", None, at),
        (ids["Open %1 of %2", 0], "Öffne %1", "draft", "human", None, at),
        (ids["Open %1 of %2", 0], "%1 von %2 öffnen", "approved", "human", "me", at + dt.timedelta(1)),
        (99, "x", "draft", "human", None, at),
    ]
    errors = {r["id"]: r["error"] for r in engine.edit(spark.createDataFrame(edits, EDIT)).collect()}
    assert errors[99] == "no such segment" and "well-formed" in errors[ids["Quit", 0]] and errors[ids["Zoom in", 0]] is None
    assert {(r["kind"], r["severity"]) for r in engine.issue_totals().collect()} == {("length", "error")}
    save = engine.segments(search="Zoom in").collect()[0]
    assert save["target_text"] == "Sichern &amp; mehr als zehn" and save["issues"][0]["kind"] == "length"

    assert engine.remember() == 1 and engine.remember() == 1
    assert [(r["target_text"], r["kind"]) for r in engine.search(project, ["Open  %1 of %2", "something else"]).collect()] == [("%1 von %2 öffnen", "exact")]
    assert [r["kind"] for r in engine.search(project, ["Open %1 of  the %2"], least=0.5).collect()] == ["semantic"]
    assert engine.suggest(ids["Open %1 of %2", 0]).count() == 1
    assert [r["entries"] for r in engine.projects().collect()] == [1]

    engine.add_terms(spark.createDataFrame([(project, "Quit", "Schließen", False)], "project_id long, source_term string, target_term string, case_sensitive boolean"))
    assert engine.issue_totals().where("kind = 'terminology'").count() == 1
    engine.remove_term(engine.glossary(project).first()["id"])
    assert engine.issue_totals().where("kind = 'terminology'").count() == 0

    out = {r["name"]: bytes(r["content"]).decode() for r in engine.export(approved_only=True).collect()}
    assert '<target state="translated">%1 von %2 öffnen</target>' in out["app.xlf"] and "Sichern" not in out["app.xlf"]
    assert out["main.ts"] == fixtures.QTTS

    # the exported file comes back: what was approved keeps its reviewer
    (tmp_path / "in" / "app.xlf").write_text(out["app.xlf"])
    kept = {r["kept"] for r in engine.import_files(str(tmp_path / "in"), project).collect()}
    assert kept == {2, 4}
    again = engine.table("segments").where(F.col("source_text") == "Open %1 of %2").first()
    assert (again["status"], again["reviewed_by"]) == ("approved", "me")
    assert {r["name"]: r["approved"] for r in engine.files(project).collect()} == {"app.xlf": 1, "main.ts": 0}
    assert engine.inconsistencies().count() == 0

    class Louder:
        def translate(self, texts, source, target):
            return [t + "!" if "close" not in t else "<g>" for t in texts]

    file = engine.files(project).where("name = 'app.xlf'").first()["file_id"]
    assert engine.pretranslate(file, Louder()) == {"asked": 1, "drafted": 0, "refused": 1}
    other = engine.files(project).where("name = 'main.ts'").first()["file_id"]
    assert engine.pretranslate(other, Louder()) == {"asked": 1, "drafted": 1, "refused": 0}
    drafted = engine.table("segments").where("origin = 'machine'").first()
    assert (drafted["status"], drafted["reviewed_by"]) == ("needs_review", None) and engine.recheck(other) >= 0
    # the edit wrote the parts of one file only
    version = current_version(spark, str(tmp_path / "tables" / "segments"))
    assert len(list((tmp_path / "tables" / "segments" / f"v{version}").glob("_part=*"))) == 1
    assert engine.table("segments").count() == 7

    for line in (["projects"], ["files"], ["issues"], ["recheck"], ["inconsistencies"], ["glossary", str(project)], ["suggest", str(project), "Zoom in"], ["export", str(tmp_path / "in")], ["remember"]):
        cli.run(engine, cli.parser().parse_args(["x", *line]))
    assert "app.xlf" in capsys.readouterr().out
