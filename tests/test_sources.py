"""Files, sinks and streams end to end on temporary folders."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tolmach.plans import fixtures
from tolmach.sources import files, tables
from tolmach.streaming import flows


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "app.XLF").write_text(fixtures.XLIFF)
    (tmp_path / "main.ts").write_text(fixtures.QTTS)
    return tmp_path


def test_import_edit_export(spark, folder):
    rows = files.read_files(spark, str(folder), 3).cache()
    assert {(r["name"], r["format"]) for r in rows.collect()} == {("app.XLF", "xliff"), ("main.ts", "qtts")}
    units = files.units(rows).cache()
    seg = files.segments(units).cache()
    assert seg.count() == seg.select("file_id", "unit_key", "form_index").distinct().count() == 7  # the vanished unit is no segment
    assert {r["status"] for r in seg.collect()} == {"untranslated", "draft", "needs_review"}
    same = files.export(rows, files.updates(units, seg))
    assert {r["name"]: bytes(r["content"]) for r in same.collect()} == {"app.XLF": fixtures.XLIFF.encode(), "main.ts": fixtures.QTTS.encode()}
    worked = seg.withColumn("target_text", F.when(F.col("source_text") == "Quit", "Schluss").otherwise(F.col("target_text")))
    todo = files.updates(units, worked)
    assert [(r["targets"], r["state"]) for r in todo.collect()] == [(["Schluss"], "draft")]
    assert files.updates(units, worked, approved_only=True).count() == 0
    out = {r["name"]: bytes(r["content"]).decode() for r in files.export(rows, todo).collect()}
    assert out["app.XLF"] == fixtures.XLIFF
    assert out["main.ts"] == fixtures.QTTS.replace("<translation>Beenden", '<translation type="unfinished">Schluss')
    spans = files.changed_spans(rows, todo).collect()
    assert len(spans) == 1 and fixtures.QTTS.encode()[spans[0]["start"] : spans[0]["end"]] == b"<translation>Beenden</translation>"
    assert tables.save_file(files.export(rows, todo), str(folder)) == 2 and "Schluss" in (folder / "main.ts").read_text()


def test_forms_the_file_lacks_are_left_out(spark):
    units = spark.createDataFrame([(1, "k", ["a", "b"], "")], "file_id long, unit_key string, targets array<string>, native_state string")
    seg = spark.createDataFrame([(1, "k", 1, "B", "draft", "human", None), (1, "k", 5, "X", "draft", "human", None)], "file_id long, unit_key string, form_index int, target_text string, status string, origin string, reviewed_by string")
    assert [r["targets"] for r in files.updates(units, seg).collect()] == [["a", "B"]]


def test_broken_and_unknown_files_are_errors(spark, tmp_path):
    (tmp_path / "x.ts").write_text("<TS><message></TS>")
    with pytest.raises(Exception, match="x.ts"):
        files.units(files.read_files(spark, str(tmp_path), 1)).collect()
    (tmp_path / "y.po").write_text("x")
    with pytest.raises(Exception, match="unsupported file"):
        files.read_files(spark, str(tmp_path), 1).collect()


def test_partitions_and_snapshots(spark, tmp_path):
    path = str(tmp_path / "p")
    tables.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "file_id long, x string"), path, "file_id")
    tables.replace_partitions(spark.createDataFrame([(2, "c")], "file_id long, x string"), path, "file_id")
    tables.append(spark.createDataFrame([("d", 3)], "x string, file_id long").select("x").withColumn("file_id", F.lit(3)).drop("file_id"), path + "/file_id=3")
    assert {(r["file_id"], r["x"]) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    root = str(tmp_path / "s")
    assert tables.current_version(spark, root) is None
    for v in (1, 2):
        tables.write_snapshot(spark.range(v), root, v)
    assert tables.read_snapshot(spark, root).count() == 2


def test_a_write_that_stops_leaves_the_version_before(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    tables.write_snapshot(spark.range(3), root, 1)
    monkeypatch.setattr(tables, "_finish", lambda *_: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError):
        tables.write_snapshot(spark.range(9), root, 2)  # its data lie there, its manifest does not
    monkeypatch.undo()
    assert tables.current_version(spark, root) == 1 and tables.read_snapshot(spark, root).count() == 3
    tables.write_snapshot(spark.range(5), root, 2)
    assert tables.read_snapshot(spark, root).count() == 5
    with pytest.raises(FileExistsError):
        tables.write_snapshot(spark.range(1), root, 2)
    for v in range(3, 7):
        tables.write_snapshot(spark.range(v), root, v)
    assert sorted(p.name for p in (tmp_path / "s").glob("v[0-9]*")) == ["v4", "v5", "v6"]


def test_parts_that_are_not_touched_stay_where_they_are(spark, tmp_path):
    root = str(tmp_path / "p")
    tables.write_parts(spark.range(200), root, 1, F.col("id"))
    part = spark.range(7, 8).select(tables.part_of(F.col("id"))).first()[0]
    mine = tables.read_snapshot(spark, root, [part]).where("id <> 7")
    tables.write_parts(mine, root, 2, F.col("id"), [part])
    assert {r["id"] for r in tables.read_snapshot(spark, root).collect()} == set(range(200)) - {7}
    assert len(list((tmp_path / "p" / "v2").glob("_part=*"))) == 1
    tables.write_parts(spark.range(0), root, 3, F.col("id"), [part])
    assert tables.read_snapshot(spark, root, [part], "id long").count() == 0


def test_files_of_one_name_do_not_overwrite_each_other(spark, tmp_path):
    df = spark.createDataFrame([(1, "a.ts", bytearray(b"x")), (2, "a.ts", bytearray(b"y"))], "id long, name string, content binary").coalesce(1)
    assert tables.save_file(df, str(tmp_path)) == 2
    assert {p.read_bytes() for p in tmp_path.rglob("a.ts")} == {b"x", b"y"}


def test_file_stream(spark, folder):
    seen = []
    stream = flows.file_stream(spark, str(folder), 3, per_batch=1)
    query = flows.run_available(stream, lambda df, n: seen.append((n, files.units(df).count())), str(folder / "cp"))
    query.awaitTermination()
    assert sorted(c for _, c in seen) == [3, 4]


def test_latest_wins_stream_survives_a_repeated_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "k string, v int, at timestamp"
    at = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    spark.createDataFrame([("a", 1, at[0]), ("b", 2, at[1])], schema).coalesce(1).write.parquet(source)
    each = flows.into_snapshot(str(tmp_path / "t"), ["k"], ["at"])
    run = lambda: flows.run_available(spark.readStream.schema(schema).parquet(source), each, str(tmp_path / "cp")).awaitTermination()
    run()
    spark.createDataFrame([("a", 3, at[2]), ("b", 4, at[0])], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    assert {(r["k"], r["v"]) for r in tables.read_snapshot(spark, str(tmp_path / "t")).collect()} == {("a", 3), ("b", 2)}
    each(spark.createDataFrame([("a", 99, at[2])], schema), 1)
    assert {(r["k"], r["v"]) for r in tables.read_snapshot(spark, str(tmp_path / "t")).collect()} == {("a", 3), ("b", 2)}
