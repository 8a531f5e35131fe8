"""The engine's operators as queries over the driver's tables, and the same as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup, text
from ..operators import changes, checks, memory, reports
from ..sources import files as file_source
from ..sources.tables import table
from . import fixtures
from .sql import SQL as SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _segments(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return reports.once(table(spark, folder, "segments"), *columns)


def _stats(spark: SparkSession, folder: str) -> DataFrame:
    return reports.file_stats(_segments(spark, folder, "file_id", "status"), table(spark, folder, "qa_issues"))


def _flat(issues: str = "issues"):
    """Findings as one string, for results that are compared by value."""
    return F.array_join(F.transform(F.col(issues), lambda i: F.concat_ws("|", i["kind"], i["severity"], i["message"])), " / ")


# Reports


@_query
def q_file_stats(spark, folder):
    return _stats(spark, folder)


@_query
def q_files_with_stats(spark, folder):
    return reports.files_with_stats(table(spark, folder, "files"), _stats(spark, folder))


@_query
def q_segments_page(spark, folder):
    rows = _segments(spark, folder, "file_id", "status", "source_text", "target_text")
    return reports.segments_page(rows, status="approved", search="the file", limit=50, offset=10).select("id", "file_id", "source_text")


@_query
def q_segments_literal_search(spark, folder):
    rows = _segments(spark, folder, "status", "source_text", "target_text")
    return reports.page_total(reports.matching(rows, search="100%", literal=True))


@_query
def q_segments_with_issues(spark, folder):
    rows = _segments(spark, folder, "file_id", "status")
    return reports.matching(rows, table(spark, folder, "qa_issues"), with_issue=True)


@_query
def q_segment_issue_lists(spark, folder):
    rows = reports.with_issue_lists(_segments(spark, folder, "file_id"), table(spark, folder, "qa_issues"))
    return rows.select("id", F.size("issues").alias("n"), F.array_join(F.transform("issues", lambda i: F.concat_ws("|", i["kind"], i["message"])), " / ").alias("listed"))


@_query
def q_approved_by_source(spark, folder):
    rows = reports.approved_by_source(_segments(spark, folder, "file_id", "status", "source_text", "target_text"), table(spark, folder, "files"))
    return rows.select("project_id", "source_text", F.array_join("variants", "\n").alias("variants"))


@_query
def q_inconsistent_sources(spark, folder):
    rows = reports.inconsistent_sources(_segments(spark, folder, "file_id", "status", "source_text", "target_text"), table(spark, folder, "files"))
    return rows.select("project_id", markup.plain_text(F.col("source_text")).alias("source_plain"), F.size("variants").alias("n"), F.array_join("variants", "\n").alias("variants"))


@_query
def q_first_inconsistent_sources(spark, folder):
    rows = reports.inconsistent_sources(_segments(spark, folder, "file_id", "status", "source_text", "target_text"), table(spark, folder, "files"), limit=20)
    return rows.select("project_id", "source_text", F.size("variants").alias("n"))


@_query
def q_other_approved(spark, folder):
    return reports.other_approved(_segments(spark, folder, "file_id", "status", "source_text", "target_text"), table(spark, folder, "files"))


@_query
def q_issue_totals(spark, folder):
    return reports.issue_totals(table(spark, folder, "qa_issues"))


@_query
def q_project_tm_counts(spark, folder):
    return memory.entry_counts(table(spark, folder, "projects"), table(spark, folder, "tm_entries"))


@_query
def q_tm_by_locale(spark, folder):
    return table(spark, folder, "tm_entries").groupBy("project_id", "target_locale").agg(F.count("*").alias("entries"), F.countDistinct("source_hash").alias("sources"))


# Text


@_query
def q_normalize_hash(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.content_hash(F.col("text")).alias("h"))


@_query
def q_normalize_fragment(spark, folder):
    return _segments(spark, folder, "source_text").select("id", text.normalize_fragment(F.col("source_text")).alias("fixed"))


@_query
def q_unit_keys(spark, folder):
    rows = _segments(spark, folder, "file_id", "context", "source_text")
    keyed = rows.select("id", "file_id", text.unit_key(F.lit("ts"), F.coalesce("context", F.lit("")), F.coalesce("source_text", F.lit("")), F.lit("")).alias("unit_key"))
    return changes.numbered(keyed, ["file_id"], "unit_key", "id").select("id", "unit_key")


@_query
def q_plain_text(spark, folder):
    return _segments(spark, folder, "source_text").select("id", markup.plain_text(F.col("source_text")).alias("plain"))


@_query
def q_fragment_errors(spark, folder):
    rows = _segments(spark, folder, "target_text").where(F.col("target_text").isNotNull())
    return rows.select("id", markup.fragment_error(F.col("target_text")).isNotNull().alias("broken"))


@_query
def q_percent_placeholders(spark, folder):
    rows = _segments(spark, folder, "source_text").select("id", markup.plain_text(F.col("source_text")).alias("plain"))
    return rows.select("id", F.array_join(text.percent_placeholders(F.col("plain")), " ").alias("found"))


@_query
def q_brace_placeholders(spark, folder):
    found = markup.placeholders(F.col("source_text"), F.lit("generic"))
    return _segments(spark, folder, "source_text").select("id", F.array_join(F.filter(found, lambda x: x.startswith("{")), " ").alias("found"))


@_query
def q_placeholders(spark, folder):
    """Every placeholder of every source, in both dialects."""
    rows = _segments(spark, folder, "source_text")
    return rows.select("id", *[F.array_join(markup.placeholders(F.col("source_text"), F.lit(d)), " ").alias(d) for d in ("generic", "qt")])


@_query
def q_inline_placeholders(spark, folder):
    return _segments(spark, folder, "target_text").select("id", F.array_join(markup.inline_elements(F.col("target_text")), " ").alias("found"))


@_query
def q_placeholder_kinds(spark, folder):
    rows = _segments(spark, folder, "source_text").select("id", markup.plain_text(F.col("source_text")).alias("plain"))
    each = rows.select("id", F.explode(text.percent_placeholders(F.col("plain"))).alias("name"))
    return each.groupBy("name", text.percent_kind(F.col("name")).alias("kind")).agg(F.count("*").alias("n"))


@_query
def q_placeholder_diff(spark, folder):
    files = table(spark, folder, "files").select(F.col("id").alias("file_id"), text.dialect(F.col("format")).alias("dialect"))
    rows = _segments(spark, folder, "file_id", "source_text", "target_text").where(~text.is_blank(F.col("target_text"))).join(files, "file_id", "left")
    dialect = F.coalesce("dialect", F.lit("generic"))
    rows = rows.select("id", markup.placeholders(F.col("source_text"), dialect).alias("source"), markup.placeholders(F.col("target_text"), dialect).alias("target"))
    source, target = F.col("source"), F.col("target")
    both = rows.select("id", F.array_join(text.multiset_minus(source, target), " ").alias("missing"), F.array_join(text.multiset_minus(target, source), " ").alias("extra"))
    return both.where((F.col("missing") != "") | (F.col("extra") != ""))


# Checks


def _placed(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    files = table(spark, folder, "files").select(F.col("id").alias("file_id"), "project_id", "format")
    projects = table(spark, folder, "projects").select(F.col("id").alias("project_id"), F.col("length_tolerance").alias("tolerance"), "target_locale")
    return _segments(spark, folder, "file_id", *columns).join(files, "file_id").join(projects, "project_id")


@_query
def q_length_check(spark, folder):
    rows = _placed(spark, folder, "source_text", "target_text", "max_width").where(~text.is_blank(F.col("target_text")))
    found = checks.length_issues(markup.plain_text(F.col("source_text")), markup.plain_text(F.col("target_text")), F.coalesce("max_width", F.lit(0)), F.col("tolerance"))
    return rows.select("id", F.explode(found).alias("i")).select("id", "i.severity", "i.message")


@_query
def q_terminology(spark, folder):
    rows = _placed(spark, folder, "source_text", "target_text").where(~text.is_blank(F.col("target_text")))
    read = rows.withColumns({c: markup.plain_text(F.col(c)) for c in ("source_text", "target_text")})
    read = read.withColumns({c: checks.both_cases(F.col(c)) for c in ("source_text", "target_text")})
    joined = read.join(checks.glossary_by_project(table(spark, folder, "glossary_terms")), "project_id")
    found = checks.terminology_issues(F.col("source_text"), F.col("target_text"), F.col("glossary"))
    return joined.select("id", F.explode(found).alias("i")).groupBy("id").agg(F.count("*").alias("n"), F.min("i.message").alias("first_message"))


@_query
def q_consistency_warnings(spark, folder):
    rows = _placed(spark, folder, "source_text", "target_text", "status")
    return checks.with_others(rows).where(F.col("others").isNotNull()).select("id", F.col("others").alias("message"))


@_query
def q_recheck(spark, folder):
    """All checks of all segments, counted by kind and severity."""
    found = checks.recheck(_segments(spark, folder, "file_id", "source_text", "target_text", "status", "max_width"), *[table(spark, folder, t) for t in ("files", "projects", "glossary_terms")])
    return found.groupBy("kind", "severity").agg(F.count("*").alias("n"))


@_query
def q_blocked_segments(spark, folder):
    lists = reports.with_issue_lists(_segments(spark, folder, "file_id"), table(spark, folder, "qa_issues"))
    return lists.where(checks.blocking(F.col("issues"))).select("id", checks.first_blocking(F.col("issues")).alias("reason"))


# Memory


def _queries(spark: SparkSession, folder: str) -> DataFrame:
    """The query set of the searches: entries whose id is divisible by 50, against all entries."""
    rows = table(spark, folder, "tm_entries").where(F.col("id") % 50 == 0)
    return rows.select(F.col("id").alias("query_id"), "project_id", "target_locale", "source_hash", "embedding")


@_query
def q_exact_matches(spark, folder):
    return memory.exact_matches(_queries(spark, folder), table(spark, folder, "tm_entries")).select("query_id", "id", "target_text", "place")


@_query
def q_semantic_matches(spark, folder):
    return memory.semantic_matches(_queries(spark, folder), table(spark, folder, "tm_entries")).select("query_id", "id", "place", F.round("score", 6).alias("score"))


@_query
def q_suggest_merge(spark, folder):
    return memory.suggest(_queries(spark, folder), table(spark, folder, "tm_entries")).select("query_id", "rank", "id", "kind", F.round("score", 6).alias("score"))


@_query
def q_first_per_pair(spark, folder):
    rows = _segments(spark, folder, "file_id", "unit_key", "form_index", "source_text", "target_text", "status").where((F.col("status") == "approved") & (F.col("form_index") == 0) & (F.col("target_text") != ""))
    hashed = rows.withColumn("h", text.content_hash(F.col("source_text")))
    return memory.first_per_pair(hashed, ["h", "target_text"], ["unit_key", "form_index", "id"]).select("id", "h")


@_query
def q_index_rows(spark, folder):
    """Approved segments as memory rows with vectors of a stand-in embedder: rows and vectors per project."""
    rows = _placed(spark, folder, "unit_key", "form_index", "source_text", "target_text", "status").where((F.col("status") == "approved") & (F.col("target_text") != ""))
    made = memory.index_rows(rows, memory.HashingEmbedder(384))
    return made.groupBy("project_id").agg(F.count("*").alias("entries"), F.count_if(F.size("embedding") == 384).alias("vectors"))


# Changes


@_query
def q_upsert_latest(spark, folder):
    rows = table(spark, folder, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return changes.latest(rows, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@_query
def q_tm_upsert(spark, folder):
    """The memory after its repeated keys were settled, the latest winning."""
    rows = table(spark, folder, "tm_entries").select("id", "project_id", "target_locale", "source_hash", "target_text", "approved_by", "created_at")
    return changes.latest(rows, ["project_id", "target_locale", "source_hash", "target_text"], ["created_at", "id"]).select("id", "project_id", "approved_by")


@_query
def q_glossary_upsert(spark, folder):
    rows = table(spark, folder, "glossary_terms").withColumn("term", F.trim("source_term"))
    return changes.latest(rows, ["project_id", "term"], ["id"]).select("project_id", "term", "id", "target_term")


@_query
def q_reimport_kept(spark, folder):
    """Files imported again with every seventh source edited: what of the state before is kept."""
    prior = changes.latest(table(spark, folder, "segments").select("id", "file_id", "unit_key", "form_index", "source_text", "target_text", "status", "reviewed_by", "updated_at"), ["file_id", "unit_key", "form_index"], ["updated_at", "id"])
    new = prior.select("id", "file_id", "unit_key", "form_index", F.when(F.col("id") % 7 == 0, F.concat("source_text", F.lit("!"))).otherwise(F.col("source_text")).alias("source_text"), "target_text", F.lit("draft").alias("status"), F.lit(None).cast("string").alias("reviewed_by"))
    made = changes.carry_over(new, prior, ["status", "reviewed_by"])
    return made.groupBy("file_id").agg(F.count("*").alias("total"), F.count_if("was_kept").alias("kept"), F.count_if(F.col("status") == "approved").alias("approved"))


@_query
def q_import_counts(spark, folder):
    units = table(spark, folder, "units")
    blank = F.size(F.filter("targets", text.is_blank))
    rows = units.select("file_id", file_source.is_skipped(F.col("source"), F.col("native_state")).alias("skipped"), blank.alias("blank"), F.size("targets").alias("forms"))
    return changes.import_counts(rows)


@_query
def q_unit_forms(spark, folder):
    units = table(spark, folder, "units")
    forms = units.select("file_id", "unit_key", "ordinal", "native_state", F.posexplode("targets").alias("form_index", "t"))
    return forms.select("file_id", "unit_key", "ordinal", "form_index", text.status_from_native(F.col("t"), F.col("native_state")).alias("status"))


@_query
def q_export_worked(spark, folder):
    """Units whose segments were worked on or whose text differs from the file."""
    seg = changes.latest(table(spark, folder, "segments").select("id", "file_id", "unit_key", "form_index", "target_text", "status", "origin", "reviewed_by", "updated_at"), ["file_id", "unit_key", "form_index"], ["updated_at", "id"])
    units = memory.first_per_pair(table(spark, folder, "units"), ["file_id", "unit_key"], ["ordinal", "source", "targets"])
    return file_source.updates(units, seg).select("file_id", "unit_key", F.array_join("targets", "\n").alias("targets"), "state")


@_query
def q_orphans_cascade(spark, folder):
    """Findings whose segment is gone are dropped; memory rows lose the reference only."""
    seg = _segments(spark, folder, "file_id")
    left = changes.cascade(table(spark, folder, "qa_issues"), "segment_id", seg)
    kept = changes.cascade(table(spark, folder, "tm_entries").select("id", "segment_id"), "segment_id", seg, null_out=True)
    counts = left.agg(F.count("*").alias("n")).select(F.lit("issues").alias("what"), "n")
    return counts.union(kept.agg(F.count("segment_id").alias("n")).select(F.lit("memory"), "n"))


# Files, over small files made in memory


@_query
def q_parse_units(spark, folder):
    rows = file_source.units(fixtures.files(spark))
    return rows.select("file_id", "ordinal", "unit_key", "context", "source", F.array_join("targets", "|").alias("targets"), "plural", F.array_join("notes", "|").alias("notes"), "max_width", "native_state")


@_query
def q_parse_segments(spark, folder):
    return file_source.segments(file_source.units(fixtures.files(spark))).select("file_id", "unit_key", "form_index", "source_text", "target_text", "status")


@_query
def q_export_bytes(spark, folder):
    made = fixtures.files(spark)
    out = file_source.export(made, fixtures.updates(spark))
    return out.select("id", "name", F.decode("content", "utf-8").alias("content"))


@_query
def q_changed_spans(spark, folder):
    return file_source.changed_spans(fixtures.files(spark), fixtures.updates(spark))
