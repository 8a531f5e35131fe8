"""The engine's operations over tables kept in one folder.

Each table is a chain of snapshots, each with a manifest of its own, so a reader sees a
whole version and a write that fails leaves the one before. The tables that grow are
kept in parts by file; a change rewrites the parts of its files only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .functions import markup, text
from .operators import changes, checks, memory, reports
from .session import materialise
from .sources import files as file_source
from .sources.tables import current_version, part_of, read_snapshot, write_parts, write_snapshot

#: What a segment keeps when its file is imported again unchanged.
KEPT = ["status", "origin", "reviewed_by", "reviewed_at", "updated_at"]


class Engine:
    """Files, segments, findings, glossary and memory of the projects in a folder."""

    def __init__(self, spark: SparkSession, root: str, embedder: memory.Embedder | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.embedder = embedder or memory.HashingEmbedder()

    def table(self, name: str, parts: list[int] | None = None) -> DataFrame:
        """The current version of a table, or some of its parts; empty before the first."""
        path = f"{self.root}/{name}"
        return schema.empty(self.spark, name) if current_version(self.spark, path) is None else read_snapshot(self.spark, path, parts, schema.DDL[name])

    def store(self, name: str, rows: DataFrame) -> None:
        """Make rows the next version of a table."""
        path = f"{self.root}/{name}"
        write_snapshot(rows.select(*schema.empty(self.spark, name).columns), path, (current_version(self.spark, path) or 0) + 1)

    def store_parts(self, name: str, rows: DataFrame, key: str, parts: list[int] | None) -> None:
        """Make rows the given parts (all if None) of a table's next version; ``key`` is their file."""
        path = f"{self.root}/{name}"
        columns = schema.empty(self.spark, name).columns
        kept = rows.select(*columns, *([key] if key not in columns else []))
        write_parts(kept, path, (current_version(self.spark, path) or 0) + 1, F.col(key), parts)

    def parts_of(self, files: DataFrame) -> list[int]:
        """The parts that hold files (file_id): at most as many as a table has."""
        return [r["p"] for r in files.select(part_of(F.col("file_id")).alias("p")).distinct().collect()]

    def add_project(self, name: str, source_locale: str, target_locale: str, length_tolerance: float | None = None) -> int:
        """Add a project, or change the one of that name; gives its id. Tolerance None is 1, 0 turns the length check off."""
        row = self.spark.createDataFrame([(name, source_locale, target_locale, length_tolerance)], "name string, source_locale string, target_locale string, length_tolerance float")
        row = row.select(F.xxhash64("name").alias("id"), "*", F.current_timestamp().alias("created_at"))
        self.store("projects", changes.upsert(self.table("projects"), row, ["id"], ["created_at"]))
        return row.first()["id"]

    def project(self, project_id: int) -> DataFrame:
        """A project's row; NotFound if there is none."""
        return schema.get(self.table("projects"), project_id)

    def projects(self) -> DataFrame:
        """All projects with the size of their memory."""
        return memory.entry_counts(self.table("projects"), self.table("tm_entries")).orderBy("name")

    def import_files(self, path: str, project_id: int) -> DataFrame:
        """Read files into a project, replacing earlier versions; segments that did not change keep their state.

        Gives per file: segments, translated, untranslated, skipped, kept.
        """
        self.project(project_id)
        new = materialise(file_source.read_files(self.spark, path, project_id), "files")  # read once, whatever changes there meanwhile
        units = materialise(file_source.units(new), "units")
        seg = changes.carry_over(file_source.segments(units), self.table("segments"), KEPT)
        ids = materialise(new.select(F.col("id").alias("file_id")), "ids")
        parts = self.parts_of(ids)
        self.store_parts("files", changes.replace_rows(self.table("files", parts), new, ["id"]), "id", parts)
        old_units, old = self.table("units", parts), self.table("segments", parts)
        self.store_parts("units", old_units.join(ids, "file_id", "left_anti").select(*old_units.columns).unionByName(units), "file_id", parts)
        kept = seg.groupBy("file_id").agg(F.count_if("was_kept").alias("kept"))
        flags = units.select("file_id", file_source.is_skipped(F.col("source"), F.col("native_state")).alias("skipped"), F.size(F.filter("targets", text.is_blank)).alias("blank"), F.size("targets").alias("forms"))
        counts = materialise(changes.import_counts(flags).join(kept, "file_id", "left").withColumn("kept", F.coalesce("kept", F.lit(0).cast("long"))), "counts")
        gone = old.join(ids, "file_id", "left_anti").select(*old.columns)
        self.store_parts("segments", gone.unionByName(seg.select(*old.columns)), "file_id", parts)
        self._recheck(ids)
        return counts

    def _recheck(self, files: DataFrame | None) -> None:
        """Check the segments of files (file_id), or all, and replace their findings; only the parts of these files are written.

        Findings of segments that are gone go as well.
        """
        segments = self.table("segments")
        found = checks.recheck(segments, self.table("files").drop("original"), self.table("projects"), self.table("glossary_terms"), files)
        place = segments.select(F.col("id").alias("segment_id"), "file_id")
        parts = None if files is None else self.parts_of(files)
        made = found.join(place, "segment_id")
        if files is not None:
            # the rest of these parts: findings of segments in other files
            others = self.table("qa_issues", parts).join(place.join(files.select("file_id").distinct(), "file_id", "left_anti"), "segment_id")
            made = made.unionByName(others.select(*made.columns))
        self.store_parts("qa_issues", made, "file_id", parts)

    def recheck(self, file_id: int | None = None) -> int:
        """Run all checks on the segments of a file, or on all, and keep their findings; gives their number."""
        if file_id is None:
            self._recheck(None)
            return self.table("qa_issues").count()
        schema.get(self.table("files"), file_id)
        self._recheck(self.spark.createDataFrame([(file_id,)], "file_id long"))
        return self.table("qa_issues").join(self.table("segments").where(F.col("file_id") == file_id).select(F.col("id").alias("segment_id")), "segment_id", "left_semi").count()

    def files(self, project_id: int | None = None) -> DataFrame:
        """Files with their counts."""
        rows = self.table("files").drop("original")
        rows = rows if project_id is None else rows.where(F.col("project_id") == project_id)
        return reports.files_with_stats(rows, self.stats()).orderBy("name")

    def stats(self) -> DataFrame:
        """Counts by status and severity of each file."""
        return reports.file_stats(self.table("segments"), self.table("qa_issues"))

    def segments(self, **filters) -> DataFrame:
        """One page of segments with their findings; filters as in ``reports.segments_page``."""
        page = reports.segments_page(self.table("segments"), self.table("qa_issues"), **filters)
        return reports.with_issue_lists(page, self.table("qa_issues")).orderBy("id")

    def edit(self, edits: DataFrame) -> DataFrame:
        """Apply edits (id, target_text, status, origin, reviewed_by, at); malformed ones are refused.

        Gives (id, error), error null where the edit was stored. Ampersands are escaped as
        needed; the latest edit of an id counts. Who may set which status is for the caller.
        """
        last = changes.latest(edits, ["id"], ["at"]).withColumn("target_text", text.normalize_fragment(F.col("target_text")))
        known = self.table("segments").select("id", "file_id")
        found = last.join(known, "id", "left")
        judged = materialise(found.withColumn("error", F.when(F.col("file_id").isNull(), F.lit("no such segment")).otherwise(markup.fragment_error(F.col("target_text")))), "edits")
        good = judged.where(F.col("error").isNull())
        files = good.select("file_id").distinct()
        parts = self.parts_of(files)
        if not parts:
            return judged.select("id", "error")
        new = {"target_text": "target_text", "status": "status", "origin": "origin", "reviewed_by": "reviewed_by", "updated_at": "at"}
        took = good.select("id", F.struct(*[F.col(v).alias(k) for k, v in new.items()]).alias("_e"))
        rows = self.table("segments", parts).join(took, "id", "left").withColumns({k: F.when(F.col("_e").isNotNull(), F.col(f"_e.{k}")).otherwise(F.col(k)) for k in new})
        rows = rows.withColumn("reviewed_at", F.when(F.col("_e").isNotNull(), F.when(F.col("_e.reviewed_by").isNotNull(), F.col("_e.updated_at"))).otherwise(F.col("reviewed_at")))
        self.store_parts("segments", rows.drop("_e"), "file_id", parts)
        self._recheck(files)
        return judged.select("id", "error")

    def pretranslate(self, file_id: int, provider: memory.DraftProvider) -> dict[str, int]:
        """Draft the untranslated segments of a file: well-formed drafts are stored as needs_review by machine and checked.

        Gives how many were asked for, drafted and refused as malformed or blank.
        """
        schema.get(self.table("files"), file_id)
        project = self.project(self.table("files").where(F.col("id") == file_id).first()["project_id"]).first()
        todo = self.table("segments").where((F.col("file_id") == file_id) & text.is_blank(F.col("target_text")))
        drafts = materialise(memory.draft(todo, provider, project["source_locale"], project["target_locale"]), "drafts")
        good = drafts.where(~text.is_blank(F.col("draft")))
        row = [F.col("draft").alias("target_text"), F.lit("needs_review").alias("status"), F.lit("machine").alias("origin"), F.lit(None).cast("string").alias("reviewed_by"), F.current_timestamp().alias("at")]
        asked, drafted = drafts.count(), good.count()
        if drafted:
            self.edit(good.select("id", *row))
        return {"asked": asked, "drafted": drafted, "refused": asked - drafted}

    def issue_totals(self) -> DataFrame:
        """Findings by kind and severity."""
        return reports.issue_totals(self.table("qa_issues")).orderBy("kind", "severity")

    def inconsistencies(self, limit: int = 100) -> DataFrame:
        """Sources with several approved wordings, as visible text."""
        found = reports.inconsistent_sources(self.table("segments"), self.table("files").drop("original"), limit)
        return found.select("project_id", markup.plain_text(F.col("source_text")).alias("source"), F.transform("variants", lambda v: v).alias("variants"))

    def add_terms(self, terms: DataFrame) -> None:
        """Add or change glossary terms (project_id, source_term, target_term, case_sensitive)."""
        rows = terms.select(F.xxhash64("project_id", "source_term").alias("id"), "project_id", "source_term", "target_term", "case_sensitive")
        self.store("glossary_terms", changes.replace_rows(self.table("glossary_terms"), rows, ["id"]))
        self._recheck(self.table("files").join(terms.select("project_id").distinct(), "project_id", "left_semi").select(F.col("id").alias("file_id")))

    def remove_term(self, term_id: int) -> None:
        """Remove a glossary term; NotFound if there is none."""
        terms = self.table("glossary_terms")
        project = schema.get(terms, term_id).first()["project_id"]
        self.store("glossary_terms", terms.where(F.col("id") != term_id))
        self._recheck(self.table("files").where(F.col("project_id") == project).select(F.col("id").alias("file_id")))

    def glossary(self, project_id: int) -> DataFrame:
        """A project's terms in the order of their source."""
        return self.table("glossary_terms").where(F.col("project_id") == project_id).orderBy("source_term")

    def remember(self) -> int:
        """Put approved segments with a reviewer into the memory, the latest of a pair winning; gives its size."""
        projects = self.table("projects").select(F.col("id").alias("project_id"), "source_locale", "target_locale")
        placed = reports.approved(self.table("segments"), self.table("files").drop("original")).where(F.col("reviewed_by") != "").join(projects, "project_id")
        made = memory.index_rows(placed, self.embedder)
        rows = made.select(
            F.xxhash64("project_id", "target_locale", "source_hash", "target_text").alias("id"), "project_id", "source_locale", "target_locale", F.col("source_plain").alias("source_text"), "target_text", "source_hash", "embedding",
            F.col("id").alias("segment_id"), F.col("reviewed_by").alias("approved_by"), F.coalesce("reviewed_at", F.current_timestamp()).alias("created_at"),
        )
        self.store("tm_entries", changes.upsert(self.table("tm_entries"), rows, ["project_id", "target_locale", "source_hash", "target_text"], ["created_at"]))
        return self.table("tm_entries").count()

    def search(self, project_id: int, texts: list[str], limit: int = 5, least: float = 0.0) -> DataFrame:
        """Suggestions for texts from a project's memory: (query_id, rank, id, target_text, kind, score), query_id being a text's place."""
        locale = self.project(project_id).first()["target_locale"]
        asked = self.spark.createDataFrame(list(enumerate(texts)), "query_id long, t string").withColumn("plain", text.normalize(markup.plain_text(F.col("t"))))
        asked = memory.embed(asked.withColumns({"project_id": F.lit(project_id).cast("long"), "target_locale": F.lit(locale), "source_hash": F.sha2("plain", 256)}), "plain", self.embedder)
        entries = self.table("tm_entries")
        near = memory.semantic_matches(asked, entries, limit, least or 0.6, self.embedder.dims)
        return memory.merge_matches(memory.exact_matches(asked, entries, limit), near, limit).orderBy("query_id", "rank")

    def suggest(self, segment_id: int, limit: int = 5, least: float = 0.0) -> DataFrame:
        """Suggestions for a segment."""
        row = schema.get(self.table("segments"), segment_id).join(self.table("files").select(F.col("id").alias("file_id"), "project_id"), "file_id").first()
        return self.search(row["project_id"], [row["source_text"]], limit, least)

    def export(self, file_id: int | None = None, approved_only: bool = False) -> DataFrame:
        """Files as they should be written: (id, name, content)."""
        rows = self.table("files") if file_id is None else schema.get(self.table("files"), file_id)
        return file_source.export(rows, file_source.updates(self.table("units"), self.table("segments"), approved_only))
