"""Reports over segments, findings, files and projects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import STATUSES


def once(segments: DataFrame, *columns: str) -> DataFrame:
    """The given columns (all if none) of each segment once: a row that arrived twice has the same id and content."""
    rows = segments.select("id", *[c for c in columns if c != "id"]) if columns else segments
    return rows.dropDuplicates(["id"])


def file_stats(segments: DataFrame, issues: DataFrame) -> DataFrame:
    """Segments of each file by status, and its findings by severity.

    Findings are counted per segment before the join, so neither count is multiplied.
    """
    per_segment = issues.groupBy(F.col("segment_id").alias("id")).agg(F.count_if(F.col("severity") == "error").alias("e"), F.count_if(F.col("severity") == "warning").alias("w"))
    rows = segments.join(per_segment, "id", "left")
    return rows.groupBy("file_id").agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES],
        F.coalesce(F.sum("e"), F.lit(0).cast("long")).alias("errors"),
        F.coalesce(F.sum("w"), F.lit(0).cast("long")).alias("warnings"),
    )


#: How many rows a page holds where none is asked for: of the programming interface, of the command line, the most there may be.
PAGE, COMMAND_PAGE, LARGEST_PAGE, DEFAULT_LIMIT = 50, 500, 500, 100


def matching(segments: DataFrame, issues: DataFrame | None = None, file_id: int | None = None, status: str = "", search: str = "", literal: bool = False, with_issue: bool = False) -> DataFrame:
    """Segments that pass the filters that are set.

    ``search`` is a case-insensitive pattern in source or target, with % and _ as
    wildcards unless ``literal``. Only the filters that are set are in the plan, so those
    on stored columns reach the scan.
    """
    rows = segments
    if file_id is not None:
        rows = rows.where(F.col("file_id") == file_id)
    if status:
        rows = rows.where(F.col("status") == status)
    if search:
        both = [F.contains(F.lower(c), F.lit(search.lower())) if literal else F.col(c).ilike(f"%{search}%") for c in ("source_text", "target_text")]
        rows = rows.where(F.coalesce(both[0], F.lit(False)) | F.coalesce(both[1], F.lit(False)))
    if with_issue and issues is not None:
        rows = rows.join(issues.select(F.col("segment_id").alias("id")), "id", "left_semi")
    return rows


def segments_page(segments: DataFrame, issues: DataFrame | None = None, limit: int = DEFAULT_LIMIT, offset: int = 0, **filters) -> DataFrame:
    """One page of the segments that ``matching`` finds, in the order of their ids; a limit of 0 or less, or above 500, is 100."""
    return matching(segments, issues, **filters).orderBy("id").offset(max(0, offset)).limit(limit if 0 < limit <= LARGEST_PAGE else DEFAULT_LIMIT)


def page_total(page_rows: DataFrame) -> DataFrame:
    """How many rows a filter finds, for paging."""
    return page_rows.agg(F.count("*").alias("total"))


def with_issue_lists(segments: DataFrame, issues: DataFrame) -> DataFrame:
    """Segments with their findings as an array in the order they were made; an empty one where there are none.

    Findings of one place are sorted by kind, severity and message; a null comes last.
    """
    columns = ["ordinal", "kind", "severity", "message"]
    ordered = F.array_sort(F.collect_list(F.struct(*[x for c in columns for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))])))
    lists = issues.groupBy(F.col("segment_id").alias("id")).agg(F.transform(ordered, lambda i: F.struct(*[i[c].alias(c) for c in columns])).alias("issues"))
    return segments.join(lists, "id", "left").withColumn("issues", F.coalesce("issues", F.array().cast("array<struct<ordinal:int,kind:string,severity:string,message:string>>")))


def approved(segments: DataFrame, files: DataFrame) -> DataFrame:
    """Approved segments with a target, and their project."""
    where = files.select(F.col("id").alias("file_id"), "project_id")
    return segments.where((F.col("status") == "approved") & (F.col("target_text") != "")).join(where, "file_id")


def wordings(segments: DataFrame, files: DataFrame) -> DataFrame:
    """Approved wordings of each source within its project, a row each: (project_id, source_text, target_text)."""
    return approved(segments, files).select("project_id", "source_text", "target_text").distinct()


def approved_by_source(segments: DataFrame, files: DataFrame) -> DataFrame:
    """Approved wordings of each source within its project as one array: (project_id, source_text, variants sorted). ``wordings`` has them as rows."""
    return wordings(segments, files).groupBy("project_id", "source_text").agg(F.array_sort(F.collect_list("target_text")).alias("variants"))


def inconsistent_sources(segments: DataFrame, files: DataFrame, limit: int | None = None) -> DataFrame:
    """Sources with more than one approved wording; in binary order of the source if limited.

    The sources are found by the least and the greatest of their wordings, so only these
    have an array, and with a limit only those within it.
    """
    rows = approved(segments, files).select("project_id", "source_text", "target_text")
    keys = ["project_id", "source_text"]
    found = rows.groupBy(*keys).agg(F.min("target_text").alias("least"), F.max("target_text").alias("most")).where("least <> most").select(*keys)
    if limit is not None:
        found = found.orderBy("source_text", "project_id").limit(limit if limit > 0 else 100)
    made = rows.join(found, keys, "left_semi").distinct().groupBy(*keys).agg(F.array_sort(F.collect_list("target_text")).alias("variants"))
    return made if limit is None else made.orderBy("source_text", "project_id")


def other_approved(segments: DataFrame, files: DataFrame) -> DataFrame:
    """Approved wordings of a segment's source in other segments of its project: (id, target_text), each once.

    A (project, source) group is first reduced to its wordings, each with up to two of
    its segments: a wording counts for a segment if some other segment has it. So a
    label that recurs everywhere does not multiply with itself.
    """
    rows = approved(segments, files)
    wordings = rows.groupBy("project_id", "source_text", "target_text").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    everyone = segments.join(files.select(F.col("id").alias("file_id"), "project_id"), "file_id").select("id", "project_id", "source_text")
    return everyone.join(wordings, ["project_id", "source_text"]).where((F.col("least") != F.col("id")) | (F.col("most") != F.col("id"))).select("id", "target_text")


def issue_totals(issues: DataFrame) -> DataFrame:
    """Findings by kind and severity."""
    return issues.groupBy("kind", "severity").agg(F.count("*").alias("n"))


def files_with_stats(files: DataFrame, stats: DataFrame) -> DataFrame:
    """Every file with its counts, 0 where it has no segments: one join instead of a query per file."""
    counts = [c for c in stats.columns if c != "file_id"]
    joined = files.select(F.col("id").alias("file_id"), "project_id", "name").join(stats, "file_id", "left")
    return joined.select("file_id", "project_id", "name", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts])

