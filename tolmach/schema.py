"""Tables of the engine and what their columns may hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
_SPAN = "STRUCT<start:INT,end:INT>"
_SLOT = f"STRUCT<exists:BOOLEAN,elem:{_SPAN},attrs:{_SPAN},inner:{_SPAN},insert_at:INT,indent:STRING>"
DDL = {
    "projects": "id BIGINT, name STRING, source_locale STRING, target_locale STRING, length_tolerance FLOAT, created_at TIMESTAMP",
    "files": "id BIGINT, project_id BIGINT, name STRING, format STRING, original BINARY, sha256 STRING, imported_at TIMESTAMP",
    "units": f"file_id BIGINT, ordinal INT, unit_key STRING, context STRING, source STRING, targets ARRAY<STRING>, plural BOOLEAN, notes ARRAY<STRING>, max_width INT, native_state STRING, unit_span {_SPAN}, slot {_SLOT}, unit_attrs {_SPAN}",
    "segments": "id BIGINT, file_id BIGINT, unit_key STRING, form_index INT, context STRING, source_text STRING, target_text STRING, status STRING, origin STRING, is_plural BOOLEAN, max_width INT, notes STRING, reviewed_by STRING, reviewed_at TIMESTAMP, updated_at TIMESTAMP",
    "qa_issues": "segment_id BIGINT, kind STRING, severity STRING, message STRING, ordinal INT",
    "glossary_terms": "id BIGINT, project_id BIGINT, source_term STRING, target_term STRING, case_sensitive BOOLEAN",
    "tm_entries": "id BIGINT, project_id BIGINT, source_locale STRING, target_locale STRING, source_text STRING, target_text STRING, source_hash STRING, embedding ARRAY<FLOAT>, segment_id BIGINT, approved_by STRING, created_at TIMESTAMP",
    "matches": "id BIGINT, source_text STRING, target_text STRING, approved_by STRING, created_at TIMESTAMP, kind STRING, score DOUBLE",
}
STATUSES = ("untranslated", "draft", "needs_review", "approved", "rejected")
ORIGINS = ("import", "human", "machine", "memory")
FORMATS = ("xliff", "qtts")
SEVERITIES = ("error", "warning")


class NotFound(LookupError):
    """A row that was asked for by its id is not there."""


def empty(spark: SparkSession, name: str) -> DataFrame:
    """An empty table of the current schema version."""
    return spark.createDataFrame([], DDL[name])


def in_domain(column: Column, allowed: tuple[str, ...], name: str) -> Column:
    """The column, or an error where it holds another value; nulls pass."""
    return F.when(column.isNull() | column.isin(*allowed), column).otherwise(F.raise_error(F.concat(F.lit(f"{name}: unknown value "), column)).cast("string"))


def violations(segments: DataFrame) -> DataFrame:
    """Segments that break a rule of the table: (id, rule)."""
    named = F.length(F.trim(F.coalesce("reviewed_by", F.lit("")))) > 0
    rules = F.array(
        F.when((F.col("status") == "approved") & (~named | F.col("reviewed_at").isNull()), F.lit("approved_needs_a_reviewer")),
        F.when(named & F.col("reviewed_at").isNull(), F.lit("reviewer_implies_timestamp")),
        F.when(~F.col("status").isin(*STATUSES), F.lit("status_domain")),
    )
    return segments.select("id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))


def get(df: DataFrame, value: int, column: str = "id") -> DataFrame:
    """The row of an id; NotFound if there is none."""
    row = df.where(F.col(column) == value)
    if row.isEmpty():
        raise NotFound(f"{column} {value}")
    return row
