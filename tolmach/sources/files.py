"""Localization files as DataFrames: files in, units and segments out, edited bytes back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup, text
from ..kernels import documents
from ..schema import DDL

_UNITS = DDL["units"]
#: The columns of the binaryFile source; a stream of files needs them given.
BINARY_FILES = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
#: Uploads larger than this are refused.
MOST_BYTES = 32 << 20


def read_files(spark: SparkSession, path: str, project_id: int) -> DataFrame:
    """Files under a path or pattern as rows of the files table; ids follow from project and name."""
    return as_files(spark.read.format("binaryFile").load(path), project_id, most_bytes=None)


def as_files(raw: DataFrame, project_id: int, most_bytes: int | None = MOST_BYTES) -> DataFrame:
    """Rows of the binaryFile source as rows of the files table; other endings are errors, as are files above ``most_bytes``."""
    name = F.element_at(F.split("path", "/"), -1)
    ending = F.lower(name)
    kind = F.when(ending.endswith(".ts"), "qtts").when(ending.endswith(".xlf") | ending.endswith(".xliff"), "xliff").otherwise(F.raise_error(F.concat(F.lit("unsupported file "), name)).cast("string"))
    content = F.col("content") if most_bytes is None else F.when(F.col("length") <= most_bytes, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("file too large: "), name)).cast("binary"))
    project = F.lit(project_id).cast("long")
    return raw.select(F.xxhash64(project, name).alias("id"), project.alias("project_id"), name.alias("name"), kind.alias("format"), content.alias("original"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("imported_at"))


def units(files: DataFrame) -> DataFrame:
    """All units of files (id, name, original): one row per unit with its slot. A file that cannot be parsed is an error that names it."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in _UNITS.split(", ")]
        for part in parts:
            for ident, name, original in zip(part["id"], part["name"], part["original"], strict=True):
                try:
                    _, found = documents.read(name, bytes(original))
                except ValueError as error:
                    raise ValueError(f"{name}: {error}") from error
                yield pd.DataFrame([{"file_id": ident} | u for u in found], columns=names)

    return files.select("id", "name", "original").mapInPandas(run, _UNITS)


def is_skipped(source: Column, native_state: Column) -> Column:
    """Units that are no segments: no visible source, or no longer part of the file."""
    return text.is_blank(markup.plain_text(source)) | F.coalesce(native_state.isin(*documents.OBSOLETE), F.lit(False))


def segments(unit_rows: DataFrame) -> DataFrame:
    """One row per unit and plural form; ids follow from file, key and form."""
    rows = unit_rows.where(~is_skipped(F.col("source"), F.col("native_state"))).select("*", F.posexplode("targets").alias("form_index", "target_text"))
    return rows.select(
        F.xxhash64("file_id", "unit_key", "form_index").alias("id"), "file_id", "unit_key", "form_index", "context", F.col("source").alias("source_text"), "target_text",
        text.status_from_native(markup.plain_text(F.col("target_text")), F.col("native_state")).alias("status"), F.lit("import").alias("origin"), F.col("plural").alias("is_plural"), "max_width", F.array_join("notes", "\n").alias("notes"),
        F.lit(None).cast("string").alias("reviewed_by"), F.lit(None).cast("timestamp").alias("reviewed_at"), F.current_timestamp().alias("updated_at"),
    )


def updates(unit_rows: DataFrame, segment_rows: DataFrame, approved_only: bool = False) -> DataFrame:
    """What an export rewrites: (file_id, unit_key, targets, state), the state being that of form 0.

    A unit is rewritten if its form 0 was worked on (origin other than import, or a
    reviewer) or its text differs from the file; obsolete units never are.
    """
    grouped = segment_rows.groupBy("file_id", "unit_key").agg(
        F.map_from_entries(F.collect_list(F.struct("form_index", F.coalesce("target_text", F.lit(""))))).alias("forms"),
        F.min_by(F.struct("status", "origin", "reviewed_by"), "form_index").alias("first"),
    )
    joined = unit_rows.select("file_id", "unit_key", "targets", "native_state").join(grouped, ["file_id", "unit_key"])
    # forms that the file does not have are left out, forms without a segment stay as they are
    joined = joined.withColumn("new", F.transform("targets", lambda t, i: F.coalesce(F.try_element_at(F.col("forms"), i), t)))
    worked = (F.col("first.origin") != "import") | F.col("first.reviewed_by").isNotNull()
    wanted = (worked | (F.col("new") != F.col("targets"))) & ~F.coalesce(F.col("native_state").isin(*documents.OBSOLETE), F.lit(False))
    if approved_only:
        wanted = wanted & (F.col("first.status") == "approved")
    return joined.where(wanted).select("file_id", "unit_key", F.col("new").alias("targets"), F.col("first.status").alias("state"))


def export(files: DataFrame, update_rows: DataFrame) -> DataFrame:
    """Files with updates written: (id, name, content); untouched bytes are those of the original.

    Updates are grouped per file, whose size is bounded; a file without any comes back as it is.
    """
    per_file = update_rows.groupBy(F.col("file_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("unit_key", "targets", "state"))).alias("edits"))
    joined = files.select("id", "name", "original").join(per_file, "id", "left")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            made = []
            for name, original, rows in zip(part["name"], part["original"], part["edits"], strict=True):
                todo = [] if rows is None else [(r["unit_key"], list(r["targets"]), r["state"]) for r in rows]
                made.append(documents.write(name, bytes(original), todo))
            yield pd.DataFrame({"id": part["id"], "name": part["name"], "content": made})

    return joined.mapInPandas(run, "id long, name string, content binary")


def changed_spans(files: DataFrame, update_rows: DataFrame) -> DataFrame:
    """The byte ranges an export rewrites: (file_id, start, end, new_length), in order."""
    per_file = update_rows.groupBy(F.col("file_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("unit_key", "targets", "state"))).alias("edits"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for ident, name, original, rows in zip(part["id"], part["name"], part["original"], part["edits"], strict=True):
                source, kind = bytes(original), documents.format_of(name)
                todo = [(r["unit_key"], list(r["targets"]), r["state"]) for r in rows]
                found = sorted(documents.edits(kind, source, documents.READERS[kind](source)[1], todo), key=lambda e: e[0])
                yield pd.DataFrame([(ident, s, e, len(n)) for s, e, n in found], columns=["file_id", "start", "end", "new_length"])

    return files.select("id", "name", "original").join(per_file, "id").mapInPandas(run, "file_id long, start int, end int, new_length int")
