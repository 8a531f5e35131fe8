"""The queries p1_ to p9_ over the tables of a data folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cutoffs, defects, exactcopies, leaks, lookalikes, nearcopies, neighbours, survivors, tokens
from .sql import SQL as SQL


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _named(df: DataFrame, *names: str) -> DataFrame:
    """The tbl number as the table's name."""
    return df.withColumn("tbl", F.array(*map(F.lit, names))[F.col("tbl")])


def _sources(spark: SparkSession, folder: str) -> DataFrame:
    parts = [_table(spark, folder, t).select(F.lit(k).alias("tbl"), "id", F.col("source_text").alias("text")) for k, t in enumerate(("segments", "tm_entries"))]
    return parts[0].union(parts[1])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of rows of one table whose source texts share most of their words."""
    return _named(nearcopies.near_pairs(_sources(spark, folder)), "segments", "tm_entries")


def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Each row that has near copies, with the representative of its word set and the numbers of its copies and links."""
    return _named(nearcopies.near_classes(_sources(spark, folder)), "segments", "tm_entries")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of entries of which one is among the other's five nearest."""
    return neighbours.similar_pairs(_table(spark, folder, "tm_entries"))



def p3_forms(spark: SparkSession, folder: str) -> DataFrame:
    """The consistent form of each target text and term that has another."""
    parts = [_table(spark, folder, t).select(F.lit(k).alias("tbl"), "id", F.col(c).alias("text")) for k, (t, c) in enumerate((("segments", "target_text"), ("glossary_terms", "target_term")))]
    return _named(lookalikes.altered(parts[0].union(parts[1])), "segments", "glossary_terms")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Target texts and terms that hold characters which only look like the usual ones."""
    return p3_forms(spark, folder).select("tbl", "id").distinct()


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Machine drafts that are no translation, each with its kind of defect."""
    origin = F.lower(F.regexp_replace("origin", r"(?U)^\s+|\s+$", ""))
    files = _table(spark, folder, "files").select(F.col("id").alias("file_id"), "project_id")
    projects = _table(spark, folder, "projects").select(F.col("id").alias("project_id"), F.lower(F.substring("target_locale", 1, 2)).alias("lang"))
    locales = files.join(projects, "project_id").select("file_id", "lang")
    rows = _table(spark, folder, "segments").select("id", "file_id", F.col("source_text").alias("source"), F.col("target_text").alias("target"), F.coalesce(origin == "machine", F.lit(False)).alias("machine"))
    placed = rows.join(locales, "file_id", "left")
    labelled = rows.select(F.lit("en").alias("lang"), F.col("source").alias("text")).union(placed.where(~F.col("machine")).select("lang", F.col("target"))).where(F.col("text").isNotNull())
    return defects.draft_defects(placed.where("machine").select("id", "source", "target", "lang"), labelled, others=placed.where(~F.col("machine")).select("id", "source", "target"))


COPY_TABLES = ("segments", "tm_entries", "tm_feed")


def _copies(spark: SparkSession, folder: str) -> DataFrame:
    parts = [_table(spark, folder, t).select(F.lit(k).alias("tbl"), F.col(i).alias("id"), F.col(x).alias("text")) for k, (t, i, x) in enumerate(zip(COPY_TABLES, ("id", "id", "feed_id"), ("source_text", "source_text", "payload"), strict=True))]
    records = exactcopies.canonical_texts(parts[0].union(parts[1])).union(exactcopies.canonical_payloads(parts[2]))
    return exactcopies.copies(records)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Superfluous records that repeat another but for their dress."""
    return _named(_copies(spark, folder), *COPY_TABLES).select("tbl", F.col("rep").alias("id_a"), F.col("id").alias("id_b"))


def p5_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The remaining record of each group of copies, and how many it has."""
    return _named(exactcopies.copy_counts(_copies(spark, folder)), *COPY_TABLES)


ENTRY = ["file_id", "unit_key", "form_index"]


#: How a record came to be; records of any other origin are a source of their own.
SOURCES = ("import", "human", "memory", "machine")


def _fields() -> dict:
    """Who may supply each field of an entry, its value, and the order of trust."""
    approved = F.coalesce(F.lower(F.trim("status")) == "approved", F.lit(False)).cast("int")
    known = survivors.somebody(F.col("reviewed_by")) & F.coalesce((F.col("reviewed_at") >= F.lit("2015-01-01").cast("timestamp")) & (F.col("reviewed_at") < F.lit("2026-07-01").cast("timestamp")), F.lit(False))
    return {
        "target_text": (~survivors.blank(F.col("target_text")), F.col("target_text"), [approved, F.col("updated_at")]),
        "review": (known, F.struct("reviewed_by", "reviewed_at"), [F.col("reviewed_at")]),
    }


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The record that supplies each field of the entries that have several: the given order of trust leaves the quality model nothing to decide here."""
    best = survivors.best_records(_table(spark, folder, "segments"), ENTRY, _fields())
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}.id").alias("id")) for f in ("target_text", "review")])
    return best.select(*ENTRY, F.explode(pairs).alias("x")).select(*ENTRY, "x.field", "x.id").where(F.col("id").isNotNull())


def p6_survivors(spark: SparkSession, folder: str) -> DataFrame:
    """The surviving record of each entry: the best target and review, and every note judged true."""
    rows = _table(spark, folder, "segments").withColumn("source", F.lower(F.trim("origin")))
    best = survivors.survive(rows, ENTRY, _fields(), "target_text", "notes", "source", SOURCES)
    review = F.col("review.value")
    return best.select(*ENTRY, F.col("target_text.value").alias("target_text"), F.round("belief", 6).alias("belief"), review["reviewed_by"].alias("reviewed_by"), review["reviewed_at"].alias("reviewed_at"), F.array_join("values", "\n").alias("notes"))


#: Folder of the public tokenizers' vocabulary files.
TOKENIZERS = os.environ.get("TOLMACH_TOKENIZERS", "/opt/tokenizers")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as token ids of the byte-level vocabulary."""
    return tokens.encode(_table(spark, folder, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the test items of which they hold twelve consecutive words."""
    return leaks.leaks(_table(spark, folder, "documents"), _table(spark, folder, "eval_items"))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "documents").select(F.col("doc_id").alias("key"), "source", "text")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that stop before their end."""
    return cutoffs.cut_off(_documents(spark, folder)).select(F.col("key").alias("doc_id")).distinct()


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """How often each source truncates."""
    rows = _documents(spark, folder)
    return cutoffs.cut_shares(rows, cutoffs.cut_off(rows))


def p9_routes(spark: SparkSession, folder: str) -> DataFrame:
    """What shows that the documents of p9_found are cut: rows by kind of end and of evidence."""
    return cutoffs.cut_routes(cutoffs.routes(_documents(spark, folder)))


QUERIES = {"p1_found": p1_found, "p1_classes": p1_classes, "p2_found": p2_found, "p3_found": p3_found, "p3_forms": p3_forms, "p4_found": p4_found, "p5_found": p5_found, "p5_counts": p5_counts, "p6_found": p6_found, "p6_survivors": p6_survivors, "p7_ids": p7_ids, "p8_found": p8_found, "p9_found": p9_found, "p9_shares": p9_shares, "p9_routes": p9_routes}
