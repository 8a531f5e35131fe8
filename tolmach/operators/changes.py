"""Append-only change logs, latest-wins tables and re-imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, keys: list[str], order: list[str | Column], deleted: str | None = None) -> DataFrame:
    """The last row of each key; keys whose last row is marked ``deleted`` are gone.

    One aggregation with a partial step before the shuffle: a key with very many
    changes costs one row per task, where a window would sort them all in one.
    """
    rest = [c for c in log.columns if c not in keys]
    rank = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"o{i}") for i, c in enumerate(order)])
    best = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_last"))
    rows = best.select(*keys, "_last.*").select(*log.columns)
    return rows if deleted is None else rows.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted)


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A table after changes of the same columns; at equal order the change wins."""
    both = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return latest(both, keys, [*order, "_new"]).drop("_new")


def carry_over(new: DataFrame, prior: DataFrame, kept: list[str]) -> DataFrame:
    """A re-imported file's rows with the state of the rows before, where key, source and target are the same.

    ``kept`` are the columns taken from before; ``was_kept`` tells where they were.
    """
    keys = ["file_id", "unit_key", "form_index"]
    old = prior.select(*keys, F.col("source_text").alias("_s"), F.col("target_text").alias("_t"), *[F.col(c).alias(f"_{c}") for c in kept])
    same = F.coalesce((F.col("_s") == F.col("source_text")) & (F.col("_t") == F.col("target_text")), F.lit(False))
    joined = new.join(old, keys, "left").withColumn("was_kept", same)
    taken = {c: F.when(F.col("was_kept"), F.col(f"_{c}")).otherwise(F.col(c) if c in new.columns else F.lit(None)) for c in kept}
    return joined.withColumns(taken).drop("_s", "_t", *[f"_{c}" for c in kept])


def replace_rows(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the keys in ``new`` replaced by its rows."""
    return table.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def cascade(child: DataFrame, column: str, parents: DataFrame, parent_id: str = "id", null_out: bool = False) -> DataFrame:
    """Child rows after parents went: gone as well, or with ``null_out`` kept without the reference."""
    known = parents.select(F.col(parent_id).alias(column)).distinct()
    if not null_out:
        return child.join(known, column, "left_semi").select(*child.columns)
    marked = child.join(known.withColumn("_known", F.lit(True)), column, "left")
    return marked.withColumn(column, F.when(F.col("_known"), F.col(column))).select(*child.columns)


def import_counts(units: DataFrame) -> DataFrame:
    """Per file: segments, translated, untranslated and skipped units of (file_id, skipped, blank, forms)."""
    return units.groupBy("file_id").agg(
        F.sum(F.when(~F.col("skipped"), F.col("forms")).otherwise(0)).alias("segments"),
        F.sum(F.when(~F.col("skipped"), F.col("forms") - F.col("blank")).otherwise(0)).alias("translated"),
        F.sum(F.when(~F.col("skipped"), F.col("blank")).otherwise(0)).alias("untranslated"),
        F.count_if(F.col("skipped")).alias("skipped"),
    )


def numbered(rows: DataFrame, groups: list[str], key: str, order: str) -> DataFrame:
    """Rows whose repeated keys within their group get -1, -2 ... in the given order."""
    nth = F.row_number().over(Window.partitionBy(*groups, key).orderBy(order)) - 1
    return rows.withColumn("_n", nth).withColumn(key, F.when(F.col("_n") > 0, F.concat(key, F.lit("-"), F.col("_n").cast("string"))).otherwise(F.col(key))).drop("_n")
