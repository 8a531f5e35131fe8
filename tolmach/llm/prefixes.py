"""Texts that another text continues, and lengths at which texts are cut.

Texts are range-partitioned and sorted; in sorted order a text that is a strict
prefix of any other is a prefix of the next different one, so each run of equal
texts looks one step ahead. What lies at the borders of partitions (at most three
texts each) is settled on the driver and sent back as a list of partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def _join(stem: str, longer: str | None) -> int:
    """0: not continued; 1: within a word; 2: elsewhere."""
    if longer is None or len(longer) <= len(stem) or not longer.startswith(stem):
        return 0
    return 1 if stem and stem[-1].isalnum() and longer[len(stem)].isalnum() else 2


SEEN = "key long, how int, after long, part int, kind int, text string"


def _look_ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, stem) in order to ``SEEN``: kind 0 a settled row, 1 a row of the last run, 2 to 4 a border text and the first key of its run."""
    part = TaskContext.get().partitionId()
    first: list[tuple[int, str]] = []
    run: list[int] = []
    current: str | None = None

    def batch_of(keys: list, how: list, after: list, kinds: list, texts: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(how, pa.int32()), pa.array(after, pa.int64()), pa.array([part] * len(kinds), pa.int32()), pa.array(kinds, pa.int32()), pa.array(texts, pa.string())], names=["key", "how", "after", "part", "kind", "text"]
        )

    for batch in batches:
        keys, how, after = [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text != current:
                if current is not None and (joint := _join(current, text)):
                    keys += run
                    how += [joint] * len(run)
                    after += [key] * len(run)
                current, run = text, []
                if len(first) < 2:
                    first.append((key, text))
            run.append(key)
        yield batch_of(keys, how, after, [0] * len(keys), [None] * len(keys))
    if current is not None:
        yield batch_of(run, [0] * len(run), [None] * len(run), [1] * len(run), [None] * len(run))
        border = [*zip((2, 3), first, strict=False), (4, (run[0] if run else None, current))]
        yield batch_of([k for _, (k, _) in border], [0] * len(border), [None] * len(border), [k for k, _ in border], [t for _, (_, t) in border])


def continued(df: DataFrame) -> DataFrame:
    """Rows (key long, stem string) that another stem continues: (key, how, after), how 1 within a word and 2 elsewhere, ``after`` a key of the longer one.

    Null stems have no result. Equal stems do not continue each other.
    """
    rows = df.select("key", "stem").where(F.col("stem").isNotNull())
    seen = materialise(rows.repartitionByRange("stem", "key").sortWithinPartitions("stem").mapInArrow(_look_ahead, SEEN), "prefixes")
    borders: dict[int, dict[int, tuple[int, str]]] = {}
    for row in seen.where("kind BETWEEN 2 AND 4").select("part", "kind", "key", "text").collect():  # three rows for each partition
        borders.setdefault(row["part"], {})[row["kind"]] = row["key"], row["text"]
    order = sorted(borders)
    late = []
    for i, part in enumerate(order):
        last = borders[part][4][1]
        after = next(((k, t) for p in order[i + 1 :] for k, t in (borders[p].get(2, (None, None)), borders[p].get(3, (None, None))) if t is not None and t != last), None)
        if after and (how := _join(last, after[1])):
            late.append((part, how, after[0]))
    by_part = F.broadcast(df.sparkSession.createDataFrame(late, "part int, late int, late_after long"))  # a row per partition at most
    last = F.col("kind") == 1
    settled = seen.where("kind < 2").join(by_part, "part", "left")
    return settled.select("key", F.when(last, F.coalesce("late", F.lit(0))).otherwise(F.col("how")).alias("how"), F.when(last, F.col("late_after")).otherwise(F.col("after")).alias("after")).where("how > 0")


def length_limits(df: DataFrame, least: int = 5, times: float = 6.0, around: int = 20) -> DataFrame:
    """Lengths of rows (grp, length) at which ``times`` as many end as at a usual neighbour: (grp, length, n).

    A length counts from ``least`` rows on; its neighbours are the ``around`` lengths
    to either side.
    """
    counts = df.where(F.col("length").isNotNull()).groupBy("grp", "length").agg(F.count("*").alias("n"))
    near = Window.partitionBy("grp").orderBy("length").rangeBetween(-around, around)
    usual = (F.sum("n").over(near) - F.col("n")) / F.lit(2.0 * around)
    return counts.withColumn("usual", usual).where((F.col("n") >= least) & (F.col("n") >= F.col("usual") * times)).select("grp", "length", "n")
