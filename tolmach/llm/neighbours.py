"""Most similar vectors for every vector, by shifted space-filling curves.

Vectors are normalised and rounded to 16-bit numbers; equal directions are
collapsed to the entry with the smallest id before anything is compared, so a
vector that a third of all rows share costs one row. Each remaining vector gets
its place on several Hilbert orders of random projections; rows are
range-partitioned by (curve, place), and each is compared with the next
``window`` rows of its curve by a bit sketch. Rows with many partners lie in a
dense group, of which windows show only a part; these are compared with all rows
that can be near them (see ``crowds``). The surviving pairs, each once, are
reranked by their exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .crowds import crowded_pairs
from .hilbert import Curves

PREPARED = "id long, digest binary, vec binary, keys array<long>, sketch array<long>"


def _prepare(width: int, curves: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        made = Curves(width, **curves)
        for batch in batches:
            column = batch.column(1)
            flat = column.flatten()
            x = np.asarray(flat.fill_null(np.nan) if flat.null_count else flat, dtype=np.float64).reshape(-1, width)
            top = np.max(np.abs(x), axis=1, initial=0.0)
            good = np.isfinite(x).all(axis=1) & (top > 0)
            if not good.any():
                continue
            ids = np.asarray(batch.column(0))[good]
            # scaled copies of a vector get the same 16-bit form
            q = np.rint(x[good] * (32767.0 / top[good])[:, None]).astype(np.int16)
            unit = q.astype(np.float32)
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            raw = [v.tobytes() for v in q]
            keys, sketch = made.keys(unit), made.sketch(unit)
            lists = [pa.ListArray.from_arrays(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32), a.ravel()) for a in (keys, sketch)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([blake2b(v, digest_size=16).digest() for v in raw], pa.binary()), pa.array(raw, pa.binary()), *lists],
                names=["id", "digest", "vec", "keys", "sketch"],
            )

    return run


def _windows(window: int, words: int, most: int):
    """Pairs of rows at most ``window`` apart on their curve whose sketches differ in at most ``most`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: tuple | None = None
        for batch in batches:
            curve, ids = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            bits = np.stack([np.asarray(batch.column(2 + i)).view(np.uint64) for i in range(words)], axis=1)
            old = 0
            if tail is not None:  # rows of the batch before belong to this window as well
                curve, ids, bits = np.concatenate([tail[0], curve]), np.concatenate([tail[1], ids]), np.concatenate([tail[2], bits])
                old = len(tail[0])
            left, right = [], []
            for step in range(1, min(window, len(ids) - 1) + 1):
                start = max(0, old - step)  # pairs within the old rows are done
                near = np.bitwise_count(bits[start + step :, 0] ^ bits[start:-step, 0]).astype(np.int16)
                for w in range(1, words):
                    near += np.bitwise_count(bits[start + step :, w] ^ bits[start:-step, w])
                at = np.flatnonzero((near <= most) & (curve[start + step :] == curve[start:-step])) + start
                left.append(ids[at])
                right.append(ids[at + step])
            tail = (curve[-window:], ids[-window:], bits[-window:])
            if left:
                a, b = np.concatenate(left), np.concatenate(right)
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def _cosines(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.stack([np.frombuffer(v, np.int16) for v in batch.column(i).to_pylist()]).astype(np.float64) for i in (2, 3))
            cos = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
            keep = pa.array(cos >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(cos[cos >= least])], names=["a", "b", "cos"])

    return run


def nearest(df: DataFrame, id_col: str = "id", vector_col: str = "embedding", width: int = 384, k: int = 5, least: float = 0.8,
            curves: int = 28, dims: int = 12, bits: int = 4, window: int = 32, words: int = 4, most_bits: int = 72, crowd: int = 128) -> DataFrame:
    """For each vector up to ``k`` others of the highest cosine of at least ``least``: (id, other, cos, place).

    Equal cosines go to the smaller id. Vectors that are null, all zero, of
    another length or hold a null, NaN or infinite number take no part. Rows that
    repeat an id with the same vector count once. Other columns are ignored; an
    empty table gives an empty result. Of the 64 * ``words`` sketch bits a pair
    at a cosine of 0.85 differs in 45 on average and in more than ``most_bits`` once in 100,000, at
    a cosine of 0.8 once in 730; all curves share the sketch, so such a pair is lost.
    Rows with more than ``crowd`` such partners get their neighbours by exact comparison.
    """
    plan = {"count": curves, "dims": dims, "bits": bits, "words": words}
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where(F.col("id").isNotNull() & (F.size("v") == width))
    prepared = materialise(rows.mapInArrow(_prepare(width, plan), PREPARED), "vectors")

    # the k+1 smallest ids of each group of equal vectors; the limit is applied before the shuffle as well
    once = prepared.select("id", "digest", "keys", "sketch")
    by_id = Window.partitionBy("digest").orderBy("id")
    ranked = once.withColumn("rank", F.dense_rank().over(by_id)).where(F.col("rank") <= k + 1)
    groups = ranked.groupBy("digest").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.min("id").alias("rep"))
    firsts = once.withColumn("n", F.row_number().over(by_id)).where(F.col("n") == 1)

    spread = firsts.select("id", F.posexplode("keys").alias("curve", "key"), *[F.col("sketch")[i].alias(f"s{i}") for i in range(words)])
    ordered = spread.repartitionByRange("curve", "key", "id").sortWithinPartitions("curve", "key", "id").select("curve", "id", *[f"s{i}" for i in range(words)])
    close = materialise(ordered.mapInArrow(_windows(window, words, most_bits), "a long, b long").distinct(), "close")

    partners = close.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    crowded = materialise(partners.where(F.col("n") > crowd).select("id"), "crowded")
    if not crowded.isEmpty():
        single = prepared.join(firsts.select("digest", "id"), ["digest", "id"], "left_semi").select("id", "vec").distinct()
        dense = materialise(single.join(crowded, "id", "left_semi"), "dense")
        flag = [crowded.select(F.col("id").alias(c), F.lit(True).alias(f"crowded_{c}")) for c in ("a", "b")]
        loose = close.join(flag[0], "a", "left").join(flag[1], "b", "left").where(F.col("crowded_a").isNull() | F.col("crowded_b").isNull()).select("a", "b")
        close = loose.union(crowded_pairs(dense, single, k, least)).distinct()

    vec = prepared.select("id", "vec")
    both = (
        close.join(vec.select(F.col("id").alias("a"), F.col("vec").alias("va")), "a")
        .join(vec.select(F.col("id").alias("b"), F.col("vec").alias("vb")), "b")
        .select("a", "b", "va", "vb")
    )
    scored = materialise(both.mapInArrow(_cosines(least), "a long, b long, cos double").distinct(), "scored")

    # neighbours of a representative: the k best groups, ties kept, then the k best of their entries
    directed = scored.select(F.col("a").alias("rep"), F.col("b").alias("to"), "cos").union(scored.select(F.col("b"), F.col("a"), F.col("cos")))
    best = directed.withColumn("r", F.rank().over(Window.partitionBy("rep").orderBy(F.desc("cos")))).where(F.col("r") <= k)
    others = best.join(groups.select(F.col("rep").alias("to"), "ids"), "to").select("rep", "cos", F.explode(F.slice("ids", 1, k)).alias("other"))
    others = others.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("cos"), "other"))).where(F.col("r") <= k)
    lists = others.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct((-F.col("cos")).alias("d"), F.col("other").alias("id")))).alias("far"))
    known = groups.join(lists, "rep", "left").where((F.size("ids") > 1) | F.col("far").isNotNull()).select("digest", "ids", "far")

    members = prepared.select("id", "digest").distinct().join(known, "digest")
    own = F.transform("ids", lambda x: F.struct(F.lit(-1.0).alias("d"), x.alias("id")))
    near = F.slice(F.filter(F.concat(own, F.coalesce("far", F.array().cast("array<struct<d:double,id:bigint>>"))), lambda x: x["id"] != F.col("id")), 1, k)
    return members.select("id", F.posexplode(near).alias("place", "n")).select("id", F.col("n.id").alias("other"), (-F.col("n.d")).alias("cos"), (F.col("place") + 1).alias("place"))


def similar_pairs(df: DataFrame, **options) -> DataFrame:
    """Each pair (id_a < id_b) of which at least one is among the other's nearest, once."""
    found = nearest(df, **options)
    return found.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
