"""Exact neighbours of rows in dense groups, where windows of a curve are too small.

Crowded rows are gathered around pivots. A row within an angle t of a crowded row is
within r + t of its pivot, r being the largest angle of the pivot's crowded rows; so
only such rows are compared, and none that counts is left out. The products are cut
into blocks, so no task holds a whole group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: More than rounding can move a cosine or an angle.
SLACK = 1e-6


def _units(raw) -> np.ndarray:
    x = np.stack([np.frombuffer(v, np.int16) for v in raw]).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _uncovered(pivots: np.ndarray, cover: float):
    """Rows (id, vec) with no pivot at a cosine of ``cover``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array((_units(batch.column(1).to_pylist()) @ pivots.T).max(axis=1) < cover))

    return run


def _assigned(pivots: np.ndarray):
    """Rows (id, vec) with their nearest pivot and the angle to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cos = _units(batch.column(1).to_pylist()) @ pivots.T
                angle = np.arccos(np.clip(cos.max(axis=1), -1.0, 1.0))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cos.argmax(axis=1).astype(np.int32)), pa.array(angle)], names=["id", "vec", "pivot", "angle"])

    return run


def _reached(pivots: np.ndarray, reach: np.ndarray):
    """Rows (id, vec), once for each pivot they are near enough to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, pivot = np.nonzero(np.arccos(np.clip(_units(batch.column(1).to_pylist()) @ pivots.T, -1.0, 1.0)) <= reach)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(pivot.astype(np.int32))], names=["id", "vec", "pivot"])

    return run


def _pivots(dense: DataFrame, cover: float, at_once: int, most: int, rounds: int = 4) -> np.ndarray:
    """At most ``most`` of the rows, chosen so that nearly every row is near one; a far one only makes a reach larger."""
    chosen: list[np.ndarray] = []
    for _ in range(rounds):
        rest = dense.mapInArrow(_uncovered(np.stack(chosen), cover), "id long, vec binary") if chosen else dense
        sample = rest.select("vec").limit(at_once).collect()
        if not sample:
            break
        left = _units([r["vec"] for r in sample])
        while len(left) and len(chosen) < most:
            chosen.append(left[0])
            left = left[left @ left[0] < cover]
        if len(chosen) >= most:
            break
    return np.stack(chosen)


def _block_pairs(k: int, least: float, rows: int = 256):
    """The best ``k`` of one block for each of its crowded rows, ties kept, as pairs."""

    def run(entries: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if len(entries) and len(asked):
            x, q = _units(entries["vec"]), _units(asked["vec"])
            ids, own = entries["id"].to_numpy(), asked["id"].to_numpy()
            for at in range(0, len(q), rows):
                cos = q[at : at + rows] @ x.T
                cos[own[at : at + rows, None] == ids[None, :]] = -2.0
                keep = min(k, cos.shape[1])
                last = np.partition(cos, -keep, axis=1)[:, -keep][:, None]
                # equal cosines differ by rounding only
                row, col = np.nonzero((cos >= last - 1e-12) & (cos >= least - SLACK))
                a.append(own[at + row])
                b.append(ids[col])
        one, two = np.concatenate(a), np.concatenate(b)
        return pd.DataFrame({"a": np.minimum(one, two), "b": np.maximum(one, two)})

    return run


def crowded_pairs(dense: DataFrame, rows: DataFrame, k: int, least: float, cover: float = 0.7, most_pivots: int = 256, rows_at_once: int = 20_000, asked_at_once: int = 2_000) -> DataFrame:
    """Pairs (a < b) that hold the ``k`` nearest of each row of ``dense`` (id, vec) among ``rows`` (id, vec), from ``least`` on.

    ``dense`` holds at least one row; no row stands twice in either table. Vectors
    are 16-bit numbers as bytes.
    """
    pivots = _pivots(dense, cover, 2_000, most_pivots)
    members = materialise(dense.mapInArrow(_assigned(pivots), "id long, vec binary, pivot int, angle double"), "members")
    reach = np.full(len(pivots), -1.0)
    down = dict.fromkeys(range(len(pivots)), 0)
    for r in members.groupBy("pivot").agg(F.max("angle").alias("far"), F.count("*").alias("n")).collect():  # a row for each pivot
        reach[r["pivot"]] = r["far"] + np.arccos(least) + SLACK
        down[r["pivot"]] = -(-r["n"] // asked_at_once)
    near = materialise(rows.mapInArrow(_reached(pivots, reach), "id long, vec binary, pivot int"), "near")
    counts = near.groupBy("pivot").agg(F.count("*").alias("n")).collect()
    grid = F.broadcast(dense.sparkSession.createDataFrame([(r["pivot"], -(-r["n"] // rows_at_once), down[r["pivot"]]) for r in counts], "pivot int, across int, down int"))
    keys = ["pivot", "x", "y"]
    left = near.join(grid, "pivot").select("id", "vec", "pivot", F.pmod(F.xxhash64("id"), "across").cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("y"))
    right = members.join(grid, "pivot").select("id", "vec", "pivot", F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("x"), F.pmod(F.xxhash64("id"), "down").cast("int").alias("y"))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_block_pairs(k, least), "a long, b long")
