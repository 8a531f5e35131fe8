"""Records that differ in dress only, by an external sort of canonical records.

A canonical record is a text's letters and digits without regard to case, or a
JSON object's fields, each so, in the order of their names. Canonical records are
range-partitioned by (table, digest, id), so only digests and ids are sampled to the
driver, and sorted by (table, digest, record, id) by Spark, which spills; equal
records are then neighbours and are found by comparing full keys. As the id is
part of the order, a record that a third of all rows share is spread over many
partitions; runs that cross a border are joined by one border row per partition.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

CANONICAL = "tbl int, id long, canon string"


def bare(text: str) -> str:
    """Letters and digits without regard to case."""
    return "".join(c for c in text.casefold() if c.isalnum()) if not text.isascii() else text.lower().translate(_ASCII)


_ASCII = {i: None for i in range(128) if not chr(i).isalnum()}


def _value(value: object) -> str:
    if isinstance(value, dict):
        return "{" + _fields(list(value.items())) + "}"
    if isinstance(value, list):
        return "[" + "\x1f".join(map(_value, value)) + "]"
    return "\x00" if value is None else bare(value if isinstance(value, str) else json.dumps(value))


def _fields(pairs: list[tuple[str, object]]) -> str:
    return "\x1e".join(sorted(f"{name.casefold()}\x1f{_value(value)}" for name, value in pairs))


class _Pairs(list):
    """The fields of an object as they stand, repeated names included."""


def canonical_json(payload: str | None) -> str | None:
    """The canonical record of a complete JSON object; None for anything else."""
    if not payload:
        return None
    try:
        made = json.loads(payload, object_pairs_hook=_Pairs)
        return _fields(_plain(made)) if isinstance(made, _Pairs) else None
    except (ValueError, RecursionError):
        return None


def _plain(pairs: _Pairs) -> list[tuple[str, object]]:
    return [(name, _inner(value)) for name, value in pairs]


def _inner(value: object) -> object:
    if isinstance(value, _Pairs):
        # a repeated name stays, under its own place
        seen: dict[str, object] = {}
        for name, v in _plain(value):
            while name in seen:
                name += "\x1d"
            seen[name] = v
        return seen
    return [_inner(v) for v in value] if isinstance(value, list) else value


def _texts(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            made = [bare(t) if t else "" for t in texts]
            # letters and digits are counted as they stand: folding may turn one into two
            keep = pa.array([len(c) >= least and (t.isascii() or sum(map(str.isalnum, t)) >= least) for t, c in zip(texts, made, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(made, pa.string()).filter(keep)], names=["tbl", "id", "canon"])

    return run


def canonical_texts(df: DataFrame, least: int = 40) -> DataFrame:
    """Rows (tbl int, id long, text) with at least ``least`` letters and digits as canonical records."""
    return df.select("tbl", "id", "text").where(F.length("text") > 0).mapInArrow(_texts(least), CANONICAL)


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = pa.array([canonical_json(p) for p in batch.column(2).to_pylist()], pa.string())
        keep = made.is_valid()
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), made.filter(keep)], names=["tbl", "id", "canon"])


def canonical_payloads(df: DataFrame) -> DataFrame:
    """Rows (tbl int, id long, text) of complete JSON objects as canonical records."""
    return df.select("tbl", "id", "text").mapInArrow(_payloads, CANONICAL)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted canonical records to (tbl, rep, id, part, kind, digest).

    Kind 0: a superfluous row of a settled run; 1: a row of the partition's first
    run, which may belong to the run before; 2 and 3: the border rows of the first
    and the last run, with a digest of their keys.
    """
    from hashlib import blake2b

    part = TaskContext.get().partitionId()
    key: tuple[int, str] | None = None
    first: tuple[int, str] | None = None
    first_rep = rep = last = 0

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        t, r, i, k, d = (pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True))
        return pa.RecordBatch.from_arrays([t, r, i, pa.array([part] * len(rows), pa.int32()), k, d], names=["tbl", "rep", "id", "part", "kind", "digest"])

    for batch in batches:
        out: list[tuple] = []
        for now in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True):
            at = now[2]
            if key is None or now[1] != key[1] or now[0] != key[0]:
                key = (now[0], now[1])
                rep = last = at
                if first is None:
                    first, first_rep = key, at
                    out.append((now[0], rep, at, 1, None))
                continue
            if at != last:  # the same row again is no copy
                out.append((now[0], rep, at, 1 if key is first else 0, None))
                last = at
        yield batch_of(out)
    if first is not None and key is not None:
        sign = [blake2b(k[1].encode("utf-8", "surrogatepass"), digest_size=16).digest() for k in (first, key)]
        yield batch_of([(first[0], first_rep, None, 2, sign[0]), (key[0], rep, None, 3, sign[1])])


def copies(canonical: DataFrame) -> DataFrame:
    """Superfluous rows of canonical records (tbl, id, canon): (tbl, rep, id), rep being the smallest id of the same record.

    Rows with a null id or record take no part; a row that occurs twice counts once.
    """
    rows = materialise(canonical.where(F.col("id").isNotNull() & F.col("canon").isNotNull()), "canonical")
    keyed = rows.withColumn("sign", F.unhex(F.md5("canon")))
    seen = materialise(keyed.repartitionByRange("tbl", "sign", "id").sortWithinPartitions("tbl", "sign", "canon", "id").select("tbl", "id", "canon").mapInArrow(_runs, "tbl int, rep long, id long, part int, kind int, digest binary"), "runs")
    borders: dict[int, dict[int, tuple]] = {}
    for row in seen.where("kind >= 2").collect():  # two rows for each partition
        borders.setdefault(row["part"], {})[row["kind"]] = ((row["tbl"], bytes(row["digest"])), row["rep"])
    carried: dict[int, int] = {}
    running: tuple | None = None
    for part in sorted(borders):
        (first, rep), (last, last_rep) = borders[part][2], borders[part][3]
        if running and running[0] == first:
            carried[part] = running[1]
            rep = running[1]
        running = (last, rep if last == first else last_rep)
    by_part = F.broadcast(canonical.sparkSession.createDataFrame(list(carried.items()), "part int, carried long"))  # a row per partition at most
    rep = F.when(F.col("kind") == 1, F.coalesce("carried", "rep")).otherwise(F.col("rep"))
    return seen.where("kind < 2").join(by_part, "part", "left").select("tbl", rep.alias("rep"), "id").where("rep <> id")


def copy_counts(found: DataFrame) -> DataFrame:
    """One row per record that has copies: (tbl, id, copies), copies counting all ids with this record."""
    return found.groupBy("tbl", F.col("rep").alias("id")).agg((F.count("*") + 1).alias("copies"))
