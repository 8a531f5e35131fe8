"""Near-duplicate texts by weighted minhash, bands and an exact check.

1. Rows with the same set of words are one record from here on.
2. Words are counted over all records; a word's weight falls with its share of
   all occurrences, so bands of unrelated records rarely meet.
3. Weighted signatures are cut into bands; records that share a band meet in a
   sort-merge join, which splits hot bands under adaptive execution. The join
   condition holds a bitmap bound that is never wrong: the bits in which two
   records' bitmaps differ are at most the words in which they differ.
4. Pairs that remain, each once, are checked on their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .bagminhash import band_keys, signatures
from .words import words


def _word_sets(least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        for batch in batches:
            tbl, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: tuple[list, ...] = ([], [], [], [])
            for t, i, text in zip(tbl, ids, batch.column(2).to_pylist(), strict=True):
                own = set(words(text))
                if len(own) >= least_words:
                    joined = " ".join(sorted(own))
                    for column, value in zip(out, (t, i, blake2b(joined.encode("utf-8", "surrogatepass"), digest_size=16).digest(), joined), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int32(), pa.int64(), pa.binary(), pa.string()), strict=True)], names=["tbl", "id", "sig", "words"])

    return run


def _bands(weight: dict[str, int], heaviest: int, bands: int, rows: int, chunk: int = 1000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for start in range(0, whole.num_rows, chunk):
                batch = whole.slice(start, chunk)
                sets = [w.split(" ") for w in batch.column(2).to_pylist()]
                known: dict[str, int] = {}
                index = np.array([known.setdefault(w, len(known)) for s in sets for w in s], np.int64)
                sizes = np.array([len(s) for s in sets], np.int64)
                row = np.repeat(np.arange(len(sets)), sizes)
                hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in known], np.uint64)
                heavy = np.array([weight.get(w, heaviest) for w in known], np.int64)
                made = signatures(row, hashes[index], heavy[index], len(sets), bands * rows)
                tbl = np.asarray(batch.column(0))
                keys = band_keys(made, bands, rows, tbl.astype(np.int64))
                bit = (hashes[index] >> np.uint64(7)) & np.uint64(127)
                halves = []
                for h in (0, 1):
                    mine = (bit >> np.uint64(6)) == h
                    half = np.zeros(len(sets), np.uint64)
                    np.bitwise_or.at(half, row[mine], np.uint64(1) << (bit[mine] & np.uint64(63)))
                    halves.append(pa.array(half.view(np.int64)))
                offsets = np.arange(0, keys.size + 1, bands, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes.astype(np.int32)), *halves, pa.ListArray.from_arrays(offsets, keys.ravel())], names=["tbl", "did", "n", "s0", "s1", "keys"])

    return run


def word_weights(sets: DataFrame, heaviest: int, common: float = 1 / 780, frequent: float = 1 / 7800) -> dict[str, int]:
    """Weights below ``heaviest``: 1 for words with a share of at least ``common`` of all occurrences, half of ``heaviest`` from ``frequent`` on.

    With a ``heaviest`` of 2, as used here, all words from ``frequent`` on weigh 1. By its
    definition this table has at most 1/frequent words, whatever the size of the corpus.
    """
    each = sets.select(F.explode(F.split("words", " ")).alias("w"))
    total = sets.agg(F.sum(F.size(F.split("words", " "))).alias("t")).first()["t"] or 0
    often = each.groupBy("w").count().where(F.col("count") >= total * frequent).collect()
    return {r["w"]: 1 if r["count"] >= total * common else max(1, heaviest // 2) for r in often}


def near_links(df: DataFrame, threshold: float = 0.7, least_words: int = 8, bands: int = 44, rows: int = 5, heaviest: int = 2) -> tuple[DataFrame, DataFrame]:
    """Near copies of rows (tbl int, id long, text string) without expanding groups: (links, members).

    ``members`` (tbl, rep, id): every row of at least ``least_words`` distinct words and the
    smallest id with the same set of words. ``links`` (tbl, rep_a, rep_b), rep_a < rep_b:
    the pairs of different sets whose shared words are at least ``threshold`` of the words in
    either. Null and empty texts have no words; a row that occurs twice counts once; very
    long texts are used whole. At 44 bands of 5 a pair is missed about once in 40,000 on
    average; of a pair at the threshold itself once in 100 if its differing words are
    all rare or all frequent, and up to once in 8 in the worst case, where all shared words are
    frequent and all differing ones rare.
    """
    rows_in = df.select(F.col("tbl").cast("int"), F.col("id").cast("long"), F.col("text").cast("string")).where(F.length("text") >= 2 * least_words - 1)
    read = materialise(rows_in.mapInArrow(_word_sets(least_words), "tbl int, id long, sig binary, words string"), "wordsets")
    sets = materialise(read.groupBy("tbl", "sig").agg(F.min("id").alias("did"), F.first("words").alias("words")), "sets")

    weight = word_weights(sets, heaviest)
    signed = sets.select("tbl", "did", "words").mapInArrow(_bands(weight, heaviest, bands, rows), "tbl int, did long, n int, s0 long, s1 long, keys array<long>")
    spread = signed.select(F.explode("keys").alias("key"), "tbl", "did", "n", "s0", "s1")
    a, b = spread.alias("a"), spread.alias("b")
    apart = F.bit_count(F.col("a.s0").bitwiseXOR(F.col("b.s0"))) + F.bit_count(F.col("a.s1").bitwiseXOR(F.col("b.s1")))
    may_differ = (F.col("a.n") + F.col("b.n")) * F.lit((1 - threshold) / (1 + threshold)) + F.lit(1e-6)
    met = (
        a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.did") < F.col("b.did")) & (F.col("a.tbl") == F.col("b.tbl")) & (apart <= may_differ))
        .select(F.col("a.tbl").alias("tbl"), F.col("a.did").alias("da"), F.col("b.did").alias("db"))
        .distinct()
    )
    text = sets.select("tbl", "did", "words")
    both = met.join(text.select("tbl", F.col("did").alias("da"), F.col("words").alias("wa")), ["tbl", "da"]).join(text.select("tbl", F.col("did").alias("db"), F.col("words").alias("wb")), ["tbl", "db"])
    wa, wb = F.split("wa", " "), F.split("wb", " ")
    shared = F.size(F.array_intersect(wa, wb))
    alike = both.select("tbl", "da", "db", shared.alias("s"), (F.size(wa) + F.size(wb)).alias("t")).where(F.col("s") >= (F.col("t") - F.col("s")) * F.lit(threshold) - F.lit(1e-9))

    links = alike.select("tbl", F.col("da").alias("rep_a"), F.col("db").alias("rep_b"))
    members = read.select("tbl", "sig", "id").join(sets.select("tbl", "sig", F.col("did").alias("rep")), ["tbl", "sig"]).select("tbl", "rep", "id").distinct()
    return links, members


def near_pairs(df: DataFrame, **options) -> DataFrame:
    """All pairs of the rows that ``near_links`` finds alike, equal word sets included: (tbl, id_a, id_b), id_a < id_b."""
    links, members = near_links(df, **options)
    own = members.groupBy("tbl", "rep").agg(F.max("id").alias("most")).where("most > rep").select("tbl", "rep", "rep")
    return (
        links.union(own)
        .join(members.select("tbl", F.col("rep").alias("rep_a"), F.col("id").alias("x")), ["tbl", "rep_a"])
        .join(members.select("tbl", F.col("rep").alias("rep_b"), F.col("id").alias("y")), ["tbl", "rep_b"])
        .where((F.col("rep_a") != F.col("rep_b")) | (F.col("x") < F.col("y")))
        .select("tbl", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    )


def near_classes(df: DataFrame, **options) -> DataFrame:
    """One row for each row that has near copies: (tbl, id, rep, copies, links), ``copies`` the rows of its word set, ``links`` the other sets it is alike to."""
    links, members = near_links(df, **options)
    ends = links.select("tbl", F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("tbl", "rep").agg(F.count("*").alias("links"))
    sizes = members.groupBy("tbl", "rep").agg(F.count("*").alias("copies"))
    groups = sizes.join(ends, ["tbl", "rep"], "left").withColumn("links", F.coalesce("links", F.lit(0).cast("long"))).where("copies > 1 OR links > 0")
    return members.join(groups, ["tbl", "rep"]).select("tbl", "id", "rep", "copies", "links")
