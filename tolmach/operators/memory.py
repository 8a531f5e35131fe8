"""Translation memory: exact and vector search, merged suggestions, indexing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markup, text, vectors


class Embedder(Protocol):
    """Turns texts into vectors of ``dims`` numbers, in their order."""

    dims: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """A deterministic stand-in for a model: hashed character trigrams, of unit length."""

    def __init__(self, dims: int = 384):
        self.dims = dims

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dims), np.float32)
        for row, value in zip(out, texts, strict=True):
            padded = f"  {value.lower()} "
            for i in range(len(padded) - 2):
                code = int.from_bytes(hashlib.blake2b(padded[i : i + 3].encode(), digest_size=8).digest(), "little")
                row[code % self.dims] += 1.0 if code >> 63 else -1.0
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(length > 0, length, 1)).tolist()


def embed(df: DataFrame, column: str, embedder: Embedder, into: str = "embedding", batch: int = 64) -> DataFrame:
    """Adds a vector per text; each worker sends ``batch`` texts at a time and checks count and width."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            made: list[list[float]] = []
            for start in range(0, len(part), batch):
                texts = part.iloc[start : start + batch].fillna("").tolist()
                got = embedder.embed(texts)
                if len(got) != len(texts) or any(len(v) != embedder.dims for v in got):
                    raise ValueError("the embedder returned another number of vectors or of dimensions")
                made += got
            yield pd.Series(made, index=part.index, dtype=object)

    return df.withColumn(into, run(F.col(column)))


def exact_matches(queries: DataFrame, memory: DataFrame, limit: int = 5) -> DataFrame:
    """Entries of the query's project and locale with its hash: adds query_id to the entry, latest first, ties to the larger id.

    ``queries``: (query_id, project_id, target_locale, source_hash).
    """
    found = queries.select("query_id", "project_id", "target_locale", "source_hash").join(memory, ["project_id", "target_locale", "source_hash"])
    order = Window.partitionBy("query_id").orderBy(F.desc("created_at"), F.desc("id"))
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).withColumns({"kind": F.lit("exact"), "score": F.lit(1.0)})


def _block_top(limit: int):
    """The best entries of one block for each of its queries, by one matrix product."""

    def run(entries: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(entries) or not len(asked):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        entries = entries.sort_values("id", kind="stable")
        x, q = (np.stack(d["embedding"].to_numpy()).astype(np.float64) for d in (entries, asked))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        q /= np.linalg.norm(q, axis=1, keepdims=True)
        score = np.round(q @ x.T, 9)
        codes = pd.factorize(np.concatenate([asked["own_hash"].to_numpy(), entries["source_hash"].to_numpy()]))[0]
        score[codes[: len(asked), None] == codes[None, len(asked) :]] = -np.inf  # nulls count as equal
        keep = min(limit, score.shape[1])
        least = -np.partition(-score, keep - 1, axis=1)[:, keep - 1 : keep]
        row, col = np.nonzero((score >= least) & np.isfinite(score))  # ties of the last place stay
        return pd.DataFrame({"query_id": asked["query_id"].to_numpy()[row], "id": entries["id"].to_numpy()[col], "score": score[row, col]})

    return run


def semantic_matches(queries: DataFrame, memory: DataFrame, limit: int = 5, least: float = 0.6, width: int = 384, entries_at_once: int = 20_000, queries_at_once: int = 2_000) -> DataFrame:
    """Entries of the query's project and locale by cosine similarity, best first, ties to the smaller id.

    ``queries``: (query_id, project_id, target_locale, source_hash, embedding). Entries
    with the query's own hash are left out: they are exact matches. Scores are rounded
    to 9 places, so ties are ties. Each project and locale is a grid of blocks of about
    ``entries_at_once`` by ``queries_at_once``, so no task holds a whole project; every
    block gives its best, of which the best per query remain.
    """
    keys = ["project_id", "target_locale"]
    m = memory.where(vectors.usable(F.col("embedding"), width)).select("id", *keys, "source_hash", "embedding")
    q = queries.where(vectors.usable(F.col("embedding"), width)).select("query_id", *keys, F.col("source_hash").alias("own_hash"), "embedding")
    rows = lambda df, most, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    grid = rows(memory, entries_at_once, "across").join(rows(queries, queries_at_once, "down"), keys)
    left = m.join(grid, keys).select("id", "source_hash", "embedding", *keys, F.pmod(F.xxhash64("id"), "across").cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("y"))
    right = q.join(grid, keys).select("query_id", "own_hash", "embedding", *keys, F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("x"), F.pmod(F.xxhash64("query_id"), "down").cast("int").alias("y"))
    best = left.groupBy(*keys, "x", "y").cogroup(right.groupBy(*keys, "x", "y")).applyInPandas(_block_top(limit), "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    top = best.withColumn("place", F.row_number().over(order)).where((F.col("place") <= limit) & (F.col("score") >= least))
    return memory.drop("embedding").join(top, "id").withColumn("kind", F.lit("semantic"))


def merge_matches(exact: DataFrame, semantic: DataFrame, limit: int = 5) -> DataFrame:
    """Suggestions per query: exact before semantic, by score, one per target text, at most ``limit``.

    Both sides: (query_id, id, target_text, kind, score, place).
    """
    columns = ["query_id", "id", "target_text", "kind", "score", "place"]
    both = exact.select(*columns).withColumn("grp", F.lit(0)).unionByName(semantic.select(*columns).withColumn("grp", F.lit(1)))
    order = [F.col("grp"), F.desc("score"), F.col("place"), F.col("id")]
    first = both.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "target_text").orderBy(*order))).where("n = 1")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= limit).select("query_id", "rank", "id", "target_text", "kind", "score")


def suggest(queries: DataFrame, memory: DataFrame, limit: int = 5, least: float = 0.0) -> DataFrame:
    """Merged suggestions for a batch of queries; a ``least`` of 0 means the usual 0.6."""
    return merge_matches(exact_matches(queries, memory, limit), semantic_matches(queries, memory, limit, least or 0.6), limit)


def index_rows(segments: DataFrame, embedder: Embedder) -> DataFrame:
    """What a memory keeps of segments with project, locales and reviewer: form 0 only, one per (project, locale, hash, target), the first by unit.

    Adds source_hash and embedding; sources that are blank without markup are left out.
    Vectors are made after repeated pairs are gone.
    """
    plain = segments.where(F.col("form_index") == 0).withColumn("source_plain", text.normalize(markup.plain_text(F.col("source_text")))).where(F.col("source_plain") != "")
    hashed = plain.withColumn("source_hash", F.sha2("source_plain", 256))
    first = first_per_pair(hashed, ["project_id", "target_locale", "source_hash", "target_text"], ["unit_key", "form_index", "id"])
    return embed(first, "source_plain", embedder)


def first_per_pair(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def entry_counts(projects: DataFrame, memory: DataFrame) -> DataFrame:
    """Memory size of every project, 0 included: (id, name, entries)."""
    sizes = memory.groupBy(F.col("project_id").alias("id")).agg(F.count("*").alias("entries"))
    return projects.select("id", "name").join(sizes, "id", "left").withColumn("entries", F.coalesce("entries", F.lit(0).cast("long")))


class DraftProvider(Protocol):
    """Drafts translations, one per text, in their order."""

    def translate(self, texts: list[str], source: str, target: str) -> list[str]: ...


def draft(df: DataFrame, provider: DraftProvider, source: str, target: str, batch: int = 20) -> DataFrame:
    """Adds ``draft`` to rows (id, source_text): answers in calls of at most ``batch`` texts, normalized; null where malformed."""
    from ..kernels.markup import fragment_error

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            made: list[str | None] = []
            for start in range(0, len(part), batch):
                texts = part["source_text"].iloc[start : start + batch].tolist()
                got = provider.translate(texts, source, target)
                if len(got) != len(texts):
                    raise ValueError(f"{len(got)} drafts for {len(texts)} texts")
                made += [t if fragment_error(t) is None else None for t in got]
            yield part.assign(draft=made)

    return df.select("id", "source_text").mapInPandas(run, "id long, source_text string, draft string").withColumn("draft", text.normalize_fragment(F.col("draft")))
