"""Encoding of texts with a public byte-level BPE vocabulary, by recursive queries of DuckDB.

Each partition starts one in-memory DuckDB with the merge table. A batch of texts is
cut into words by the vocabulary's pattern; the bytes of each different word are
rows (word, position, token). The recursive query joins neighbouring tokens with
the merge table, takes each word's pair of the smallest rank and contracts it from
the left, until no pair is left. Words and their ids stay in the database, and the ids
of texts leave it as Arrow. As no merge can use a token before the merge that
makes it, all places of that pair are contracted in one turn, in a run of overlapping
places every second one. Ordered aggregation then gives each text its list of ids.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern by which this vocabulary's texts are cut into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

CONTRACT = """
WITH RECURSIVE state AS (
    SELECT w, p, t, false AS done, 0 AS n FROM start
    UNION ALL
    SELECT * FROM (
        WITH pairs AS (
            SELECT w, p, t, n, lead(t) OVER (PARTITION BY w ORDER BY p) AS next FROM state WHERE NOT done AND n < {rounds}
        ), ranked AS (
            SELECT pairs.*, merges.made, merges.rank AS r, min(merges.rank) OVER (PARTITION BY w) AS best
            FROM pairs LEFT JOIN merges ON merges.a = pairs.t AND merges.b = pairs.next
        ), marked AS (
            SELECT *, coalesce(r = best, false) AS hit,
                   row_number() OVER (PARTITION BY w ORDER BY p) - row_number() OVER (PARTITION BY w, coalesce(r = best, false) ORDER BY p) AS run
            FROM ranked
        ), taken AS (
            SELECT *, hit AND row_number() OVER (PARTITION BY w, hit, run ORDER BY p) % 2 = 1 AS take FROM marked
        ), dropped AS (
            SELECT *, coalesce(lag(take) OVER (PARTITION BY w ORDER BY p), false) AS gone FROM taken
        )
        SELECT w, p, CASE WHEN take THEN made ELSE t END AS t, best IS NULL AS done, n + 1 AS n FROM dropped WHERE NOT gone
    )
)
SELECT w, list(t ORDER BY p) AS ids, bool_and(done) AS done FROM state WHERE done OR n = {rounds} GROUP BY w
"""


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> tuple[list[int], list[tuple[int, int, int, int]]]:
    """The token of each byte, and the merges (a, b, rank, made), of a tokenizer file."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    ids = model["vocab"]
    merges = []
    for rank, pair in enumerate(model["merges"]):
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        merges.append((ids[a], ids[b], rank, ids[a + b]))
    letters = byte_letters()
    return [ids[letters[b]] for b in range(256)], merges


ASSEMBLE = """
SELECT each.d, coalesce(flatten(list(known.ids ORDER BY cut.k) FILTER (known.ids IS NOT NULL)), []::INT[]) AS ids
FROM (SELECT unnest(range({texts})) AS d) AS each LEFT JOIN cut ON cut.d = each.d LEFT JOIN known ON known.w = cut.w
GROUP BY each.d ORDER BY each.d
"""


class Encoder:
    """Encodes batches of texts; keeps the ids of words it has seen, up to ``remember``, as a table of its database."""

    def __init__(self, path: str, remember: int = 300_000):
        import duckdb
        import regex

        self.words = regex.compile(PATTERN)
        of_byte, merges = read_vocabulary(path)
        self.bytes = np.array(of_byte, np.int32)
        # no spilling: an executor has no folder of its own to write to
        self.db = duckdb.connect(config={"threads": 1, "temp_directory": "", "memory_limit": "900MB"})
        a, b, rank, made = (list(c) for c in zip(*merges, strict=True))
        given = pa.table({"a": a, "b": b, "rank": rank, "made": made})
        self.db.register("given", given)
        self.db.execute("CREATE TABLE merges AS SELECT a::INT AS a, b::INT AS b, rank::INT AS rank, made::INT AS made FROM given")
        self.remember = remember
        self.forget()

    def forget(self) -> None:
        """Start without known words."""
        self.number: dict[str, int] = {}
        self.db.execute("CREATE OR REPLACE TABLE known (w INT, ids INT[])")

    def learn(self, first: int, new: list[str], at_once: int = 400_000) -> None:
        """Ids of new words, numbered from ``first`` on, in queries of about ``at_once`` bytes."""
        raw = [word.encode("utf-8", "surrogatepass") for word in new]
        start, size = 0, 0
        for end, word in enumerate(raw, 1):
            size += len(word)
            if size >= at_once or end == len(raw):
                self._contract(first + start, raw[start:end])
                start, size = end, 0

    def _contract(self, first: int, words: list[bytes]) -> None:
        sizes = np.array([len(w) for w in words], np.int64)
        left = int(sizes.sum())
        starts = np.cumsum(sizes) - sizes
        table = pa.table({
            "w": pa.array(np.repeat(np.arange(first, first + len(words)), sizes).astype(np.int32)),
            "p": pa.array((np.arange(left) - np.repeat(starts, sizes)).astype(np.int32)),
            "t": pa.array(self.bytes[np.frombuffer(b"".join(words), np.uint8)]),
        })
        self.db.register("given_words", table)
        self.db.execute("CREATE OR REPLACE TEMP TABLE start AS SELECT * FROM given_words")
        self.db.unregister("given_words")
        while left:
            # the query keeps the rows of all its rounds, so a very long word is contracted in several queries
            rounds = max(1, min(64, 8_000_000 // left))
            self.db.execute("CREATE OR REPLACE TEMP TABLE found AS " + CONTRACT.format(rounds=rounds))
            self.db.execute("INSERT INTO known SELECT w, ids FROM found WHERE done")
            self.db.execute("CREATE OR REPLACE TEMP TABLE start AS SELECT w, (generate_subscripts(ids, 1) - 1)::INT AS p, unnest(ids) AS t FROM found WHERE NOT done")
            left = self.db.execute("SELECT count(*) FROM start").fetchall()[0][0]

    def encode(self, texts: list[str | None]) -> pa.Array:
        """The ids of each text; an empty list for an empty or null one."""
        if len(self.number) > self.remember:
            self.forget()
        number = self.number
        old = len(number)
        cut = [[number.setdefault(w, len(number)) for w in self.words.findall(t)] if t else [] for t in texts]
        if len(number) > old:
            self.learn(old, list(itertools.islice(number, old, None)))
        sizes = np.array([len(c) for c in cut], np.int64)
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        flat = np.fromiter(itertools.chain.from_iterable(cut), np.int32, int(sizes.sum()))
        self.db.register("cut", pa.table({"d": pa.array(np.repeat(np.arange(len(texts)), sizes)), "k": pa.array(place), "w": pa.array(flat)}))
        found = self.db.sql(ASSEMBLE.format(texts=len(texts))).to_arrow_table()
        self.db.unregister("cut")
        return found.column("ids").combine_chunks().cast(pa.list_(pa.int32()))


def _encoded(path: str, at_once: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            start = 0
            sizes = [len(t or "") for t in batch.column(1).to_pylist()]
            while start < batch.num_rows:
                end, size = start, 0
                while end < batch.num_rows and (end == start or size + sizes[end] <= at_once):
                    size += sizes[end]
                    end += 1
                part = batch.slice(start, end - start)
                encoder = encoder or Encoder(path)
                yield pa.RecordBatch.from_arrays([part.column(0), encoder.encode(part.column(1).to_pylist())], names=["doc_id", "ids"])
                start = end

    return run


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", at_once: int = 4_000_000) -> DataFrame:
    """Each row's text as token ids: (doc_id, ids array<int>), without special tokens.

    Null and empty texts give an empty list; a text that looks like a special token
    is ordinary text; a row that occurs twice comes out twice; texts are encoded
    whole, in blocks of about ``at_once`` characters. ``path`` names the vocabulary file
    on every executor.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_encoded(path, at_once), "doc_id long, ids array<int>")
