"""Documents that hold passages of test items, by a Wu-Manber search over words.

The patterns are all windows of ``length`` consecutive words of the items. A window
slides over a document's words; the block of its last ``block`` words gives how far it
may jump without missing a pattern; at a jump of zero the patterns that end in this
block are compared word by word. Items are taken in groups of at most ``most_words``
words, whatever their number, so what every task holds is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import words


class Patterns:
    """Shift and bucket tables of the items' windows."""

    def __init__(self, items: list[tuple[int, list[str]]], length: int = 12, block: int = 3):
        self.length, self.block = length, block
        self.number: dict[str, int] = {}
        self.items = [(i, [self.number.setdefault(w, len(self.number)) for w in own]) for i, own in items if len(own) >= length]
        self.default = length - block + 1
        self.shift: dict[tuple[int, ...], int] = {}
        self.ends: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for n, (_, own) in enumerate(self.items):
            for end in range(block, len(own) + 1):
                key = tuple(own[end - block : end])
                if end >= length:  # the last block of a pattern
                    self.shift[key] = 0
                    self.ends.setdefault(key, []).append((n, end))
                else:  # its distance from the end of the first pattern
                    self.shift[key] = min(self.shift.get(key, self.default), length - end)

    def search(self, text: str | None) -> set[int]:
        """Ids of the items of which a pattern occurs."""
        own = [self.number.get(w, -1) for w in words(text)]
        found: set[int] = set()
        end, size, length, block = self.length, len(own), self.length, self.block
        while end <= size:
            key = tuple(own[end - block : end])
            jump = self.shift.get(key, self.default)
            if not jump:
                window = own[end - length : end]
                for n, at in self.ends[key]:
                    item, wanted = self.items[n]
                    if item not in found and wanted[at - length] == window[0] and wanted[at - length : at] == window:
                        found.add(item)
                jump = 1
            end += jump
        return found


def _searched(items: list[tuple[int, list[str]]], length: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = Patterns(items, length, block)
        for batch in batches:
            rows = [(d, i) for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i in sorted(patterns.search(text))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["doc_id", "item_id"])

    return run


def leaks(documents: DataFrame, items: DataFrame, length: int = 12, block: int = 3, most_words: int = 500_000) -> DataFrame:
    """Documents (doc_id, text) and the items (item_id, text) of which they hold ``length`` consecutive words: (doc_id, item_id), each once.

    Null and empty texts, and items with fewer words, have no match; texts are searched
    whole. Two ids of one item text both come out.
    """
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & (F.length("text") >= 2 * length - 1))
    # a word takes two characters at least with what parts it from the next
    total = wanted.agg(F.sum((F.length("text") + 1) / 2)).first()[0] or 0
    groups = max(1, int(-(-total // most_words)))
    found = None
    for g in range(groups):
        part = wanted if groups == 1 else wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g)
        held = [(r["item_id"], words(r["text"])) for r in part.distinct().collect()]  # at most about most_words words
        now = rows.mapInArrow(_searched(held, length, block), "doc_id long, item_id long")
        found = now if found is None else found.union(now)
    return found.distinct()
