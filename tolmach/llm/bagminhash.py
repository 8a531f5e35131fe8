"""Weighted minhash signatures by hierarchical Poisson processes, as plain numpy.

The weight axis of each element is cut into the intervals [0,1), [1,2), [2,4),
[4,8) ... Each interval has its own Poisson process in time, of a rate equal to
its length; every point falls on one signature slot and at one height within its
interval. A point counts for an element of weight w if it lies below w. A slot
keeps the earliest point that counts, so two signatures agree in a slot with the
probability of their weighted Jaccard similarity. A record is done once every
slot is filled by a point earlier than all that are still to be drawn.
"""

from __future__ import annotations

import numpy as np

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a fixed one-to-one scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(rows: np.ndarray, elements: np.ndarray, weights: np.ndarray, count: int, slots: int, first: int = 24) -> np.ndarray:
    """(count, slots) times of the earliest points.

    ``rows``: the record (0 to count-1) of each entry; ``elements``: its 64-bit hash;
    ``weights``: whole numbers of at least 1. A record without entries keeps
    infinity everywhere. The result depends on nothing but a record's own entries.
    """
    best = np.full(count * slots, np.inf)
    parts = []
    top = int(weights.max(initial=0))
    level, low, length = 0, 0, 1
    while low < top:
        at = np.flatnonzero(weights > low)
        own, index = np.unique(elements[at], return_inverse=True)
        parts.append([length, mix(own + np.uint64((level + 1) * int(_GOLDEN) & (2**64 - 1))), index.ravel(), rows[at], np.minimum(weights[at] - low, length), np.zeros(len(own))])
        low, length, level = low + length, max(1, low + length), level + 1
    open_rows = np.zeros(count, bool)
    open_rows[rows] = True
    drawn, step = 0, first
    while open_rows.any():
        frontier = np.full(count, np.inf)
        for part in parts:
            length, seeds, index, row, height, clock = part
            points = step * length
            used = np.zeros(len(seeds), bool)
            live = open_rows[row]
            index, row, height = index[live], row[live], height[live]
            used[index] = True
            to = np.cumsum(used) - 1
            seeds, clock, index = seeds[used], clock[used], to[index]
            part[1:] = seeds, index, row, height, clock
            if not len(row):
                continue
            turn = np.arange(drawn * length, drawn * length + points, dtype=np.uint64) * _GOLDEN
            draw = mix(seeds[:, None] + turn[None, :])
            gaps = -np.log((draw >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / length
            times = np.cumsum(gaps, axis=1)
            times += clock[:, None]
            again = mix(draw ^ _GOLDEN)
            slot = (again >> np.uint64(40)) % np.uint64(slots)
            part[5] = times[:, -1].copy()
            np.minimum.at(frontier, row, part[5][index])
            where = row[:, None] * slots + slot.astype(np.int64)[index]
            when = times[index]
            if (height < length).any():
                under = (again & np.uint64(0xFFFFFF)).astype(np.float64) * (length * 2.0**-24)
                counts = under[index] < height[:, None]
                np.minimum.at(best, where[counts], when[counts])
            else:
                np.minimum.at(best, where.ravel(), when.ravel())
        drawn += step
        step = drawn
        open_rows &= best.reshape(count, slots).max(axis=1) > frontier
    return best.reshape(count, slots)


def band_keys(signature: np.ndarray, bands: int, rows: int, salt: np.ndarray) -> np.ndarray:
    """(n, bands) signed 64-bit keys of ``rows`` slots each; ``salt`` keeps collections apart."""
    bits = signature[:, : bands * rows].copy().view(np.uint64).reshape(len(signature), bands, rows)
    key = np.arange(bands, dtype=np.uint64)[None, :] * _GOLDEN + salt.astype(np.uint64)[:, None]
    for r in range(rows):
        key = mix(key ^ bits[:, :, r])
    return key.view(np.int64)
