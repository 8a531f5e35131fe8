"""Hilbert curve keys of projected vectors, as plain numpy (no Spark).

A curve is a seeded random projection to ``dims`` axes, a seeded shift of the
grid and a Hilbert order of the cells. Vectors that point in nearly the same
direction tend to get neighbouring keys; several independent curves make it
unlikely that a close pair is separated on all of them.
"""

from __future__ import annotations

import numpy as np


class Curves:
    """``count`` shifted Hilbert orders and one bit sketch of unit vectors."""

    def __init__(self, width: int, count: int, dims: int, bits: int, words: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.count, self.dims, self.bits, self.words = count, dims, bits, words
        self.planes = rng.standard_normal((width, count * dims)).astype(np.float32)
        self.shift = rng.random(count * dims).astype(np.float32)
        self.sketch_planes = rng.standard_normal((width, 64 * words)).astype(np.float32)

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """(n, width) unit vectors to (n, count) signed 64-bit keys."""
        x = unit @ self.planes
        # a logistic stand-in for the normal distribution function fills the cells evenly
        u = 1.0 / (1.0 + np.exp(np.float32(-1.702) * x))
        cell = ((u + self.shift) * np.float32(0.5 * (1 << self.bits))).astype(np.uint32)
        np.minimum(cell, (1 << self.bits) - 1, out=cell)
        return hilbert_index(cell.reshape(-1, self.dims), self.bits).reshape(len(unit), self.count)

    def sketch(self, unit: np.ndarray) -> np.ndarray:
        """(n, words) signed 64-bit words: on which side of random planes a vector lies."""
        side = (unit @ self.sketch_planes) > 0
        return np.packbits(side, axis=1).view(np.int64).reshape(len(unit), self.words)


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of each cell (n, dims) on the Hilbert curve of that many bits per axis.

    The axes are turned into the curve's transposed form by undoing the
    reflections and exchanges from the coarsest level down, then Gray-decoded;
    the bits of all axes are interleaved into one key, which must fit 63 bits.
    """
    dims = cells.shape[1]
    if dims * bits > 63:
        raise ValueError("a key has at most 63 bits")
    axis = [np.ascontiguousarray(cells[:, i]).astype(np.uint32) for i in range(dims)]
    for level in range(bits - 1, 0, -1):
        low = np.uint32((1 << level) - 1)
        for i in range(dims):
            upper = (axis[i] >> np.uint32(level)) & np.uint32(1)
            flip = (np.uint32(0) - upper) & low  # all low bits where the cell lies in the upper half
            swap = (axis[0] ^ axis[i]) & (low & ~flip)
            axis[0] = axis[0] ^ (flip | swap)
            if i:
                axis[i] = axis[i] ^ swap
    for i in range(1, dims):
        axis[i] = axis[i] ^ axis[i - 1]
    fold = np.zeros_like(axis[0])
    for level in range(bits - 1, 0, -1):
        upper = (axis[-1] >> np.uint32(level)) & np.uint32(1)
        fold ^= (np.uint32(0) - upper) & np.uint32((1 << level) - 1)
    key = np.zeros(len(cells), np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | (((axis[i] ^ fold) >> np.uint32(level)) & np.uint32(1)).astype(np.int64)
    return key
