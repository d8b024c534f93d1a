"""Deterministic position hashes and noise, computed with BIGINT arithmetic that cannot overflow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import BLOCK_PLATE, BLOCK_X, BLOCK_Y, GOLDEN_32, KNUTH_32
from .numeric import as_col

MASK = 0xFFFFFFFF


def scramble32(value) -> Column:
    """(value xor golden) * knuth modulo 2^32, by halves so the product stays below 2^63."""
    mixed = as_col(value).cast("bigint").bitwiseXOR(F.lit(GOLDEN_32)).bitwiseAND(F.lit(MASK))
    low = mixed.bitwiseAND(F.lit(0xFFFF)) * F.lit(KNUTH_32)
    high = (F.shiftright(mixed, 16) * F.lit(KNUTH_32)).bitwiseAND(F.lit(0xFFFF))
    return (low + F.shiftleft(high, 16)).bitwiseAND(F.lit(MASK))


def block_hash(x, y, plate_idx) -> Column:
    """32-bit hash of a block corner on a plate."""
    total = (as_col(x).cast("bigint") * F.lit(BLOCK_X) + as_col(y).cast("bigint") * F.lit(BLOCK_Y)
             + as_col(plate_idx).cast("bigint") * F.lit(BLOCK_PLATE))
    return total.bitwiseAND(F.lit(MASK))


def unit_noise(x, y, seed) -> Column:
    """Uniform value in [0, 1) for a position: two scrambles of the block hash."""
    first = scramble32(block_hash(x, y, seed))
    second = scramble32(F.shiftright(first, 7) + as_col(seed).cast("bigint"))
    return F.shiftright(second, 8).cast("double") / F.lit(16777216.0)


def noise_at(x, y, seed):
    """``unit_noise`` of integer arrays inside a task."""
    import numpy as np

    word = lambda v: np.asarray(v, dtype=np.int64).astype(np.uint64)
    mask = np.uint64(MASK)

    def scramble(v):
        return ((v & mask) ^ np.uint64(GOLDEN_32)) * np.uint64(KNUTH_32) & mask

    corner = (word(x) * np.uint64(BLOCK_X) + word(y) * np.uint64(BLOCK_Y) + word(seed) * np.uint64(BLOCK_PLATE)) & mask
    return (scramble((scramble(corner) >> np.uint64(7)) + word(seed)) >> np.uint64(8)).astype(np.float64) / 16777216.0


def smooth_noise(x, y, cell, seed) -> Column:
    """Bilinear blend of unit_noise on a lattice with the given spacing (own generator)."""
    fx, fy = as_col(x).cast("double") / as_col(cell), as_col(y).cast("double") / as_col(cell)
    x0, y0 = F.floor(fx), F.floor(fy)
    tx, ty = fx - x0, fy - y0
    one = F.lit(1)
    top = unit_noise(x0, y0, seed) * (one - tx) + unit_noise(x0 + 1, y0, seed) * tx
    low = unit_noise(x0, y0 + 1, seed) * (one - tx) + unit_noise(x0 + 1, y0 + 1, seed) * tx
    return top * (one - ty) + low * ty
