"""Vectorised words of whole Arrow text columns: byte classes, word spans and 64-bit word hashes.

Works on the UTF-8 bytes of a batch at once. Both word rules of the library only look at bytes below 0x80, so every
byte of a multi-byte character is a word byte and no decoding is needed.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK = 1 << 21  # bytes hashed at a time, so that the work arrays stay in cache and memory is bounded
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _lowered() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = _lowered()
#: 0-9, A-Z, a-z and everything outside ASCII.
ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
#: Everything but the space and \t \n \v \f \r.
SOLID = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random value per lower-cased byte, and the powers of an odd base and of its inverse modulo 2^64."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)[LOWER]
    inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
    power = np.full(BLOCK + 1, _ODD, dtype=np.uint64)
    back = np.full(BLOCK + 1, inverse, dtype=np.uint64)
    power[0] = back[0] = 1
    return values, np.multiply.accumulate(power), np.multiply.accumulate(back)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 row bounds in them; nulls are empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    column = column.fill_null("") if column.null_count else column
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[bounds[0]:bounds[-1]] if len(column) else raw[:0], bounds - bounds[0]


def word_spans(raw: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and the n + 1 bounds of each row's words among them."""
    if not len(raw):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(bounds), np.int64)
    word = inside[raw]
    fresh = np.zeros(len(raw) + 1, bool)
    fresh[bounds] = True  # a word never runs on into the next row
    start = word.copy()
    start[1:] &= ~word[:-1] | fresh[1:-1]
    end = word.copy()
    end[:-1] &= ~word[1:] | fresh[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words with A-Z lowered: a polynomial over random byte values from prefix sums."""
    values, power, back = _tables()
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = int(np.searchsorted(ends, low + BLOCK, side="right"))
        if j <= i:  # one word longer than a block
            total, base = np.uint64(0), np.uint64(1)
            with np.errstate(over="ignore"):
                for at in range(int(low), int(ends[i]), BLOCK):
                    piece = values[raw[at:min(at + BLOCK, int(ends[i]))]]
                    total = total + base * (piece * power[:len(piece)]).sum(dtype=np.uint64)
                    base = base * power[len(piece)]
            out[i] = total + _ODD * np.uint64(ends[i] - low)
            i += 1
            continue
        sums = np.zeros(int(ends[j - 1] - low) + 1, np.uint64)
        piece = values[raw[low:ends[j - 1]]]
        piece *= power[:len(piece)]
        np.cumsum(piece, out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (sums[e] - sums[s]) * back[s] + _ODD * (e - s).astype(np.uint64)
        i = j
    return mix(out)


def batch_words(column: pa.Array, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, byte starts, byte ends (within the batch) and row bounds of the words of a string column."""
    raw, bounds = text_bytes(column)
    starts, ends, rows = word_spans(raw, bounds, inside)
    return hash_words(raw, starts, ends), starts, ends, rows
