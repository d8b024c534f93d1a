"""FM-index over integer symbols: suffix order, wavelet-matrix ranks, sampled positions; all queries are vectorised."""

from __future__ import annotations

import numpy as np

SAMPLE = 16  # every 16th position of a segment keeps its place


class Ranks:
    """A wavelet matrix: one bit vector per symbol bit, with counts before every 64-bit word."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.words, self.before, self.zeros = bits, [], [], []
        row = symbols
        for level in range(bits - 1, -1, -1):
            bit = ((row >> level) & 1).astype(bool)
            packed = np.zeros((len(row) // 64 + 1) * 8, np.uint8)
            own = np.packbits(bit, bitorder="little")
            packed[:len(own)] = own
            word = packed.view(np.uint64)
            self.words.append(word)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(word), dtype=np.int64)]))
            self.zeros.append(int(len(row) - bit.sum()))
            row = np.concatenate([row[~bit], row[bit]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        word, offset = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << offset) - np.uint64(1)
        return self.before[level][word] + np.bitwise_count(self.words[level][word] & mask).astype(np.int64)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        low = np.zeros(len(at), np.int64)
        for level in range(self.bits):
            one = (symbol >> (self.bits - 1 - level)) & 1 == 1
            ones_at, ones_low = self._ones(level, at), self._ones(level, low)
            at = np.where(one, self.zeros[level] + ones_at, at - ones_at)
            low = np.where(one, self.zeros[level] + ones_low, low - ones_low)
        return at - low

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbol at each place."""
        symbol = np.zeros(len(at), np.int64)
        for level in range(self.bits):
            word, offset = at >> 6, (at & 63).astype(np.uint64)
            one = (self.words[level][word] >> offset) & np.uint64(1) == 1
            ones = self._ones(level, at)
            at = np.where(one, self.zeros[level] + ones, at - ones)
            symbol = symbol * 2 + one
        return symbol


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Places in suffix order by prefix doubling. Symbol 0 ends a segment and is smaller at an earlier place.

    Only groups that are still equal are sorted again, so long repeats cost one round per doubling of their length.
    """
    n = len(symbols)
    end = symbols == 0
    name = np.where(end, np.cumsum(end) - 1, symbols + int(end.sum())).astype(np.int64)
    order = np.argsort(name, kind="stable")
    rank = np.empty(n, np.int64)
    sorted_name = name[order]
    first = np.concatenate([[True], sorted_name[1:] != sorted_name[:-1]])
    rank[order] = np.flatnonzero(first)[np.cumsum(first) - 1]  # the place where the group begins
    step = 1
    open_group = ~(first & np.concatenate([first[1:], [True]]))
    while open_group.any():
        rows = np.flatnonzero(open_group)
        places = order[rows]
        after = rank[np.minimum(places + step, n - 1)]
        again = np.lexsort((after, rank[places]))
        places, after = places[again], after[again]
        order[rows] = places
        group = rank[places]
        start = np.concatenate([[True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])])
        rank[places] = rows[np.flatnonzero(start)[np.cumsum(start) - 1]]
        open_group[rows] = ~(start & np.concatenate([start[1:], [True]]))
        step *= 2
    return order


class FMIndex:
    """Search and locate phrases in segments of symbols 1..sigma-1, each segment followed by one 0."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        order = suffix_order(symbols)
        last = np.roll(symbols, 1)[order]
        self.ranks = Ranks(last, max(1, int(sigma - 1).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))])
        starts = np.concatenate([[True], symbols[:-1] == 0])
        begin = np.maximum.accumulate(np.where(starts, np.arange(len(symbols)), 0))
        keep = ((np.arange(len(symbols)) - begin) % SAMPLE == 0)[order]  # a segment's start always is, so no walk leaves it
        self.kept, self.places = keep, order[keep]
        self.kept_before = np.cumsum(keep) - 1
        self.n = len(symbols)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of all phrases by backward search. Phrases are right-aligned in their array."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for step in range(phrases.shape[1]):
            live = np.flatnonzero((lengths > step) & (low < high))
            if not len(live):
                break
            symbol = phrases[live, -1 - step]
            low[live] = self.first[symbol] + self.ranks.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.ranks.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of the suffixes in these rows: walk back to a sampled place."""
        rows, out, walked = rows.copy(), np.empty(len(rows), np.int64), 0
        todo = np.arange(len(rows))
        while len(todo):
            at = rows[todo]
            hit = self.kept[at]
            out[todo[hit]] = self.places[self.kept_before[at[hit]]] + walked
            todo, at = todo[~hit], at[~hit]
            symbol = self.ranks.access(at)
            rows[todo] = self.first[symbol] + self.ranks.rank(symbol, at)
            walked += 1
        return out
