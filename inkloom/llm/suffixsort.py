"""Suffix sorting of many strings at once: multikey quicksort to a shallow depth, blind tries below it."""

from __future__ import annotations

import numpy as np

SHALLOW = 16  # bytes that are sorted by multikey quicksort
PAIR_BYTES = 4 << 20  # bytes of pairs of strings compared at a time


def _words(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as one big-endian number: a character of the quicksort."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(raw), np.uint64)
    for i in range(8):
        out = out << np.uint64(8) | padded[i:i + len(raw)]
    return out


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the run of equal neighbours that each entry lies in, and the sizes of the runs."""
    number = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])) if len(key) else key.astype(np.int64)
    return number, np.bincount(number) if len(key) else number


def _multikey(words: np.ndarray, at: np.ndarray, order: np.ndarray, group: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sort ``order`` within groups by the first ``depth`` bytes, in place; returns the slots (and group numbers) still tied.

    All groups are partitioned at once around a pivot each: smaller, equal and larger characters; the equal part moves on to
    the next character.
    """
    tied, slots, key, done = [], np.arange(len(order)), group, np.zeros(len(order), np.int64)
    while len(slots):
        number, sizes = _runs(key)
        many = sizes[number] > 1
        deep = many & (done >= depth)
        tied.append((slots[deep], number[deep]))
        go = many & ~deep
        slots, done = slots[go], done[go]
        if not len(slots):
            break
        number, sizes = _runs(number[go])
        item = order[slots]
        word = words[at[item] + done]
        pivot = word[np.cumsum(sizes) - (sizes + 1) // 2][number]
        key = number * 3 + (word == pivot) + 2 * (word > pivot)
        by = np.argsort(key, kind="stable")
        order[slots] = item[by]
        key, done = key[by], done[by]
        done = np.where(key % 3 == 1, done + 8, done)
    return [t for t in tied if len(t[0])]


def _common(raw: np.ndarray, owner: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray, item: np.ndarray,
            lead: np.ndarray, length: int) -> np.ndarray:
    """Length of the common prefix of strings ``item`` and ``lead``, at most ``length``. Strings of the same two texts that are equally
    far apart share one comparison of the texts: the next place where they differ ends all of them."""
    shift = at[lead] - at[item]
    span, texts = 2 * len(raw) + 1, len(begin)
    coded, which = np.unique((owner[item] * texts + owner[lead]) * span + shift + len(raw), return_inverse=True)
    pairs = np.stack([coded // span // texts, coded // span % texts, coded % span - len(raw)])
    low = np.maximum(begin[pairs[0]], begin[pairs[1]] - pairs[2])
    high = np.minimum(end[pairs[0]], end[pairs[1]] - pairs[2])
    out = np.empty(len(item), np.int64)
    order = np.argsort(which, kind="stable")
    first = np.searchsorted(which[order], np.arange(pairs.shape[1] + 1))
    size = high - low
    upto = np.cumsum(size)
    i = 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + PAIR_BYTES, side="right")))
        n = size[i:j]
        base = np.cumsum(n) - n
        places = np.repeat(low[i:j] - base, n) + np.arange(n.sum())
        differs = raw[places] != raw[places + np.repeat(pairs[2, i:j], n)]
        stop = np.where(differs, np.arange(len(differs)), len(differs))
        ends = np.repeat(base + n, n)
        stop = np.minimum(np.minimum.accumulate(stop[::-1])[::-1], ends)
        own = order[first[i]:first[j]]
        place = at[item[own]] - low[which[own]] + base[which[own] - i]
        out[own] = stop[place] - place
        i = j
    return np.minimum(out, length)


def sort_strings(raw: np.ndarray, owner: np.ndarray, at: np.ndarray, group: np.ndarray, begin: np.ndarray, end: np.ndarray,
                 length: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings raw[at:at + length] by group and then by bytes, and whether each equals the one before it in its group.

    ``owner`` is the text of each string, ``begin`` and ``end`` the places of the texts in ``raw``. Deep groups are ordered by blind
    tries: a trie keeps, for one member's path, only the depth at which others leave it and the byte they leave by. Each round
    inserts all members of all groups along their leader (the member of the first text): members that never leave are
    equal to it, those that leave at one depth by one byte are the next round's groups.
    """
    order = np.lexsort((at, group))
    _, ranked = np.unique(group, return_inverse=True)
    equal = np.zeros(len(order), bool)
    words = _words(raw)
    for slots, number in _multikey(words, at, order, ranked.ravel()[order], min(shallow, length // 8 * 8)):
        while len(slots):
            number, sizes = _runs(number)
            item = order[slots]
            starts = np.cumsum(sizes) - sizes
            lead = item[np.lexsort((item, owner[item], number))[starts]][number]  # the member of the first text
            same = _common(raw, owner, at, begin, end, item, lead, length)
            whole = same >= length
            here, there = (raw[np.where(whole, at[i], at[i] + same)] for i in (item, lead))
            side = np.where(whole, 1, np.where(here < there, 0, 2))
            leaves = np.where(side == 2, length - same, same)
            key = ((number * 3 + side) * (length + 1) + np.where(whole, 0, leaves)) * 256 + np.where(whole, 0, here)
            by = np.argsort(key, kind="stable")
            order[slots] = item[by]
            run, count = _runs(key[by])
            done = side[by] == 1
            follows = np.concatenate([[False], run[1:] == run[:-1]])
            equal[slots[done & follows]] = True
            go = ~done & (count[run] > 1)
            slots, number = slots[go], run[go]
    return order, equal
