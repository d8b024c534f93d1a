"""Substring dedup and the suffix sorter against brute force, and their edges."""

import random

import numpy as np
import pytest

from inkloom.llm import substrings
from inkloom.llm.suffixsort import sort_strings


def brute_force(rows, length):
    """(id, bytes, removed, spans, kept) from a count of every string of ``length`` bytes."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = {}
    for _, b in texts:
        for p in range(len(b) - length + 1):
            seen[b[p:p + length]] = seen.get(b[p:p + length], 0) + 1
    out = []
    for i, b in texts:
        gone = [False] * (len(b) + 1)
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                gone[p:p + length] = [True] * length
        spans = sum(gone[p] and (p == 0 or not gone[p - 1]) for p in range(len(b)))
        out.append((i, len(b), sum(gone), spans, bytes(b[p] for p in range(len(b)) if not gone[p])))
    return sorted(out, key=repr)


def found(df, length, k):
    rows = substrings.without_repeats(df, length=length, k=k).collect()
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in rows), key=repr)


def made(rng, n, common):
    """Texts with copies, edits, frequent passages and lines, periodic stretches and multi-byte letters."""
    text = lambda m: "".join(rng.choice("abcdeé \n") for _ in range(m))
    base, passage, rows = [text(rng.randint(20, 300)) for _ in range(8)], text(common), []
    for i in range(n):
        t = rng.choice(base) if rng.random() < 0.6 else text(rng.randint(0, 200))
        for _ in range(rng.choice([0, 0, 1, 3])):
            p = rng.randrange(len(t) + 1)
            t = t[:p] + text(1) + t[p + 1:]
        if i % 3 == 0:
            p = rng.randrange(len(t) + 1)
            t = t[:p] + passage + t[p:]
        rows.append((i, t + ("ab" * 60 if i % 17 == 0 else "")))
    return rows + [(901, None), (902, ""), (903, "short"), (903, "x" * 300), (None, base[0]), (None, None)]


@pytest.mark.parametrize("length,k,common,limit,bucket", [(40, 12, 90, 2048, 4 << 20), (40, 12, 30, 3, 2000), (40, 12, 90, 2, 2000), (33, 8, 200, 2, 500),
                                                          (16, 16, 20, 4, 300)])
def test_without_repeats_equals_brute_force(frame, monkeypatch, length, k, common, limit, bucket):
    monkeypatch.setattr(substrings, "LIMIT", limit)
    monkeypatch.setattr(substrings, "BUCKET", bucket)
    rows = made(random.Random(length + common), 90, common)
    assert found(frame(rows), length, k) == brute_force(rows, length)


def test_long_texts_are_sampled_in_pieces(frame, monkeypatch):
    monkeypatch.setattr(substrings, "PIECE", 500)
    rng = random.Random(4)
    line = "".join(rng.choice("abcdefgh") for _ in range(700))
    rows = [(1, "".join(rng.choice("abcdefgh") for _ in range(3000)) + line), (2, "xy" + line + "tail" * 300), (3, "z" * 1200)]
    assert found(frame(rows), 60, 20) == brute_force(rows, 60)


def test_edges(spark, frame):
    rows = [(1, "a" * 400), (2, "a" * 399), (3, "b" * 401), (4, None)]
    df = frame(rows).selectExpr("*", "1 AS n1", "'r' AS runs", "2 AS key", "3 AS d1", "4 AS start", "5 AS shape", "6 AS spans", "7 AS kept")
    assert found(df, 400, 64) == brute_force(rows, 400)
    assert substrings.without_repeats(df.limit(0)).collect() == []
    assert found(frame([(1, None), (2, "")]), 400, 64) == [(1, 0, 0, 0, b""), (2, 0, 0, 0, b"")]


@pytest.mark.parametrize("seed", range(25))
def test_sorted_strings(seed):
    rng = random.Random(seed)
    length, letters = rng.choice([3, 8, 13, 24, 40]), rng.choice([b"ab", b"abc", bytes(range(256))])
    base = bytes(rng.choice(letters) for _ in range(90))
    texts = [bytes(rng.choice(letters) if rng.random() < 0.03 else c for c in base[rng.randint(0, 30):90 - rng.randint(0, 10)])
             for _ in range(rng.randint(1, 25))]
    raw, end = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    begin = end - [len(t) for t in texts]
    owner, at = map(np.array, zip(*[(i, begin[i] + j) for i, t in enumerate(texts) for j in range(len(t) - length + 1)], strict=True))
    group = np.array([rng.choice([0, 0, 7]) for _ in at])
    order, equal = sort_strings(raw, owner, at, group, begin, end, length, rng.choice([0, 8, 16]))
    strings = [(group[i], raw[at[i]:at[i] + length].tobytes()) for i in range(len(at))]
    ranked = [strings[i] for i in order]
    assert sorted(order) == list(range(len(at))) and ranked == sorted(strings)
    assert equal.tolist() == [False] + [a == b for a, b in zip(ranked[1:], ranked, strict=False)]
