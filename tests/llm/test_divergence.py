"""Source divergence against brute force, and its edges."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from inkloom.llm import divergence

LOWER = {c: c + 32 for c in range(65, 91)}


def brute_force(rows, least):
    """Rows of (text, lang, source) -> result rows, from the definition with unbounded integers."""
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = [t for t in df if df[t] >= least]

        def shares(words, kept=kept):
            count = Counter(w for w in words if w in kept)
            return count, {t: 1 + 10**9 * (count[t] + 2) // (sum(count.values()) + 2 * len(kept)) for t in kept}

        whole = shares([w for d in own for w in d[2]])[1]
        by = {s: shares([w for d in own if d[1] == s for w in d[2]]) for s in {d[1] for d in own}}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s, (count, p) in by.items():
            pairs = [(o, sum(f(p[t], q[t]) for t in kept)) for o, (_, q) in by.items() if o != s]
            terms = [(t, f(p[t], whole[t])) for t in kept if count[t] and p[t] > whole[t]]
            for part, items, top in (("pair", pairs, None), ("term", terms, 10)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:top]
                out += [(lang, s, part, *x, n + 1) for n, x in enumerate(ranked)]
    return sorted(out)


def made(rng, n):
    words = [rng.choice("abcdé") + rng.choice("xyzZ") * rng.randint(1, 3) for _ in range(30)]
    rows = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else f"s{rng.randrange(6)}"
        rows.append((" ".join(rng.choice(words[:rng.randint(3, 30)]) for _ in range(rng.randint(0, 25))), rng.choice(["en", "en", "fr", None]), source))
    return rows + [(None, "en", None), ("", "xx", "a"), ("7 - 8", "xx", "b"), ("rare", "yy", "only")]


@pytest.mark.parametrize("postings,chunk,held", [(1 << 16, 1 << 20, 1 << 18), (5, 3, 4)])
def test_divergence_equals_brute_force(spark, monkeypatch, postings, chunk, held):
    monkeypatch.setattr(divergence, "POSTINGS", postings)
    monkeypatch.setattr(divergence, "CHUNK", chunk)
    monkeypatch.setattr(divergence, "HELD", held)
    rows = made(random.Random(postings), 150)
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    assert sorted(map(tuple, divergence.source_divergence(df, least_docs=4).collect())) == brute_force(rows, 4)


def test_divergence_edges(spark):
    rows = [("Straße straße", "de", "a")] * 10 + [("STRASSE x", "de", "b")] * 9 + [("y " * 200_000 + "straße", "de", "c"), (None, "de", "d")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr(
        "*", "1 AS n", "'k' AS term", "2 AS block", "3 AS docs", "4 AS p", "5 AS value", "6 AS rank")
    assert sorted(map(tuple, divergence.source_divergence(df).collect())) == brute_force(rows, 10)
    assert divergence.source_divergence(df.limit(0)).collect() == []
    alone = divergence.source_divergence(df.where("source IN ('b', 'd')"))
    assert sorted(map(tuple, alone.collect())) == [("de", "b", "pair", "d", 0, 1), ("de", "d", "pair", "b", 0, 1)]


def test_shares_of_huge_counts_are_exact(spark):
    n, total, terms = 900_000_000_000, 5_000_000_000_001, 40_000_000
    df = spark.createDataFrame([(n, total, terms)], "n bigint, total bigint, terms bigint")
    assert df.select(divergence._share(df.n, df.total, df.terms)).first()[0] == 1 + 10**9 * (n + 2) // (total + 2 * terms)


def test_accumulated_without_terms():
    none = np.empty(0, np.int64)
    assert [t.tolist() for _, t in divergence.accumulated(none, none, none, np.array([7, 9]), 0)] == [[0, 0], [0, 0]]
