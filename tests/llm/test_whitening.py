"""Whitening against an eigenvalue solver, and its edges."""

import numpy as np
import pytest

from inkloom.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute_force(vectors, components=4):
    """Integers, fit list, covariance and projections by dense algebra; the sign of a component is left open."""
    x = {i: tuple(int(np.floor(256 * float(np.float32(c)))) for c in v) for i, v in vectors}
    fit = np.array(sorted(set(x.values())), np.int64)
    n, sums = len(fit), [sum(int(v) for v in col) for col in fit.T]
    centred = fit - np.array(sums) / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1][:components], basis[:, ::-1][:, :components]
    share = values / (centred ** 2).sum() * n
    return n, {i: (sum((n * v - s) ** 2 for v, s in zip(own, sums, strict=True)),
                   (np.array(own) - np.array(sums) / n) @ basis / np.sqrt(values)) for i, own in x.items()}, share


@pytest.mark.parametrize("dim,rows", [(64, 500), (5, 40), (2, 9)])
def test_whitening_equals_dense_algebra(spark, dim, rows):
    rng = np.random.default_rng(dim)
    data = rng.standard_normal((rows, dim)) * np.linspace(1, 3, dim) + 0.3
    vectors = [(i, data[i // 2 if i % 5 == 0 else i].astype(np.float32).tolist()) for i in range(rows)]
    df = spark.createDataFrame([(i, v, None) for i, v in vectors], SCHEMA).repartition(5)
    out = whitening.whiten(df).collect()
    n, want, share = brute_force(vectors)
    count = min(4, dim)
    assert len(out) == rows * count
    got = {(r["vec_id"], r["component"]): r for r in out}
    for c in range(count):
        mine = np.array([got[i, c + 1]["whitened"] for i, _ in vectors])
        dense = np.array([want[i][1][c] for i, _ in vectors])
        assert min(np.abs(mine - dense).max(), np.abs(mine + dense).max()) < 1e-9
    for r in out:
        assert (r["n"], r["deviation"]) == (n, want[r["vec_id"]][0])
        assert abs(r["explained"] / share[r["component"] - 1] - 1) < 1e-9 and r["identity_error"] < 1e-9


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0, -2.0]), (1, [0.5, 1.0, -2.0]), (None, [1.5, -1.0, 0.0]), (2, [0.0, 0.0, 0.0]), (3, None), (4, [1.0, None, 2.0]),
            (5, [nan, 1.0, 2.0]), (6, [inf, 1.0, 2.0]), (7, []), (8, [1.0, 2.0]), (9, [-0.0, 0.001, 0.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).selectExpr("*", "1 AS key", "2 AS dim", "3 AS n", "4 AS component")
    out = whitening.whiten(df).collect()
    assert sorted(r["vec_id"] or 0 for r in out) == sorted([1, 1, 0, 2, 9] * 3)
    assert {r["n"] for r in out} == {3}  # the small vector 9 has the integers of vector 2
    third = [r for r in out if r["component"] == 3]
    assert {r["whitened"] for r in third} == {0.0} and {r["explained"] for r in third} == {0.0}
    assert all(r["identity_error"] < 1e-9 for r in out)
    alone = whitening.whiten(df.where("vec_id = 1")).collect()
    assert {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in alone} == {(1, 0, 0.0, 0.0, 0.0)}
    assert whitening.whiten(df.limit(0)).collect() == [] and whitening.whiten(df.where("vec_id = 3")).collect() == []


def test_integers_too_large_for_64_bits(spark):
    rows = [(i, [1e30 if i == 0 else 2.0 ** (24 + i), float(i)], 0) for i in range(6)]
    out = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 12 and {r["deviation"] for r in out if r["vec_id"] == 0} == {None}
    small = [(i, [2.0 ** 18 * i, float(i * i)]) for i in range(6)]
    out = whitening.whiten(spark.createDataFrame([(*r, 0) for r in small], SCHEMA)).collect()
    want = brute_force(small)[1]
    assert {(r["vec_id"], r["deviation"]) for r in out} == {(i, want[i][0] if want[i][0] < 2 ** 63 else None) for i, _ in small}


@pytest.mark.parametrize("spectrum", [[3, 3, 3, 1], [1, 1 - 1e-9, 0.5, 0.5, 0.1], [5, 0, 0, 0], [1, 1e-4, 1e-8, 1e-12, 1e-15], [2, 1], [7]])
def test_leading_components_of_a_spectrum(spectrum):
    rng = np.random.default_rng(len(spectrum))
    q = np.linalg.qr(rng.standard_normal((len(spectrum),) * 2))[0]
    a = (q * np.array(spectrum)) @ q.T
    values, basis = whitening.leading((a + a.T) / 2, 4)
    top = max(spectrum)
    assert np.abs(values - sorted(spectrum, reverse=True)[:4]).max() < 1e-14 * top * 4
    assert np.abs(basis.T @ basis - np.eye(len(values))).max() < 1e-13
    assert np.linalg.norm(a @ basis - basis * values) < 1e-13 * top


def test_polar_factor_of_an_ill_conditioned_matrix():
    q = np.linalg.qr(np.random.default_rng(3).standard_normal((30, 30)))[0]
    w = np.geomspace(1e-12, 1, 30) * np.where(np.arange(30) % 2, 1, -1)
    a = (q * w) @ q.T
    u = whitening.polar((a + a.T) / 2)
    assert np.abs(u @ u - np.eye(30)).max() < 1e-13 and round(float(np.trace(u))) == 0
    well = whitening.polar((q * (np.sign(w) * np.geomspace(1e-3, 1, 30))) @ q.T)
    assert np.abs(well - (q * np.sign(w)) @ q.T).max() < 1e-12
