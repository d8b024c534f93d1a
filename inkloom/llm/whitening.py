"""Whitening of embeddings: spectral divide and conquer by QDWH polar decompositions of the shifted covariance."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import schema_of, written

STEP = 256.0  # cells per unit of a component
EPS = float(np.finfo(np.float64).eps)
LARGEST = 2.0 ** 61  # integers stop here
SAFE = 2 ** 62  # sums of products up to here are taken in 64 bits
CUTS = 40  # halvings of a spectrum that leave one side empty before it counts as one eigenvalue


# ---- dense algebra on a d x d matrix ----

def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by the dynamically weighted Halley iteration: the weights follow a lower
    bound of the singular values, so some six steps do for any conditioning. Steps with large weights go through a QR
    factorisation of [sqrt(c) X; I], the later well-conditioned ones through a Cholesky factor."""
    n = len(a)
    x = a / np.linalg.norm(a)
    low = min(1.0, max(EPS, 1 / max(1.0, np.linalg.norm(np.linalg.inv(x), 1)) / n ** 0.5)) if np.linalg.cond(x, 1) < 1 / EPS else EPS
    for _ in range(30):
        square = low * low
        d = np.cbrt(max(0.0, 4 * (1 - square)) / square ** 2)
        big_a = np.sqrt(1 + d) + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - square) / (square * np.sqrt(1 + d))))
        b = (big_a - 1) ** 2 / 4
        c = big_a + b - 1
        if c > 100:
            q = np.linalg.qr(np.vstack([np.sqrt(c) * x, np.eye(n)]))[0]
            fresh = b / c * x + (big_a - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        else:
            z = np.linalg.cholesky(np.eye(n) + c * (x.T @ x))
            fresh = b / c * x + (big_a - b / c) * np.linalg.solve(z.T, np.linalg.solve(z, x.T)).T
        fresh = (fresh + fresh.T) / 2
        low = min(1.0, low * (big_a + b * square) / (1 + c * square))
        moved, x = np.linalg.norm(fresh - x), fresh
        if moved <= 4 * EPS ** (1 / 3) and abs(1 - low) < 10 * EPS or moved <= 10 * EPS * n ** 0.5:
            break
    return x


def _halves(a: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of the invariant subspaces above and below the shift, from the projector (U + I) / 2."""
    n = len(a)
    projector = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
    rank = int(round(float(np.trace(projector))))
    start = np.random.default_rng(n).standard_normal((n, n))
    upper = np.linalg.qr(projector @ start[:, :rank])[0] if rank else start[:, :0]
    for _ in range(2):
        upper = np.linalg.qr(projector @ upper)[0] if rank else upper
    lower = np.linalg.qr(np.hstack([upper, start[:, rank:]]))[0][:, rank:]
    for _ in range(2):
        lower = np.linalg.qr(lower - projector @ lower)[0] if rank < n else lower
    return upper, lower


def leading(a: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns.

    Spectral divide and conquer: the polar factor of the matrix less a shift gives the projector on the eigenvectors above the shift;
    bases of both sides carry the matrix into two smaller blocks, and these are divided in turn, the upper one first. Lower
    blocks are left alone once enough components are found. A block whose spectrum cannot be divided has one eigenvalue. Each
    eigenvector is corrected once, to first order, by what its block lost.
    """
    n = len(a)
    scale = np.linalg.norm(a)
    values: list[float] = []
    vectors: list[np.ndarray] = []
    stack = [np.eye(n)]
    while stack and len(values) < count:
        basis = stack.pop()
        block = basis.T @ a @ basis
        block = (block + block.T) / 2
        m = len(block)
        middle = float(np.trace(block)) / m
        if m == 1 or np.linalg.norm(block - middle * np.eye(m)) <= 4 * EPS * m * scale:
            values += [middle] * m
            vectors += list(basis.T)
            continue
        radius = np.abs(block).sum(1) - np.abs(np.diag(block))
        low, high = float((np.diag(block) - radius).min()), float((np.diag(block) + radius).max())
        shift = float(np.median(np.diag(block))) if m > 2 else middle
        for _ in range(CUTS):
            upper, lower = _halves(block, shift)
            if upper.shape[1] and lower.shape[1]:
                break
            low, high = (shift, high) if upper.shape[1] else (low, shift)
            shift = (low + high) / 2
        else:
            values += [middle] * m
            vectors += list(basis.T)
            continue
        stack += [basis @ lower, basis @ upper]
    order = np.argsort(-np.array(values), kind="stable")[:count]
    found = np.array(vectors).T[:, order]
    return _polished(a, found, scale)


def _polished(a: np.ndarray, vectors: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Rayleigh quotients, and vectors after one inverse iteration step each; a step that turns away from its vector is not taken
    (equal eigenvalues have no single vector)."""
    out = []
    for i in range(vectors.shape[1]):
        v = vectors[:, i]
        e = float(v @ a @ v)
        try:
            w = np.linalg.solve(a - (e + 4 * EPS * scale) * np.eye(len(a)), v)
            w = w - sum((o @ w) * o for o in out)
            w = w / np.linalg.norm(w)
        except np.linalg.LinAlgError:
            w = v
        out.append(w * np.sign(w @ v) if abs(w @ v) > 1 - 1e-6 else v)
    basis = np.array(out).T
    return np.array([v @ a @ v for v in basis.T]), basis


# ---- the tables ----

def _cells(raw: np.ndarray) -> np.ndarray:
    """floor(256 c) as 64-bit integers; beyond 2^61 they stay there."""
    with np.errstate(over="ignore"):
        x = np.clip(np.floor(raw * STEP), -LARGEST, LARGEST)
    return x.astype(np.int64)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, dim) of the vectors without null and non-finite entries: the key holds the integers, as narrow as they allow."""
    for batch in batches:
        column = batch.column(1)
        lengths = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), -1), np.int64)
        flat = column.flatten()  # null lists have no entries here
        starts = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))])
        raw = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls are nan
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(raw))])
        ok = np.flatnonzero((lengths > 0) & (bad[starts[1:]] == bad[starts[:-1]]))
        cells = _cells(np.nan_to_num(raw))
        keys = []
        for i in ok:
            own = cells[starts[i]:starts[i + 1]]
            top = max(int(own.max()), -int(own.min()))
            keys.append(own.astype("<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ok)), pa.array(keys, pa.binary()), pa.array(lengths[ok], pa.int32())],
                                         names=["doc_id", "key", "dim"])


def _matrix(keys: pa.Array, dim: int) -> np.ndarray:
    """The integers of keys of one dimension."""
    out = np.empty((len(keys), dim), np.int64)
    for i, key in enumerate(keys.to_pylist()):
        out[i] = np.frombuffer(key, f"<i{len(key) // dim}")
    return out


def _sums(dim: int):
    """(place, sum) over a task's vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, small, held = np.zeros(dim, object), np.zeros(dim, np.int64), 0
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            top = int(np.abs(x).max(initial=0)) * len(x)
            if top >= SAFE:
                total = total + x.astype(object).sum(0)
                continue
            if held + top >= SAFE:
                total, small, held = total + small.astype(object), np.zeros(dim, np.int64), 0
            small, held = small + x.sum(0), held + top
        total = total + small.astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([str(int(t)) for t in total])], names=["place", "total"])
    return run


def _products(dim: int, centre: np.ndarray, basis: np.ndarray | None, shift: np.ndarray | None):
    """(i, j, sum) of products of centred vectors over a task, or of their whitened components. Whole numbers below 2^53 add up exactly in
    doubles, so the sums do not depend on how the tasks are cut."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = dim if basis is None else basis.shape[1]
        total = np.zeros((size, size))
        for batch in batches:
            x = (_matrix(batch.column(0), dim) - centre).astype(np.float64)
            if basis is not None:
                x = (x - shift) @ basis
            total += x.T @ x
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "v"])
    return run


def _gram(fit: DataFrame, dim: int, centre: np.ndarray, basis: np.ndarray | None = None, shift: np.ndarray | None = None) -> np.ndarray:
    """The summed products; what reaches the driver is one number per pair of dimensions."""
    rows = (fit.select("key").mapInArrow(_products(dim, centre, basis, shift), "i int, j int, v double")
            .groupBy("i", "j").agg(F.sum("v").alias("v")).collect())
    out = np.zeros((dim if basis is None else basis.shape[1],) * 2)
    for r in rows:
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n x - S)^2 per row, exact; null where it leaves 64 bits."""
    dim, far = x.shape[1], max([1, *map(abs, sums)])
    if dim * (n * int(np.abs(x).max(initial=0)) + far) ** 2 < SAFE:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(1)
    return [int(v) if v < 2 ** 63 else None for v in exact]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4) -> DataFrame:
    """Vectors projected on the leading principal components of all distinct vectors and scaled to unit variance:
    ``vec_id, component, n, deviation, whitened, explained, identity_error``, one row per vector and component.

    1. An entry c becomes the integer floor(256 c). The fit list holds every distinct integer vector once: n vectors with sums S.
    2. Tasks add up products of the vectors centred at the integers next to S / n, which is exact; the rest of the centring is a rank-one
       correction below one half per dimension. Only sums, one per pair of dimensions, reach the driver.
    3. There QDWH polar decompositions of the shifted covariance give spectral projectors that divide it until the leading
       components stand alone (see ``leading``).
    4. The d x ``components`` projection travels with the tasks of one pass over all rows, as does the largest absolute entry of the
       whitened fit list's covariance less the identity, which a pass over the fit list measures.

    Vectors that are null, empty or hold null or non-finite entries are dropped, as are vectors of another length than the one most
    vectors have (of equally frequent ones the largest). Entries whose integer would leave 2^61 stay there, and a deviation beyond 64
    bits is null. A component without variance (fewer distinct vectors than components, one repeated vector) is whitened to 0 and
    left out of identity_error; explained is then 0. Repeated rows and null ids stay, each with its rows. Equal eigenvalues
    have any orthonormal vectors of their space, the same for all rows. An empty table gives no rows. Further columns are ignored.
    """
    spark, id_type = vectors.sparkSession, vectors.schema[id_col].dataType
    schema = T.StructType([T.StructField("vec_id", id_type), *T.StructType.fromDDL(
        "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double").fields])
    source = vectors.select(F.col(id_col).alias("doc_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    kept = source.mapInArrow(_kept, schema_of(source, "doc_id", "key binary, dim int"))
    common = kept.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    dim = common["dim"]
    kept = kept.where(F.col("dim") == dim)
    fit = written(kept.select("key").distinct(), "fit")
    n = fit.count()
    totals = fit.mapInArrow(_sums(dim), "place int, total string").groupBy("place").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    sums = [0] * dim
    for r in totals:
        sums[r["place"]] = int(r["total"])
    centre = np.array([round(Fraction(s, n)) for s in sums], np.int64)
    shift = np.array([float(Fraction(s, n) - int(c)) for s, c in zip(sums, centre, strict=True)])
    covariance = _gram(fit, dim, centre) / n - np.outer(shift, shift)
    count, trace = min(components, dim), float(np.trace(covariance))
    values, basis = leading(covariance, count)
    has = values > 16 * EPS * dim * max(float(values[0]), 0.0)
    scaled = np.where(has, basis / np.sqrt(np.where(has, values, 1.0)), 0.0)
    error = np.abs(_gram(fit, dim, centre, scaled, shift) / n - np.diag(has.astype(float))).max() if has.any() else 0.0
    explained = np.where(has, values / trace, 0.0) if trace > 0 else np.zeros(count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            white = ((x - centre).astype(np.float64) - shift) @ scaled
            m = len(x)
            each = lambda a, kind: pa.array(np.tile(a, m), kind)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(m), count))), each(np.arange(1, count + 1), pa.int32()),
                 pa.array(np.full(m * count, n), pa.int64()),
                 pa.array([d for d in _deviation(x, n, sums) for _ in range(count)], pa.int64()), pa.array(white.ravel()),
                 each(explained, pa.float64()), pa.array(np.full(m * count, error))], names=[f.name for f in schema])

    return kept.select("doc_id", "key").mapInArrow(run, schema)
