"""Near-duplicate vectors on a robust-pruned flat graph, built on overlapping cluster shards and searched by range."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graphs import components
from .store import written

SAMPLE = 20_000  # vectors that centroids are fitted on, at most about so many
TARGET = 6000  # vectors wanted in a shard
LIMIT = 16_384  # a larger shard is worked on in pairs of blocks of half that size
NEAR, FAR, POOL = 32, 8, 64  # neighbours kept of the nearest and of far ones, and candidates for the former
ALPHA = 1.2
BEAM = 8
STEPS = 1 << 20  # list entries followed at a time
AUDIT = 200  # vectors that recall is audited on
RECALL = 0.99


def unit(flat: np.ndarray) -> np.ndarray:
    flat = flat.astype(np.float64)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def centroids(u: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means from evenly spread rows; empty cells keep their centre."""
    centre = u[np.linspace(0, len(u) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        cell = np.argmax(u @ centre.T, axis=1)
        for c in np.unique(cell):
            mean = u[cell == c].mean(0)
            if (length := np.linalg.norm(mean)) > 0:
                centre[c] = mean / length
    return centre


def cells_of(u: np.ndarray, centre: np.ndarray, radius: float, overlap: int) -> list[list[int]]:
    """The cells of each vector: the nearest, and those of the next ``overlap`` - 1 whose bisecting plane to the nearest is
    within the radius. Beyond that plane no vector within the radius can have its nearest centre."""
    near = u @ centre.T
    order = np.argsort(-near, axis=1, kind="stable")[:, :overlap]
    first = order[:, :1]
    gap = np.take_along_axis(near, first, 1) - np.take_along_axis(near, order, 1)
    apart = np.linalg.norm(centre[order] - centre[first], axis=2)
    inside = gap <= radius * apart
    inside[:, 0] = True
    return [sorted(o[i].tolist()) for o, i in zip(order, inside, strict=True)]


def robust_prune(u: np.ndarray, own: np.ndarray, pool: np.ndarray, keep: int) -> np.ndarray:
    """Of the candidates of the rows ``own``, nearest first, those that no kept one is closer to by the factor ALPHA; -1
    fills up."""
    near = u[pool]
    far = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nd,npd->np", u[own], near)))
    open_, out, rows = np.ones(pool.shape, bool), np.full((len(own), keep), -1), np.arange(len(own))
    for slot in range(keep):
        has = open_.any(1)
        if not has.any():
            break
        best = np.argmax(open_, axis=1)
        out[has, slot] = pool[rows, best][has]
        between = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nd,npd->np", near[rows, best], near)))
        open_ &= ALPHA * between > far
        open_[rows, best] = False
    return out


def build(u: np.ndarray, seed: int = 5) -> list[np.ndarray]:
    """Adjacency lists of one shard: pruned nearest candidates, a few far ones so that the graph hangs together, and all
    edges backwards."""
    n = len(u)
    if n < 2:
        return [np.empty(0, np.int64)] * n
    pool = min(POOL, n - 1)
    near = np.empty((n, pool), np.int64)
    for at in range(0, n, 256):
        sims = u[at:at + 256] @ u.T
        sims[np.arange(len(sims)), np.arange(at, at + len(sims))] = -2
        best = np.argpartition(-sims, pool - 1, axis=1)[:, :pool]
        near[at:at + 256] = np.take_along_axis(best, np.argsort(-np.take_along_axis(sims, best, 1), axis=1, kind="stable"), 1)
    kept = np.concatenate([robust_prune(u, np.arange(at, min(n, at + 256)), near[at:at + 256], NEAR) for at in range(0, n, 256)])
    far = np.random.default_rng(seed).integers(0, n, (n, FAR))
    a = np.repeat(np.arange(n), kept.shape[1] + FAR)
    b = np.concatenate([kept, far], 1).ravel()
    ok = (b >= 0) & (a != b)
    edge = np.unique(np.concatenate([a[ok] * n + b[ok], b[ok] * n + a[ok]]))
    return np.split(edge % n, np.searchsorted(edge // n, np.arange(1, n)))


def _runs(ahead: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose summed sizes (``ahead`` is their running sum) are about the limit."""
    lo = 0
    while lo < len(ahead):
        hi = max(lo + 1, int(np.searchsorted(ahead, (ahead[lo - 1] if lo else 0) + limit, side="right")))
        yield lo, hi
        lo = hi


def range_search(u: np.ndarray, lists: list[np.ndarray], queries: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """(query, members with cosine >= least) for query rows: greedy search from the medoid and the query's own
    place until its BEAM best are expanded, then expansion of everything in range until nothing new is in range."""
    n = len(u)
    medoid = int(np.argmax(u @ u.mean(0)))
    degree = np.array([len(x) for x in lists])
    first, ends = np.cumsum(degree) - degree, np.concatenate(lists)
    for at in range(0, len(queries), 256):
        q = queries[at:at + 256]
        met = np.zeros(len(q) * n, bool)  # by query and member: whether its cosine is known
        rows = np.arange(len(q))
        codes = np.unique(np.concatenate([rows * n + medoid, rows * n + q]))
        beam, found = (codes[:0], np.empty(0), np.empty(0, bool)), []
        met[codes] = True
        while len(codes):
            row, node = np.divmod(codes, n)
            sims = np.concatenate([np.einsum("nd,nd->n", u[q[row[p:p + 8192]]], u[node[p:p + 8192]]) for p in range(0, len(row), 8192)])
            hit = sims >= least
            found.append(codes[hit])
            code, sim, ended = (np.concatenate(x) for x in zip(beam, (codes, sims, np.zeros(len(codes), bool)), strict=True))
            order = np.lexsort((-sim, code // n))
            code, sim, ended = code[order], sim[order], ended[order]
            begin = np.flatnonzero(np.diff(code // n, prepend=-1))
            best = np.arange(len(code)) - np.repeat(begin, np.diff(begin, append=len(code))) < BEAM
            grow = np.concatenate([code[best & ~ended], codes[hit]])  # the best not yet expanded, and all that is in range
            beam = code[best], sim[best], np.ones(int(best.sum()), bool)
            row, node = np.divmod(np.unique(grow), n)
            steps, fresh = degree[node], [codes[:0]]
            ahead = np.cumsum(steps)
            for lo, hi in _runs(ahead, STEPS):
                own = steps[lo:hi]
                place = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
                codes = np.repeat(row[lo:hi] * n, own) + ends[np.repeat(first[node[lo:hi]], own) + place]
                codes = np.unique(codes[~met[codes]])
                met[codes] = True
                fresh.append(codes)
            codes = np.concatenate(fresh)
        row, node = np.divmod(np.sort(np.concatenate(found)), n)
        for query, own in zip(q, np.split(node, np.searchsorted(row, np.arange(1, len(q)))), strict=True):
            yield int(query), own[own != query]


def _matrix(table: pa.Table) -> np.ndarray:
    flat = table.column("embedding").combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return unit(np.asarray(flat, dtype=np.float64).reshape(table.num_rows, -1))


def _assign(centres: dict, radius: float, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            labels, dims = batch.column("label").to_pylist(), batch.column("dim").to_pylist()
            flat = batch.column("embedding")
            bounds = np.concatenate([[0], np.cumsum(dims)])
            values = np.asarray(flat.flatten(), dtype=np.float64)
            cells: list = [[0]] * batch.num_rows
            groups: dict = {}
            for i, key in enumerate(zip(labels, dims, strict=True)):
                if key in centres:
                    groups.setdefault(key, []).append(i)
            for key, rows in groups.items():
                own = unit(np.stack([values[bounds[i]:bounds[i + 1]] for i in rows]))
                for i, c in zip(rows, cells_of(own, centres[key], radius, overlap), strict=True):
                    cells[i] = c
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))],
                                             names=[*batch.schema.names, "cells"])
    return run


def _built(table: pa.Table) -> pa.Table:
    node = table.column("node").to_numpy()
    lists = build(_matrix(table))
    return pa.table({"node": table.column("node"), "near": pa.array([node[x] for x in lists], pa.list_(pa.int64()))})


def _searched(least: float):
    def run(table: pa.Table) -> pa.Table:
        i, j, cell = (table.column(c)[0].as_py() for c in ("i", "j", "cell"))
        node, copies, block = (table.column(c).to_numpy() for c in ("node", "copies", "block"))
        cells = [set(c) for c in table.column("cells").to_pylist()]
        at = {int(x): k for k, x in enumerate(node)}
        lists = [np.array([at[x] for x in near if x in at], np.int64) for near in table.column("near").to_pylist()]
        u = _matrix(table)
        root, count = np.arange(len(node)), np.zeros(len(node), np.int64)
        many = any(len(c) > 1 for c in cells)
        for q, hit in range_search(u, lists, np.arange(len(node)), least):
            if i != j:  # pairs within a block are met in that block's own task
                hit = hit[block[hit] != block[q]]
            if many:  # of the shards that two vectors share, the least counts their link
                hit = hit[[min(cells[q] & cells[y]) == cell for y in hit]] if len(hit) else hit
            count[q] = copies[hit].sum()
            for y in np.unique(root[hit]):
                if y != root[q]:
                    root[root == y] = root[q]
        return pa.table({"node": table.column("node"), "links": pa.array(count), "root": pa.array(node[root], pa.int64())})
    return run


def _fit(classes: DataFrame, sample: int, radius: float) -> dict:
    """Centroids by (label, dimension) of every label that needs more than one shard; what is collected is the sample."""
    n = classes.count()
    share = min(1.0, sample / max(1, n))
    rows = classes.where(F.pmod(F.xxhash64("key", "label"), F.lit(1_000_003)) < F.lit(int(1_000_003 * share) + 1)) \
        .select("label", "dim", "key", "embedding").orderBy("label", "dim", "key").toPandas()
    out = {}
    for (label, dim), own in rows.groupby(["label", "dim"]):
        k = min(round(len(own) / share / TARGET), len(own) // 8)
        if k > 1:
            out[label, dim] = centroids(unit(np.stack(own["embedding"].to_numpy())), k)
    return out


def _blocks(members: DataFrame, *keys: str) -> DataFrame:
    """Members of shards over the limit in every pair of blocks that theirs belongs to; smaller shards are one block."""
    size = written(members.groupBy(*keys).agg(F.count("*").alias("m")), "sizes")
    parts = F.when(F.col("m") <= LIMIT, 1).otherwise(F.ceil(F.col("m") / (LIMIT // 2))).cast("int")
    return (members.join(size, [*keys]).withColumn("block", F.pmod(F.xxhash64("node"), parts).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
            .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "m"))


def _audit(classes: DataFrame, counted: DataFrame, least: float, sample: int) -> float:
    """Share of the true links of about ``sample`` vectors that were counted: they are compared with all vectors."""
    n = classes.count()
    probes = classes.where(F.pmod(F.xxhash64("key"), F.lit(1_000_003)) < F.lit(1 + int(1_000_003 * sample / max(1, n)))) \
        .select("node", "label", "dim", "embedding").toPandas()
    groups = {key: (g["node"].to_numpy(), unit(np.stack(g["embedding"].to_numpy()))) for key, g in probes.groupby(["label", "dim"])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            keys = list(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist(), strict=True))
            table = pa.Table.from_batches([batch])
            for key in set(keys) & groups.keys():
                own = table.take(pa.array([i for i, k in enumerate(keys) if k == key]))
                ids, u = groups[key]
                near = (u @ _matrix(own).T >= least) & (ids[:, None] != own.column("node").to_numpy()[None])
                for x, v in zip(ids.tolist(), near @ own.column("copies").to_numpy(), strict=True):
                    total[x] = total.get(x, 0) + int(v)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["node", "v"])

    truth = classes.select("node", "label", "dim", "embedding", "copies").mapInArrow(run, "node bigint, v bigint") \
        .groupBy("node").agg(F.sum("v").alias("v"))
    row = truth.join(counted, "node", "left").agg(F.sum("v").alias("v"), F.sum(F.coalesce("links", F.lit(0))).alias("l")).first()
    return 1.0 if not row["v"] else row["l"] / row["v"]


def near_vectors(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label", overlap: int = 3, sample: int = SAMPLE, audit: int = AUDIT) -> DataFrame:
    """Links and components of vectors with equal labels and a cosine of at least ``least`` (double precision).

    Returns one row per input row: ``vec_id, n_links, component_id, kept``.

    1. Equal vectors of a label are one node with a number of copies. Centroids are fitted on a bounded sample; every
       vector goes to its nearest cell and to further ones that can hold a link of it, ``overlap`` at most at first.
    2. Every shard builds a flat graph: nearest candidates, pruned robustly, and a few far ones. The adjacency lists of a
       vector are united over its shards. A shard of more than 16,384 vectors is worked on in pairs of blocks.
    3. Every vector is searched in its shards: greedily from the medoid and its own place, then outwards through all that
       is in range. A link is counted in the least shard that both ends share, so no pair leaves a task; what leaves
       is a count and a local root per vector.
    4. The links of about ``audit`` vectors are counted by comparing them with all vectors. Below a recall of 0.99 the
       search is repeated with twice the overlap, until all cells overlap.

    Null labels, null or zero vectors and vectors with null or non-finite components link with nothing and are their own
    component; so are vectors of another dimension to each other. Repeated rows are links of each other. Rows with a null
    id take part; a component of only null ids has a null id and its rows are kept. Further columns are ignored.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    base = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    usable = F.coalesce(F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    base = base.withColumn("key", F.when(usable, F.md5(F.concat_ws(",", F.transform("embedding", lambda x: (x + 0.0).cast("string"))).cast("binary"))))
    classes = written(base.where("key IS NOT NULL").groupBy("label", "key").agg(
        F.first("embedding").alias("embedding"), F.min("vec_id").alias("least"), F.count("*").alias("copies"))
        .withColumn("dim", F.size("embedding")).withColumn("node", F.monotonically_increasing_id()), "classes")

    radius = (2 - 2 * least) ** 0.5
    centres = _fit(classes, sample, radius)
    most = max([1, *(len(c) for c in centres.values())])
    label = classes.schema["label"].dataType.simpleString()
    while True:
        placed = classes.select("node", "label", "dim", "embedding", "copies").mapInArrow(
            _assign(centres, radius, min(overlap, most)),
            f"node bigint, label {label}, dim int, embedding array<double>, copies bigint, cells array<int>")
        members = placed.withColumn("cell", F.explode("cells"))
        blocks = written(_blocks(members, "label", "dim", "cell"), "shards")
        task = ("label", "dim", "cell", "i", "j")
        graph = written(blocks.select(*task, "node", "embedding").groupBy(*task).applyInArrow(_built, "node bigint, near array<bigint>")
                        .groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")
        found = written(blocks.join(graph, "node").groupBy(*task).applyInArrow(_searched(least), "node bigint, links bigint, root bigint"), "found")
        counted = written(found.groupBy("node").agg(F.sum("links").alias("links")), "counted")
        if overlap >= most or _audit(classes, counted, least, audit) >= RECALL:
            break
        overlap *= 2

    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = written(classes.select("node", "least").join(joined, "node", "left")
                    .withColumn("component", F.coalesce("component", "node")), "named")
    ids = written(named.groupBy("component").agg(F.min("least").alias("component_id")), "ids")
    answer = written(classes.select("node", "label", "key", "copies").join(counted, "node", "left")
                     .join(named.select("node", "component"), "node").join(ids, "component")
                     .select("label", "key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "answer")
    return (base.select("vec_id", "label", "key").join(answer, ["label", "key"], "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                    F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
