"""Near-duplicate texts by min-max hashing: both extremes of every permutation are kept and banded."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graphs import components
from .store import schema_of, slices, written
from .words import SOLID, batch_words, mix

BLOCK = 512  # members of a bucket compared at a time
BLOCK_SHINGLES = 1 << 20  # and their shingles, but for one longer text
COLUMNS = 4096  # shingles per matrix product
ROWS = 4  # signature values per band: two minima and two maxima of the same two permutations


def _multipliers(n: int, seed: int = 17) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(seed)) | np.uint64(1)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; a shorter, non-empty sequence is one shingle."""
    if not len(words):
        return words
    m = max(1, len(words) - k + 1)
    total = np.full(m, np.uint64(min(k, len(words))))
    for i, factor in enumerate(_multipliers(min(k, len(words)), 29)):
        total = total + words[i:i + m] * factor
    return np.unique(mix(total))


def signature(shingles: np.ndarray, permutations: int) -> np.ndarray:
    """Minima of all permutations, then their maxima. Long sets are folded in chunks, so memory stays bounded."""
    factors, low, high = _multipliers(permutations), None, None
    for at in range(0, len(shingles), 4096):
        y = ((shingles[at:at + 4096, None] * factors) >> np.uint64(32)).astype(np.uint32)
        low = y.min(0) if low is None else np.minimum(low, y.min(0))
        high = y.max(0) if high is None else np.maximum(high, y.max(0))
    return np.concatenate([low, high])


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of two permutations, mixed with the band's number."""
    p = len(sig) // 2
    wide = sig.astype(np.uint64)
    low, high = wide[:p] << np.uint64(32) | wide[p:], np.arange(p // 2, dtype=np.uint64)
    return mix(mix(low[0::2] + high) + low[1::2])


def _sign(k: int, permutations: int, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_at):
            words, _, _, rows = batch_words(batch.column(text_at), SOLID)
            nodes, sizes, keys, sketches = [], [], [], []
            for i in range(batch.num_rows):
                s = shingle_hashes(words[rows[i]:rows[i + 1]], k)
                sizes.append(len(s))
                if not len(s):
                    nodes.append(None), keys.append(None), sketches.append(None)
                    continue
                nodes.append(f"{int(s.sum(dtype=np.uint64)):016x}{int(mix(s ^ np.uint64(len(s))).sum(dtype=np.uint64)):016x}")
                sig = signature(s, permutations)
                keys.append(band_keys(sig).view(np.int64))
                sketches.append((sig & np.uint32(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(nodes, pa.string()), pa.array(sizes, pa.int64()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                names=[*batch.schema.names, "digest", "n", "bands", "sketch"])
    return run


def _likely(threshold: float, permutations: int) -> float:
    """Share of equal signature values below which a pair is out of reach: five standard deviations under the bound."""
    return threshold - 5 * (threshold * (1 - threshold) / (2 * permutations)) ** 0.5


def _screen(threshold: float, permutations: int):
    """Of candidate pairs with sketches, those whose sketches can belong to the threshold."""
    least = _likely(threshold, permutations)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                        for c in ("sa", "sb"))
                yield batch.select(["a", "b"]).filter(pa.array((a == b).mean(1) >= least))
    return run


def _shared(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, as products of 0/1 matrices over a few thousand shingles at a time."""
    values, places = np.unique(np.concatenate([*sets, *others]), return_inverse=True)
    rows = np.repeat(np.arange(len(sets) + len(others)), [len(s) for s in [*sets, *others]])
    order = np.argsort(places, kind="stable")
    rows, places, out = rows[order], places[order], np.zeros((len(sets), len(others)))
    for at in range(0, len(values), COLUMNS):
        lo, hi = np.searchsorted(places, [at, at + COLUMNS])
        part = np.zeros((len(sets) + len(others), min(COLUMNS, len(values) - at)), np.float32)
        part[rows[lo:hi], places[lo:hi] - at] = 1
        out += part[:len(sets)] @ part[len(sets):].T
    return out


def _candidates(table: pa.Table, percent: int, permutations: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the left and the right block of a task, which of their pairs can be links, and the components. A pair can be one
    if its components differ, sizes and sketches allow it, and no earlier band puts it into a bucket as well."""
    i, j, band = (table.column(c)[0].as_py() for c in ("i", "j", "band"))
    least = _likely(percent / 100, permutations)
    comp = np.unique(table.column("component").to_numpy(), return_inverse=True)[1]
    n, block = table.column("n").to_numpy(), table.column("block").to_numpy()
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(table.num_rows, -1)
    bands = np.array(table.column("bands").to_pylist(), np.int64)[:, :band]
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    can = np.zeros((len(left), len(right)), bool)
    for row, x in enumerate(left):
        can[row] = ((comp[right] != comp[x]) & (np.minimum(n[right], n[x]) * 100 >= np.maximum(n[right], n[x]) * percent)
                    & ((sketch[right] == sketch[x]).mean(1) >= least) & ~(bands[right] == bands[x]).any(1))
    return left, right, can, comp


def _needed(percent: int, permutations: int):
    """The members of a task that have a candidate in it."""
    def run(table: pa.Table) -> pa.Table:
        left, right, can, _ = _candidates(table, percent, permutations)
        rows = np.unique(np.concatenate([left[can.any(1)], right[can.any(0)]]))
        return table.take(pa.array(rows, pa.int64()))
    return run


def _across(k: int, percent: int, permutations: int):
    """Links of one pair of blocks of a bucket that join different components: full sets decide the candidates, and of the
    links found only those that merge components are returned."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        node, n = table.column("node").to_numpy(), table.column("n").to_numpy()
        left, right, can, comp = _candidates(table, percent, permutations)
        words, _, _, rows = batch_words(table.column("text").combine_chunks(), SOLID)
        sets = [shingle_hashes(words[rows[x]:rows[x + 1]], k) for x in range(len(node))]
        both = _shared([sets[x] for x in left], [sets[x] for x in right])
        linked = can & (100 * both >= percent * (n[left][:, None] + n[right] - both))
        out: tuple[list, list] = [], []
        for row, x in enumerate(left):
            for y in right[linked[row]]:
                if comp[x] != comp[y]:
                    comp[comp == comp[y]] = comp[x]
                    out[0].append(node[x])
                    out[1].append(node[y])
        return pa.table([pa.array(o, pa.int64()) for o in out], schema=schema)
    return run


def _confirm(k: int, numerator: int, denominator: int):
    """Of pairs with both texts, those with denominator * intersection >= numerator * union of their full sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            (wa, _, _, ra), (wb, _, _, rb) = (batch_words(batch.column(c), SOLID) for c in ("ta", "tb"))
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = shingle_hashes(wa[ra[i]:ra[i + 1]], k), shingle_hashes(wb[rb[i]:rb[i + 1]], k)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = denominator * both >= numerator * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(ok))
    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 85,
                    permutations: int = 48, with_text: bool = False) -> DataFrame:
    """Classes of documents whose sets of k-word shingles have a Jaccard similarity of at least ``percent`` / 100.

    Returns one row per input row: ``doc_id, n_shingles, component_id, kept, chosen``; component_id is the least id
    reachable over links, kept says whether the row has that id, chosen is true for exactly one row of each class.
    ``with_text`` adds the text.

    1. One pass computes the set of every whole text, its 128-bit key, and a min-max signature: the minimum and the
       maximum under each of ``permutations`` multiplicative permutations, banded two permutations (four values) at a
       time. With 48 permutations a pair at 0.85 shares no band with a probability of 2e-8; closer pairs with less.
    2. Rows with equal sets become one node. Every bucket links its members to its least node (a star), so a bucket of m
       members gives m - 1 candidates. Size ratio and sketches screen them, full sets confirm them.
    3. Where a bucket still spans several components, its members are compared across components in pairs of blocks of
       512 members or a million shingles. Sketches screen first, each pair in the first bucket that it shares; only members
       with a candidate are joined to their texts. Full sets confirm by products of 0/1 matrices, and only links that merge
       components leave the task: no pair of a shared bucket is left out, none is emitted for its own sake, and no group is
       held by one task.

    Null, empty and white-space texts have no shingles and link with nothing; such rows are their own component.
    Repeated rows fall into one class and all carry the class's id (kept is true for each of them if they are the
    least, chosen for one). Rows with a null id take part and come after all others; a class of only null ids has a null
    component and is kept. Words split on the six ASCII white-space characters and A-Z are lowered. Further columns are
    ignored.
    """
    spark, threshold = docs.sparkSession, percent / 100
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = written(source.mapInArrow(_sign(k, permutations, 1), schema_of(
        docs, id_col, "text string, digest string, n bigint, bands array<bigint>, sketch binary"))
        .withColumn("row", F.monotonically_increasing_id()), "signed")

    first_row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    nodes = written(signed.where("n > 0").groupBy("digest").agg(
        F.min(first_row).alias("least"), F.max("n").alias("n"), F.first("bands").alias("bands"),
        F.first("sketch").alias("sketch")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    spread = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    full = written(spread.groupBy("key").agg(F.count("*").alias("m"), F.min("node").alias("centre")).where("m > 1"),
                   "full")
    buckets = written(spread.join(full, "key"), "buckets")
    facts = nodes.select("node", "n", "sketch")

    def screened(pairs: DataFrame) -> DataFrame:
        met = (pairs.join(facts.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
               .join(facts.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
               .where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent))
        return met.select("a", "b", "sa", "sb").mapInArrow(_screen(threshold, permutations), "a bigint, b bigint")

    met = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", F.col("least.row").alias("row"))
    texts = written(signed.select("row", "text").join(met, "row").select("node", "text"), "texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        with_text = (pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
                     .join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a"))
        return with_text.select("a", "b", "ta", "tb").mapInArrow(_confirm(k, percent, 100), "a bigint, b bigint")

    stars = written(screened(buckets.where("node > centre").select(F.col("centre").alias("a"), F.col("node").alias("b"))
                             .distinct()), "stars")
    links = written(confirmed(stars), "confirmed")
    first = written(components(links), "components")

    placed = written(buckets.where("m > 2").join(first, "node", "left")
                     .join(nodes.select("node", "n"), "node")
                     .select("key", "band", "node", "m", "n", F.coalesce("component", "node").alias("component")), "placed")
    mixed = written(placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                              F.sum("n").alias("total")).where("lo < hi").select("key", "total"), "mixed")
    parts = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    blocks = (placed.join(mixed, "key").join(nodes.select("node", "sketch", "bands"), "node")
              .withColumn("block", F.pmod(F.xxhash64("node"), parts).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
              .select("key", "node", "component", "n", "sketch", "bands", "band", "block",
                      F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")))
    needed = written(blocks.groupBy("key", "i", "j").applyInArrow(_needed(percent, permutations), blocks.schema), "needed")
    more = (needed.join(texts, "node").groupBy("key", "i", "j")
            .applyInArrow(_across(k, percent, permutations), "a bigint, b bigint"))
    joined = written(more.union(first.select(F.col("component").alias("a"), F.col("node").alias("b"))), "joined")
    final = components(joined)

    # Tables joined on a key that one group may fill are written first: plain exchanges on both sides can be split.
    named = written(final.join(nodes.select("node", "least"), "node"), "named")
    ids = written(named.groupBy("component").agg(F.min("least").alias("best")), "ids")
    named = named.select("node", "component").join(ids, "component").select("node", "best")
    answer = written(nodes.select("node", "digest", "least").join(named, "node", "left")
                     .select("digest", F.coalesce("best", "least").alias("best")), "answer")
    alone = F.col("digest").isNull()
    return (signed.select("doc_id", F.col("n").alias("n_shingles"), "digest", "row", *(["text"] if with_text else []))
            .join(answer, "digest", "left")
            .withColumn("component_id", F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
            .withColumn("chosen", alone | (F.col("row") == F.col("best.row")))
            .drop("digest", "row", "best"))
