"""Exact substring dedup: suffixes of all texts are dealt out by sampled k-grams and sorted deep-shallow in bounded tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import schema_of, slices, written
from .suffixsort import sort_strings
from .words import mix, text_bytes

LENGTH = 400  # bytes of a repeated string
KGRAM = 64  # bytes of the sampled strings by which suffixes are dealt out
PIECE = 1 << 21  # bytes sampled at a time
BUCKET = 4 << 20  # bytes of stretches sorted at a time
LIMIT = 2048  # stretches of a k-gram that are sorted together; larger groups are split by longer strings
SPLIT = 4  # parts that the places of such a k-gram are split into
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 24) - 1)
STRETCH = "key bigint, d1 bigint, d2 bigint, n1 bigint, n2 bigint, start int, shape int"
SUFFIXES = "bucket int, key bigint, d1 bigint, d2 bigint, n bigint, shape int, body binary"
RUNS = "d1 bigint, d2 bigint, runs array<struct<lo:int,hi:int>>"


def _sampled(raw: np.ndarray, bounds: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of starts of ``length`` bytes that share their least k-gram (by hash, the first of equals): first start, number of starts,
    place of the k-gram, its hash. Equal strings have their k-gram at the same place inside, wherever they stand."""
    n, none = len(raw), np.empty(0, np.int64)
    if n < length:
        return none, none, none, none.view(np.uint64)
    values = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
    power = np.full(n + 1, _ODD)
    back = np.full(n + 1, np.uint64(pow(int(_ODD), -1, 1 << 64)))
    power[0] = back[0] = 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values[raw] * np.multiply.accumulate(power)[:n], out=sums[1:])
    hashes = mix((sums[k:] - sums[:-k]) * np.multiply.accumulate(back)[:n - k + 1])
    ranked = hashes & ~_LOW | np.arange(len(hashes), dtype=np.uint64)
    w = length - k + 1
    table = np.concatenate([ranked, np.full(-len(ranked) % w, ~np.uint64(0))]).reshape(-1, w)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.arange(n - length + 1)
    least = (np.minimum(behind[starts], ahead[starts + w - 1]) & _LOW).astype(np.int64)
    inside = np.zeros(n + 1, np.int64)
    long = np.flatnonzero(np.diff(bounds) >= length)
    np.add.at(inside, bounds[long], 1)
    np.add.at(inside, bounds[long + 1] - length + 1, -1)
    valid = np.cumsum(inside)[:len(starts)] > 0
    fresh = valid.copy()
    fresh[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    first = np.flatnonzero(fresh)
    number = np.cumsum(fresh) - 1
    count = np.bincount(number[valid], minlength=len(first))
    return first, count, least[first], hashes[least[first]]


def _digest(*parts: bytes) -> tuple[int, int]:
    h = hashlib.blake2b(digest_size=16)
    for p in parts:
        h.update(p)
    whole = h.digest()
    return int.from_bytes(whole[:8], "little", signed=True), int.from_bytes(whole[8:], "little", signed=True)


def _stretches(length: int, k: int, piece: int):
    """(k-gram hash, digest of the stretch's bytes, text, first start, shape) of all starts of a text; shape is starts * 2^16 + the place of the k-gram."""
    def pieces(raw: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if len(raw) <= piece:
            yield 0, raw, bounds
            return
        for at in range(0, len(raw) - length + 1, piece - length + 1):  # one long text: every start is in one piece
            own = raw[at:at + piece]
            yield at, own, np.array([0, len(own)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, piece):
            whole, bounds = text_bytes(batch.column(2))
            for at, raw, own in pieces(whole, bounds):
                first, count, place, hashes = _sampled(raw, own, length, k)
                row = np.searchsorted(own, first, side="right") - 1
                view = memoryview(raw.tobytes())
                digests = np.array([_digest(view[f:f + c + length - 1]) for f, c in zip(first.tolist(), count.tolist(), strict=True)],
                                   np.int64).reshape(-1, 2)
                owner = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), batch.column(0).take(owner),
                     batch.column(1).take(owner), pa.array((first - own[row] + at).astype(np.int32)), pa.array((count << 16 | place - first).astype(np.int32))],
                    names=["key", "d1", "d2", "n1", "n2", "start", "shape"])
    return run


def _bodies(length: int, size: int):
    """The stretches that a text represents, with their bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, size):
            raw, bounds = text_bytes(batch.column(0))
            raw, out = raw.tobytes(), []
            for i, wanted in enumerate(batch.column(1).to_pylist()):
                for s in wanted:
                    at = int(bounds[i]) + s["start"]
                    out.append((s["bucket"], s["key"], s["d1"], s["d2"], s["n"], s["shape"], raw[at:at + (s["shape"] >> 16) + length - 1]))
            yield _suffix_batch(out)
    return run


def _suffix_batch(rows: list[tuple], extra: tuple[str, ...] = ()) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), *[pa.int64() if e.startswith("of") else pa.int32() for e in extra]]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)],
                                      names=["bucket", "key", "d1", "d2", "n", "shape", "body", *extra])


def _sorted(length: int):
    """The starts of each stretch whose strings stand somewhere else as well: by the sorted suffixes of a bucket. A suffix is compared with
    those that have the same k-gram at the same place."""
    def run(table: pa.Table) -> pa.Table:
        body = table.column("body").combine_chunks()
        body = body.combine_chunks() if isinstance(body, pa.ChunkedArray) else body
        raw, begin = text_bytes(body.cast(pa.large_binary()).view(pa.large_string()))
        key, shape, copies = (table.column(c).to_numpy() for c in ("key", "shape", "n"))
        count, place = (shape >> 16).astype(np.int64), (shape & 0xFFFF).astype(np.int64)
        owner = np.repeat(np.arange(len(count)), count)
        inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        _, number = np.unique(key, return_inverse=True)
        group = number.ravel()[owner] * length + place[owner] - inner
        order, equal = sort_strings(raw, owner, begin[:-1][owner] + inner, group, begin[:-1], begin[1:], length)
        run_of = np.cumsum(~equal) - 1
        found = np.empty(len(order), bool)
        found[order] = np.bincount(run_of, copies[owner[order]], minlength=1)[run_of] > 1
        edge = found.copy()
        edge[1:] &= ~found[:-1] | (inner[1:] == 0)
        last = found.copy()
        last[:-1] &= ~found[1:] | (inner[1:] == 0)
        low, high = np.flatnonzero(edge), np.flatnonzero(last)
        rows = np.unique(owner[low])
        cuts = np.searchsorted(owner[low], np.append(rows, len(count)))
        runs = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays(
            [pa.array(inner[low], pa.int32()), pa.array(inner[high], pa.int32())], names=["lo", "hi"]))
        return pa.table({"d1": table.column("d1").take(pa.array(rows)), "d2": table.column("d2").take(pa.array(rows)), "runs": runs})
    return run


def _parts(length: int, k: int):
    """A stretch of a frequent k-gram, split: starts are told apart by how far before the k-gram they lie (``lo`` to ``hi``), in
    parts, and all strings of a part hold one longer string, which with the part's place becomes their key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                count, place, step = r["shape"] >> 16, r["shape"] & 0xFFFF, -(-(r["hi"] - r["lo"] + 1) // SPLIT)
                for lo in range(r["lo"], r["hi"] + 1, step):
                    hi = min(r["hi"], lo + step - 1)
                    first, last = max(0, place - hi), min(count - 1, place - lo)
                    if first > last:
                        continue
                    body = r["body"][first:last + length]
                    shared = r["body"][place - lo:place - hi + length]
                    name = b"%d:%d:%d:" % (r["key"], lo, hi)
                    out.append((0, _digest(name, shared)[0], *_digest(name, body), r["n"], (last - first + 1) << 16 | place - first, body,
                                r["d1"], r["d2"], first, lo, hi))
            yield _suffix_batch(out, ("of1", "of2", "first", "lo", "hi"))
    return run


def _grouped(classes: DataFrame) -> DataFrame:
    """Stretches with the number of different ones that have their key, without those whose key no other place has."""
    keys = written(classes.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("total")).where("total > 1").select("key", "m"), "keys")
    return classes.join(keys, "key")


def _found(suffixes: DataFrame, length: int, name: str) -> DataFrame:
    return written(suffixes.groupBy("bucket").applyInArrow(_sorted(length), RUNS), name)


def _bucket(size: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(max(1, -(-size // BUCKET)))).cast("int")


def _split(hot: DataFrame, length: int, k: int) -> DataFrame:
    """Repeated starts of stretches with frequent k-grams: parts of longer and longer common strings, until a part is small enough to be
    sorted or one string. Equal parts are one row with their number, so a frequent passage is a few rows."""
    levels, done = [], None
    while hot.take(1):
        parts = written(hot.mapInArrow(_parts(length, k), SUFFIXES + ", of1 bigint, of2 bigint, first int, lo int, hi int"), "parts")
        levels.append(parts)
        once = written(parts.groupBy("d1", "d2").agg(*(F.first(c).alias(c) for c in ("key", "shape", "body", "lo", "hi")), F.sum("n").alias("n")), "once")
        once = written(_grouped(once), "grouped")
        small = (F.col("m") <= LIMIT) | (F.col("lo") == F.col("hi"))
        size = once.where(small).agg(F.sum(F.length("body"))).first()[0] or 0
        own = _found(once.where(small).select(_bucket(size).alias("bucket"), "key", "d1", "d2", "n", "shape", "body"), length, "part_runs")
        done = own if done is None else done.unionByName(own)
        hot = once.where(~small).select("key", "d1", "d2", "n", "shape", "body", "lo", "hi")
    for parts in reversed(levels):  # what a part found is carried up to the stretches that it came from
        moved = F.transform("runs", lambda r: F.struct((r["lo"] + F.col("first")).alias("lo"), (r["hi"] + F.col("first")).alias("hi")))
        up = parts.select("d1", "d2", "of1", "of2", "first").join(done, ["d1", "d2"]).groupBy("of1", "of2").agg(
            F.flatten(F.collect_list(moved)).alias("runs"))
        done = written(done.unionByName(up.select(F.col("of1").alias("d1"), F.col("of2").alias("d2"), "runs")), "carried")
    return done


def _cut(length: int):
    """Length, maximal removed runs and remaining bytes of each text; ``runs`` holds first and last starts of repeated strings."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            raw, bounds = text_bytes(batch.column(1))
            sizes, removed, spans, kept = np.diff(bounds), [], [], []
            for i, runs in enumerate(batch.column(2).to_pylist()):
                own = raw[bounds[i]:bounds[i + 1]]
                found = []
                for s in sorted(runs or (), key=lambda s: s["lo"]):
                    stop = s["hi"] + length
                    if found and s["lo"] <= found[-1]["stop"]:
                        found[-1]["stop"] = max(found[-1]["stop"], stop)
                    else:
                        found.append({"start": s["lo"], "stop": stop})
                gone = np.zeros(len(own), bool)
                for s in found:
                    gone[s["start"]:s["stop"]] = True
                removed.append(int(gone.sum()))
                spans.append(found)
                kept.append(own[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])
    return run


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = KGRAM) -> DataFrame:
    """Texts without the bytes covered by strings of ``length`` bytes that stand somewhere else too:
    ``doc_id, n_bytes, n_removed, spans (start, stop in bytes), kept (remaining bytes)``, one row per document.

    1. Every start of ``length`` bytes belongs to its least k-gram, so equal strings meet wherever they stand; neighbouring starts with
       one k-gram are a stretch. One pass writes a narrow row per stretch (one in about 170 bytes): hash of the k-gram,
       digest of the stretch's bytes, text, place. Equal stretches are counted as one; those whose k-gram no other place has are done.
    2. The bytes of the others go, one copy of equal ones with their number, into buckets of about 4 MB by k-gram. A bucket's suffixes
       are sorted by multikey quicksort to a shallow depth and by blind tries below it; neighbours that agree on ``length`` bytes, or
       stand for several copies, are repeated.
    3. A k-gram with more than 2048 different stretches (a frequent line) is split by longer strings around it, in up to five rounds:
       most of its parts stand alone and are done, others are equal and become one, so no group is sorted by one task.
    4. Repeated starts are joined back to all copies of their stretch and gathered per text; one pass cuts the texts.

    Texts are UTF-8 bytes; strings never cross documents, all are judged on the input. A start counts anywhere else, in the same document
    too, so of equal strings none stays. Null texts are empty; texts below ``length`` bytes lose nothing; texts of any length are
    sampled in pieces. Repeated rows and null ids are documents of their own. An empty table gives no rows. Further columns are
    ignored. Equal texts are known by 120 bits of SHA-256, equal stretches by 128 bits of BLAKE2b.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.sha2(text.cast("binary"), 256)
    half = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("bigint")
    source = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), half(1).alias("n1"), half(16).alias("n2"))
    rows = written(source.select("n1", "n2", "text").mapInArrow(_stretches(length, k, PIECE), STRETCH), "stretches")
    # All columns are fixed-size, so one hash aggregation takes them from the same row.
    classes = written(rows.groupBy("d1", "d2").agg(*(F.first(c).alias(c) for c in ("key", "n1", "n2", "start", "shape")),
                                                   F.count("*").alias("n")), "classes")
    wanted = written(_grouped(classes), "wanted")
    small = F.col("m") <= LIMIT
    size = wanted.where(small).agg(F.sum(F.shiftright("shape", 16) + length)).first()[0] or 0
    stretch = F.struct(F.when(small, _bucket(size)).otherwise(-1).alias("bucket"), "key", "d1", "d2", "n", "start", "shape")
    per_text = wanted.groupBy("n1", "n2").agg(F.collect_list(stretch).alias("wanted"))
    texts = source.groupBy("n1", "n2").agg(F.first("text").alias("text"))
    bodies = texts.join(per_text, ["n1", "n2"]).select("text", "wanted").mapInArrow(_bodies(length, BUCKET), SUFFIXES)
    if wanted.where(~small).take(1):
        bodies = written(bodies, "bodies")
        hot = bodies.where("bucket < 0").select("key", "d1", "d2", "n", "shape", "body", F.lit(0).alias("lo"), F.lit(length - k).alias("hi"))
        runs = _found(bodies.where("bucket >= 0"), length, "runs").unionByName(_split(hot, length, k))
    else:
        runs = _found(bodies, length, "runs")
    spans = written(rows.select("d1", "d2", "n1", "n2", "start").join(runs, ["d1", "d2"]).select("n1", "n2", F.explode("runs").alias("r"), "start")
                    .groupBy("n1", "n2").agg(F.collect_set(F.struct((F.col("start") + F.col("r.lo")).alias("lo"),
                                                                    (F.col("start") + F.col("r.hi")).alias("hi"))).alias("runs")), "spans")
    cut = source.join(spans, ["n1", "n2"], "left").select("doc_id", "text", "runs")
    return cut.mapInArrow(_cut(length), schema_of(source, "doc_id", "n_bytes bigint, n_removed bigint, spans array<struct<start:int,stop:int>>, kept binary"))
