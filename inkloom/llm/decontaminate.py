"""Benchmark decontamination: an FM-index per training shard, searched backwards for the windows of the test items."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fmindex import FMIndex
from .store import schema_of, slices, written
from .words import ALNUM, batch_words, text_bytes, word_spans

WINDOW = 13
BLOCK_CHARS = 16 << 20  # test text carried by one pass over the corpus
CHUNK = 1 << 20  # symbols of one index
ADDED = "n_words bigint, spans array<struct<first:bigint,last:bigint>>, items array<string>"


@dataclass
class Phrases:
    """The distinct windows of a block of test items as symbols, and the items of each."""

    vocabulary: np.ndarray  # sorted word hashes; symbol = place + 1
    seen: np.ndarray  # by the top 20 bits of a hash, whether the vocabulary has such a word
    symbols: np.ndarray  # right-aligned
    lengths: np.ndarray
    items: list[list[str]]


def phrases_of(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> Phrases:
    """All windows of ``window`` consecutive words; an item of fewer words, but not none, is one window."""
    hashes, _, _, rows = batch_words(pa.array([t for _, t in items], pa.string()), ALNUM)
    vocabulary, symbols = np.unique(hashes, return_inverse=True)
    found: dict[bytes, set] = {}
    for i, (item, _) in enumerate(items):
        own = (symbols[rows[i]:rows[i + 1]] + 1).astype(np.int64)
        for at in range(max(1, len(own) - window + 1) if len(own) else 0):
            found.setdefault(own[at:at + window].tobytes(), set()).add(item)
    windows = [np.frombuffer(w, np.int64) for w in found]
    width = max(map(len, windows), default=1)
    table = np.zeros((len(windows), width), np.int64)
    for i, w in enumerate(windows):
        table[i, width - len(w):] = w
    seen = np.zeros(1 << 20, bool)
    seen[(vocabulary >> np.uint64(44)).astype(np.int64)] = True
    return Phrases(vocabulary, seen, table, np.array([len(w) for w in windows], np.int64),
                   [sorted(x for x in s if x is not None) for s in found.values()])


def _segments(hashes: np.ndarray, rows: np.ndarray, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and word places of every run of test words that is long enough to hold a window, each run closed by 0.

    A window holds test words only and lies within one row, so nothing that can match is left out.
    """
    known = np.flatnonzero(p.seen[(hashes >> np.uint64(44)).astype(np.int64)])
    at = np.searchsorted(p.vocabulary, hashes[known])
    same = p.vocabulary[np.minimum(at, len(p.vocabulary) - 1)] == hashes[known]
    known, symbol = known[same], at[same] + 1
    if not len(known):
        return known, known
    new_row = np.zeros(len(hashes) + 1, bool)
    new_row[rows] = True
    start = np.concatenate([[True], (np.diff(known) > 1) | new_row[known[1:]]])
    run = np.cumsum(start) - 1
    long = (np.bincount(run) >= p.lengths.min())[run]
    known, symbol, start = known[long], symbol[long], start[long]
    if not len(known):
        return known, known
    ends = np.append(np.flatnonzero(start)[1:], len(known))
    return np.insert(symbol, ends, 0), np.insert(known, ends, -1)


def _occurrences(symbols: np.ndarray, places: np.ndarray, p: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(phrase, word place) of all occurrences, index by index. Neighbouring indexes overlap by a window less one."""
    overlap = p.symbols.shape[1] - 1
    for at in range(0, max(1, len(symbols) - overlap), CHUNK):
        part, own = symbols[at:at + CHUNK + overlap], places[at:at + CHUNK + overlap]
        if part[-1] != 0:
            part, own = np.append(part, 0), np.append(own, -1)
        index = FMIndex(part, len(p.vocabulary) + 1)
        low, high = index.search(p.symbols, p.lengths)
        count = high - low
        phrase = np.repeat(np.arange(len(count)), count)
        rows = np.arange(len(phrase)) - np.repeat(np.cumsum(count) - count, count) + low[phrase]
        yield phrase, own[index.locate(rows)]


def _spans(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], covered.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _scan(p: Phrases, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            hashes, _, _, rows = batch_words(batch.column(1), ALNUM)
            delta, met = np.zeros(len(hashes) + 1, np.int32), [set() for _ in range(batch.num_rows)]
            symbols, places = _segments(hashes, rows, p) if len(p.lengths) else (hashes[:0], hashes[:0])
            if len(symbols):
                for phrase, place in _occurrences(symbols, places, p):
                    np.add.at(delta, place, 1)
                    np.add.at(delta, place + p.lengths[phrase], -1)
                    owner = np.searchsorted(rows, place, side="right") - 1
                    for row, ph in set(zip(owner.tolist(), phrase.tolist(), strict=True)):
                        met[row].update(p.items[ph])
            covered = np.cumsum(delta[:-1]) > 0
            if not first:  # what earlier blocks of items have found
                for row, spans in enumerate(batch.column(3).to_pylist()):
                    met[row].update(batch.column(4)[row].as_py())
                    for s in spans:
                        covered[rows[row] + s["first"]:rows[row] + s["last"] + 1] = True
            spans = []
            busy = {int(x) for x in np.searchsorted(rows, np.flatnonzero(covered), side="right") - 1}
            for row in range(batch.num_rows):
                lo, hi = _spans(covered[rows[row]:rows[row + 1]]) if row in busy else ((), ())
                spans.append([{"first": int(a), "last": int(b) - 1} for a, b in zip(lo, hi, strict=True)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(rows), pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                 pa.array([sorted(m) for m in met], pa.list_(pa.string()))],
                names=["doc_id", "text", "n_words", "spans", "items"])
    return run


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Where windows of test items occur in documents: ``doc_id, text, n_words, spans, items`` per input row.

    ``spans`` are the merged removal spans (first and last word, counted from 0), ``items`` the ids (as strings,
    sorted) of the test items with an occurring window. Words are runs of ASCII letters and digits and non-ASCII
    characters, A-Z lowered. No shuffle: each task indexes its own rows in slices of about 8 MB of text, a longer text
    in overlapping indexes of a million symbols, so memory does not grow with a document or a group of copies.
    The alphabet of an index is the vocabulary of the test items; other words can be in no window and end a segment.
    Test items travel in blocks of at most about 16 MB of text, one pass over the corpus per block; the result is
    written between blocks, so driver and tasks hold the windows of one block.

    Null and empty texts have no words, no spans and no items. Empty item texts have no windows. Items with a null id
    mark spans but are not listed. Repeated rows are judged alike, repeated items count once. Further columns are
    ignored, so their names may clash.
    """
    schema = schema_of(docs, id_col, f"text string, {ADDED}")
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tests = items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text"))
    chars = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS) or 1
    for b in range(blocks):
        own = tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b) if blocks > 1 else tests
        phrases = phrases_of([(r["item"], r["text"]) for r in own.toLocalIterator()], window)
        out = out.mapInArrow(_scan(phrases, b == 0), schema)
        if b < blocks - 1:  # so that no plan holds the windows of two blocks
            out = written(out, "block")
    return out


def contamination(docs: DataFrame, items: DataFrame, share: int = 20, **columns) -> DataFrame:
    """``find_contamination`` with its verdict: n_hit words in spans, n_items, the digest of the item ids, and
    contaminated, true where words are hit and ``share`` * n_hit >= n_words."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"] + 1)
    return (find_contamination(docs, items, **columns).withColumn("n_hit", hit)
            .withColumn("n_items", F.size("items").cast("bigint"))
            .withColumn("items_sha256", F.sha2(F.concat_ws(",", "items").cast("binary"), 256))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))))


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of its removal spans (and what lies between them)."""
    raw, bounds = text_bytes(pa.array([text]))
    starts, ends, _ = word_spans(raw, bounds, ALNUM)
    data, out, at = raw.tobytes(), [], 0
    for a, b in spans:
        out.append(data[at:starts[a]])
        at = int(ends[b])
    return b"".join([*out, data[at:]]).decode()
