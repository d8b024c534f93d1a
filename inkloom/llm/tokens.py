"""Token counts by section: whole documents are encoded once, token spans are joined to section spans."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import schema_of, slices
from .words import text_bytes

# The split pattern of the byte-level vocabulary, and the characters that are white space to it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2000,}")
SLICE_BYTES = 2 << 20
RULES = ("most", "start", "end")
COUNTS = "section int, start bigint, stop bigint, n_tokens bigint, n_crossing bigint"


@lru_cache(maxsize=2)
def _encoding(vocabulary: bytes, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def encode(encoding: tiktoken.Encoding, text: str) -> list[int]:
    """The tokens of a whole text. The splitter overflows on very long white space; such a run is one piece of its own,
    but for its last character where text follows, exactly as the pattern splits it."""
    out, at = [], 0
    for run in _LONG_SPACE.finditer(text):
        stop = run.end() - (run.end() < len(text))
        out += encoding.encode_ordinary(text[at:run.start()])
        out += encoding._encode_single_piece(text[run.start():stop])
        at = stop
    return out + encoding.encode_ordinary(text[at:])


def _lines(raw: np.ndarray) -> np.ndarray:
    """Byte bounds of the lines of a text; a line keeps its line feed."""
    cuts = np.flatnonzero(raw == 10) + 1
    return np.concatenate([[0], cuts, [len(raw)]] if not len(cuts) or cuts[-1] != len(raw) else [[0], cuts])


def allocate(token_ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token and whether it crosses a bound; tokens and sections both tile the text.

    ``most``: the section with most of the token's bytes, the earliest of equals. ``start`` / ``end``: the section of the
    first or last byte.
    """
    starts = np.concatenate([[0], token_ends])[:-1]
    first = np.searchsorted(bounds, starts, side="right") - 1
    last = np.searchsorted(bounds, token_ends, side="left") - 1
    if rule == "end":
        return last, first != last
    if rule == "most":
        chosen = first.copy()
        for t in np.flatnonzero(first != last):
            inner = bounds[first[t]:last[t] + 2].clip(starts[t], token_ends[t])
            chosen[t] = first[t] + int(np.argmax(np.diff(inner)))
        return chosen, first != last
    return first, first != last


def _count(vocabulary, pattern: str, rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = _encoding(vocabulary.value, pattern)
        for batch in slices(batches, 1, SLICE_BYTES):
            raw, rows = text_bytes(batch.column(1))
            given = batch.column(2).to_pylist()
            parts: list[list[np.ndarray]] = [[] for _ in range(5)]
            sections = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = raw[rows[i]:rows[i + 1]]
                chars = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])  # code points before each byte
                if given[i] is None:
                    bounds = _lines(own)
                else:
                    bounds = np.searchsorted(chars, np.concatenate([[0], np.cumsum(given[i], dtype=np.int64)]), side="left")
                    bounds[-1] = len(own)
                ends = np.cumsum(lengths[np.array(encode(encoding, text or ""), np.int64)])
                chosen, crossing = allocate(ends, bounds, rule)
                n = len(bounds) - 1
                sections.append(n)
                for part, values in zip(parts, (np.arange(n), chars[bounds[:-1]], chars[bounds[1:]],
                                                np.bincount(chosen, minlength=n),
                                                np.bincount(chosen, weights=crossing, minlength=n)), strict=True):
                    part.append(values)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), sections)))
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array(np.concatenate(p).astype(np.int64)).cast(t) for p, t in zip(parts, types, strict=True))],
                names=["doc_id", "section", "start", "stop", "n_tokens", "n_crossing"])
    return run


def joined_fields(fields: Sequence[str], separator: str = "\n") -> tuple[Column, Column]:
    """Fields put together as one document: its text, and the lengths of its sections (a field keeps the separator after
    it; null fields are empty). Use both columns with ``section_tokens``."""
    texts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    texts = [F.concat(t, F.lit(separator)) for t in texts[:-1]] + texts[-1:]
    return F.concat(*texts), F.array(*(F.length(t) for t in texts))


def section_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: Column | str = "text",
                   lengths: Column | None = None, rule: str = "most", pattern: str = PATTERN) -> DataFrame:
    """Tokens of each section of each document: ``doc_id, section, start, stop, n_tokens, n_crossing``.

    ``vocabulary`` is the path of a byte-level rank file; the driver reads it and ships its bytes (it is as large as a
    vocabulary). ``lengths`` gives the lengths of the sections in code points, in order, covering the text; without it
    every line with its line feed is a section. A whole text is encoded once. Tokens and sections are then joined by
    their spans with two binary searches per document. A token that crosses bounds goes to one section by ``rule`` (see
    ``allocate``) and counts in n_crossing there, so a document's sections always add up to its tokens.

    No shuffle; a task holds 2 MB of text or one longer text. A null or empty text has one empty section without tokens.
    Repeated rows and null ids are kept. Further columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    with open(vocabulary, "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())
    source = docs.select(F.col(id_col).alias("doc_id"), (F.col(text) if isinstance(text, str) else text).cast("string").alias("text"),
                         (F.lit(None) if lengths is None else lengths).cast("array<bigint>").alias("lengths"))
    return source.mapInArrow(_count(shipped, pattern, rule), schema_of(docs, id_col, COUNTS))
