"""Patterns on whole texts: leftmost non-overlapping matches in linear time, and their span lists."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .store import slices

SPAN = "array<struct<kind:string,start:int,stop:int,score:double,base:boolean>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()),
                             ("score", pa.float64()), ("base", pa.bool_())]))


def matches(pattern: str, flags: int = 0) -> Callable[[str], Iterator[tuple[int, int, re.Match]]]:
    """A finder of the pattern's matches as (start, stop, match)."""
    compiled = re.compile(pattern, flags)
    return lambda text: ((m.start(), m.end(), m) for m in compiled.finditer(text))


def text_scan(find: Callable[..., list[tuple]], text_at: int, with_next: bool = False):
    """A mapInArrow body that appends the span list which ``find`` gives for each text (null: empty). With
    ``with_next``, the column after the text is passed along too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_at):
            texts = (t or "" for t in batch.column(text_at).to_pylist())
            rows = (zip(texts, batch.column(text_at + 1).to_pylist(), strict=True) if with_next else ((t,) for t in texts))
            found = [[dict(zip(("kind", "start", "stop", "score", "base"), s, strict=True)) for s in find(*row)] for row in rows]
            keep = [i for i in range(batch.num_columns) if i != text_at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(found, _ARROW)],
                                             names=[*(batch.schema.names[i] for i in keep), "spans"])
    return run


def count_kind(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("bigint")


def listed(spans: Column) -> Column:
    """kind:start:stop, comma-joined in the order of the list."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])))


def base_digest(spans: str) -> Column:
    return F.sha2(listed(F.filter(spans, lambda s: s["base"])).cast("binary"), 256)


def by_place(spans: Iterable[tuple], kinds: tuple[str, ...]) -> list[tuple]:
    """Spans by start, then by the listed order of their kinds."""
    return sorted(spans, key=lambda s: (s[1], kinds.index(s[0])))


def redact(text: str, spans: Iterable[dict]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, at, stop, kind = [], 0, -1, ""
    for s in sorted(spans, key=lambda s: s["start"]):
        if s["start"] < stop:
            stop = max(stop, s["stop"])
            continue
        if stop >= 0:
            out.append(f"[{kind}]")
            at = stop
        out.append(text[at:s["start"]])
        stop, kind = s["stop"], s["kind"]
    if stop >= 0:
        out.append(f"[{kind}]")
        at = stop
    return "".join([*out, text[at:]])
