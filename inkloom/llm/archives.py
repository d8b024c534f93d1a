"""WARC records in seekable Zstandard bundles: independent frames, a seek table, and an index of frame-relative offsets."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import slices, written

# Fixed values of the formats.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"

FRAME_BYTES = 512 << 10  # uncompressed bytes at which a frame is closed
BUNDLE_BYTES = 128 << 20  # compressed bytes at which a bundle is closed
LEAST_SHARED = 1000  # shorter payloads are always stored
DATE = "2000-01-01T00:00:00Z"
INDEX = "record_id string, file string, frame int, offset bigint, length bigint"
RECORD = "page_id {0}, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to {0}, payload binary"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The Arrow file system of a path in shared storage (file, hdfs, s3, gs)."""
    for alias in ("s3a://", "s3n://"):
        path = path.replace(alias, "s3://", 1)
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:/", "file:///", 1))


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer: a skippable frame with the compressed and plain size of every frame."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(handle) -> list[tuple[int, int]]:
    """(offset, compressed size) of every frame of an open bundle, from its last bytes."""
    size = handle.size()
    handle.seek(size - 9)
    count, _, magic = struct.unpack("<IBI", handle.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    handle.seek(size - 9 - 8 * count)
    sizes = [c for c, _ in struct.iter_unpack("<II", handle.read(8 * count))]
    at, out = 0, []
    for c in sizes:
        out.append((at, c))
        at += c
    return out


def _urn(page) -> str:
    return f"<{URN}{'' if page is None else page}>"


def warc_record(page, url: str | None, payload: bytes, size: int, digest: str, refers) -> bytes:
    """One record; a revisit (``refers`` not None) keeps the head of the response and the size of the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if refers is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {_urn(page)}",
             f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if refers is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes, at: int = 0) -> Iterator[tuple]:
    """(page id text, url, type, payload size, hex digest, refers-to text, payload or None) of all records of a frame.
    Sizes and digests of stored payloads are checked."""
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode().split("\r\n")
        head = dict(line.split(": ", 1) for line in lines[1:])
        start, length = stop + 4, int(head["Content-Length"])
        block = data[start:start + length]
        cut = block.index(b"\r\n\r\n") + 4
        size = int(block[:cut].split(b"Content-Length: ", 1)[1].split(b"\r\n", 1)[0])
        digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        payload = block[cut:] if head["WARC-Type"] == "response" else None
        if payload is not None and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"damaged record {head['WARC-Record-ID']}")
        yield (head["WARC-Record-ID"][1 + len(URN):-1], head.get("WARC-Target-URI"), head["WARC-Type"], size, digest,
               head["WARC-Refers-To"][1 + len(URN):-1] if "WARC-Refers-To" in head else None, payload)
        at = start + length + 4


class _Bundle:
    """One archive file being written, frame by frame."""

    def __init__(self, folder: str, level: int):
        store, path = _store(folder)
        store.create_dir(path, recursive=True)
        self.name = f"bundle-{uuid.uuid4().hex}.warc.zst"
        self.out, self.squeeze = store.open_output_stream(f"{path}/{self.name}", compression=None), zstandard.ZstdCompressor(level=level)
        self.frames, self.open, self.size, self.bytes = [], [], 0, 0

    def add(self, record: bytes) -> tuple[int, int, int]:
        """Frame number, offset in the plain frame, and length of the record."""
        place = len(self.frames), self.size, len(record)
        self.open.append(record)
        self.size += len(record)
        if self.size >= FRAME_BYTES:
            self._flush()
        return place

    def _flush(self) -> None:
        if self.open:
            frame = self.squeeze.compress(b"".join(self.open))
            self.out.write(frame)
            self.frames.append((len(frame), self.size))
            self.bytes += len(frame)
            self.open, self.size = [], 0

    def close(self) -> None:
        self._flush()
        self.out.write(seek_table(self.frames))
        self.out.close()


def _write(folder: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in slices(batches, 2):
            index = []
            for page, url, html, size, digest, refers, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bundle = bundle or _Bundle(folder, level)
                record = warc_record(page, url, b"" if revisit else (html or "").encode(), size, digest, refers if revisit else None)
                index.append((f"{URN}{'' if page is None else page}", bundle.name, *bundle.add(record)))
                if bundle.bytes >= BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*index, strict=True)],
                                             schema=pa.schema([("record_id", pa.string()), ("file", pa.string()), ("frame", pa.int32()),
                                                               ("offset", pa.int64()), ("length", pa.int64())]))
        if bundle:
            bundle.close()
    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   level: int = 3) -> DataFrame:
    """Write a WARC record per row into bundles below ``folder`` (shared storage) and return the index of the records:
    ``record_id, file, frame, offset, length``; offsets are relative to the plain frame.

    Of rows with equal payloads of at least 1000 bytes, those with the largest id are responses and the others revisit
    them; shorter payloads are always responses. The html in UTF-8 is the payload, null is empty. Where all ids of equal
    payloads are null, all are responses; a null id beside others is a revisit. Repeated rows of the largest id are responses
    alike. Null urls leave the header out; others are percent-encoded where a header could not hold them.

    A task streams its rows into bundles of its own, one frame in memory. File names are unique per attempt, and the
    index is written by Spark's committer: bundles of a failed attempt are in no index and are never read.
    """
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
                          F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    source = source.select("page_id", "url", "html", F.octet_length("html").cast("bigint").alias("size"), F.sha1("html").alias("digest"))
    latest = written(source.where(F.col("size") >= LEAST_SHARED).groupBy("digest")
                     .agg(F.max("page_id").alias("latest"), F.count("*").alias("n")).where("n > 1").select("digest", "latest"), "latest")
    rows = source.join(latest, "digest", "left").select(
        "page_id", "url", "html", "size", "digest", "latest",
        (F.col("latest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("latest"))).alias("revisit"))
    return written(rows.mapInArrow(_write(folder, level), INDEX), "index")


def _frames(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                with store.open_input_file(f"{path}/{name}") as handle:
                    rows += [(name, i, at, size) for i, (at, size) in enumerate(read_seek_table(handle))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in
                                              enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64()))],
                                             names=["file", "frame", "at", "size"])
    return run


def _records(folder: str, convert, id_type: pa.DataType, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        for batch in batches:
            for name, at, size in sorted(zip(*(batch.column(c).to_pylist() for c in ("file", "at", "size")), strict=True)):
                with store.open_input_file(f"{path}/{name}") as handle:
                    handle.seek(at)
                    data = zstandard.ZstdDecompressor().decompress(handle.read(size))
                rows = [list(c) for c in zip(*parse_records(data), strict=True)]
                rows[0], rows[5] = ([None if not v else convert(v) for v in rows[i]] for i in (0, 5))
                if not with_payload:
                    rows[6] = [None] * len(rows[0])
                types = (id_type, pa.string(), pa.string(), pa.int64(), pa.string(), id_type, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)],
                                                 names=["page_id", "url", "record_type", "payload_bytes", "payload_digest",
                                                        "refers_to", "payload"])
    return run


def read_archives(index: DataFrame, folder: str, id_type: str = "bigint", with_payload: bool = True) -> DataFrame:
    """All records of the bundles that an index names. Seek tables are read per bundle, frames are then dealt out and
    read alone. Sizes and digests of stored payloads are verified. ``id_type`` is bigint or string."""
    convert, kind = (int, pa.int64()) if id_type == "bigint" else (str, pa.string())
    frames = index.select("file").distinct().mapInArrow(_frames(folder), "file string, frame int, at bigint, size bigint")
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, since pointers are tiny and would be folded into one task
    return frames.repartition(tasks, "file", "frame").mapInArrow(_records(folder, convert, kind, with_payload), RECORD.format(id_type))


def _fetch(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        for batch in batches:
            out, last, data = [], None, b""
            for key in sorted(zip(*(c.to_pylist() for c in batch.columns), strict=True), key=lambda r: (r[1], r[2])):
                record, name, frame, offset, length = key
                if (name, frame) != last:
                    with store.open_input_file(f"{path}/{name}") as handle:
                        at, size = read_seek_table(handle)[frame]
                        handle.seek(at)
                        data, last = zstandard.ZstdDecompressor().decompress(handle.read(size)), (name, frame)
                out.append((record, data[offset:offset + length]))
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.string()), pa.array([d for _, d in out], pa.binary())],
                                             names=["record_id", "record"])
    return run


def fetch_records(index: DataFrame, folder: str, wanted: DataFrame) -> DataFrame:
    """Random access: ``record_id, record`` (its bytes) for the ids in ``wanted``; only the frames that hold them are read."""
    found = index.join(wanted.select("record_id").distinct(), "record_id").select(*index.columns)
    return found.repartition("file", "frame").mapInArrow(_fetch(folder), "record_id string, record binary")
