"""Image files: intake audit, headers and pixel tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed_values import (IMAGE_SIGNATURES, MAX_IMAGE_BYTES, MAX_IMAGE_PIXELS, MAX_IMAGE_SIDE,
                                      REFUSALS)
from ..functions.numeric import int_range

PIXEL_SCHEMA = "image_id string, w int, h int, x int, y int, r int, g int, b int, a int"


def _signature_ok(declared: Column, head: Column) -> Column:
    hexed = F.hex(head)
    cases = F.lit(False)
    for mime, parts in IMAGE_SIGNATURES.items():
        match = F.lit(True)
        for offset, digits in parts:
            match = match & (F.substring(hexed, 2 * offset + 1, len(digits)) == digits)
        cases = F.when(declared == mime, match).otherwise(cases)
    return cases


def refusal_reason(declared_type="declared_type", length="length", head="head", width="width",
                   height="height") -> Column:
    """First rule an upload breaks, or null when it is accepted."""
    declared = F.lower(F.col(declared_type))
    w, h = F.col(width), F.col(height)
    rules = [
        (~F.coalesce(declared.isin(*IMAGE_SIGNATURES), F.lit(False)), "type"),
        (F.col(length) == 0, "empty"),
        (F.col(length) > MAX_IMAGE_BYTES, "bytes"),
        (~F.coalesce(_signature_ok(declared, F.col(head)), F.lit(False)), "signature"),
        (w.isNull() | h.isNull() | (w <= 0) | (h <= 0), "invalid"),
        ((w > MAX_IMAGE_SIDE) | (h > MAX_IMAGE_SIDE)
         | (w.cast("bigint") * h.cast("bigint") > MAX_IMAGE_PIXELS), "dimensions"),
    ]
    return F.coalesce(*[F.when(bad, F.lit(REFUSALS[name])) for bad, name in rules])


def intake_audit(files: DataFrame) -> DataFrame:
    """Adds the refusal text (null = accepted) to rows of (declared_type, length, head, width, height)."""
    return files.withColumn("refusal", refusal_reason())


def picture_size(head: bytes) -> tuple[int, int] | None:
    """Width and height from the bytes of a PNG, JPEG or WebP file, or None where they cannot be found."""
    big, little = (lambda at, n: int.from_bytes(head[at:at + n], "big")), (lambda at, n: int.from_bytes(head[at:at + n], "little"))
    if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) >= 24:
        return big(16, 4), big(20, 4)
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP" and len(head) >= 30:
        kind = head[12:16]
        if kind == b"VP8X":
            return little(24, 3) + 1, little(27, 3) + 1
        if kind == b"VP8L":
            packed = little(21, 4)
            return (packed & 0x3FFF) + 1, (packed >> 14 & 0x3FFF) + 1
        return little(26, 2) & 0x3FFF, little(28, 2) & 0x3FFF
    at = 2
    while head[:2] == b"\xff\xd8" and at + 9 <= len(head) and head[at] == 0xFF:
        if 0xC0 <= head[at + 1] <= 0xCF and head[at + 1] not in (0xC4, 0xC8, 0xCC):  # a frame header holds the size
            return big(at + 7, 2), big(at + 5, 2)
        at += 2 + big(at + 2, 2)
    return None


def _measured(batches: Iterator) -> Iterator:
    for pdf in batches:
        sizes = [picture_size(bytes(c)) or (None, None) for c in pdf.pop("content")]
        yield pdf.assign(width=[s[0] for s in sizes], height=[s[1] for s in sizes]).astype({"width": "Int32", "height": "Int32"})


def scan_headers(spark: SparkSession, path: str) -> DataFrame:
    """File name, size, first 12 bytes, declared type by extension, and the size of the picture from its header (null where
    there is none); the content itself is not kept. The result can be audited as it is."""
    ext = F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1))
    return spark.read.format("binaryFile").load(path).select(
        "path", "length", F.substring("content", 1, 12).alias("head"),
        F.when(ext.isin("jpg", "jpeg"), "image/jpeg").otherwise(F.concat(F.lit("image/"), ext)).alias("declared_type"), "content"
    ).mapInPandas(_measured, "path string, length bigint, head binary, declared_type string, width int, height int")


def _strips_to_pixels(batches: Iterator) -> Iterator:
    import numpy as np
    import pandas as pd

    for pdf in batches:
        for image_id, w, h, channels, y, strip in pdf.itertuples(index=False):
            raw = np.frombuffer(strip, dtype=np.uint8).reshape(w, channels)
            blue, green, red = (raw[:, i if channels >= 3 else 0] for i in range(3))
            alpha = raw[:, 3] if channels == 4 else np.full(w, 255, np.uint8)
            yield pd.DataFrame({"image_id": image_id, "w": w, "h": h, "x": np.arange(w), "y": y,
                                "r": red, "g": green, "b": blue, "a": alpha})


def scan_frames(spark: SparkSession, path: str) -> DataFrame:
    """One row per image file with its decoded data. Files that cannot be decoded keep their row, with a null size and the
    refusal text, so nothing is lost unseen."""
    found = spark.read.format("image").option("dropInvalid", False).load(path).select(
        F.regexp_extract("image.origin", r"([^/]+)$", 1).alias("image_id"), "image.*")
    good = F.col("width") > 0
    return found.select("image_id", *[F.when(good, F.col(c)).alias(n) for c, n in (("width", "w"), ("height", "h"),
                        ("nChannels", "channels"), ("data", "data"))], F.when(~good, F.lit(REFUSALS["invalid"])).alias("refusal"))


def refused_images(spark: SparkSession, path: str) -> DataFrame:
    """The files that give no pixels, and why: the report that goes with ``scan_images``."""
    return scan_frames(spark, path).where("refusal IS NOT NULL").select("image_id", "refusal")


def scan_images(spark: SparkSession, path: str) -> DataFrame:
    """PNG and JPEG files as one row per pixel; files without pixels are listed by ``refused_images``.

    The built-in image source decodes; each image is cut into row strips on the JVM and spread over the
    cluster, so one large sheet is unpacked by many tasks. A strip is at most one image side long.
    """
    image = scan_frames(spark, path).where("refusal IS NULL")
    strips = image.withColumn("y", F.explode(int_range(F.col("h")))).select(
        "image_id", "w", "h", "channels", "y",
        F.substring(F.col("data"), F.col("y") * F.col("w") * F.col("channels") + 1,
                    F.col("w") * F.col("channels")).alias("strip"))
    return strips.repartition("image_id", "y").mapInPandas(_strips_to_pixels, PIXEL_SCHEMA)
