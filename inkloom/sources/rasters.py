"""Rasters from point tables: binning, densifying, generating frames, packing rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import int_range


def bin_raster(points: DataFrame, x: str = "px", y: str = "py", image: str = "image_id",
               sums: dict[str, str] | None = None) -> DataFrame:
    """Bin points into integer cells: count and sums per cell.

    One aggregation with partial sums before the exchange; a hot cell or image costs one partial row
    per task.
    """
    aggs = [F.count(F.lit(1)).cast("int").alias("n")]
    aggs += [F.sum(src).cast("bigint").alias(out) for out, src in (sums or {}).items()]
    return points.groupBy(
        image, F.floor(x).cast("int").alias("x"), F.floor(y).cast("int").alias("y")).agg(*aggs)


def frame_pixels(headers: DataFrame, width: str = "w", height: str = "h") -> DataFrame:
    """All pixel positions of each frame: rows first, then columns, so no array exceeds one side."""
    return (headers.withColumn("y", F.explode(int_range(F.col(height))))
            .withColumn("x", F.explode(int_range(F.col(width)))))


def densify_raster(cells: DataFrame, width: int, height: int, image: str = "image_id") -> DataFrame:
    """Fill the cells that have no points with zero counts.

    Occupied and empty cells are unioned and re-aggregated, so the grid costs one partial aggregation
    instead of a join.
    """
    heads = cells.select(image).distinct().select(
        image, F.lit(width).alias("w"), F.lit(height).alias("h"))
    empty = frame_pixels(heads).select(image, "x", "y", F.lit(0).alias("n"))
    both = cells.select(image, "x", "y", "n").unionByName(empty)
    return both.groupBy(image, "x", "y").agg(F.sum("n").cast("int").alias("n")).select(
        image, F.lit(width).alias("w"), F.lit(height).alias("h"), "x", "y", "n")


def pack_rows(df: DataFrame, keys: list[str], value: str = "cov", out: str = "row") -> DataFrame:
    """One array per raster row, in column order. The group is one row: at most one image side long."""
    pairs = F.sort_array(F.collect_list(F.struct("x", value)))
    return df.groupBy(*keys).agg(F.transform(pairs, lambda s: s[value]).alias(out))


def unpack_rows(df: DataFrame, keys: list[str], row: str = "row", value: str = "cov") -> DataFrame:
    """Inverse of pack_rows for dense rows."""
    return df.select(*keys, F.posexplode(row).alias("x", value))
