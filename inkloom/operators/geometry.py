"""Document geometry: per-job and per-image expressions, and artwork placement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import DPI, PREVIEW_LONGEST_SIDE, SHEETS
from ..functions.numeric import as_col, clamp, round_half_even, round_half_up, truncate
from ..sources.rasters import frame_pixels


def sheet_side(sheet, orientation, which: str, dpi: int = DPI) -> Column:
    """Sheet width or height in pixels. The eight sheets are folded into one CASE, so no join is needed."""
    sheet, portrait = as_col(sheet), as_col(orientation) == "portrait"
    out = None
    for name, _, wide, high in SHEETS:
        w, h = round_half_up(F.lit(wide) * dpi).cast("int"), round_half_up(F.lit(high) * dpi).cast("int")
        value = F.when(portrait, w if which == "w" else h).otherwise(h if which == "w" else w)
        out = F.when(sheet == name, value) if out is None else out.when(sheet == name, value)
    return out


def sheet_dims(jobs: DataFrame) -> DataFrame:
    """Adds sheet_w and sheet_h at the document resolution."""
    return jobs.withColumns({
        "sheet_w": sheet_side(F.col("sheet_id"), F.col("orientation"), "w"),
        "sheet_h": sheet_side(F.col("sheet_id"), F.col("orientation"), "h")})


def placement(jobs: DataFrame, variant: str = "web") -> DataFrame:
    """Adds the artwork rectangle on the sheet. The desktop variant pans by offset_x and offset_y."""
    scale = F.col("scale_pct") / F.lit(100.0)
    if variant == "desktop":
        scale = F.greatest(F.lit(0.01), scale)
    sized = jobs.withColumns({
        "art_w": F.greatest(F.lit(1), truncate(F.col("src_w") * scale)).cast("int"),
        "art_h": F.greatest(F.lit(1), truncate(F.col("src_h") * scale)).cast("int")})
    left = F.floor((F.col("sheet_w") - F.col("art_w")) / 2)
    top = F.floor((F.col("sheet_h") - F.col("art_h")) / 2)
    if variant == "desktop":
        left, top = left - F.col("offset_x"), top - F.col("offset_y")
    return sized.withColumns({"art_x": left.cast("int"), "art_y": top.cast("int")})


def fit_scale(src_w, src_h, sheet_w, sheet_h, variant: str = "web") -> Column:
    """Percent that fits the artwork on the sheet: 10..400 on the web, at least 1 on the desktop."""
    ratio = F.least(as_col(sheet_w) / as_col(src_w), as_col(sheet_h) / as_col(src_h))
    if variant == "desktop":
        return round_half_even(F.greatest(F.lit(0.01), ratio) * 100.0).cast("int")
    return clamp(round_half_up(ratio * 100), 10, 400).cast("int")


def auto_orientation(src_w, src_h, current) -> Column:
    ratio = as_col(src_w) / as_col(src_h)
    return F.when(ratio > 1.1, "landscape").when(ratio < 0.9, "portrait").otherwise(as_col(current))


def target_dims(jobs: DataFrame, width=None, height=None, preview: bool = False) -> DataFrame:
    """Adds target_w, target_h (sheet fitted into the request) and the sampling size sample_w, sample_h.

    ``width`` and ``height`` are columns or numbers; null or absent means unconstrained.
    """
    by_w = as_col(width).cast("double") / F.col("sheet_w")
    by_h = as_col(height).cast("double") / F.col("sheet_h")
    scale = F.coalesce(F.least(by_w, by_h), F.lit(1.0))  # least skips nulls
    scale = F.when((scale > 0) & (scale < float("inf")), scale).otherwise(1.0)
    side = lambda c, s: F.greatest(F.lit(1), round_half_up(c * s)).cast("int")
    out = jobs.withColumns({"target_w": side(F.col("sheet_w"), scale), "target_h": side(F.col("sheet_h"), scale)})
    longest = F.greatest("target_w", "target_h")
    sample = F.least(F.lit(1.0), F.lit(float(PREVIEW_LONGEST_SIDE)) / longest) if preview else F.lit(1.0)
    return out.withColumns({"sample_w": side(F.col("target_w"), sample), "sample_h": side(F.col("target_h"), sample)})


def lpi(cell, dpi: int = DPI) -> Column:
    """Lines per inch of a cell size."""
    return F.lit(float(dpi)) / as_col(cell)


def normalize_angle(angle) -> Column:
    """Angle in [0, 360)."""
    return ((as_col(angle) % 360) + 360) % 360


def quantize_step(value, low, high, step, decimals: int) -> Column:
    """Snap to low + k*step, clamp and keep at most four decimals."""
    snapped = as_col(low) + round_half_up((as_col(value) - as_col(low)) / as_col(step)) * as_col(step)
    return F.round(clamp(snapped, low, high), min(4, decimals))


def _gather(targets: DataFrame, pixels: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Fetch source values for target positions that carry (src_x, src_y); misses give null."""
    source = pixels.select(*keys, F.col("x").alias("src_x"), F.col("y").alias("src_y"), *values)
    return targets.join(source.hint("merge"), [*keys, "src_x", "src_y"], "left")


def place_artwork(pixels: DataFrame, frames: DataFrame, filter: str = "nearest") -> DataFrame:
    """Resample artwork onto its sheet on a white ground, optionally mirrored.

    ``frames`` has one row per image: sheet_w, sheet_h, art_x, art_y, art_w, art_h, mirror,
    mirror_direction. Instead of generating the sheet and joining the artwork to it, every source pixel
    emits the target pixels that sample it (a contiguous rectangle), and the margin is generated apart;
    only the narrow frame table is joined, by image. Bilinear output joins four neighbours.
    """
    if filter == "bilinear":
        return _place_bilinear(pixels, frames)
    px = pixels.join(frames, "image_id")
    mirror_x = F.col("mirror") & (F.col("mirror_direction") == "horizontal")
    mirror_y = F.col("mirror") & (F.col("mirror_direction") == "vertical")

    def targets(pos, size, art, flipped):
        # Target k samples floor((k + 0.5) * size / art); the k of one source pixel are contiguous.
        lo = F.ceil(pos * art / size - F.lit(0.5))
        hi = F.ceil((pos + 1) * art / size - F.lit(0.5)) - 1
        span = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(span, lambda k: F.when(flipped, art - 1 - k).otherwise(k))

    art = (px.withColumn("tx", F.explode(targets(F.col("x"), F.col("w"), F.col("art_w"), mirror_x)))
           .withColumn("ty", F.explode(targets(F.col("y"), F.col("h"), F.col("art_h"), mirror_y)))
           .select("image_id", F.col("sheet_w").alias("w"), F.col("sheet_h").alias("h"),
                   (F.col("tx") + F.col("art_x")).cast("int").alias("x"),
                   (F.col("ty") + F.col("art_y")).cast("int").alias("y"), "r", "g", "b"))
    inside = (F.col("x") >= 0) & (F.col("x") < F.col("w")) & (F.col("y") >= 0) & (F.col("y") < F.col("h"))
    return art.where(inside).unionByName(_margin(frames))


def _margin(frames: DataFrame) -> DataFrame:
    grid = frame_pixels(frames, "sheet_w", "sheet_h")
    in_art = (F.col("x").between(F.col("art_x"), F.col("art_x") + F.col("art_w") - 1)
              & F.col("y").between(F.col("art_y"), F.col("art_y") + F.col("art_h") - 1))
    return grid.where(~in_art).select(
        "image_id", F.col("sheet_w").alias("w"), F.col("sheet_h").alias("h"), "x", "y",
        *[F.lit(255).alias(c) for c in "rgb"])


def _place_bilinear(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    art = frame_pixels(frames.withColumns({"tw": F.col("art_w"), "th": F.col("art_h")}), "tw", "th")
    sizes = pixels.select("image_id", "w", "h").distinct()
    at = art.join(sizes, "image_id")
    sx = clamp((F.col("x") + 0.5) * F.col("w") / F.col("art_w") - 0.5, F.lit(0.0), F.col("w") - F.lit(1.0))
    sy = clamp((F.col("y") + 0.5) * F.col("h") / F.col("art_h") - 0.5, F.lit(0.0), F.col("h") - F.lit(1.0))
    at = at.withColumns({"sx": sx, "sy": sy})
    x0, y0 = F.floor("sx"), F.floor("sy")
    fx, fy = F.col("sx") - x0, F.col("sy") - y0
    corners = F.array(*[
        F.struct(F.least(x0 + i, F.col("w") - 1).cast("int").alias("src_x"),
                 F.least(y0 + j, F.col("h") - 1).cast("int").alias("src_y"),
                 ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("weight"))
        for i in (0, 1) for j in (0, 1)])
    mirror_x = F.col("mirror") & (F.col("mirror_direction") == "horizontal")
    mirror_y = F.col("mirror") & (F.col("mirror_direction") == "vertical")
    out_x = F.col("art_x") + F.when(mirror_x, F.col("art_w") - 1 - F.col("x")).otherwise(F.col("x"))
    out_y = F.col("art_y") + F.when(mirror_y, F.col("art_h") - 1 - F.col("y")).otherwise(F.col("y"))
    asked = at.select("image_id", "sheet_w", "sheet_h", out_x.alias("ox"), out_y.alias("oy"),
                      F.explode(corners).alias("c")).select("*", "c.*").drop("c")
    found = _gather(asked, pixels, ["image_id"], ["r", "g", "b"])
    inside = F.col("ox").between(0, F.col("sheet_w") - 1) & F.col("oy").between(0, F.col("sheet_h") - 1)
    art_px = found.where(inside).groupBy("image_id", "sheet_w", "sheet_h", "ox", "oy").agg(
        *[round_half_up(F.sum(F.col(c) * F.col("weight"))).cast("int").alias(c) for c in "rgb"])
    art_px = art_px.select("image_id", F.col("sheet_w").alias("w"), F.col("sheet_h").alias("h"),
                           F.col("ox").cast("int").alias("x"), F.col("oy").cast("int").alias("y"), "r", "g", "b")
    return art_px.unionByName(_margin(frames))


def upscale_nearest(pixels: DataFrame, working_dpi: int, dpi: int = DPI) -> DataFrame:
    """Enlarge to the document resolution: every pixel emits the block it covers (no join, no shuffle)."""
    if working_dpi >= dpi:
        return pixels
    factor = dpi / working_dpi
    new_w = round_half_even(F.col("w") * factor).cast("int")
    new_h = round_half_even(F.col("h") * factor).cast("int")

    def span(pos, size, new):
        lo = F.ceil(pos * new / size - F.lit(0.5))
        hi = F.ceil((pos + 1) * new / size - F.lit(0.5)) - 1
        return F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>")))

    rest = [c for c in pixels.columns if c not in ("w", "h", "x", "y")]
    wide = pixels.withColumns({"new_w": new_w, "new_h": new_h})
    wide = wide.withColumn("nx", span(F.col("x"), F.col("w"), F.col("new_w")))
    wide = wide.withColumn("ny", span(F.col("y"), F.col("h"), F.col("new_h")))
    return wide.select(F.col("new_w").alias("w"), F.col("new_h").alias("h"), F.col("nx").cast("int").alias("x"),
                       F.col("ny").cast("int").alias("y"), *rest)
