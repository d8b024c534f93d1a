"""Separation: luminance, four-colour coverage, channel operations, bounds and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import PLATES
from ..functions.numeric import as_col, clamp, round_half_up
from ..functions.plates import unpivot_plates

PAPER_CUTOFF = 250
FRAME = ["image_id", "w", "h", "x", "y"]


def luminance(r="r", g="g", b="b") -> Column:
    return F.lit(0.299) * F.col(r) + F.lit(0.587) * F.col(g) + F.lit(0.114) * F.col(b)


def is_paper() -> Column:
    return luminance() >= PAPER_CUTOFF


def with_cmyk(pixels: DataFrame) -> DataFrame:
    """Cyan, magenta, yellow and black with full grey replacement."""
    raw = {p: F.lit(1.0) - clamp(F.col(c), 0, 255) / F.lit(255.0) for p, c in zip(PLATES, "rgb")}
    black = F.least(*raw.values())
    return pixels.withColumns({**{p: clamp(raw[p] - black) for p in PLATES[:3]}, "black": black})


def coverage(pixels: DataFrame, invert: bool = False, grayscale: bool = False,
             plates: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Ink coverage per plate in long form.

    Paper is cut off before inversion. Grayscale feeds only the black plate. Hidden plates are never
    produced: they are left out of the unpivot, not filtered after it.
    """
    ids = (keep or []) + FRAME
    wanted = [p for p in PLATES if p in (plates or PLATES)]
    if grayscale:
        grey = round_half_up(clamp(luminance(), 0, 255)) / F.lit(255.0)
        tone = F.pow(grey if invert else F.lit(1.0) - grey, F.lit(0.75))
        out = pixels.withColumn("black", F.when(is_paper(), 0.0).otherwise(clamp(tone)))
        return unpivot_plates(out.select(*ids, "black"), ids, plates=[p for p in wanted if p == "black"])
    flip = (lambda c: F.lit(1.0) - c) if invert else (lambda c: c)
    cmyk = with_cmyk(pixels)
    cmyk = cmyk.select(*ids, *[F.when(is_paper(), 0.0).otherwise(flip(F.col(p))).alias(p) for p in wanted])
    return unpivot_plates(cmyk, ids, plates=wanted)


def gray_alpha(pixels: DataFrame, invert: bool = False) -> DataFrame:
    """Desktop grey coverage: tone to the power 0.75, weighted by alpha."""
    level = (F.col("r") * 19595 + F.col("g") * 38470 + F.col("b") * 7471 + 32768)
    tone = F.shiftright(level.cast("bigint"), 16) / F.lit(255.0)
    tone = tone if invert else F.lit(1.0) - tone
    return pixels.select(*FRAME, F.lit("black").alias("plate"),
                         (F.pow(clamp(tone), F.lit(0.75)) * F.col("a") / F.lit(255.0)).alias("cov"))


def channel_op(cov: Column, op: str, amount=None) -> Column:
    """invert above a floor, gamma by contrast percent, fixed threshold, or threshold from a column."""
    if op == "invert":
        return F.when(cov > as_col(0.015 if amount is None else amount), F.lit(1.0) - cov).otherwise(cov)
    if op == "gamma":
        percent = F.greatest(F.lit(1.0), as_col(100.0 if amount is None else amount))
        return F.pow(clamp(cov), F.lit(100.0) / percent)
    if op == "threshold":
        return (cov > as_col(0.5 if amount is None else amount)).cast("double")
    if op == "threshold_map":
        return (cov > as_col(amount)).cast("double")
    raise ValueError(f"unknown channel operation {op!r}")


def content_bounds(pixels: DataFrame) -> DataFrame:
    """Bounding box of inked pixels per image; the whole frame when there is no ink."""
    ink = ~is_paper()
    box = pixels.groupBy("image_id", "w", "h").agg(
        *[fn(F.when(ink, F.col(c))).alias(name) for name, fn, c in (
            ("min_x", F.min, "x"), ("min_y", F.min, "y"), ("max_x", F.max, "x"), ("max_y", F.max, "y"))])
    zero = F.lit(0)
    return box.select(
        "image_id", "w", "h",
        F.coalesce("min_x", zero).alias("min_x"), F.coalesce("min_y", zero).alias("min_y"),
        F.coalesce("max_x", F.col("w") - 1).alias("max_x"), F.coalesce("max_y", F.col("h") - 1).alias("max_y"))


def plate_stats(cov: DataFrame, ink_above: float = 0.0) -> DataFrame:
    """Mean coverage, inked pixels and number of levels per image and plate, with corpus totals.

    The level count is over coverage at six decimals. Rollup rows carry null keys.
    """
    level = F.round("cov", 6)
    fine = cov.groupBy("image_id", "plate", level.alias("level")).agg(
        F.count(F.lit(1)).alias("px"), F.count_if(F.col("cov") > ink_above).alias("ink"), F.sum("cov").alias("total"))
    return fine.rollup("plate", "image_id").agg(
        F.sum("px").alias("pixels"), F.sum("ink").alias("ink_pixels"),
        F.round(F.sum("total") / F.sum("px"), 6).alias("mean_cov"),
        F.countDistinct("level").alias("levels"))


LEVEL_BITS, SPREAD_SIZE = 14, 400  # accuracy of the sketches: about 0.8 % for many levels (few are exact), about 0.7 % of rank


def plate_sketches(cov: DataFrame, ink_above: float = 0.0) -> DataFrame:
    """One mergeable row per image and plate: counts, and sketches of the levels (coverage at six decimals) and of their distribution.

    Stored once per day of images, totals over any set of days and keys come from these rows alone (see ``merged_sketches``).
    """
    level = F.round(F.col("cov") * 1_000_000).cast("bigint")
    return cov.groupBy("image_id", "plate").agg(
        F.lit(1).cast("bigint").alias("images"), F.count(F.lit(1)).alias("pixels"), F.count_if(F.col("cov") > ink_above).alias("ink_pixels"),
        F.sum("cov").alias("total"), F.hll_sketch_agg(level, LEVEL_BITS).alias("levels"),
        F.kll_sketch_agg_double("cov", SPREAD_SIZE).alias("spread"))


def merged_sketches(sketches: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``plate_sketches``, or of this function, added up by the keys; the result can be stored and merged again."""
    return sketches.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("images", "pixels", "ink_pixels", "total")],
        F.hll_union_agg("levels").alias("levels"), F.kll_merge_agg_double("spread", SPREAD_SIZE).alias("spread"))


def sketch_report(sketches: DataFrame, *shares: float) -> DataFrame:
    """What sketches say: counts, mean coverage, number of levels, and the coverage below which the given shares of pixels lie."""
    held = ("images", "pixels", "ink_pixels", "total", "levels", "spread")
    keys = [c for c in sketches.columns if c not in held]
    at = [F.kll_sketch_get_quantile_double("spread", F.lit(float(q))).alias(f"cov_{round(q * 100)}") for q in shares]
    return sketches.select(*keys, "images", "pixels", "ink_pixels", F.round(F.col("total") / F.col("pixels"), 6).alias("mean_cov"),
                           F.hll_sketch_estimate("levels").alias("levels"), *at)
