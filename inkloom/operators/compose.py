"""Compositing: plates to colour, layer stacks, plate merging and paper."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed_values import PLATES
from ..functions.numeric import clamp, round_half_up, truncate

FRAME = ["image_id", "w", "h", "x", "y"]


def compose_cmyk(cov: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Multiply the plates back to RGB; channels are truncated to integers. Missing plates count as no ink."""
    keys = keys or FRAME
    ink = {p: F.coalesce(F.max(F.when(F.col("plate") == p, F.col("cov"))), F.lit(0.0)) for p in PLATES}
    wide = cov.groupBy(*keys).agg(*[v.alias(p) for p, v in ink.items()])
    rest = F.lit(1.0) - F.col("black")
    return wide.select(*keys, *[
        truncate(clamp((F.lit(1.0) - F.col(p)) * rest * F.lit(255.0), 0.0, 255.0)).cast("int").alias(c)
        for p, c in zip(PLATES, "rgb")])


def _spread(pos, size, new):
    """Target positions whose nearest source is ``pos`` when a side of ``size`` becomes ``new``."""
    lo = F.ceil(pos * new / size - F.lit(0.5))
    hi = F.ceil((pos + 1) * new / size - F.lit(0.5)) - 1
    return F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>")))


def layers_on_base(layers: DataFrame, pixels: DataFrame) -> DataFrame:
    """Visible layer pixels scaled, faded by opacity and placed around the centre of the base frame.

    ``layers``: image_id, z, w, h, visible, scale_pct, opacity, offset_x, offset_y. The base frame is the
    first visible layer. ``pixels``: image_id, z, x, y, r, g, b, a. Only the narrow layer table is joined. ``place`` numbers the
    visible layers of an image from the bottom, from 0.
    """
    shown = layers.where("visible")
    stack = Window.partitionBy("image_id").orderBy("z")
    base = F.first(F.struct("w", "h")).over(stack)
    scale = F.greatest(F.lit(0.01), F.col("scale_pct") / F.lit(100.0))
    heads = shown.withColumns({"base": base, "place": F.row_number().over(stack) - 1}).select(
        "image_id", "z", "place", "opacity", "offset_x", "offset_y", F.col("w").alias("lw"), F.col("h").alias("lh"),
        F.col("base.w").alias("w"), F.col("base.h").alias("h"),
        F.greatest(F.lit(1), truncate(F.col("w") * scale)).alias("tw"),
        F.greatest(F.lit(1), truncate(F.col("h") * scale)).alias("th"))
    px = pixels.select("image_id", "z", F.col("x").alias("sx"), F.col("y").alias("sy"), "r", "g", "b", "a")
    px = px.join(heads, ["image_id", "z"])
    px = px.withColumn("kx", _spread(F.col("sx"), F.col("lw"), F.col("tw")))
    px = px.withColumn("ky", _spread(F.col("sy"), F.col("lh"), F.col("th")))
    out = px.select(
        "image_id", "w", "h",
        (F.col("kx") + F.floor((F.col("w") - F.col("tw")) / 2) + F.col("offset_x")).cast("int").alias("x"),
        (F.col("ky") + F.floor((F.col("h") - F.col("th")) / 2) + F.col("offset_y")).cast("int").alias("y"),
        "z", "place", "r", "g", "b", truncate(F.col("a") * F.col("opacity")).cast("int").alias("a"))
    return out.where(F.col("x").between(0, F.col("w") - 1) & F.col("y").between(0, F.col("h") - 1))


SLOT_BITS = 2  # a step composites runs of four neighbouring layers


def _composited(px: DataFrame) -> DataFrame:
    """One row per pixel and run of four neighbouring layers, source-over in premultiplied form; runs are numbered like layers."""
    run, slot = F.shiftright("place", SLOT_BITS), F.col("place").bitwiseAND(F.lit((1 << SLOT_BITS) - 1))
    slots = [[F.coalesce(F.max(F.when(slot == k, F.col(c))), F.lit(0.0)).alias(f"{c}{k}") for c in "rgba"] for k in range(1 << SLOT_BITS)]
    wide = px.groupBy(*FRAME, run.alias("place")).agg(*[c for own in slots for c in own])
    for k in range(1, 1 << SLOT_BITS):  # every layer over what lies under it, in place of the lowest
        wide = wide.withColumns({f"{c}0": F.col(f"{c}{k}") + F.col(f"{c}0") * (F.lit(1.0) - F.col(f"a{k}")) for c in "rgba"})
    return wide.select(*FRAME, "place", *[F.col(f"{c}0").alias(c) for c in "rgba"])


def flatten_layers(layers: DataFrame, pixels: DataFrame, most: int | None = None) -> DataFrame:
    """Ordered source-over of the layers at every pixel.

    In premultiplied form source-over is associative, so runs of four neighbouring layers become one row, then runs of runs: plain
    aggregates with a buffer of fixed size, in tasks before the exchange as well, and no list of layers at any pixel. ``most``
    is the largest number of visible layers of an image; unless given, that number is read from the layer table. With more than four,
    pixels are dealt out once and the further steps stay in their tasks.
    """
    most = most or layers.where("visible").groupBy("image_id").count().agg(F.max("count")).first()[0] or 1
    px = layers_on_base(layers, pixels).withColumn("a", F.col("a") / F.lit(255.0)).withColumns({c: F.col(c) * F.col("a") for c in "rgb"})
    steps = max(1, -(-(most - 1).bit_length() // SLOT_BITS))
    if steps > 1:
        px = px.repartition(*FRAME)
    for _ in range(steps):
        px = _composited(px)
    value = lambda c: F.when(F.col("a") > 0, F.col(c) / F.col("a")).otherwise(0.0)
    return px.select(*FRAME, *[F.round(value(c), 6).alias(c) for c in "rgb"], F.round(F.col("a") * 255, 6).alias("a"))


def merge_layer_plates(layer_cov: DataFrame) -> DataFrame:
    """Per plate: layer coverage weighted by content alpha, added, clipped and cut at one half.

    ``layer_cov`` has cov and alpha (0..1) per (image_id, plate, x, y, z). Terms are never negative, so
    clipping the sum equals clipping after each layer.
    """
    total = F.least(F.lit(1.0), F.sum(F.col("cov") * F.col("alpha")))
    return layer_cov.groupBy("image_id", "plate", "x", "y").agg((total >= 0.5).cast("int").alias("ink"))


def paper_fill(pixels: DataFrame, background: str = "white", paper: tuple[int, int, int] | None = None) -> DataFrame:
    """Put RGBA sheet pixels over paper. Black paper gets a white rectangle under the artwork.

    Expects art_x, art_y, art_w, art_h on the rows (or no such columns: the artwork fills the sheet).
    """
    colour = paper or ((0, 0, 0) if background == "black" else (255, 255, 255))
    under_art = F.lit(True)
    if "art_x" in pixels.columns:
        under_art = (F.col("x").between(F.col("art_x"), F.col("art_x") + F.col("art_w") - 1)
                     & F.col("y").between(F.col("art_y"), F.col("art_y") + F.col("art_h") - 1))
    ground = [F.when(under_art, 255).otherwise(v) if background == "black" else F.lit(v) for v in colour]
    mix = lambda c, g: round_half_up(
        (F.col(c) * F.col("a") + g * (255 - F.col("a"))) / F.lit(255.0)).cast("int")
    return pixels.select(*FRAME, *[mix(c, g).alias(c) for c, g in zip("rgb", ground)])
