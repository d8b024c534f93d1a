"""Block and text renderings, depth maps, stereograms and iso-contours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed_values import BLOCK_FILL, CHARSETS, PLATES, STRIP_PATTERNS
from ..functions.mixing import unit_noise
from ..functions.numeric import as_col, clamp, floor_div, int_range, round_half_even, truncate
from ..functions.plates import plate_index
from . import tiles
from .dither import gaussian_blur

BLOCK = ["image_id", "w", "h", "bx", "by"]


def _with_block(df: DataFrame, block: int) -> DataFrame:
    b = max(2, block)
    return df.withColumns({"bx": floor_div(F.col("x"), b).cast("int"), "by": floor_div(F.col("y"), b).cast("int")})


def _expand(blocks: DataFrame, block: int) -> DataFrame:
    """Pixels of each block row; the partial blocks at the far edges stop at the frame."""
    b = max(2, block)
    wide = F.least(F.lit(b), F.col("w") - F.col("bx") * b)
    high = F.least(F.lit(b), F.col("h") - F.col("by") * b)
    rows = blocks.withColumn("dy", F.explode(int_range(high))).withColumn("dx", F.explode(int_range(wide)))
    return rows.withColumns({"x": F.col("bx") * b + F.col("dx"), "y": F.col("by") * b + F.col("dy")}).drop(
        "bx", "by", "dx", "dy")


def pixelate(pixels: DataFrame, block: int = 20) -> DataFrame:
    """Mean colour per block, truncated, spread back over the block.

    Only block rows cross the exchange (partial averages); the pixels are regenerated from them instead of
    being joined back.
    """
    channels = [c for c in "rgba" if c in pixels.columns]
    means = _with_block(pixels, block).groupBy(*BLOCK).agg(*[
        truncate(clamp(F.sum(c) / F.count(F.lit(1)), F.lit(0), F.lit(255))).cast("int").alias(c) for c in channels])
    return _expand(means, block).select("image_id", "w", "h", "x", "y", *channels)


def block_means(cov: DataFrame, block: int) -> DataFrame:
    """Mean coverage of the four plates per block, one row per block."""
    return _with_block(cov, block).groupBy(*BLOCK).agg(*[
        F.coalesce(F.avg(F.when(F.col("plate") == p, F.col("cov"))), F.lit(0.0)).alias(p) for p in PLATES])


def pixelate_plates(cov: DataFrame, block: int = 20) -> DataFrame:
    """Colour blocks composed from mean plate coverage; levels are cut at six decimals, then truncated."""
    rest = F.lit(1.0) - F.col("black")
    means = block_means(cov, block).select(*BLOCK, *[
        truncate(clamp(F.round((F.lit(1.0) - F.col(p)) * rest * 255.0, 6), 0.0, 255.0)).cast("int").alias(c)
        for p, c in zip(PLATES, "rgb")])
    return _expand(means, block).select("image_id", "w", "h", "x", "y", "r", "g", "b")


def apportion_strips(cov: DataFrame, block: int = 20) -> DataFrame:
    """Share each block's width between the plates by coverage and lay the strips side by side.

    While the rounded widths exceed the block, the first widest strip loses one pixel. Widths come from means
    at nine decimals, so ties do not depend on summation order.
    """
    b = max(2, block)
    bw = F.least(F.lit(b), F.col("w") - F.col("bx") * b)
    raw = F.array(*[round_half_even(F.round(F.col(p) * bw, 9)).cast("int") for p in PLATES])
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, v: s + v)

    def shave(widths, _):
        first = F.array_position(widths, F.array_max(widths)) - 1
        return F.transform(widths, lambda v, i: F.when(i == first, v - 1).otherwise(v))

    rows = block_means(cov, b).select(*BLOCK, bw.cast("int").alias("bw"), raw.alias("raw"))
    rows = rows.withColumn("widths", F.aggregate(int_range(total(F.col("raw")) - F.col("bw")), F.col("raw"), shave))
    strips = F.transform(F.array(*[F.lit(p) for p in PLATES]), lambda p, i: F.struct(
        p.alias("plate"), F.get("widths", i).alias("width"),
        (F.col("bx") * b + total(F.slice("widths", F.lit(1), i))).alias("start")))
    return rows.select(*BLOCK, F.explode(strips).alias("s")).select(
        *BLOCK, "s.plate", "s.start", "s.width", (F.col("by") * b).alias("top"),
        F.least(F.lit(b), F.col("h") - F.col("by") * b).alias("height")).where(F.col("width") > 0)


def ascii_cells(cov: DataFrame, cell: int = 10, charset: str = "default", custom: str = "", invert: bool = False,
                levels: int = 10) -> DataFrame:
    """One character per cell from the mean tone of the cell's share of the frame."""
    ramp = (custom if custom.strip() else CHARSETS["default"]) if charset == "custom" else CHARSETS.get(
        charset, CHARSETS["default"])
    n = len(ramp)
    cols = F.greatest(F.lit(1), floor_div(F.col("w"), int(cell)))
    rows = F.greatest(F.lit(1), floor_div(F.col("h"), int(cell)))
    placed = cov.withColumns({"col": floor_div(F.col("x") * cols, F.col("w")).cast("int"),
                              "row": floor_div(F.col("y") * rows, F.col("h")).cast("int")})
    mean = placed.groupBy("image_id", "plate", "row", "col").agg(F.round(F.avg("cov"), 9).alias("mean"))
    tone = F.pow(clamp(F.col("mean")), F.lit(1 / 1.8))
    tone = F.lit(1.0) - tone if invert else tone
    steps = max(2, min(levels, n))
    if levels <= n:
        level = clamp(truncate(tone * (steps - 1) + 0.5), F.lit(0), F.lit(steps - 1))
        index = truncate(level * (n - 1) / F.lit(float(max(1, steps - 1))) + 0.5)
    else:
        index = truncate(tone * (n - 1) + 0.5)
    index = clamp(index, F.lit(0), F.lit(n - 1))
    return mean.select("image_id", "plate", "row", "col", "mean",
                       F.substr(F.lit(ramp), (index + 1).cast("int"), F.lit(1)).alias("ch"))


def ascii_render(cov: DataFrame, **kw) -> DataFrame:
    """Lines of text per plate; the group is one text row, at most one image side of cells."""
    cells = ascii_cells(cov, **kw)
    ordered = F.sort_array(F.collect_list(F.struct("col", "ch")))
    return cells.groupBy("image_id", "plate", "row").agg(
        F.array_join(F.transform(ordered, lambda c: c["ch"]), "").alias("line"))


def block_fill(cells: DataFrame, cell: int = 10, line_spacing: float = 1.0) -> DataFrame:
    """Centred rectangles for block characters, sized by the share of the cell they fill."""
    fill = F.lit(0.5)
    for ch, share in BLOCK_FILL:
        fill = F.when(F.col("ch") == ch, share).otherwise(fill)
    high = int(cell * line_spacing)
    rows = cells.withColumn("fill", fill).where(F.col("fill") > 0)
    full = F.col("fill") >= 1.0
    rw = F.when(full, F.lit(cell)).otherwise(truncate(F.lit(float(cell)) * F.sqrt("fill")))
    rh = F.when(full, F.lit(high)).otherwise(truncate(F.lit(float(high)) * F.sqrt("fill")))
    rows = rows.withColumns({"rw": rw, "rh": rh})
    return rows.select(
        "image_id", "plate", "row", "col", "ch",
        (F.col("col") * cell + floor_div(F.lit(cell) - F.col("rw"), 2)).cast("int").alias("rx"),
        (F.col("row") * high + floor_div(F.lit(high) - F.col("rh"), 2)).cast("int").alias("ry"),
        F.greatest(F.lit(1), F.col("rw")).cast("int").alias("rw"),
        F.greatest(F.lit(1), F.col("rh")).cast("int").alias("rh"))


def depth_map(pixels: DataFrame, invert: bool = False, smooth: int = 30) -> DataFrame:
    """Grey level as depth, optionally inverted and blurred by a tenth of the smoothing setting."""
    grey = F.shiftright((F.col("r") * 19595 + F.col("g") * 38470 + F.col("b") * 7471 + 32768).cast("bigint"), 16)
    depth = grey / F.lit(255.0)
    out = pixels.select("image_id", "w", "h", F.lit("depth").alias("plate"), "x", "y",
                        (F.lit(1.0) - depth if invert else depth).alias("cov"))
    return gaussian_blur(out, smooth / 10.0) if smooth > 0 else out


def pattern_color(pattern, x, y, height, colors: int, offset=0, seed: int = 42) -> Column:
    """Colour index of a pattern strip. Rows are rolled by the offset, except for random dots, where the
    offset changes the seed."""
    pattern, x, offset = as_col(pattern), as_col(x), as_col(offset)
    row = F.pmod(as_col(y) - offset, as_col(height))
    inner = F.pmod(floor_div(x, 4) + floor_div(row, 4), F.lit(max(1, colors - 1))) if colors > 1 else F.lit(0)
    value = {
        "random dots": F.floor(unit_noise(x, as_col(y), F.lit(seed) + offset) * colors),
        "horizontal lines": row % colors,
        "vertical lines": x % colors,
        "diagonal /": (x + row) % colors,
        "diagonal \\": F.pmod(x - row, F.lit(colors)),
        "checkerboard": (floor_div(x, 2) + floor_div(row, 2)) % colors,
        "grid": F.when((x % 4 == 0) | (row % 4 == 0), colors - 1).otherwise(inner),
    }
    out = F.lit(0)
    for name in STRIP_PATTERNS:
        out = F.when(pattern == name, value[name]).otherwise(out)
    return out.cast("int")


def pattern_strip(frames: DataFrame, colors: int = 3) -> DataFrame:
    """Strips from rows of (width, height, pattern, offset)."""
    grid = frames.withColumn("y", F.explode(int_range(F.col("height")))).withColumn(
        "x", F.explode(int_range(F.col("width"))))
    return grid.withColumn("color", pattern_color(F.col("pattern"), F.col("x"), F.col("y"), F.col("height"), colors,
                                                  F.col("offset")))


def stereogram(depth: DataFrame, separation: int = 60, intensity: int = 50, dot: int = 4, colors: int = 3,
               pattern="random dots", offset=0, expand: bool = True) -> DataFrame:
    """Colour indices of a stereogram from a dense depth field (cov in 0..1).

    Every cell copies the colour of a cell to its left. Lines are independent: each is packed into one array
    (one shuffle, at most one image side), the copy chain is resolved inside the row by pointer jumping
    (log2 of the width steps), and roots take the colour of the pattern strip.
    """
    gap = separation // dot
    strip = max(1, gap)
    ws, hs = floor_div(F.col("w"), dot).cast("int"), floor_div(F.col("h"), dot).cast("int")
    small = depth.where((F.col("x") % dot == 0) & (F.col("y") % dot == 0)).select(
        "image_id", "w", "h", floor_div(F.col("x"), dot).cast("int").alias("cx"),
        floor_div(F.col("y"), dot).cast("int").alias("cy"), "cov", ws.alias("ws"), hs.alias("hs"))
    small = small.where((F.col("cx") < F.col("ws")) & (F.col("cy") < F.col("hs")))
    x = F.col("cx")
    shift = truncate(F.lit(gap * (intensity / 100.0)) * F.col("cov"))
    source = x - gap + F.least(shift, x - 1)
    parent = F.when(x < strip, x).when((source >= 0) & (source < x), source).otherwise(F.greatest(F.lit(0), x - gap))
    lines = small.withColumn("parent", parent.cast("int")).groupBy("image_id", "w", "h", "ws", "hs", "cy").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("cx", "parent"))), lambda s: s["parent"]).alias("parents"))
    rounds = F.ceil(F.log2(F.size("parents").cast("double") + 1)).cast("int")
    roots = F.aggregate(int_range(rounds), F.col("parents"),
                        lambda chain, _: F.transform(chain, lambda p: F.get(chain, p)))
    cells = lines.select("image_id", "w", "h", "hs", "cy", F.posexplode(roots).alias("cx", "root"))
    color = F.when(F.col("root") < strip, pattern_color(
        pattern, F.col("root"), F.col("cy"), F.col("hs"), colors, offset)).otherwise(0)
    cells = cells.select("image_id", "w", "h", "cx", "cy", color.alias("color"))
    if not expand:
        return cells
    out = cells.withColumn("dy", F.explode(int_range(dot))).withColumn("dx", F.explode(int_range(dot)))
    return out.select("image_id", "w", "h", (F.col("cx") * dot + F.col("dx")).alias("x"),
                      (F.col("cy") * dot + F.col("dy")).alias("y"), "color")


def stereo_plates(colored: DataFrame, colors: int = 3, fray_x: int = 0, fray_y: int = 0) -> DataFrame:
    """Ink rows per plate from colour indices (black only with four colours), with seeded frayed edges.

    Lines with a positive draw lose a fixed strip at their near edge, a negative draw at the far edge.
    """
    ink = colored.where(F.col("color") < min(4, max(3, colors))).withColumn(
        "plate", F.get(F.array(*[F.lit(p) for p in PLATES]), F.col("color")))
    for axis, other, amount, seed in (("x", "y", fray_x, 42), ("y", "x", fray_y, 43)):
        if amount <= 0:
            continue
        reach = int(amount * 1.5)
        depth = max(10, reach * 2)
        box = ink.groupBy("image_id", "plate").agg(F.min(axis).alias("lo"), F.max(axis).alias("hi"))
        draw = lambda k: F.floor(unit_noise(F.col(other), plate_index("plate"), F.lit(seed + k)) * (2 * reach + 1)) - reach  # noqa: E731,B023
        near = (draw(0) > 0) & (F.col(axis) < F.col("lo") + depth)
        far = (draw(100) < 0) & (F.col(axis) >= F.col("hi") - depth)
        ink = ink.join(box, ["image_id", "plate"]).where(~(near | far)).drop("lo", "hi")
    return ink


def compose_stereo(plates: DataFrame, pixels: DataFrame, inks: dict[str, str] | None = None) -> DataFrame:
    """RGBA of the stereogram: ink colours on white, alpha kept from the artwork, white where transparent."""
    inks = inks or {"cyan": "#00FFFF", "magenta": "#FF00FF", "yellow": "#FFFF00", "black": "#000000"}
    channel = lambda k: {p: int(v.lstrip("#")[2 * k:2 * k + 2], 16) for p, v in inks.items()}
    spots = plates.select("image_id", "x", "y", "plate")
    both = pixels.select("image_id", "x", "y", "a").join(spots.hint("merge"), ["image_id", "x", "y"], "left")

    def level(k):
        out = F.lit(255)
        for p, v in channel(k).items():
            out = F.when(F.col("plate") == p, v).otherwise(out)
        return F.when(F.col("a") > 0, out).otherwise(255)

    return both.select("image_id", "x", "y", *[level(k).alias(c) for k, c in enumerate("rgb")], "a")


# Edges crossed by the contour for each corner pattern (1 = top left, 2 = top right,
# 4 = bottom right, 8 = bottom left); T, R, B, L are the cell edges.
CONTOUR_CASES = {
    1: ["TL"], 14: ["TL"], 2: ["TR"], 13: ["TR"], 4: ["RB"], 11: ["RB"], 7: ["LB"], 8: ["LB"],
    3: ["LR"], 12: ["LR"], 6: ["TB"], 9: ["TB"], 5: ["TL", "RB"], 10: ["TR", "LB"],
}


def iso_contours(cov: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Marching squares: contour segments per cell of a dense raster.

    The three neighbours of a pixel come from its tile, which holds a border of one pixel: one exchange, no self-join.
    """
    cells = tiles.tile_map(cov, 1, tiles.corners, ["tl", "tr", "bl", "br"])
    cells = cells.where(F.col("tr").isNotNull() & F.col("bl").isNotNull() & F.col("br").isNotNull())
    bits = sum((F.when(F.col(c) > threshold, bit).otherwise(0) for c, bit in (("tl", 1), ("tr", 2), ("br", 4), ("bl", 8))),
               F.lit(0))
    cells = cells.withColumn("kind", bits).where((F.col("kind") > 0) & (F.col("kind") < 15))

    def between(a, b):
        va, vb = F.col(a), F.col(b)
        return F.when(F.abs(vb - va) < 0.001, 0.5).otherwise((F.lit(threshold) - va) / (vb - va))

    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    point = lambda px, py: F.struct(px.alias("x"), py.alias("y"))
    cells = cells.withColumns({"T": point(x + between("tl", "tr"), y), "B": point(x + between("bl", "br"), y + 1),
                               "L": point(x, y + between("tl", "bl")), "R": point(x + 1, y + between("tr", "br"))})
    none = F.array().cast("array<struct<s:struct<x:double,y:double>,e:struct<x:double,y:double>>>")
    segments = none
    for kind, pairs in CONTOUR_CASES.items():
        lines = F.array(*[F.struct(F.col(p[0]).alias("s"), F.col(p[1]).alias("e")) for p in pairs])
        segments = F.when(F.col("kind") == kind, lines).otherwise(segments)
    return cells.select("image_id", "plate", "x", "y", F.posexplode(segments).alias("seg", "l")).select(
        "image_id", "plate", "x", "y", "seg", F.col("l.s.x").alias("x1"), F.col("l.s.y").alias("y1"),
        F.col("l.e.x").alias("x2"), F.col("l.e.y").alias("y2"))
