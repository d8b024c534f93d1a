"""Screening: lattices, coverage sampling, mark sizes, geometry, rasterised marks and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed_values import PREVIEW_MARK_BUDGET
from ..functions.mixing import smooth_noise, unit_noise
from ..functions.numeric import as_col, clamp, int_range, radians, round_half_even, round_half_up, truncate
from ..session import fan_out
from .preflight import estimate_grid_points

PI = 3.141592653589793


def _lattice(headers: DataFrame, n_u: Column, n_v: Column, spread: bool) -> DataFrame:
    """Explode the two lattice axes. With ``spread`` the half-expanded axis is dealt out, so one huge sheet uses many tasks; without
    it points stay in the tasks of their headers, as fits many small sheets (see ``deal_sheets``)."""
    rows = headers.withColumns({"n_v": n_v, "u_idx": F.explode(int_range(n_u))})
    return (fan_out(rows) if spread else rows).withColumn("v_idx", F.explode(int_range(F.col("n_v")))).drop("n_v")


def with_bounds(headers: DataFrame, bounds: DataFrame) -> DataFrame:
    """Attach content bounds to lattice headers (narrow tables), so marks are cut before any pixel join. Bounds have a row
    per image, so they are not broadcast."""
    return headers.join(bounds.select("image_id", "min_x", "min_y", "max_x", "max_y").hint("merge"), "image_id")


def screen_lattice(headers: DataFrame, spread: bool = True) -> DataFrame:
    """Rotated lattice centred on the frame, kept within one cell of it.

    ``headers``: image_id, plate, w, h (output size), sw, sh (coverage size), cell, angle and optionally the
    content bounds in coverage pixels, which then restrict the marks to the artwork.
    """
    half = F.ceil(F.hypot(F.col("w").cast("double"), F.col("h").cast("double"))) / F.lit(2.0) + F.col("cell")
    count = F.floor(half * 2 / F.col("cell")) + 1
    theta = radians(F.col("angle"))
    heads = headers.withColumns({"half": half, "cos_t": F.cos(theta), "sin_t": F.sin(theta)})
    grid = _lattice(heads, count, count, spread)
    u = -F.col("half") + F.col("u_idx") * F.col("cell")
    v = -F.col("half") + F.col("v_idx") * F.col("cell")
    grid = grid.withColumns({
        "cx": F.col("w") / F.lit(2.0) + u * F.col("cos_t") - v * F.col("sin_t"),
        "cy": F.col("h") / F.lit(2.0) + u * F.col("sin_t") + v * F.col("cos_t")})
    cell = F.col("cell")
    keep = ((F.col("cx") >= -cell) & (F.col("cy") >= -cell)
            & (F.col("cx") <= F.col("w") + cell) & (F.col("cy") <= F.col("h") + cell))
    if "min_x" in headers.columns:
        for pos, side, src, low, high in (("cx", "w", "sw", "min_x", "max_x"), ("cy", "h", "sh", "min_y", "max_y")):
            edge = lambda b: F.col(b) / F.col(src) * F.col(side)
            keep = keep & (F.col(pos) >= edge(low)) & (F.col(pos) <= edge(high))
    return grid.where(keep).drop("half", "cos_t", "sin_t", "min_x", "min_y", "max_x", "max_y")


def screen_lattice_desktop(headers: DataFrame, spread: bool = True) -> DataFrame:
    """Cell-centred lattice over the rotated bounding box, only points inside the frame."""
    theta = radians(F.col("angle"))
    heads = headers.withColumns({"cos_t": F.cos(theta), "sin_t": F.sin(theta)})
    c, s = F.abs(F.col("cos_t")), F.abs(F.col("sin_t"))
    heads = heads.withColumns({"eff_w": F.col("w") * c + F.col("h") * s, "eff_h": F.col("w") * s + F.col("h") * c})
    size = F.greatest(F.lit(1e-6), F.col("cell"))
    steps = lambda e: F.greatest(F.lit(1), F.ceil(F.col(e) / size))
    grid = _lattice(heads, steps("eff_w"), steps("eff_h"), spread)
    u = -F.col("eff_w") / 2 + (F.col("u_idx") + F.lit(0.5)) * F.col("cell")
    v = -F.col("eff_h") / 2 + (F.col("v_idx") + F.lit(0.5)) * F.col("cell")
    grid = grid.withColumns({
        "cx": F.col("w") / F.lit(2.0) + u * F.col("cos_t") - v * F.col("sin_t"),
        "cy": F.col("h") / F.lit(2.0) + u * F.col("sin_t") + v * F.col("cos_t")})
    inside = (F.col("cx") >= 0) & (F.col("cx") < F.col("w")) & (F.col("cy") >= 0) & (F.col("cy") < F.col("h"))
    return grid.where(inside).drop("cos_t", "sin_t", "eff_w", "eff_h")


def sample_coverage(marks: DataFrame, cov: DataFrame, variant: str = "web") -> DataFrame:
    """Coverage under every mark: one equi-join on the rounded source pixel.

    Coverage is unique per key and a pixel without a row counts as 0, so the row count of the marks is kept. The key
    contains the pixel, so a single huge image still spreads over all partitions; neither side is broadcast.
    """
    if variant == "desktop":
        sx, sy = truncate(F.col("cx")), truncate(F.col("cy"))
    else:
        sx = clamp(round_half_up(F.col("cx") / F.col("w") * F.col("sw")), F.lit(0), F.col("sw") - 1)
        sy = clamp(round_half_up(F.col("cy") / F.col("h") * F.col("sh")), F.lit(0), F.col("sh") - 1)
    asked = marks.withColumns({"sx": sx.cast("int"), "sy": sy.cast("int")})
    field = cov.select("image_id", "plate", F.col("x").alias("sx"), F.col("y").alias("sy"), "cov")
    met = asked.join(field.hint("merge"), ["image_id", "plate", "sx", "sy"], "left")
    return met.withColumn("cov", F.coalesce("cov", F.lit(0.0)))


def dot_size(sampled: DataFrame) -> DataFrame:
    """Web size from coverage; invisible marks are dropped."""
    size = F.col("cell") * F.sqrt("cov") * F.lit(1.04)
    return sampled.withColumn("size", size).where(F.col("size") > 0.12)


def dot_size_desktop(sampled: DataFrame, elem: float = 1.0) -> DataFrame:
    """Desktop radius from coverage with tone correction; invisible marks are dropped."""
    tone = F.pow(clamp(F.col("cov")), F.lit(1.0 / 1.8))
    return sampled.withColumn("radius", F.lit(0.5) * F.col("cell") * F.lit(elem) * tone).where(F.col("radius") > 0.05)


def dot_geometry(marks: DataFrame, stroke: float = 1.0, variant: str = "web") -> DataFrame:
    """Extent (box_w, box_h) and ink area of each mark from its shape and size (diameter)."""
    d, s = F.col("size"), F.col("shape")
    r = d / 2
    disc = F.lit(PI) * r * r
    hole = F.greatest(F.lit(0.0), r - F.lit(float(stroke)))
    if variant == "desktop":
        bar = F.greatest(F.lit(1.0), r * 0.5)
        area = (F.when(s.isin("square", "diamond"), d * d).when(s == "triangle", d * d / 2)
                .when(s == "cross", 2 * d * bar - bar * bar)
                .when(s == "circle-outline", F.lit(2 * PI * stroke) * r).otherwise(disc))
        box = F.when(s == "diamond", d * F.sqrt(F.lit(2.0))).when(s == "circle-outline", d + stroke).otherwise(d)
        return marks.withColumns({"box_w": box, "box_h": box, "area": area})
    high = d * 0.32
    area = (F.when(s == "square", d * d).when(s == "custom", d * d).when(s == "diamond", d * d / 2)
            .when(s == "triangle", d * d / 2)
            .when(s == "line", (d - high) * high + F.lit(PI) * high * high / 4)
            .when(s == "cross", 2 * d * (d * 0.28) - (d * 0.28) * (d * 0.28))
            .when(s == "circle-outline", F.lit(PI) * (r * r - hole * hole)).otherwise(disc))
    return marks.withColumns({"box_w": d, "box_h": F.when(s == "line", high).otherwise(d), "area": area})


def lines_invert(cov: Column, floor: float = 0.02) -> Column:
    """Invert inside the content; background stays without ink."""
    return F.when(cov > floor, F.lit(1.0) - cov).otherwise(0.0)


def line_marks(sampled: DataFrame, stroke: float = 1.0, width_pct: float = 1.0, length_pct: float = 100.0,
               density_pct: float = 1.0, elem: float = 1.0, taper: float = 0.0, variation: float = 0.0,
               seed: int = 5) -> DataFrame:
    """Line segments whose length follows coverage, optionally tapered into at least three pieces.

    Uses point_angle (degrees) when present, else the plate angle.
    """
    length = (F.col("cell") * F.lit(density_pct)) * F.lit(elem) * F.col("cov") * F.lit(length_pct / 100.0)
    rows = sampled.withColumn("length", length).where(F.col("length") > 0.10)
    theta = radians(F.col("point_angle" if "point_angle" in sampled.columns else "angle"))
    base = F.greatest(F.lit(1.0), round_half_even(F.lit(stroke * width_pct)))
    width = base
    if variation > 0:
        noise = unit_noise(F.col("u_idx"), F.col("v_idx"), F.lit(seed))
        width = F.greatest(F.lit(1), truncate(base * (F.lit(1.0) + (noise - 0.5) * variation * 2)))
    rows = rows.withColumns({"width": width.cast("int"), "ct": F.cos(theta), "st": F.sin(theta)})
    if taper <= 0:
        dx, dy = F.col("length") / 2 * F.col("ct"), F.col("length") / 2 * F.col("st")
        return rows.withColumns({"seg": F.lit(0), "x1": F.col("cx") - dx, "y1": F.col("cy") - dy,
                                 "x2": F.col("cx") + dx, "y2": F.col("cy") + dy}).drop("ct", "st")
    rows = rows.withColumn("pieces", F.greatest(F.lit(3), truncate(F.col("length") / 5)).cast("int"))
    rows = rows.withColumn("seg", F.explode(int_range(F.col("pieces"))))
    progress = F.col("seg") / (F.col("pieces") - 1)
    fade = F.lit(1.0) - F.abs(progress - 0.5) * 2 * taper
    shift = (progress - 0.5) * 2
    mx = F.col("cx") + F.col("length") * F.col("ct") / 2 * shift
    my = F.col("cy") + F.col("length") * F.col("st") / 2 * shift
    piece = F.col("length") / F.col("pieces") * 1.2
    dx, dy = piece * F.col("ct") / 2, piece * F.col("st") / 2
    return rows.withColumns({
        "x1": mx - dx, "y1": my - dy, "x2": mx + dx, "y2": my + dy,
        "width": F.greatest(F.lit(1), truncate(F.col("width") * fade)).cast("int")}).drop("ct", "st", "pieces")


def bump_cell(w, h, cell, angle, budget: int = PREVIEW_MARK_BUDGET) -> Column:
    """Coarser cell for previews whose lattice exceeds the budget."""
    total = estimate_grid_points(w, h, cell, angle)
    return F.when(total > budget, as_col(cell) * F.sqrt(total / F.lit(float(budget)))).otherwise(as_col(cell))


def warp_lattice(marks: DataFrame, amount: float, scale: float = 100.0, seed: int = 1234) -> DataFrame:
    """Displace lattice points by smooth noise and clip them to the frame."""
    short = F.least("w", "h").cast("double")
    knots = F.greatest(F.lit(2), truncate(short * F.lit(scale / 100.0) / 5))
    noise = smooth_noise(F.floor("cx"), F.floor("cy"), short / knots, F.lit(seed)) * 2 - 1
    moved = marks.withColumn("offset", noise * amount)
    return moved.withColumns({
        "cx": clamp(F.col("cx") + F.col("offset"), F.lit(0.0), F.col("w") - F.lit(1.0)),
        "cy": clamp(F.col("cy") + F.col("offset"), F.lit(0.0), F.col("h") - F.lit(1.0))}).drop("offset")


def displace_plate(cov: DataFrame, dx, dy) -> DataFrame:
    """Shift plate pixels and clip at the frame (no join: every pixel moves itself)."""
    moved = cov.withColumns({"x": (F.col("x") + dx).cast("int"), "y": (F.col("y") + dy).cast("int")})
    return moved.where((F.col("x") >= 0) & (F.col("x") < F.col("w")) & (F.col("y") >= 0) & (F.col("y") < F.col("h")))


def splat_marks(marks: DataFrame, value: str | None = None) -> DataFrame:
    """Rasterise discs given by cx, cy and radius: hard edges, overlaps combined by the maximum.

    Each mark emits its own spans, one per row. Without ``value`` ink is 1 everywhere: a span is cut into words of 64 pixels, the words of a
    row are united bit by bit, and only united words are expanded to pixels, so what is aggregated and exchanged is a word per row and
    mark. With ``value`` partial aggregation merges overlapping pixels before the exchange, and the key contains the pixel.
    """
    diameter = F.greatest(F.lit(1.0), round_half_even(F.col("radius") * 2))
    reach = F.when(diameter <= 2, 0).otherwise(F.floor(diameter / 2)).cast("int")
    ink = F.col(value) if value else F.lit(1.0)
    rows = marks.select("image_id", "plate", "w", "h", round_half_even(F.col("cx")).cast("int").alias("px"),
                        round_half_even(F.col("cy")).cast("int").alias("py"), reach.alias("reach"), ink.alias("ink"))
    rows = rows.withColumn("dy", F.explode(F.sequence(-F.col("reach"), F.col("reach"))))
    span = F.floor(F.sqrt((F.col("reach") * F.col("reach") - F.col("dy") * F.col("dy")).cast("double"))).cast("int")
    rows = rows.withColumn("span", span)
    if value is None:
        return _united_spans(rows.select("image_id", "plate", "w", "h", (F.col("py") + F.col("dy")).alias("y"),
                                         F.greatest(F.lit(0), F.col("px") - F.col("span")).alias("low"),
                                         F.least(F.col("w") - 1, F.col("px") + F.col("span")).alias("high")))
    rows = rows.withColumn("dx", F.explode(F.sequence(-F.col("span"), F.col("span"))))
    cells = rows.select("image_id", "plate", "w", "h", (F.col("px") + F.col("dx")).alias("x"),
                        (F.col("py") + F.col("dy")).alias("y"), "ink")
    cells = cells.where((F.col("x") >= 0) & (F.col("x") < F.col("w")) & (F.col("y") >= 0) & (F.col("y") < F.col("h")))
    return cells.groupBy("image_id", "plate", "w", "h", "x", "y").agg(F.max("ink").alias("cov"))


def _united_spans(spans: DataFrame) -> DataFrame:
    """Pixels of the union of spans (y, low .. high) that start and end within the frame's width."""
    inside = spans.where((F.col("low") <= F.col("high")) & F.col("y").between(0, F.col("h") - 1))
    words = inside.withColumn("word", F.explode(F.sequence(F.shiftright("low", 6), F.shiftright("high", 6))))
    first, last = F.greatest(F.lit(0), F.col("low") - F.col("word") * 64), F.least(F.lit(63), F.col("high") - F.col("word") * 64)
    ones = F.call_function("shiftrightunsigned", F.lit(-1).cast("bigint"), (63 - last + first).cast("int"))
    words = words.withColumn("ones", F.call_function("shiftleft", ones, first.cast("int")))
    united = words.groupBy("image_id", "plate", "w", "h", "y", "word").agg(F.bit_or("ones").alias("ones"))
    cells = united.withColumn("bit", F.explode(F.sequence(F.lit(0), F.least(F.lit(63), F.col("w") - 1 - F.col("word") * 64))))
    lit = F.call_function("shiftright", F.col("ones"), F.col("bit")).bitwiseAND(F.lit(1)) == 1
    return cells.where(lit).select("image_id", "plate", "w", "h", (F.col("word") * 64 + F.col("bit")).cast("int").alias("x"), "y",
                                   F.lit(1.0).alias("cov"))


def moire_swatch(headers: DataFrame, level: float = 0.60, spread: bool = True) -> DataFrame:
    """A flat field screened through every plate and composed to colour: shows interference of angles."""
    from .compose import compose_cmyk

    flat = screen_lattice_desktop(headers, spread).withColumn("cov", F.lit(level))
    return compose_cmyk(splat_marks(dot_size_desktop(flat)))


def registration_marks(frames: DataFrame, mode: str = "corners", size=None, offset=None, weight: float = 1.0,
                       variant: str = "web") -> DataFrame:
    """Registration marks per frame (any key columns plus w and h)."""
    short = F.least("w", "h")
    if variant == "desktop":
        size, offset = as_col(size), as_col(offset)
        line = F.greatest(F.lit(1.0), round_half_even(F.greatest(F.lit(2.0), round_half_even(size * 0.06)) * weight))
    else:
        size = F.greatest(F.lit(7), round_half_up(short * 0.014)) if size is None else as_col(size)
        offset = F.greatest(F.lit(14), round_half_up(short * 0.035)) if offset is None else as_col(offset)
        line = F.greatest(F.lit(0.5), F.lit(float(weight)))
    w, h = F.col("w"), F.col("h")
    if mode == "centered":
        points = [(w / 2, offset), (w / 2, h - offset)]
    elif variant == "desktop":
        points = [(offset, offset), (w - offset, offset), (w - offset, h - offset), (offset, h - offset)]
    else:
        points = [(offset, offset), (w - offset, offset), (offset, h - offset), (w - offset, h - offset)]
    spots = F.array(*[F.struct(px.cast("double").alias("x"), py.cast("double").alias("y")) for px, py in points])
    return frames.select("*", size.cast("double").alias("size"), line.cast("double").alias("weight"),
                         F.posexplode(spots).alias("mark", "p")).select("*", "p.x", "p.y").drop("p")


def mark_histogram(marks: DataFrame, width: float = 0.5) -> DataFrame:
    """Marks per plate and size class."""
    return marks.groupBy("plate", F.floor(F.col("size") / F.lit(float(width))).cast("int").alias("size_class")).agg(
        F.count(F.lit(1)).alias("marks"))


def densest_tiles(marks: DataFrame, tile: int = 256, k: int = 10) -> DataFrame:
    """The k tiles with most marks per plate: counted with partial aggregation, then ranked.

    The rank filter is applied per task before the exchange, so no task receives a plate's whole tile list.
    """
    tiles = marks.groupBy("plate", "image_id", F.floor(F.col("cx") / tile).cast("int").alias("tile_x"),
                          F.floor(F.col("cy") / tile).cast("int").alias("tile_y")).agg(
        F.count(F.lit(1)).alias("marks"))
    order = Window.partitionBy("plate").orderBy(F.col("marks").desc(), "image_id", "tile_y", "tile_x")
    return tiles.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
