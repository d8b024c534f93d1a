"""Coordinate and block effects on coverage fields."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed_values import (FRAY_BOTTOM, FRAY_LEFT, FRAY_RIGHT, FRAY_TOP, GLITCH_DEFAULTS, LCG_INCREMENT,
                                      LCG_MULTIPLIER, PLATES, SORT_SEED, SORT_SEED_STEP)
from ..functions.mixing import MASK, block_hash, scramble32, unit_noise
from ..functions.numeric import clamp, floor_div, int_range, radians, round_half_even, round_half_up
from ..functions.plates import plate_index

INK_FLOOR = 0.1
FRAME = ["image_id", "w", "h", "plate"]


def settings(**given) -> dict:
    """Effect settings over their defaults."""
    unknown = set(given) - set(GLITCH_DEFAULTS)
    if unknown:
        raise ValueError(f"unknown settings {sorted(unknown)}")
    return {**GLITCH_DEFAULTS, **given}


# -- moves without a join --------------------------------------------------------------------------

def shift_clamped(cov: DataFrame, axis: str, offset) -> DataFrame:
    """Target reads source at position + offset, clamped to the frame.

    The offset may depend on the other axis and the plate. Every source pixel emits the targets that read
    it: one inside the frame, and the whole overhang at an edge. No join and no shuffle.
    """
    size, pos = F.col("w" if axis == "x" else "h"), F.col(axis)
    back = pos - round_half_up(offset)
    low = F.greatest(F.lit(0), F.when(pos == 0, F.lit(0)).otherwise(back))
    high = F.least(size - 1, F.when(pos == size - 1, size - 1).otherwise(back))
    return cov.withColumns({"_low": low, "_high": high}).where("_low <= _high").withColumn(
        axis, F.explode(F.sequence(F.col("_low").cast("int"), F.col("_high").cast("int")))).drop("_low", "_high")


def band_offset(axis: str, size: int, shift: float, factor: int) -> Column:
    """Offset of the band a pixel lies in: band * factor modulo (2 shift + 1), centred."""
    return (floor_div(F.col(axis), max(2, size)) * factor) % F.lit(shift * 2 + 1) - F.lit(shift)


def slice_shift(cov: DataFrame, shift: int, size: int = 20) -> DataFrame:
    return shift_clamped(cov, "x", band_offset("y", size, shift, 37)) if shift > 0 else cov


def vertical_slice_shift(cov: DataFrame, shift: int, size: int = 20) -> DataFrame:
    return shift_clamped(cov, "y", band_offset("x", size, shift, 53)) if shift > 0 else cov


def slice_roll(cov: DataFrame, shift: int, size: int = 20, angle: float = 0.0, vertical: bool = False,
               seed: int = 7) -> DataFrame:
    """Desktop slices: every band is rolled with wrap-around by a seeded amount; bands may be rotated.

    Each pixel moves itself, so there is no join.
    """
    if shift == 0:
        return cov
    along, across = ("y", "x") if vertical else ("x", "y")
    line = F.col(across)
    if abs(angle) > 0.5:
        theta = math.radians(angle)
        line = F.col(across) * F.lit(math.cos(theta)) - F.col(along) * F.lit(math.sin(theta))
    band = floor_div(line, max(2, size))
    amount = F.floor(unit_noise(band, F.lit(0), F.lit(seed)) * F.lit(2 * shift + 1)) - shift
    side = F.col("h" if vertical else "w")
    return cov.withColumn(along, F.pmod(F.col(along) + amount, side).cast("int"))


def channel_desync(cov: DataFrame, amount: float, block: int = 16, variant: str = "web", seed: int = 1337) -> DataFrame:
    """Translate plates against each other: twice and clamped on the web, once and cut on the desktop."""
    if amount <= 0:
        return cov
    if variant == "desktop":
        reach = int(amount * max(4, block) * 2)
        if reach < 1:
            return cov
        step = lambda k: F.floor(
            unit_noise(plate_index("plate"), F.lit(k), F.lit(seed)) * F.lit(2 * reach + 1)) - reach
        moved = cov.withColumns({"x": (F.col("x") + step(1)).cast("int"), "y": (F.col("y") + step(2)).cast("int")})
        return moved.where((F.col("x") >= 0) & (F.col("x") < F.col("w"))
                           & (F.col("y") >= 0) & (F.col("y") < F.col("h")))
    size = max(4, block)
    first = shift_clamped(cov, "x", (plate_index("plate") + 1) * F.lit(float(amount)) * size * 2)
    return shift_clamped(first, "x", F.lit(float(amount) * max(8, block * 2)))


def macroblock_corrupt(cov: DataFrame, rate: float, dropout: float = 0.25, block: int = 16) -> DataFrame:
    """Blocks whose hash falls below the rate are crushed to four steps or dropped (one projection)."""
    if rate <= 0:
        return cov
    chance = (_block_hash(max(4, block)) % 1000) / F.lit(1000.0)
    crushed = round_half_up(F.col("cov") * 4) / F.lit(4.0)
    return cov.withColumn("cov", F.when(chance < F.lit(dropout * rate), 0.0).when(chance < rate, crushed)
                          .otherwise(F.col("cov")))


def macroblock_modes(cov: DataFrame, rate: float, dropout: float = 0.25, block: int = 16, seed: int = 911) -> DataFrame:
    """Desktop corruption of seeded blocks: dim, repeat a neighbour, crush or roll.

    Affected blocks are drawn per block by hash, so no block list is ranked or collected. Only the pixels of
    repeating and rolling blocks take part in the gather join.
    """
    if rate <= 0:
        return cov
    b = max(4, block)
    bx, by = floor_div(F.col("x"), b), floor_div(F.col("y"), b)
    draw = lambda k: unit_noise(bx, by, plate_index("plate") * 64 + F.lit(seed + k))
    whole = lambda k, low, count: F.floor(draw(k) * count) + low
    mix = min(1.0, max(0.0, dropout))
    roll = draw(1)
    mode = (F.when(draw(0) >= rate, "keep").when(roll < mix * 0.55, "dim").when(roll < 0.55, "repeat")
            .when(roll < 0.82, "crush").otherwise("roll"))
    last_x, last_y = floor_div(F.col("w") - 1, b), floor_div(F.col("h") - 1, b)
    ox = clamp(bx + whole(2, -2, 5), F.lit(0), last_x) * b + F.col("x") - bx * b
    oy = clamp(by + whole(3, -2, 5), F.lit(0), last_y) * b + F.col("y") - by * b
    in_frame = (ox < F.col("w")) & (oy < F.col("h"))
    side_x, side_y = F.least(F.lit(b), F.col("w") - bx * b), F.least(F.lit(b), F.col("h") - by * b)
    turn, flat = whole(4, -b, 2 * b + 1), draw(5) < 0.5
    rx = bx * b + F.when(flat, F.col("x") - bx * b).otherwise(F.pmod(F.col("x") - bx * b - turn, side_x))
    ry = by * b + F.when(flat, F.pmod(F.col("y") - by * b - turn, side_y)).otherwise(F.col("y") - by * b)
    step = F.lit(1.0) / F.greatest(F.lit(1), whole(6, 2, 4) - 1)
    marked = cov.withColumn("mode", mode).withColumns({
        "sx": F.when((F.col("mode") == "repeat") & in_frame, ox).when(F.col("mode") == "roll", rx).otherwise(F.col("x")).cast("int"),
        "sy": F.when((F.col("mode") == "repeat") & in_frame, oy).when(F.col("mode") == "roll", ry).otherwise(F.col("y")).cast("int"),
        "own": F.when(F.col("mode") == "dim", F.col("cov") * draw(7) * 0.25)
        .when(F.col("mode") == "crush", round_half_even(clamp(F.col("cov")) / step) * step).otherwise(F.col("cov"))})
    names = cov.columns
    stay = marked.where(~F.col("mode").isin("repeat", "roll")).withColumn("cov", F.col("own")).select(*names)
    move = marked.where(F.col("mode").isin("repeat", "roll"))
    return stay.unionByName(gather(move, cov).select(*names))


# -- gathers ---------------------------------------------------------------------------------------

def _sample_point(x: Column, y: Column, s: dict) -> tuple[Column, Column]:
    """Where the fused sampler reads for a target position: the sum of the displacements of the effects that are on."""
    zero, number = F.lit(0.0), lambda name: F.lit(float(s[name]))
    block = max(4, s["blockShiftSize"])

    def band(pos, size, factor, reach):
        return (floor_div(pos, max(2, s[size])) * factor) % F.lit(s[reach] * 2 + 1) - F.lit(s[reach])

    def wave(curve, pos):
        return curve(pos.cast("double") / F.lit(float(max(2, s["warpScale"])))) * number("gridWarp")

    def third(pos):
        return (floor_div(pos, block) % 3 - 1) * number("blockShift") * block * 2

    pull = ((x * 17 + y * 31) % F.lit(max(1, s["smearLength"]))) * number("smearDrag")
    apart = number("channelDesync") * max(8, s["blockShiftSize"] * 2)
    moves = {  # by effect: how far it moves the reading position along x and along y
        "sliceShift": lambda: (band(y, "sliceSize", 37, "sliceShift"), zero),
        "verticalSliceShift": lambda: (zero, band(x, "verticalSliceSize", 53, "verticalSliceShift")),
        "gridWarp": lambda: (wave(F.sin, y), wave(F.cos, x)),
        "smearDrag": lambda: (zero, pull) if s["smearVertical"] else (pull, zero),
        "blockShift": lambda: (third(x), third(y)),
        "channelDesync": lambda: (apart, zero)}
    terms = [move() for effect, move in moves.items() if s[effect] > 0]
    total = lambda pos, axis: sum((t[axis] for t in terms), pos.cast("double"))
    return _inside(total(x, 0), "w"), _inside(total(y, 1), "h")


def _inside(pos: Column, side: str) -> Column:
    return clamp(round_half_up(pos), F.lit(0), F.col(side) - 1)


def _block_hash(block: int) -> Column:
    corner = lambda c: floor_div(F.col(c), block) * block
    return block_hash(corner("x"), corner("y"), plate_index("plate"))


def gather(targets: DataFrame, cov: DataFrame) -> DataFrame:
    """Read coverage at (sx, sy) for each target; a position without a row reads 0. The key holds the pixel, so one huge
    image spreads evenly; positions that many targets share after clamping are split by adaptive skew handling. A pixel
    table is never broadcast: its size is estimated before it is expanded, so the join is told to sort and merge."""
    source = cov.select("image_id", "plate", F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("cov").alias("read"))
    met = targets.join(source.hint("merge"), ["image_id", "plate", "sx", "sy"], "left")
    return met.select("image_id", "w", "h", "plate", "x", "y", F.coalesce("read", F.lit(0.0)).alias("cov"))


def _positions(cov: DataFrame) -> DataFrame:
    return cov.select("image_id", "w", "h", "plate", "x", "y")


def sample_field(cov: DataFrame, **given) -> DataFrame:
    """The fused sampler alone (slices, warp, smear, thirds, first desync): one gather for all of them."""
    sx, sy = _sample_point(F.col("x"), F.col("y"), settings(**given))
    return gather(_positions(cov).withColumns({"sx": sx.cast("int"), "sy": sy.cast("int")}), cov)


def grid_warp(cov: DataFrame, amount: float, scale: float = 100) -> DataFrame:
    return sample_field(cov, gridWarp=amount, warpScale=scale) if amount > 0 else cov


def smear_drag(cov: DataFrame, amount: float, length: int = 24, vertical: bool = False) -> DataFrame:
    return sample_field(cov, smearDrag=amount, smearLength=length, smearVertical=vertical) if amount > 0 else cov


def smear_band(cov: DataFrame, amount: float, length: int, block: int = 16, vertical: bool = False,
               seed: int = 701) -> DataFrame:
    """Desktop smear: in seeded bands, the maximum of decayed copies dragged along the line, blended in.

    The drag is a window over the line, ordered with or against the drag direction; lines are the groups.
    """
    if amount <= 0:
        return cov
    along, across = ("y", "x") if vertical else ("x", "y")
    reach = max(1, int(length))
    decay = [1.0 - 0.8 * k / reach for k in range(reach + 1)]
    band = floor_div(F.col(across), max(2, block // 2))
    key = plate_index("plate") + F.lit(seed)
    touched = unit_noise(band, F.lit(0), key) <= F.lit(min(1.0, 0.35 + amount * 0.65))
    forward = unit_noise(band, F.lit(1), key) >= 0.5
    marked = cov.withColumns({"touched": touched, "at": F.when(forward, F.col(along)).otherwise(-F.col(along))})
    line = Window.partitionBy("image_id", "plate", across).orderBy("at")
    peak = F.greatest(*[F.lag("cov", k).over(line) * F.lit(decay[k]) for k in range(1, reach + 1)], F.col("cov"))
    blend = clamp(F.col("cov") * F.lit(1.0 - 0.4 * amount) + F.col("peak") * F.lit(0.4 * amount + 0.35))
    return marked.withColumn("peak", peak).withColumn(
        "cov", F.when(F.col("touched"), blend).otherwise(F.col("cov"))).drop("touched", "at", "peak")


def block_shift(cov: DataFrame, amount: float, block: int = 16) -> DataFrame:
    """Thirds pattern in the sampler, then a hashed move per block: composed into one gather."""
    return glitch_field(cov, blockShift=amount, blockShiftSize=block) if amount > 0 else cov


def block_copy(cov: DataFrame, amount: float, block: int = 16, seed: int = 42) -> DataFrame:
    """Desktop block shift: seeded blocks are overwritten from a random offset; reads off the frame keep the
    block's own pixels."""
    if amount <= 0:
        return cov
    b = max(4, block)
    at = _positions(cov).withColumns({"bx": floor_div(F.col("x"), b), "by": floor_div(F.col("y"), b)})
    # The draws become columns before they are used, so that the generated code stays small.
    for k, name in enumerate(("hit", "dx", "dy")):
        at = at.withColumn(name, unit_noise(F.col("bx"), F.col("by"), plate_index("plate") * 64 + F.lit(seed + k)))
    to = lambda pos, draw: F.col(pos) + F.floor(F.col(draw) * (4 * b + 1)).cast("int") - 2 * b
    at = at.withColumns({"tx": to("x", "dx"), "ty": to("y", "dy")})
    ok = (F.col("hit") < amount) & F.col("tx").between(0, F.col("w") - 1) & F.col("ty").between(0, F.col("h") - 1)
    at = at.withColumn("ok", ok)
    return gather(at.withColumns({"sx": F.when(F.col("ok"), F.col("tx")).otherwise(F.col("x")).cast("int"),
                                  "sy": F.when(F.col("ok"), F.col("ty")).otherwise(F.col("y")).cast("int")}), cov)


def glitch_field(cov: DataFrame, **given) -> DataFrame:
    """Sampler, plate shift, corruption and block moves in their fixed order, as a single gather join.

    Block moves read the field before corruption and touch every block, so with them the coordinate maps
    compose and corruption has no effect; without them corruption is a projection after the gather.
    """
    s = settings(**given)
    block = max(4, s["blockShiftSize"])
    at = _positions(cov).withColumns({"tx": F.col("x"), "ty": F.col("y")})
    if s["blockShift"] > 0:
        step = lambda bits: ((F.shiftright(_block_hash(block), bits) % 5) - 2) * F.lit(float(s["blockShift"])) * block
        at = at.withColumns({"tx": _inside(F.col("x") + step(8), "w"), "ty": _inside(F.col("y") + step(16), "h")})
    sx, sy = _sample_point(F.col("tx"), F.col("ty"), s)
    at = at.withColumns({"px": sx, "sy": sy.cast("int")})
    if s["channelDesync"] > 0:
        own = (plate_index("plate") + 1) * F.lit(float(s["channelDesync"])) * block * 2
        at = at.withColumn("px", _inside(F.col("px") + own, "w"))
    moves = any(s[k] > 0 for k in ("sliceShift", "verticalSliceShift", "gridWarp", "smearDrag", "blockShift",
                                   "channelDesync"))
    out = gather(at.withColumn("sx", F.col("px").cast("int")), cov) if moves else cov
    if s["blockShift"] <= 0:
        out = macroblock_corrupt(out, s["macroblockCorrupt"], s["macroblockDropout"], block)
    return out


# -- lines -----------------------------------------------------------------------------------------

def drawn(lines: Column, plate_idx: Column, line: Column, amount: float) -> Column:
    """Whether a shuffle of ``lines`` lines by a 32-bit linear congruential generator puts the line among the first ones.

    Only the line's own place is followed through the swaps: a fold over one image side with two numbers as state, no array
    is moved.
    """
    keep = F.greatest(F.lit(1), F.least(lines, F.floor(lines * F.lit(min(1.0, max(0.0, amount))))))
    seed = (F.lit(SORT_SEED) + plate_idx * SORT_SEED_STEP).cast("bigint").bitwiseAND(F.lit(MASK))

    def swapped(held: Column, last: Column) -> Column:
        state = (held["state"] * F.lit(LCG_MULTIPLIER) + F.lit(LCG_INCREMENT)).bitwiseAND(F.lit(MASK))
        other = F.shiftright(state * (last + 1), 32)
        place = F.when(held["place"] == last, other).when(held["place"] == other, last).otherwise(held["place"])
        return F.struct(state.alias("state"), place.cast("bigint").alias("place"))

    start = F.struct(seed.alias("state"), line.cast("bigint").alias("place"))
    steps = F.transform(int_range(lines - 1), lambda k: (lines - 1 - k).cast("bigint"))
    return F.aggregate(steps, start, swapped, lambda held: held["place"] < keep)


def _by_line(cov: DataFrame, across: str, spread: bool) -> DataFrame:
    """Pixels dealt out by raster line; without ``spread`` they stay where they are, as fits many small sheets that are dealt out by
    image (see ``deal_sheets``): what follows then needs no exchange. Everything that follows from one result of this function shares its exchange, because all of it
    reads every column: the frame size is part of the keys."""
    return cov.repartition(*FRAME, across) if spread else cov


def _axes(vertical: bool) -> tuple[str, str, str]:
    return ("y", "x", "w") if vertical else ("x", "y", "h")


def _sorted_runs(lines: DataFrame, amount: float, vertical: bool) -> DataFrame:
    """Pixels dealt out by line, with every run above the ink floor on drawn lines sorted."""
    along, across, side = _axes(vertical)
    keys = [*FRAME, across]
    line = Window.partitionBy(*keys).orderBy(along)
    upto = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ink = F.col("cov") > INK_FLOOR
    once = lines.withColumns({"first": F.lag(along).over(line).isNull(), "gap": F.max(F.when(~ink, F.col(along))).over(upto)})
    once = once.withColumn("lead", F.when(F.col("first"), drawn(F.col(side), plate_index("plate"), F.col(across), amount)))
    marked = once.withColumn("active", F.first("lead").over(upto) & ink)
    runs = marked.withColumn("start", F.when(F.col("active"), F.coalesce("gap", F.lit(-1)) + 1).otherwise(-1))
    rank = F.row_number().over(Window.partitionBy(*keys, "start").orderBy("cov", along))
    moved = F.when(F.col("active"), F.col("start") + rank - 1).otherwise(F.col(along))
    return runs.withColumn("to", moved.cast("int")).drop(along).withColumnRenamed("to", along).select(
        "image_id", "w", "h", "plate", "x", "y", "cov")


def bitmap_sort(cov: DataFrame, amount: float, vertical: bool = False, spread: bool = True) -> DataFrame:
    """Sort every run above the ink floor on drawn lines, ascending.

    Pixels are dealt out by line; a line is tested once for being drawn. A run covers consecutive positions, so a pixel of rank
    k in its run moves to the k-th position after the run's start: windows over the line, without a further exchange. No
    group exceeds one image side.
    """
    return _sorted_runs(_by_line(cov, _axes(vertical)[1], spread), amount, vertical) if amount > 0 else cov


def _inset(axis: str, factors: tuple[int, int], reach: int) -> Column:
    return scramble32(F.col(axis) * factors[0] + factors[1]) % F.lit(reach + 1)


def _power(pos: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), pos.bitwiseAND(F.lit(63)).cast("int"))


def _bit(words: Column, pos: Column) -> Column:
    """Whether a bitmap of 64-bit words has the bit; null where there is no bitmap."""
    word = F.coalesce(F.get(words, F.shiftright(pos, 6)), F.lit(0).cast("bigint"))
    return words.isNotNull() & (F.call_function("shiftright", word, pos.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1)


def _content_lines(lines: DataFrame, along: str, across: str, reach: int) -> DataFrame:
    """One row per line that is within ``reach`` of the content: the content box of its plate, and as bitmaps which lines and which
    positions of lines hold content. Sixty-four pixels become a word inside the exchange by line; only words are moved on.
    """
    ink = F.col("cov") > INK_FLOOR
    words = lines.groupBy(*FRAME, across, F.shiftright(along, 6).alias("word")).agg(
        F.bit_or(F.when(ink, _power(F.col(along)))).alias("bits"), F.min(F.when(ink, F.col(along))).alias("low"),
        F.max(F.when(ink, F.col(along))).alias("high")).where("bits IS NOT NULL")
    both = F.array(F.struct(F.lit(along).alias("axis"), "word", "bits"),
                   F.struct(F.lit(across).alias("axis"), F.shiftright(across, 6).alias("word"), _power(F.col(across)).alias("bits")))
    merged = words.select(*FRAME, across, "low", "high", F.explode(both).alias("k")).groupBy(*FRAME, "k.axis", "k.word").agg(
        F.bit_or("k.bits").alias("bits"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.min(across).alias("first"), F.max(across).alias("last"))
    held = lambda axis: F.collect_list(F.when(F.col("axis") == axis, F.struct("word", "bits")))
    # The keys are taken as maxima: the null filters that a join adds would go down to the pixels as filters on grouping keys, and the two
    # users of the exchange would no longer be alike.
    box = merged.groupBy(*(F.col(c).alias(f"_{c}") for c in FRAME)).agg(*(F.max(c).alias(c) for c in FRAME), F.min("low").alias("low"), F.max("high").alias("high"),
        F.min("first").alias("first"), F.max("last").alias("last"), held("x").alias("x_words"), held("y").alias("y_words"))

    def dense(words: str) -> Column:
        by_word = F.map_from_entries(words)
        return F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys(by_word))),
                           lambda i: F.coalesce(F.try_element_at(by_word, i), F.lit(0).cast("bigint")))

    ends = {along: ("low", "high"), across: ("first", "last")}
    plates = box.select(*FRAME, dense("x_words").alias("x_ink"), dense("y_words").alias("y_ink"),
                        *(F.col(c).alias(n) for axis, names in (("x", ("left", "right")), ("y", ("top", "bottom")))
                          for c, n in zip(ends[axis], names, strict=True)))
    first, last = ("top", "bottom") if across == "y" else ("left", "right")
    return plates.withColumn(across, F.explode(F.sequence(F.col(first) - reach, F.col(last) + reach)))


def _frayed(cov: DataFrame, content: DataFrame, across: str, reach_x: int, reach_y: int) -> DataFrame:
    x, y, cut = F.col("x"), F.col("y"), F.lit(False)
    if reach_x > 0:
        a, b = _inset("y", FRAY_LEFT, reach_x), _inset("y", FRAY_RIGHT, reach_x)
        limit = max(10, reach_x * 2)
        near = (a > 0) & (a < limit) & (x >= F.col("left")) & (x < F.col("left") + a)
        far = (b > 0) & (b < limit) & (x >= F.col("right") - b) & (x <= F.col("right"))
        cut = cut | ((near | far) & _bit(F.col("y_ink"), y))
    if reach_y > 0:
        a, b = _inset("x", FRAY_TOP, reach_y), _inset("x", FRAY_BOTTOM, reach_y)
        limit = max(10, reach_y * 2)
        near = (a > 0) & (a < limit) & (y >= F.col("top")) & (y < F.col("top") + a)
        far = (b > 0) & (b < limit) & (y >= F.col("bottom") - b) & (y <= F.col("bottom"))
        cut = cut | ((near | far) & _bit(F.col("x_ink"), x))
    out = cov.join(content.hint("merge"), [*FRAME, across], "left")
    return out.withColumn("cov", F.when(F.coalesce(cut, F.lit(False)), 0.0).otherwise(F.col("cov"))).select(*cov.columns)


def _reach(amount: float) -> int:
    return math.floor(max(0, amount) * 1.5)


def frayed_edges(cov: DataFrame, x_amount: float, y_amount: float, spread: bool = True) -> DataFrame:
    """Eat hashed insets into the edges of the content, row by row and column by column.

    Pixels are dealt out by row once. The content box and the presence of rows and columns come from that exchange as bitmaps, 64 pixels
    to a word, and return as one narrow row per line; pixels are neither moved nor computed a second time.
    """
    reach_x, reach_y = _reach(x_amount), _reach(y_amount)
    if reach_x <= 0 and reach_y <= 0:
        return cov
    lines = _by_line(cov, "y", spread)
    return _frayed(lines, _content_lines(lines, "x", "y", reach_y), "y", reach_x, reach_y).select(*cov.columns)


def glitch_chain(cov: DataFrame, fray_x: float = 0, fray_y: float = 0, spread: bool = True, **given) -> DataFrame:
    """All effects in their fixed order: field gather, line sort, fraying.

    The gathered field is dealt out by line once, for the sort and for the content summary of fraying. Sorting a run leaves
    the places above the ink floor as they are, so the summary is taken from the unsorted lines, and gather and sort run once.
    """
    s = settings(**given)
    reach_x, reach_y = _reach(fray_x), _reach(fray_y)
    out = glitch_field(cov, **given)
    if s["bitmapSort"] <= 0 and reach_x <= 0 and reach_y <= 0:
        return out
    along, across, _ = _axes(s["bitmapSortVertical"] and s["bitmapSort"] > 0)
    lines = _by_line(out, across, spread)
    done = _sorted_runs(lines, s["bitmapSort"], s["bitmapSortVertical"]) if s["bitmapSort"] > 0 else lines
    if reach_x > 0 or reach_y > 0:
        done = _frayed(done, _content_lines(lines, along, across, reach_y if across == "y" else reach_x), across, reach_x, reach_y)
    return done
