"""Queries over coordinate and block effects."""

from __future__ import annotations

from ..operators import glitch as g
from .fixture_sql import COV, LUM, block_hash, half_up, scramble, unit_noise, with_
from .registry import register
from .separation import long
from .tables import parts_coverage


def inside(expr: str, side: str) -> str:
    return f"CAST(least({side} - 1, greatest(0, {half_up(expr)})) AS INT)"


PTS = COV + ",\npts AS (SELECT g.*, p.plate, p.i FROM grid g, plates p)"


def part_value(source: str, name: str) -> str:
    """CTE: the part raster is a closed formula, so the value at (sx, sy) is computed there instead of joined."""
    return (f"{name}_m AS (SELECT *, (sx < 1 OR sy < 1 OR sx >= w - 1 OR sy >= h - 1) AS m FROM {source}), "
            f"{name}_c AS (SELECT *, CASE WHEN m THEN 255 ELSE (17 * sx + 3 * size) % 256 END AS r, "
            f"CASE WHEN m THEN 255 ELSE (23 * sy + image_id) % 256 END AS g, "
            f"CASE WHEN m THEN 255 ELSE (11 * (sx + sy) + price) % 256 END AS b FROM {name}_m), "
            f"{name}_k AS (SELECT *, 1e0 - greatest(r, g, b) / 255e0 AS k FROM {name}_c), "
            f"{name} AS (SELECT *, CASE WHEN {LUM} >= 250 THEN 0e0 WHEN i = 3 THEN k "
            f"ELSE 1e0 - (CASE i WHEN 0 THEN r WHEN 1 THEN g ELSE b END) / 255e0 - k END AS cov FROM {name}_k)")


def remap(sx: str, sy: str, source: str = "pts", name: str = "moved") -> str:
    """CTE: every position of ``source`` reads the value at (sx, sy), expressions over x, y, w, h, i."""
    return f"{name}_at AS (SELECT *, {sx} AS sx, {sy} AS sy FROM {source}), {part_value(f'{name}_at', name)}"


OUT = "SELECT image_id, x, y, plate, round(cov, 6) AS cov FROM {}"
SLICE = "((y // 3) * 37) % 5 - 2"
VSLICE = "((x // 4) * 53) % 5 - 2"


@register("slice_shift", with_(PTS, remap(inside(f"x + {SLICE}", "w"), "y"), OUT.format("moved")))
def slice_shift(spark, sf):
    return long(g.slice_shift(parts_coverage(spark, sf), 2, 3))


@register("slice_roll", with_(COV, f""",
b AS (SELECT *, CAST(floor((y * cos(radians(10)) - x * sin(radians(10))) / 3) AS BIGINT) AS band FROM cov),
m AS (SELECT *, CAST(floor({unit_noise('band', '0', '7')} * 7) AS BIGINT) - 3 AS amt FROM b)
SELECT image_id, CAST(((x + amt) % w + w) % w AS INT) AS x, y, plate, round(cov, 6) AS cov FROM m"""))
def slice_roll(spark, sf):
    return long(g.slice_roll(parts_coverage(spark, sf), 3, 3, angle=10.0))


@register("vertical_slice_shift", with_(PTS, remap("x", inside(f"y + {VSLICE}", "h")), OUT.format("moved")))
def vertical_slice_shift(spark, sf):
    return long(g.vertical_slice_shift(parts_coverage(spark, sf), 2, 4))


WARP = ("sin(y / 3e0) * 2.5e0", "cos(x / 3e0) * 2.5e0")


@register("grid_warp", with_(PTS, remap(inside(f"x + {WARP[0]}", "w"), inside(f"y + {WARP[1]}", "h")), OUT.format("moved")))
def grid_warp(spark, sf):
    return long(g.grid_warp(parts_coverage(spark, sf), 2.5, 3))


PULL = "((x * 17 + y * 31) % 5) * 0.7e0"


@register("smear_drag", with_(PTS, remap(inside(f"x + {PULL}", "w"), "y"), OUT.format("moved")))
def smear_drag(spark, sf):
    return long(g.smear_drag(parts_coverage(spark, sf), 0.7, 5))


@register("smear_band", with_(COV, f""",
b AS (SELECT *, {unit_noise('(y // 4)', '0', '(i + 701)')} <= 0.74e0 AS touched, {unit_noise('(y // 4)', '1', '(i + 701)')} >= 0.5 AS fwd FROM cov),
p AS (SELECT a.image_id, a.x, a.y, a.plate, a.touched, a.cov, max(c.cov * (1e0 - 0.8e0 * abs(a.x - c.x) / 5)) AS peak
      FROM b a JOIN cov c ON c.image_id = a.image_id AND c.plate = a.plate AND c.y = a.y
       AND CASE WHEN a.fwd THEN a.x - c.x ELSE c.x - a.x END BETWEEN 0 AND 5 GROUP BY ALL)
SELECT image_id, x, y, plate, round(CASE WHEN touched THEN least(1e0, greatest(0e0, cov * 0.76e0 + peak * 0.59e0)) ELSE cov END, 6) AS cov FROM p"""))
def smear_band(spark, sf):
    return long(g.smear_band(parts_coverage(spark, sf), 0.6, 5, block=8))


BLOCK = block_hash("(x // 4) * 4", "(y // 4) * 4", "i")
THIRD = lambda c: f"((({c}) // 4) % 3 - 1) * 2.4e0"
STEP = lambda bits: f"((({BLOCK}) >> {bits}) % 5 - 2) * 1.2e0"


@register("block_shift", with_(PTS, f"""
bt AS (SELECT *, {inside(f'x + {STEP(8)}', 'w')} AS tx, {inside(f'y + {STEP(16)}', 'h')} AS ty FROM pts)""",
                               remap(inside(f"tx + {THIRD('tx')}", "w"), inside(f"ty + {THIRD('ty')}", "h"), "bt"), OUT.format("moved")))
def block_shift(spark, sf):
    return long(g.block_shift(parts_coverage(spark, sf), 0.3, 4))


@register("channel_desync", with_(PTS, remap(inside("sx0 + 0.2e0 * (i + 1) * 8", "w"), "y",
                                             f"(SELECT *, {inside('x + 1.6e0', 'w')} AS sx0 FROM pts)"), OUT.format("moved")))
def channel_desync(spark, sf):
    return long(g.channel_desync(parts_coverage(spark, sf), 0.2, 4))


CORRUPT = f"""corrupted AS (SELECT image_id, w, h, x, y, plate, i, CASE WHEN p < 0.5e0 * 0.4e0 THEN 0e0 WHEN p < 0.5e0 THEN floor(cov * 4 + 0.5e0) / 4 ELSE cov END AS cov
  FROM (SELECT *, ({BLOCK} % 1000) / 1000e0 AS p FROM {{}}))"""


@register("macroblock_corrupt", with_(COV, CORRUPT.format("cov"), OUT.format("corrupted")))
def macroblock_corrupt(spark, sf):
    return long(g.macroblock_corrupt(parts_coverage(spark, sf), 0.5, 0.4, 4))


DRAW = lambda k: unit_noise("u", "v", f"(i * 64 + {911 + k})")
WHOLE = lambda k, low, count: f"CAST(floor({DRAW(k)} * ({count})) AS BIGINT) + ({low})"
WRAP = lambda v, n: f"((({v}) % ({n}) + ({n})) % ({n}))"


@register("macroblock_modes", with_(PTS, """
mb AS (SELECT *, x // 4 AS u, y // 4 AS v FROM pts)""", f"""
md AS (SELECT *, {DRAW(0)} AS d0, {DRAW(1)} AS d1, {WHOLE(4, -4, 9)} AS turn, {DRAW(5)} < 0.5e0 AS flat, {DRAW(7)} AS d7,
  least(greatest(u + {WHOLE(2, -2, 5)}, 0), (w - 1) // 4) * 4 + x - u * 4 AS ox,
  least(greatest(v + {WHOLE(3, -2, 5)}, 0), (h - 1) // 4) * 4 + y - v * 4 AS oy,
  1e0 / greatest(1, {WHOLE(6, 2, 4)} - 1) AS step FROM mb)""", f"""
mm AS (SELECT *, CASE WHEN d0 >= 0.5e0 THEN 'keep' WHEN d1 < 0.4e0 * 0.55e0 THEN 'dim' WHEN d1 < 0.55e0 THEN 'repeat' WHEN d1 < 0.82e0 THEN 'crush' ELSE 'roll' END AS mode,
  CASE WHEN flat THEN x ELSE u * 4 + {WRAP('x - u * 4 - turn', 'least(4, w - u * 4)')} END AS rx,
  CASE WHEN flat THEN v * 4 + {WRAP('y - v * 4 - turn', 'least(4, h - v * 4)')} ELSE y END AS ry FROM md)""",
    remap("CASE WHEN mode = 'roll' THEN rx WHEN mode = 'repeat' AND ox < w AND oy < h THEN ox ELSE x END",
          "CASE WHEN mode = 'roll' THEN ry WHEN mode = 'repeat' AND ox < w AND oy < h THEN oy ELSE y END", "mm"), """
SELECT image_id, x, y, plate, round(CASE mode WHEN 'dim' THEN cov * d7 * 0.25e0
  WHEN 'crush' THEN round_even(least(1e0, greatest(0e0, cov)) / step, 0) * step ELSE cov END, 6) AS cov FROM moved"""))
def macroblock_modes(spark, sf):
    return long(g.macroblock_modes(parts_coverage(spark, sf), 0.5, 0.4, 4))


@register("block_copy", with_(PTS, f"""
bd AS (SELECT *, x + CAST(floor({unit_noise('(x // 4)', '(y // 4)', '(i * 64 + 43)')} * 17) AS INT) - 8 AS ox, y + CAST(floor({unit_noise('(x // 4)', '(y // 4)', '(i * 64 + 44)')} * 17) AS INT) - 8 AS oy,
             {unit_noise('(x // 4)', '(y // 4)', '(i * 64 + 42)')} < 0.5 AS hit FROM pts),
be AS (SELECT *, hit AND ox >= 0 AND ox < w AND oy >= 0 AND oy < h AS ok FROM bd)""",
                              remap("CASE WHEN ok THEN ox ELSE x END", "CASE WHEN ok THEN oy ELSE y END", "be"), OUT.format("moved")))
def block_copy(spark, sf):
    return long(g.block_copy(parts_coverage(spark, sf), 0.5, 4))


# The generator's shuffle: where each line of a frame with n lines ends up, one swap per level.
WALK = """walk(n, i, line, k, state, place) AS (
  SELECT n, i, CAST(unnest(range(n)) AS INT) AS line, n - 1, CAST(99 + 17 * i AS BIGINT), CAST(unnest(range(n)) AS BIGINT)
  FROM (SELECT DISTINCT h AS n FROM heads), plates
  UNION ALL SELECT n, i, line, k - 1, s, CASE place WHEN k THEN o WHEN o THEN k ELSE place END
  FROM (SELECT *, (s * (k + 1)) >> 32 AS o FROM (SELECT *, (state * 1664525 + 1013904223) % 4294967296 AS s FROM walk WHERE k > 0)))"""


def sort_sql(source: str, name: str = "sorted") -> str:
    return f"""{WALK},
picks AS (SELECT n, i, line FROM walk WHERE k = 0 AND place < greatest(1, floor(n * 0.6e0))),
act AS (SELECT c.*, p.line IS NOT NULL AND cov > 0.1e0 AS active FROM {source} c LEFT JOIN picks p ON p.n = c.h AND p.i = c.i AND p.line = c.y),
isl AS (SELECT *, sum(CASE WHEN active THEN 0 ELSE 1 END) OVER (PARTITION BY image_id, plate, y ORDER BY x) AS g FROM act),
{name} AS (SELECT image_id, w, h, plate, i, y, cov, CASE WHEN active THEN CAST(min(x) OVER run + row_number() OVER (run ORDER BY cov, x) - 1 AS INT) ELSE x END AS x
  FROM isl WINDOW run AS (PARTITION BY image_id, plate, y, g, active))"""


def fray_sql(source: str, name: str = "frayed") -> str:
    h = lambda axis, a, b, reach: f"({scramble(f'{axis} * {a} + {b}')} % {reach + 1})"
    return f"""inkpx AS (SELECT * FROM {source} WHERE cov > 0.1e0),
fbox AS (SELECT image_id, plate, min(x) AS l, max(x) AS r, min(y) AS t, max(y) AS b FROM inkpx GROUP BY ALL),
frow AS (SELECT DISTINCT image_id, plate, y FROM inkpx), fcol AS (SELECT DISTINCT image_id, plate, x FROM inkpx),
fin AS (SELECT c.*, fb.l, fb.r, fb.t, fb.b, fr.y IS NOT NULL AS has_row, fc.x IS NOT NULL AS has_col,
  {h('c.y', 17, 701, 3)} AS il, {h('c.y', 31, 907, 3)} AS ir, {h('c.x', 17, 1301, 4)} AS it, {h('c.x', 31, 1709, 4)} AS ib
  FROM {source} c LEFT JOIN fbox fb ON fb.image_id = c.image_id AND fb.plate = c.plate
  LEFT JOIN frow fr ON fr.image_id = c.image_id AND fr.plate = c.plate AND fr.y = c.y LEFT JOIN fcol fc ON fc.image_id = c.image_id AND fc.plate = c.plate AND fc.x = c.x),
{name} AS (SELECT image_id, w, h, x, y, plate, i, CASE WHEN (has_row AND ((il > 0 AND x >= l AND x < l + il) OR (ir > 0 AND x >= r - ir AND x <= r)))
   OR (has_col AND ((it > 0 AND y >= t AND y < t + it) OR (ib > 0 AND y >= b - ib AND y <= b))) THEN 0e0 ELSE cov END AS cov FROM fin)"""


@register("bitmap_sort", with_(COV, sort_sql("cov"), OUT.format("sorted")))
def bitmap_sort(spark, sf):
    return long(g.bitmap_sort(parts_coverage(spark, sf), 0.6, spread=False))


@register("frayed_edges", with_(COV, fray_sql("cov"), OUT.format("frayed")))
def frayed_edges(spark, sf):
    return long(g.frayed_edges(parts_coverage(spark, sf), 2, 3, spread=False))


CHAIN = dict(sliceShift=2, sliceSize=3, verticalSliceShift=2, verticalSliceSize=4, gridWarp=2.5, warpScale=3,
             smearDrag=0.7, smearLength=5, macroblockCorrupt=0.5, macroblockDropout=0.4, blockShiftSize=4,
             channelDesync=0.2, bitmapSort=0.6)


@register("glitch_chain", with_(PTS, remap(
    inside(f"{inside(f'x + {SLICE} + {WARP[0]} + {PULL} + 1.6e0', 'w')} + 0.2e0 * (i + 1) * 8", "w"),
    inside(f"y + ({VSLICE}) + {WARP[1]}", "h")), CORRUPT.format("moved"), sort_sql("corrupted"), fray_sql("sorted"),
    OUT.format("frayed")))
def glitch_chain(spark, sf):
    return long(g.glitch_chain(parts_coverage(spark, sf), 2, 3, spread=False, **CHAIN))
