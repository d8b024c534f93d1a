"""Queries over blocks, text, depth, stereograms, paths and contours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fixed_values import BLOCK_FILL, CHARSETS, STRIP_PATTERNS
from ..functions.numeric import six
from ..operators import blocks as b
from ..operators import paths as pt
from .dithering import GRAY, blur_sql
from .fixture_sql import COV, PARTS, PLATE_DIM, unit_noise, with_
from .registry import register
from .separation import long
from .tables import (field_emb, part_headers, parts_coverage, path_targets, raster_parts, read, vector_paths)


@register("pixelate", with_(PARTS, """,
m AS (SELECT image_id, x // 4 AS bx, y // 4 AS by, CAST(trunc(sum(r) / count(*)) AS INT) AS r, CAST(trunc(sum(g) / count(*)) AS INT) AS g,
             CAST(trunc(sum(b) / count(*)) AS INT) AS b, CAST(trunc(sum(a) / count(*)) AS INT) AS a FROM parts GROUP BY ALL)
SELECT p.image_id, p.x, p.y, m.r, m.g, m.b, m.a FROM parts p JOIN m ON m.image_id = p.image_id AND m.bx = p.x // 4 AND m.by = p.y // 4"""))
def pixelate(spark, sf):
    return b.pixelate(raster_parts(spark, sf), 4).drop("w", "h")


@register("pixelate_plates", with_(COV, """,
m AS (SELECT image_id, x // 4 AS bx, y // 4 AS by, avg(cov) FILTER (i = 0) AS c, avg(cov) FILTER (i = 1) AS m, avg(cov) FILTER (i = 2) AS ye, avg(cov) FILTER (i = 3) AS k FROM cov GROUP BY ALL)
SELECT p.image_id, p.x, p.y, CAST(trunc(round((1 - c) * (1 - k) * 255, 6)) AS INT) AS r, CAST(trunc(round((1 - m) * (1 - k) * 255, 6)) AS INT) AS g, CAST(trunc(round((1 - ye) * (1 - k) * 255, 6)) AS INT) AS b
FROM parts p JOIN m ON m.image_id = p.image_id AND m.bx = p.x // 4 AND m.by = p.y // 4"""))
def pixelate_plates(spark, sf):
    return b.pixelate_plates(parts_coverage(spark, sf), 4).drop("w", "h")


STRIPS = """means AS (SELECT image_id, w, h, x // 5 AS bx, y // 5 AS "by", avg(cov) FILTER (i = 0) AS c, avg(cov) FILTER (i = 1) AS m, avg(cov) FILTER (i = 2) AS ye, avg(cov) FILTER (i = 3) AS k FROM cov GROUP BY ALL),
shave AS (SELECT image_id, w, h, bx, "by", bw, list_transform([c, m, ye, k], lambda v: CAST(round_even(round(v * bw, 9), 0) AS INT)) AS ws FROM (SELECT *, least(5, w - bx * 5) AS bw FROM means)
  UNION ALL SELECT image_id, w, h, bx, "by", bw, list_transform(range(1, 5), lambda j: CAST(CASE WHEN j = list_position(ws, list_max(ws)) THEN ws[j] - 1 ELSE ws[j] END AS INT)) FROM shave WHERE list_sum(ws) > bw),
fin AS (SELECT * FROM shave WHERE list_sum(ws) <= bw)"""


@register("apportion_strips", with_(COV, STRIPS, """
SELECT image_id, bx, "by", plate, CAST(bx * 5 + coalesce(list_sum(ws[1:i]), 0) AS INT) AS start, ws[i + 1] AS width, "by" * 5 AS top, least(5, h - "by" * 5) AS height
FROM fin, plates WHERE ws[i + 1] > 0"""))
def apportion_strips(spark, sf):
    return b.apportion_strips(parts_coverage(spark, sf), 5).drop("w", "h")


def _cells_sql(ramp: str, cell: int, invert: bool) -> str:
    n = len(ramp)
    steps = max(2, min(10, n))
    quoted = "'" + ramp.replace("'", "''") + "'"
    tone = "1e0 - pow(mean, 1e0 / 1.8e0)" if invert else "pow(mean, 1e0 / 1.8e0)"
    index = (f"CAST(trunc(least({steps - 1}, greatest(0, trunc(({tone}) * {steps - 1} + 0.5e0))) * {n - 1} / {max(1, steps - 1)}e0 + 0.5e0) AS INT)"
             if 10 <= n else f"CAST(trunc(({tone}) * {n - 1} + 0.5e0) AS INT)")
    return f"""cm AS (SELECT image_id, plate, CAST((y * greatest(1, h // {cell})) // h AS INT) AS row, CAST((x * greatest(1, w // {cell})) // w AS INT) AS col, round(avg(cov), 9) AS mean FROM cov GROUP BY ALL),
cells AS (SELECT *, substr({quoted}, least({n - 1}, greatest(0, {index})) + 1, 1) AS ch FROM cm)"""


@register("ascii_render", with_(COV, _cells_sql(CHARSETS["default"], 2, True), """
SELECT image_id, plate, row, string_agg(ch, '' ORDER BY col) AS line FROM cells GROUP BY image_id, plate, row"""))
def ascii_render(spark, sf):
    return b.ascii_render(parts_coverage(spark, sf), cell=2, invert=True)


@register("block_fill", with_(COV, _cells_sql(CHARSETS["blocks"], 3, False), "fills AS (SELECT * FROM (VALUES " +
                              ", ".join(f"('{c}', {v}e0)" for c, v in BLOCK_FILL) + ") t(ch, fill))", """,
rc AS (SELECT c.*, fill, CAST(trunc(3e0 * sqrt(fill)) AS INT) AS rw0, CAST(trunc(3e0 * sqrt(fill)) AS INT) AS rh0 FROM cells c JOIN fills f ON f.ch = c.ch WHERE fill > 0)
SELECT image_id, plate, row, col, ch, CAST(col * 3 + (3 - rw0) // 2 AS INT) AS rx, CAST(row * 3 + (3 - rh0) // 2 AS INT) AS ry, greatest(1, rw0) AS rw, greatest(1, rh0) AS rh FROM rc"""))
def block_fill(spark, sf):
    return b.block_fill(b.ascii_cells(parts_coverage(spark, sf), cell=3, charset="blocks"), 3)


GREY = "((r * 19595 + g * 38470 + b * 7471 + 32768) >> 16) / 255e0"


@register("depth_map", with_(PARTS, f"d0 AS (SELECT image_id, 'depth' AS plate, w, h, x, y, 1e0 - {GREY} AS cov FROM parts)",
                             blur_sql("d0", 0.8, "soft"), "SELECT image_id, x, y, round(cov, 6) AS depth FROM soft"))
def depth_map(spark, sf):
    return b.depth_map(raster_parts(spark, sf), invert=True, smooth=8).select(
        "image_id", "x", "y", six(F.col("cov")).alias("depth"))


def _pattern_sql(pattern: str, x: str, y: str, height: str, colors: int, offset: str) -> str:
    row = f"((({y} - {offset}) % {height} + {height}) % {height})"
    return f"""CAST(CASE {pattern} WHEN 'random dots' THEN floor({unit_noise(x, y, f'(42 + {offset})')} * {colors})
 WHEN 'horizontal lines' THEN {row} % {colors} WHEN 'vertical lines' THEN {x} % {colors} WHEN 'diagonal /' THEN ({x} + {row}) % {colors}
 WHEN 'diagonal \\' THEN (({x} - {row}) % {colors} + {colors}) % {colors} WHEN 'checkerboard' THEN ({x} // 2 + {row} // 2) % {colors}
 WHEN 'grid' THEN CASE WHEN {x} % 4 = 0 OR {row} % 4 = 0 THEN {colors - 1} ELSE ({x} // 4 + {row} // 4) % {max(1, colors - 1)} END END AS INT)"""


PATTERN_LIST = "[" + ",".join(f"'{p}'" for p in STRIP_PATTERNS) + "]"


@register("pattern_strip", with_(PARTS, f"""
SELECT image_id, pattern, "offset", x, y, {_pattern_sql('pattern', 'x', 'y', 'h', 3, '"offset"')} AS color
FROM (SELECT *, list_extract({PATTERN_LIST}, CAST(image_id % 7 + 1 AS INT)) AS pattern, CAST(image_id % 3 AS INT) AS "offset" FROM parts)"""))
def pattern_strip(spark, sf):
    k = F.col("image_id")
    frames = part_headers(spark, sf).select(
        "image_id", F.col("w").alias("width"), F.col("h").alias("height"),
        F.get(F.array(*[F.lit(p) for p in STRIP_PATTERNS]), (k % 7).cast("int")).alias("pattern"),
        (k % 3).cast("int").alias("offset"))
    return b.pattern_strip(frames).drop("width", "height")


def depth_fields(spark, sf):
    """Grey depth of the parts, and every embedding vector as a one-line image."""
    parts = b.depth_map(raster_parts(spark, sf), smooth=0)
    vec = field_emb(spark, sf).select((-1 - F.col("y")).alias("image_id"), "w", F.lit(1).alias("h"),
                                      F.lit("depth").alias("plate"), "x", F.lit(0).alias("y"), "cov")
    return parts.unionByName(vec)


DEPTH = f"""depth AS (SELECT image_id, w, h, x, y, {GREY} AS cov FROM parts
  UNION ALL SELECT -1 - vec_id, 64, 1, CAST(unnest(range(64)) AS INT), 0, least(1e0, greatest(0e0, 0.5e0 + CAST(unnest(embedding) AS DOUBLE))) FROM embeddings),
par AS (SELECT image_id, w, h, x, y, CASE WHEN x < 5 THEN x WHEN s >= 0 AND s < x THEN s ELSE greatest(0, x - 5) END AS parent
  FROM (SELECT *, CAST(x - 5 + least(CAST(trunc(5e0 * cov) AS INT), x - 1) AS INT) AS s FROM depth)),
walk AS (SELECT image_id, w, h, x, y, parent AS cur FROM par
  UNION ALL SELECT k.image_id, k.w, k.h, k.x, k.y, p.parent FROM walk k JOIN par p ON p.image_id = k.image_id AND p.y = k.y AND p.x = k.cur WHERE k.cur >= 5),
painted AS (SELECT image_id, w, h, x, y, {_pattern_sql("'checkerboard'", 'cur', 'y', 'h', 4, '2')} AS color FROM walk WHERE cur < 5)"""


@register("stereogram", with_(PARTS, DEPTH, "SELECT image_id, x, y, color FROM painted"))
def stereogram(spark, sf):
    return b.stereogram(depth_fields(spark, sf), separation=5, intensity=100, dot=1, colors=4, pattern="checkerboard",
                        offset=2).drop("w", "h")


@register("stereo_plates", with_(PLATE_DIM, PARTS, DEPTH, f""",
ink AS (SELECT image_id, x, y, plate, i FROM painted JOIN plates ON i = color WHERE image_id >= 0),
bx AS (SELECT image_id, plate, min(x) AS lo, max(x) AS hi FROM ink GROUP BY ALL),
kept AS (SELECT k.* FROM ink k JOIN bx USING (image_id, plate)
  WHERE NOT (CAST(floor({unit_noise('y', 'i', '42')} * 9) AS INT) - 4 > 0 AND x < lo + 10)
    AND NOT (CAST(floor({unit_noise('y', 'i', '142')} * 9) AS INT) - 4 < 0 AND x >= hi - 10))
SELECT p.image_id, p.x, p.y, CASE WHEN p.a > 0 AND plate IN ('cyan', 'black') THEN 0 ELSE 255 END AS r, CASE WHEN p.a > 0 AND plate IN ('magenta', 'black') THEN 0 ELSE 255 END AS g,
  CASE WHEN p.a > 0 AND plate IN ('yellow', 'black') THEN 0 ELSE 255 END AS b, p.a FROM parts p LEFT JOIN kept k ON k.image_id = p.image_id AND k.x = p.x AND k.y = p.y"""))
def stereo_plates(spark, sf):
    px = raster_parts(spark, sf)
    colored = b.stereogram(b.depth_map(px, smooth=0), separation=5, intensity=100, dot=1, colors=4,
                           pattern="checkerboard", offset=2)
    return b.compose_stereo(b.stereo_plates(colored, 4, fray_x=3), px)


VPATHS = """vp AS (SELECT path_id, seq, 6e0 * seq + 20e0 * e AS px, 60e0 + 80e0 * e AS py FROM
  (SELECT vec_id AS path_id, CAST(unnest(range(64)) AS INT) AS seq, CAST(unnest(embedding) AS DOUBLE) AS e FROM embeddings))"""
TANGENTS = """tg0 AS (SELECT *, coalesce(lead(px, 3) OVER w, lead(px, 2) OVER w, lead(px, 1) OVER w, px) - coalesce(lag(px, 3) OVER w, lag(px, 2) OVER w, lag(px, 1) OVER w, px) AS dx,
   coalesce(lead(py, 3) OVER w, lead(py, 2) OVER w, lead(py, 1) OVER w, py) - coalesce(lag(py, 3) OVER w, lag(py, 2) OVER w, lag(py, 1) OVER w, py) AS dy,
   coalesce(sqrt((px - lag(px) OVER w) * (px - lag(px) OVER w) + (py - lag(py) OVER w) * (py - lag(py) OVER w)), 0e0) AS step
  FROM vp WINDOW w AS (PARTITION BY path_id ORDER BY seq)),
tg AS (SELECT path_id, seq, px, py, degrees(atan2(dy, dx)) AS tangent, sum(step) OVER (PARTITION BY path_id ORDER BY seq) AS arc FROM tg0)"""


@register("smooth_path", with_(VPATHS, """,
c AS (SELECT *, coalesce(lag(px) OVER w, px) AS px0, coalesce(lag(py) OVER w, py) AS py0, lead(px) OVER w AS px2, lead(py) OVER w AS py2,
  coalesce(lead(px, 2) OVER w, lead(px) OVER w) AS px3, coalesce(lead(py, 2) OVER w, lead(py) OVER w) AS py3 FROM vp WINDOW w AS (PARTITION BY path_id ORDER BY seq)),
s AS (SELECT *, CASE WHEN px2 IS NULL THEN 1 ELSE greatest(3, CAST(trunc(sqrt(pow(px2 - px, 2) + pow(py2 - py, 2)) / 2e0) AS INT)) END AS pieces FROM c),
e AS (SELECT *, step / CAST(pieces AS DOUBLE) AS t FROM (SELECT *, CAST(unnest(range(pieces)) AS INT) AS step FROM s))
SELECT path_id, seq, step, round(CASE WHEN px2 IS NULL THEN px ELSE 0.5e0 * (2 * px + (px2 - px0) * t + (2 * px0 - 5 * px + 4 * px2 - px3) * (t * t) + (3 * px - px0 - 3 * px2 + px3) * (t * t * t)) END, 6) AS sx,
  round(CASE WHEN px2 IS NULL THEN py ELSE 0.5e0 * (2 * py + (py2 - py0) * t + (2 * py0 - 5 * py + 4 * py2 - py3) * (t * t) + (3 * py - py0 - 3 * py2 + py3) * (t * t * t)) END, 6) AS sy FROM e"""))
def smooth_path(spark, sf):
    out = pt.smooth_path(vector_paths(spark, sf), chunk=16)
    return out.select("path_id", "seq", "step", six(F.col("sx")).alias("sx"), six(F.col("sy")).alias("sy"))


@register("path_tangents", with_(VPATHS, TANGENTS, "SELECT path_id, seq, round(tangent, 6) AS tangent, round(arc, 6) AS arc FROM tg"))
def path_tangents(spark, sf):
    out = pt.path_tangents(vector_paths(spark, sf), chunk=16)
    return out.select("path_id", "seq", six(F.col("tangent")).alias("tangent"), six(F.col("arc")).alias("arc"))


@register("nearest_path_angle", with_(VPATHS, TANGENTS, """,
sg AS (SELECT path_id, seq, px AS x1, py AS y1, lead(px) OVER w AS x2, lead(py) OVER w AS y2, tangent AS a1, lead(tangent) OVER w AS a2 FROM tg WINDOW w AS (PARTITION BY path_id ORDER BY seq)),
pts AS (SELECT vec_id AS path_id, j * 12 + i AS point_id, i * 32e0 + 16e0 AS x, j * 24e0 + 12e0 AS y FROM embeddings, (SELECT unnest(range(5)) AS j), (SELECT unnest(range(12)) AS i)),
near AS (SELECT p.*, s.seq, s.a1, s.a2, s.x1, s.y1, s.x2, s.y2, least(1e0, greatest(0e0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) + 1e-10))) AS t
  FROM pts p JOIN sg s ON s.path_id = p.path_id AND s.x2 IS NOT NULL AND (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) >= 0.001),
best AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY path_id, point_id ORDER BY sqrt((x - (x1 + t * (x2 - x1))) * (x - (x1 + t * (x2 - x1))) + (y - (y1 + t * (y2 - y1))) * (y - (y1 + t * (y2 - y1)))), seq) = 1),
raw AS (SELECT b.path_id, b.point_id, b.seq, b.a1 + b.t * ((CASE WHEN b.a2 - b.a1 > 180 THEN b.a2 - 360 WHEN b.a2 - b.a1 < -180 THEN b.a2 + 360 ELSE b.a2 END) - b.a1) AS ang,
   (b.x - h.x1) * (h.x2 - h.x1) + (b.y - h.y1) * (h.y2 - h.y1) < 0 AS before, (b.x - e.x1) * (e.x2 - e.x1) + (b.y - e.y1) * (e.y2 - e.y1) > (e.x2 - e.x1) * (e.x2 - e.x1) + (e.y2 - e.y1) * (e.y2 - e.y1) AS after, h.a1 AS ha, e.a2 AS ea
  FROM best b JOIN sg h ON h.path_id = b.path_id AND h.seq = 0 JOIN sg e ON e.path_id = b.path_id AND e.seq = 62),
fin AS (SELECT *, CASE WHEN after THEN ea WHEN before THEN ha ELSE ang END AS g FROM raw)
SELECT path_id, point_id, seq AS nearest, round(degrees(atan2(sin(30e0 * 3.141592653589793e0 / 180e0) * 0.25e0 + sin(g * 3.141592653589793e0 / 180e0) * 0.75e0,
  cos(30e0 * 3.141592653589793e0 / 180e0) * 0.25e0 + cos(g * 3.141592653589793e0 / 180e0) * 0.75e0)), 6) AS angle FROM fin"""))
def nearest_path_angle(spark, sf):
    out = pt.nearest_path_angle(path_targets(spark, sf), vector_paths(spark, sf), 30.0, 0.75, chunk=8)
    return out.select("path_id", "point_id", "nearest", six(F.col("angle")).alias("angle"))


@register("iso_contours", with_(COV, """,
f AS (SELECT image_id, plate, x, y, cov FROM cov),
cl AS (SELECT a.image_id, a.plate, a.x, a.y, a.cov AS tl, b.cov AS tr, c.cov AS bl, d.cov AS br,
  CAST(a.cov > 0.5e0 AS INT) + 2 * CAST(b.cov > 0.5e0 AS INT) + 4 * CAST(d.cov > 0.5e0 AS INT) + 8 * CAST(c.cov > 0.5e0 AS INT) AS k
  FROM f a JOIN f b ON b.image_id = a.image_id AND b.plate = a.plate AND b.x = a.x + 1 AND b.y = a.y JOIN f c ON c.image_id = a.image_id AND c.plate = a.plate AND c.x = a.x AND c.y = a.y + 1
  JOIN f d ON d.image_id = a.image_id AND d.plate = a.plate AND d.x = a.x + 1 AND d.y = a.y + 1),
e AS (SELECT *, x + CASE WHEN abs(tr - tl) < 0.001e0 THEN 0.5e0 ELSE (0.5e0 - tl) / (tr - tl) END AS tx, x + CASE WHEN abs(br - bl) < 0.001e0 THEN 0.5e0 ELSE (0.5e0 - bl) / (br - bl) END AS bx,
  y + CASE WHEN abs(bl - tl) < 0.001e0 THEN 0.5e0 ELSE (0.5e0 - tl) / (bl - tl) END AS ly, y + CASE WHEN abs(br - tr) < 0.001e0 THEN 0.5e0 ELSE (0.5e0 - tr) / (br - tr) END AS ry FROM cl WHERE k BETWEEN 1 AND 14),
o AS (SELECT *, CASE WHEN k IN (1, 14, 5) THEN 'TL' WHEN k IN (2, 13, 10) THEN 'TR' WHEN k IN (4, 11) THEN 'RB' WHEN k IN (7, 8) THEN 'LB' WHEN k IN (3, 12) THEN 'LR' ELSE 'TB' END AS s, 0 AS seg FROM e
  UNION ALL SELECT *, CASE k WHEN 5 THEN 'RB' ELSE 'LB' END, 1 FROM e WHERE k IN (5, 10))
SELECT image_id, plate, x, y, seg, round(CASE s[1] WHEN 'T' THEN tx WHEN 'L' THEN x ELSE x + 1 END, 6) AS x1, round(CASE s[1] WHEN 'T' THEN y WHEN 'L' THEN ly ELSE ry END, 6) AS y1,
  round(CASE s[2] WHEN 'L' THEN x WHEN 'R' THEN x + 1 ELSE bx END, 6) AS x2, round(CASE s[2] WHEN 'L' THEN ly WHEN 'R' THEN ry ELSE y + 1 END, 6) AS y2 FROM o"""))
def iso_contours(spark, sf):
    out = b.iso_contours(parts_coverage(spark, sf))
    return out.select("image_id", "plate", "x", "y", "seg", *[six(F.col(c)).alias(c) for c in ("x1", "y1", "x2", "y2")])
