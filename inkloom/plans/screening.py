"""Queries over screens and marks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fixed_values import ANGLE_PRESETS, PLATES
from ..functions.numeric import six
from ..functions.plates import plate_index
from ..operators import screen as sc
from ..operators.geometry import sheet_dims
from ..operators.separate import content_bounds
from ..session import deal_sheets
from .fixture_sql import (COV, JOBS, JOB_PLATES, LUM, PARTS, PLATE_DIM, PRESET_DIM, half_up, marks_of, unit_noise,
                          with_)
from .registry import register
from .tables import jobs, part_headers, parts_coverage, raster_parts


def screen_headers(spark, sf):
    """Lattice headers: each part printed at three times its size, cell 4..6, angles from its preset."""
    heads = deal_sheets(part_headers(spark, sf))
    preset = F.array(*[F.array(*[F.lit(a) for a in p[1:]]) for p in ANGLE_PRESETS])
    heads = heads.select("image_id", F.col("w").alias("sw"), F.col("h").alias("sh"), (F.col("w") * 3).alias("w"),
                         (F.col("h") * 3).alias("h"), (4 + F.col("image_id") % 3).cast("double").alias("cell"),
                         F.explode(F.array(*[F.lit(p) for p in PLATES])).alias("plate"))
    return heads.withColumn("angle", F.get(F.get(preset, (F.col("image_id") % 4).cast("int")), plate_index("plate")))


HEADERS = f"""scr AS (
  SELECT image_id, w AS sw, h AS sh, w * 3 AS w, h * 3 AS h, CAST(4 + image_id % 3 AS DOUBLE) AS cell, plate, i,
         CASE i WHEN 0 THEN a0 WHEN 1 THEN a1 WHEN 2 THEN a2 ELSE a3 END AS angle,
         CASE i WHEN 0 THEN a0 WHEN 1 THEN a1 WHEN 2 THEN a2 ELSE a3 END * 3.141592653589793e0 / 180e0 AS th
  FROM heads JOIN presets p ON p.k = image_id % 4, plates)"""
WEB = """web_axes AS (SELECT *, ceil(sqrt(CAST(w * w + h * h AS DOUBLE))) / 2e0 + cell AS half FROM scr),
web_grid AS (SELECT *, unnest(range(n)) AS v_idx FROM (SELECT *, unnest(range(n)) AS u_idx FROM
  (SELECT *, CAST(floor(half * 2 / cell) AS BIGINT) + 1 AS n FROM web_axes))),
web AS (SELECT * FROM (SELECT *, w / 2e0 + (-half + u_idx * cell) * cos(th) - (-half + v_idx * cell) * sin(th) AS cx,
               h / 2e0 + (-half + u_idx * cell) * sin(th) + (-half + v_idx * cell) * cos(th) AS cy FROM web_grid)
        WHERE cx >= -cell AND cy >= -cell AND cx <= w + cell AND cy <= h + cell)"""
DESK = """desk_axes AS (SELECT *, w * abs(cos(th)) + h * abs(sin(th)) AS ew, w * abs(sin(th)) + h * abs(cos(th)) AS eh FROM scr),
desk_grid AS (SELECT *, unnest(range(greatest(1, CAST(ceil(eh / cell) AS BIGINT)))) AS v_idx FROM
  (SELECT *, unnest(range(greatest(1, CAST(ceil(ew / cell) AS BIGINT)))) AS u_idx FROM desk_axes)),
desk AS (SELECT * FROM (SELECT *,
    w / 2e0 + (-ew / 2 + (u_idx + 0.5e0) * cell) * cos(th) - (-eh / 2 + (v_idx + 0.5e0) * cell) * sin(th) AS cx,
    h / 2e0 + (-ew / 2 + (u_idx + 0.5e0) * cell) * sin(th) + (-eh / 2 + (v_idx + 0.5e0) * cell) * cos(th) AS cy FROM desk_grid)
  WHERE cx >= 0 AND cx < w AND cy >= 0 AND cy < h)"""
BOUNDS = f"""box AS (SELECT image_id, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y
  FROM parts WHERE {LUM} < 250 GROUP BY 1)"""
SAMPLED = f"""sampled AS (SELECT m.*, c.cov, cell * sqrt(c.cov) * 1.04e0 AS size
  FROM (SELECT web.*, CAST(least(sw - 1, greatest(0, {half_up('cx / w * sw')})) AS INT) AS sx,
               CAST(least(sh - 1, greatest(0, {half_up('cy / h * sh')})) AS INT) AS sy
        FROM web JOIN box USING (image_id) WHERE cx >= min_x / sw * w AND cx <= max_x / sw * w
         AND cy >= min_y / sh * h AND cy <= max_y / sh * h) m
  JOIN cov c ON c.image_id = m.image_id AND c.plate = m.plate AND c.x = sx AND c.y = sy)"""
DESK_SAMPLED = """dsampled AS (SELECT m.*, c.cov, 0.5e0 * cell * pow(c.cov, 1e0 / 1.8e0) AS radius FROM desk m
  JOIN cov c ON c.image_id = m.image_id AND c.plate = m.plate AND c.x = CAST(trunc(m.cx / 3) AS INT) AND c.y = CAST(trunc(m.cy / 3) AS INT))"""
BASE = [PLATE_DIM, PRESET_DIM, PARTS, HEADERS]
COV_BASE = [COV, PRESET_DIM, HEADERS]
POINT = "image_id, plate, u_idx, v_idx, round(cx, 6) + 0e0 AS cx, round(cy, 6) + 0e0 AS cy"


def point(df, *more):
    return df.select("image_id", "plate", F.col("u_idx").cast("bigint").alias("u_idx"),
                     F.col("v_idx").cast("bigint").alias("v_idx"), six(F.col("cx")).alias("cx"),
                     six(F.col("cy")).alias("cy"), *more)


def sampled(spark, sf, inked=False):
    """Sampled marks; with ``inked`` only those with any coverage (the others never print)."""
    px = raster_parts(spark, sf)
    marks = sc.screen_lattice(sc.with_bounds(screen_headers(spark, sf), content_bounds(px)), spread=False)
    cov = parts_coverage(spark, sf)
    return sc.sample_coverage(marks, cov.where(F.col("cov") > 0) if inked else cov)


def sampled_desktop(spark, sf):
    """Desktop lattice over the enlarged frame, sampled from coverage of the same enlargement."""
    cov = parts_coverage(spark, sf)
    marks = sc.screen_lattice_desktop(screen_headers(spark, sf), spread=False)
    at = marks.withColumns({"bx": F.col("cx"), "by": F.col("cy"), "cx": F.col("cx") / 3, "cy": F.col("cy") / 3})
    got = sc.sample_coverage(at, cov, variant="desktop")
    return got.withColumns({"cx": F.col("bx"), "cy": F.col("by")}).drop("bx", "by")


@register("screen_lattice", with_(*BASE, WEB, f"SELECT {POINT} FROM web"))
def screen_lattice(spark, sf):
    return point(sc.screen_lattice(screen_headers(spark, sf), spread=False))


@register("screen_lattice_desktop", with_(*BASE, DESK, f"SELECT {POINT} FROM desk"))
def screen_lattice_desktop(spark, sf):
    return point(sc.screen_lattice_desktop(screen_headers(spark, sf), spread=False))


@register("bumped_lattice", with_(PLATE_DIM, PRESET_DIM, PARTS, HEADERS.replace("scr AS (", "fine AS ("), f"""
scr AS (SELECT * REPLACE (CASE WHEN marks > 40 THEN cell * sqrt(marks / 40e0) ELSE cell END AS cell)
        FROM (SELECT *, {marks_of('w', 'h', 'cell', 'angle')} AS marks FROM fine))""", DESK, f"SELECT {POINT} FROM desk"))
def bumped_lattice(spark, sf):
    heads = screen_headers(spark, sf)
    coarse = heads.withColumn("cell", sc.bump_cell(F.col("w"), F.col("h"), F.col("cell"), F.col("angle"), 40))
    return point(sc.screen_lattice_desktop(coarse, spread=False))


@register("sample_coverage", with_(*COV_BASE, WEB, BOUNDS, SAMPLED, f"SELECT {POINT}, round(cov, 6) AS cov FROM sampled"))
def sample_coverage(spark, sf):
    return point(sampled(spark, sf), six(F.col("cov")).alias("cov"))


@register("dot_size", with_(*COV_BASE, WEB, BOUNDS, SAMPLED,
                            f"SELECT {POINT}, round(size, 6) AS size FROM sampled WHERE size > 0.12"))
def dot_size(spark, sf):
    return point(sc.dot_size(sampled(spark, sf, inked=True)), six(F.col("size")).alias("size"))


@register("dot_size_desktop", with_(*COV_BASE, DESK, DESK_SAMPLED,
                                    f"SELECT {POINT}, round(radius, 6) AS radius FROM dsampled WHERE radius > 0.05"))
def dot_size_desktop(spark, sf):
    return point(sc.dot_size_desktop(sampled_desktop(spark, sf)), six(F.col("radius")).alias("radius"))


@register("dot_geometry", with_(COV, """,
m AS (SELECT image_id, plate, x, y, sqrt(cov) * 4.16e0 AS d, sqrt(cov) * 4.16e0 / 2 AS q,
  list_extract(['round','square','diamond','triangle','cross','line','circle-outline','custom'], CAST(image_id % 8 + 1 AS INT)) AS shape FROM cov WHERE cov > 0)
SELECT image_id, plate, x, y, shape, round(d, 6) AS box_w, round(CASE WHEN shape = 'line' THEN d * 0.32e0 ELSE d END, 6) AS box_h,
 round(CASE shape WHEN 'square' THEN d * d WHEN 'custom' THEN d * d WHEN 'diamond' THEN d * d / 2 WHEN 'triangle' THEN d * d / 2
  WHEN 'line' THEN (d - d * 0.32e0) * (d * 0.32e0) + pi() * (d * 0.32e0) * (d * 0.32e0) / 4 WHEN 'cross' THEN 2 * d * (d * 0.28e0) - (d * 0.28e0) * (d * 0.28e0)
  WHEN 'circle-outline' THEN pi() * (q * q - greatest(0e0, q - 1) * greatest(0e0, q - 1)) ELSE pi() * q * q END, 6) AS area FROM m"""))
def dot_geometry(spark, sf):
    from .files import shaped_marks
    g = sc.dot_geometry(shaped_marks(spark, sf))
    return g.select("image_id", "plate", F.col("u_idx").alias("x"), F.col("v_idx").alias("y"), "shape",
                    *[six(F.col(c)).alias(c) for c in ("box_w", "box_h", "area")])


@register("line_marks", with_(*COV_BASE, WEB, BOUNDS, SAMPLED, f""",
ln AS (SELECT *, (cell * 3e0) * 1e0 * cov * (150e0 / 100) AS len,
   greatest(1, CAST(trunc(3e0 * (1e0 + ({unit_noise('u_idx', 'v_idx', '5')} - 0.5e0) * 0.4e0 * 2)) AS BIGINT)) AS base FROM sampled),
sg AS (SELECT *, unnest(range(pieces)) AS seg FROM (SELECT *, CAST(greatest(3, trunc(len / 5)) AS BIGINT) AS pieces FROM ln WHERE len > 0.10)),
pp AS (SELECT *, seg / CAST(pieces - 1 AS DOUBLE) AS pr, len / pieces * 1.2e0 AS pl FROM sg)
SELECT image_id, plate, u_idx, v_idx, CAST(seg AS INT) AS seg,
  round(cx + len * cos(th) / 2 * ((pr - 0.5e0) * 2) - pl * cos(th) / 2, 6) + 0e0 AS x1, round(cy + len * sin(th) / 2 * ((pr - 0.5e0) * 2) - pl * sin(th) / 2, 6) + 0e0 AS y1,
  round(cx + len * cos(th) / 2 * ((pr - 0.5e0) * 2) + pl * cos(th) / 2, 6) + 0e0 AS x2, round(cy + len * sin(th) / 2 * ((pr - 0.5e0) * 2) + pl * sin(th) / 2, 6) + 0e0 AS y2,
  CAST(greatest(1, trunc(base * (1e0 - abs(pr - 0.5e0) * 2 * 0.6e0))) AS INT) AS width FROM pp"""))
def line_marks(spark, sf):
    out = sc.line_marks(sampled(spark, sf, inked=True), stroke=3.0, length_pct=150.0, density_pct=3.0, taper=0.6, variation=0.4)
    return out.select("image_id", "plate", F.col("u_idx").cast("bigint").alias("u_idx"),
                      F.col("v_idx").cast("bigint").alias("v_idx"), "seg",
                      *[six(F.col(c)).alias(c) for c in ("x1", "y1", "x2", "y2")], "width")


@register("lines_invert", with_(COV, """
SELECT image_id, x, y, plate, round(CASE WHEN cov > 0.02 THEN 1e0 - cov ELSE 0e0 END, 6) AS cov FROM cov"""))
def lines_invert(spark, sf):
    return parts_coverage(spark, sf).select("image_id", "x", "y", "plate",
                                            six(sc.lines_invert(F.col("cov"))).alias("cov"))


@register("bump_cell", with_(JOBS, f"""
SELECT job_id, round(CASE WHEN t > 800000 THEN cell_size * sqrt(t / 800000e0) ELSE cell_size END, 6) AS cell
FROM (SELECT *, {marks_of('sheet_w', 'sheet_h', 'cell_size', 'a1')} AS t FROM jobs)"""))
def bump_cell(spark, sf):
    j = sheet_dims(jobs(spark, sf))
    return j.select("job_id", six(sc.bump_cell(F.col("sheet_w"), F.col("sheet_h"), F.col("cell_size"),
                                               F.col("angles.magenta"))).alias("cell"))


def _smooth(x: str, y: str, cell: str, seed: str) -> str:
    x0, y0 = f"CAST(floor({x} / {cell}) AS BIGINT)", f"CAST(floor({y} / {cell}) AS BIGINT)"
    tx, ty = f"({x} / {cell} - {x0})", f"({y} / {cell} - {y0})"
    n = lambda dx, dy: unit_noise(f"({x0} + {dx})", f"({y0} + {dy})", seed)
    return (f"(({n(0, 0)} * (1 - {tx}) + {n(1, 0)} * {tx}) * (1 - {ty}) + "
            f"({n(0, 1)} * (1 - {tx}) + {n(1, 1)} * {tx}) * {ty})")


@register("warp_lattice", with_(*BASE, DESK, f""",
k AS (SELECT *, CAST(least(w, h) AS DOUBLE) / greatest(2, CAST(trunc(least(w, h) * 1e0 / 5) AS BIGINT)) AS sp, floor(cx) AS fx, floor(cy) AS fy FROM desk),
o AS (SELECT *, ({_smooth('fx', 'fy', 'sp', '1234')} * 2 - 1) * 6e0 AS off FROM k)
SELECT image_id, plate, u_idx, v_idx, round(least(w - 1e0, greatest(0e0, cx + off)), 6) AS cx, round(least(h - 1e0, greatest(0e0, cy + off)), 6) AS cy FROM o"""))
def warp_lattice(spark, sf):
    return point(sc.warp_lattice(sc.screen_lattice_desktop(screen_headers(spark, sf), spread=False), 6.0))


SPLAT = """disc AS (SELECT image_id, plate, w, h, CAST(round_even(cx, 0) AS INT) AS px, CAST(round_even(cy, 0) AS INT) AS py,
  CAST(CASE WHEN greatest(1, round_even(radius * 2, 0)) <= 2 THEN 0 ELSE floor(round_even(radius * 2, 0) / 2) END AS INT) AS reach FROM {0}),
splat AS (SELECT DISTINCT image_id, plate, w, h, CAST(px + dx AS INT) AS x, CAST(py + dy AS INT) AS y
  FROM (SELECT *, unnest(range(-reach, reach + 1)) AS dx FROM (SELECT *, unnest(range(-reach, reach + 1)) AS dy FROM disc))
  WHERE dx * dx + dy * dy <= reach * reach AND px + dx >= 0 AND px + dx < w AND py + dy >= 0 AND py + dy < h)"""


@register("splat_marks", with_(*COV_BASE, DESK, DESK_SAMPLED,
                               SPLAT.format("(SELECT * FROM dsampled WHERE radius > 0.05)"),
                               "SELECT image_id, plate, x, y, 1e0 AS cov FROM splat"))
def splat_marks(spark, sf):
    marks = sc.dot_size_desktop(sampled_desktop(spark, sf))
    return sc.splat_marks(marks).select("image_id", "plate", "x", "y", "cov")


@register("moire_swatch", with_(*BASE, DESK, SPLAT.format(
    "(SELECT *, 0.5e0 * cell * pow(0.6e0, 1e0 / 1.8e0) AS radius FROM desk)"), """,
px AS (SELECT image_id, x, y, max(CAST(plate = 'cyan' AS INT)) AS c, max(CAST(plate = 'magenta' AS INT)) AS m,
              max(CAST(plate = 'yellow' AS INT)) AS ye, max(CAST(plate = 'black' AS INT)) AS k FROM splat GROUP BY ALL)
SELECT image_id, x, y, (1 - c) * (1 - k) * 255 AS r, (1 - m) * (1 - k) * 255 AS g, (1 - ye) * (1 - k) * 255 AS b FROM px"""))
def moire_swatch(spark, sf):
    return sc.moire_swatch(screen_headers(spark, sf), spread=False).drop("w", "h")


@register("registration_marks", with_(JOB_PLATES, f""",
f AS (SELECT job_id, plate, sheet_w AS w, sheet_h AS h, CAST(greatest(7, {half_up('least(sheet_w, sheet_h) * 0.014e0')}) AS DOUBLE) AS size,
             CAST(greatest(14, {half_up('least(sheet_w, sheet_h) * 0.035e0')}) AS DOUBLE) AS o FROM job_plates WHERE registration)
SELECT job_id, plate, CAST(m AS INT) AS mark, CASE WHEN m % 2 = 0 THEN o ELSE w - o END AS x, CASE WHEN m < 2 THEN o ELSE h - o END AS y,
       size, 1e0 AS weight FROM f, (SELECT unnest(range(4)) AS m)"""))
def registration_marks(spark, sf):
    return sc.registration_marks(registered_frames(spark, sf)).drop("w", "h")


def registered_frames(spark, sf):
    from ..operators.preflight import job_plates
    j = sheet_dims(jobs(spark, sf)).where("registration")
    return j.select("job_id", F.col("sheet_w").alias("w"), F.col("sheet_h").alias("h"),
                    F.explode(F.transform(job_plates(), lambda p: p["plate"])).alias("plate"))


@register("registration_marks_desktop", with_(JOB_PLATES, """,
f AS (SELECT job_id, plate, sheet_w AS w, sheet_h AS h, CAST(60 + job_id % 80 AS DOUBLE) AS size, CAST(90 + job_id % 40 AS DOUBLE) AS o FROM job_plates WHERE registration)
SELECT job_id, plate, CAST(m AS INT) AS mark, CASE WHEN m IN (0, 3) THEN o ELSE w - o END AS x, CASE WHEN m < 2 THEN o ELSE h - o END AS y,
       size, greatest(1e0, round_even(greatest(2e0, round_even(size * 0.06e0, 0)) * 1.5e0, 0)) AS weight FROM f, (SELECT unnest(range(4)) AS m)"""))
def registration_marks_desktop(spark, sf):
    marks = sc.registration_marks(registered_frames(spark, sf), size=60 + F.col("job_id") % 80, offset=90 + F.col("job_id") % 40, weight=1.5, variant="desktop")
    return marks.drop("w", "h")


@register("displace_plate", with_(COV, """
SELECT image_id, plate, x + dx AS x, y + dy AS y, round(cov, 6) AS cov FROM (
  SELECT *, CASE plate WHEN 'cyan' THEN 2 WHEN 'magenta' THEN -1 ELSE 0 END AS dx, CASE plate WHEN 'cyan' THEN -1 WHEN 'yellow' THEN 3 ELSE 0 END AS dy FROM cov)
WHERE x + dx >= 0 AND x + dx < w AND y + dy >= 0 AND y + dy < h"""))
def displace_plate(spark, sf):
    from ..functions.plates import plate_case
    dx = plate_case({"cyan": 2, "magenta": -1, "yellow": 0, "black": 0})
    dy = plate_case({"cyan": -1, "magenta": 0, "yellow": 3, "black": 0})
    return sc.displace_plate(parts_coverage(spark, sf), dx, dy).select(
        "image_id", "plate", "x", "y", six(F.col("cov")).alias("cov"))


@register("mark_histogram", with_(*COV_BASE, WEB, BOUNDS, SAMPLED, """
SELECT plate, CAST(floor(size / 0.5e0) AS INT) AS size_class, count(*) AS marks FROM sampled WHERE size > 0.12 GROUP BY ALL"""))
def mark_histogram(spark, sf):
    return sc.mark_histogram(sc.dot_size(sampled(spark, sf, inked=True)))


@register("densest_tiles", with_(*COV_BASE, WEB, BOUNDS, SAMPLED, """,
t AS (SELECT plate, image_id, CAST(floor(cx / 16) AS INT) AS tile_x, CAST(floor(cy / 16) AS INT) AS tile_y, count(*) AS marks
      FROM sampled WHERE size > 0.12 GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY plate ORDER BY marks DESC, image_id, tile_y, tile_x) AS INT) AS rank FROM t QUALIFY rank <= 20"""))
def densest_tiles(spark, sf):
    return sc.densest_tiles(sc.dot_size(sampled(spark, sf, inked=True)), tile=16, k=20)
