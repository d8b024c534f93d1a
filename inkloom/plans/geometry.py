"""Queries over document geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import six
from ..operators import geometry as g
from .fixture_sql import JOBS, PARTS, half_up, with_
from .registry import register
from .tables import jobs, part_headers, raster_parts


@register("sheet_dims", with_(JOBS, "SELECT job_id, sheet_id, orientation, sheet_w, sheet_h FROM jobs"))
def sheet_dims(spark, sf):
    return g.sheet_dims(jobs(spark, sf)).select("job_id", "sheet_id", "orientation", "sheet_w", "sheet_h")


@register("placement", with_(JOBS, """,
placed AS (SELECT *, greatest(1, CAST(trunc(src_w * (scale_pct / 100e0)) AS INT)) AS art_w,
                  greatest(1, CAST(trunc(src_h * (scale_pct / 100e0)) AS INT)) AS art_h FROM jobs)
SELECT job_id, art_w, art_h, CAST(floor((sheet_w - art_w) / 2e0) AS INT) AS art_x,
       CAST(floor((sheet_h - art_h) / 2e0) AS INT) AS art_y FROM placed"""))
def placement(spark, sf):
    return g.placement(g.sheet_dims(jobs(spark, sf))).select("job_id", "art_w", "art_h", "art_x", "art_y")


@register("fit_scale", with_(JOBS, f"""
SELECT job_id,
  CAST(least(400, greatest(10, {half_up('least(sheet_w / src_w, sheet_h / src_h) * 100')})) AS INT) AS web_pct,
  CAST(round_even(greatest(0.01e0, least(sheet_w / src_w, sheet_h / src_h)) * 100e0, 0) AS INT) AS desktop_pct
FROM jobs"""))
def fit_scale(spark, sf):
    d = g.sheet_dims(jobs(spark, sf))
    args = [F.col(c) for c in ("src_w", "src_h", "sheet_w", "sheet_h")]
    return d.select("job_id", g.fit_scale(*args).alias("web_pct"),
                    g.fit_scale(*args, variant="desktop").alias("desktop_pct"))


@register("auto_orientation", with_(JOBS, """
SELECT job_id, CASE WHEN src_w / src_h > 1.1e0 THEN 'landscape' WHEN src_w / src_h < 0.9e0 THEN 'portrait'
                    ELSE orientation END AS orientation FROM jobs"""))
def auto_orientation(spark, sf):
    return jobs(spark, sf).select("job_id", g.auto_orientation(
        F.col("src_w"), F.col("src_h"), F.col("orientation")).alias("orientation"))


@register("target_dims", with_(JOBS, f"""
SELECT job_id, tw AS target_w, th AS target_h,
  CAST(greatest(1, {half_up('tw * least(1e0, 1100e0 / greatest(tw, th))')}) AS INT) AS sample_w,
  CAST(greatest(1, {half_up('th * least(1e0, 1100e0 / greatest(tw, th))')}) AS INT) AS sample_h
FROM (SELECT job_id, CAST(greatest(1, {half_up('sheet_w * s')}) AS INT) AS tw,
             CAST(greatest(1, {half_up('sheet_h * s')}) AS INT) AS th
      FROM (SELECT *, least(CAST(src_w AS DOUBLE) / sheet_w,
              CASE WHEN grayscale THEN CAST(src_h AS DOUBLE) / sheet_h ELSE 1e300 END) AS s FROM jobs))"""))
def target_dims(spark, sf):
    d = g.sheet_dims(jobs(spark, sf))
    d = g.target_dims(d, F.col("src_w"), F.when(F.col("grayscale"), F.col("src_h")), preview=True)
    return d.select("job_id", "target_w", "target_h", "sample_w", "sample_h")


def part_frames(spark, sf):
    """Each part's artwork placed on a sheet of 24 x 20 at 130 or 70 percent, mirrored by key."""
    head = part_headers(spark, sf).withColumns({
        "src_w": F.col("w"), "src_h": F.col("h"), "sheet_w": F.lit(24), "sheet_h": F.lit(20),
        "scale_pct": F.when(F.col("image_id") % 2 == 0, 130).otherwise(70)})
    placed = g.placement(head)
    return placed.select("image_id", "sheet_w", "sheet_h", "art_x", "art_y", "art_w", "art_h",
                         (F.col("image_id") % 3 == 0).alias("mirror"),
                         F.when(F.col("image_id") % 4 < 2, "horizontal").otherwise("vertical").alias("mirror_direction"))


FRAMES_SQL = """frames AS (
  SELECT *, CAST(floor((24 - art_w) / 2e0) AS INT) AS art_x, CAST(floor((20 - art_h) / 2e0) AS INT) AS art_y
  FROM (SELECT image_id, w, h, CAST(trunc(w * s) AS INT) AS art_w, CAST(trunc(h * s) AS INT) AS art_h,
               image_id % 3 = 0 AND image_id % 4 < 2 AS flip_x, image_id % 3 = 0 AND image_id % 4 >= 2 AS flip_y
        FROM (SELECT *, CASE WHEN image_id % 2 = 0 THEN 130 / 100e0 ELSE 70 / 100e0 END AS s FROM heads)))"""


@register("place_artwork", with_(PARTS, FRAMES_SQL, """,
sheet AS (SELECT *, CAST(unnest(range(24)) AS INT) AS x FROM (SELECT *, CAST(unnest(range(20)) AS INT) AS y FROM frames)),
asked AS (SELECT *, x >= art_x AND x < art_x + art_w AND y >= art_y AND y < art_y + art_h AS inside,
  CASE WHEN flip_x THEN art_w - 1 - (x - art_x) ELSE x - art_x END AS kx,
  CASE WHEN flip_y THEN art_h - 1 - (y - art_y) ELSE y - art_y END AS ky FROM sheet)
SELECT a.image_id, a.x, a.y, CASE WHEN inside THEN p.r ELSE 255 END AS r, CASE WHEN inside THEN p.g ELSE 255 END AS g,
       CASE WHEN inside THEN p.b ELSE 255 END AS b
FROM asked a LEFT JOIN parts p ON p.image_id = a.image_id AND a.inside
 AND p.x = CAST(floor((kx + 0.5e0) * a.w / art_w) AS INT) AND p.y = CAST(floor((ky + 0.5e0) * a.h / art_h) AS INT)
"""))
def place_artwork(spark, sf):
    frames = part_frames(spark, sf).hint("shuffle_hash")  # a row per part: too many to broadcast
    return g.place_artwork(raster_parts(spark, sf), frames).select("image_id", "x", "y", "r", "g", "b")


@register("upscale_nearest", with_(PARTS, """,
big AS (SELECT *, CAST(unnest(range(nw)) AS INT) AS nx FROM (SELECT *, CAST(unnest(range(nh)) AS INT) AS ny FROM (
  SELECT *, CAST(round_even(w * (240 / 150e0), 0) AS INT) AS nw, CAST(round_even(h * (240 / 150e0), 0) AS INT) AS nh FROM heads)))
SELECT q.image_id, nw AS w, nh AS h, nx AS x, ny AS y, p.r, p.g, p.b FROM big q JOIN parts p ON p.image_id = q.image_id
 AND p.x = CAST(floor((nx + 0.5e0) * q.w / nw) AS INT) AND p.y = CAST(floor((ny + 0.5e0) * q.h / nh) AS INT)
"""))
def upscale_nearest(spark, sf):
    return g.upscale_nearest(raster_parts(spark, sf), 150).select("image_id", "w", "h", "x", "y", "r", "g", "b")


@register("lpi_profile", with_(JOBS, """
SELECT CAST(floor((240e0 / cell_size) / 10) * 10 AS INT) AS lpi_band, count(*) AS jobs,
       round(avg(240e0 / cell_size), 6) AS mean_lpi FROM jobs GROUP BY 1"""))
def lpi_profile(spark, sf):
    lines = jobs(spark, sf).select(g.lpi(F.col("cell_size")).alias("lpi"))
    return lines.groupBy((F.floor(F.col("lpi") / 10) * 10).cast("int").alias("lpi_band")).agg(
        F.count(F.lit(1)).alias("jobs"), F.round(F.avg("lpi"), 6).alias("mean_lpi"))


@register("normalize_angle", """
SELECT o_orderkey AS job_id, round(((a % 360) + 360) % 360, 6) AS angle
FROM (SELECT o_orderkey, o_custkey * 1.5e0 - o_orderkey * 0.25e0 AS a FROM orders)""")
def normalize_angle(spark, sf):
    from .tables import read
    o = read(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("job_id"), six(g.normalize_angle(
        F.col("o_custkey") * F.lit(1.5) - F.col("o_orderkey") * F.lit(0.25))).alias("angle"))


@register("quantize_step", """
SELECT event_id, round(least(50e0, greatest(0.25e0, 0.25e0 + floor((value - 0.25e0) / 0.25e0 + 0.5e0) * 0.25e0)), 2) AS quarter,
       round(least(30e0, greatest(5e0, 5e0 + floor((value - 5e0) / 0.1e0 + 0.5e0) * 0.1e0)), 1) AS tenth FROM events""")
def quantize_step(spark, sf):
    from .tables import read
    v = F.col("value")
    return read(spark, sf, "events").select(
        "event_id", g.quantize_step(v, 0.25, 50.0, 0.25, 2).alias("quarter"),
        g.quantize_step(v, 5.0, 30.0, 0.1, 1).alias("tenth"))
