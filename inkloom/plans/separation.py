"""Queries over colour separation and compositing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import six
from ..operators import compose as cp
from ..operators import separate as s
from .fixture_sql import COV, EVENT_RASTER, LUM, PARTS, PLATE_DIM, SHIP, half_up, separated, with_
from .registry import register
from .tables import (layer_headers, layer_pixels, parts_coverage, raster_events, raster_parts, raster_ship)

LONG = "SELECT image_id, x, y, plate, round(cov, 6) AS cov FROM cov"


def long(df):
    return df.select("image_id", "x", "y", "plate", six(F.col("cov")).alias("cov"))


@register("luminance_cutoff", with_(PARTS, f"""
SELECT image_id, x, y, round({LUM}, 6) AS lum, CASE WHEN {LUM} >= 250 THEN 0e0 ELSE round(1 - {LUM} / 255e0, 6) END AS ink
FROM parts"""))
def luminance_cutoff(spark, sf):
    return raster_parts(spark, sf).select(
        "image_id", "x", "y", six(s.luminance()).alias("lum"),
        F.when(s.is_paper(), 0.0).otherwise(six(1 - s.luminance() / F.lit(255.0))).alias("ink"))


@register("rgb_to_cmyk", with_(SHIP, """
SELECT image_id, x, y, round(c - k, 6) AS cyan, round(m - k, 6) AS magenta, round(ye - k, 6) AS yellow, round(k, 6) AS black
FROM (SELECT *, least(c, m, ye) AS k FROM (SELECT *, 1 - r / 255e0 AS c, 1 - g / 255e0 AS m, 1 - b / 255e0 AS ye FROM ship))"""))
def rgb_to_cmyk(spark, sf):
    return s.with_cmyk(raster_ship(spark, sf)).select(
        "image_id", "x", "y", *[six(F.col(p)).alias(p) for p in s.PLATES])


@register("coverage_cmyk", with_(COV, LONG))
def coverage_cmyk(spark, sf):
    return long(parts_coverage(spark, sf))


@register("coverage_gray", with_(PLATE_DIM, PARTS, separated(grayscale=True), LONG))
def coverage_gray(spark, sf):
    return long(parts_coverage(spark, sf, grayscale=True))


@register("coverage_invert", with_(PLATE_DIM, PARTS, separated(invert=True), LONG))
def coverage_invert(spark, sf):
    return long(parts_coverage(spark, sf, invert=True))


@register("gray_alpha", with_(PARTS, """
SELECT image_id, x, y, 'black' AS plate,
       round(pow(1e0 - ((r * 19595 + g * 38470 + b * 7471 + 32768) >> 16) / 255e0, 0.75e0) * a / 255e0, 6) AS cov FROM parts"""))
def gray_alpha(spark, sf):
    return long(s.gray_alpha(raster_parts(spark, sf)))


@register("channel_ops", with_(COV, """
SELECT image_id, x, y, plate, round(CASE WHEN cov > 0.015e0 THEN 1 - cov ELSE cov END, 6) AS inverted,
       round(pow(cov, 100e0 / 140e0), 6) AS gamma, CAST(CASE WHEN cov > 0.5 THEN 1 ELSE 0 END AS DOUBLE) AS cut,
       CAST(CASE WHEN cov > ((x * 5 + y * 3) % 8) / 8e0 THEN 1 ELSE 0 END AS DOUBLE) AS mapped FROM cov"""))
def channel_ops(spark, sf):
    cov, limit = F.col("cov"), ((F.col("x") * 5 + F.col("y") * 3) % 8) / F.lit(8.0)
    return parts_coverage(spark, sf).select(
        "image_id", "x", "y", "plate", six(s.channel_op(cov, "invert")).alias("inverted"),
        six(s.channel_op(cov, "gamma", 140.0)).alias("gamma"), s.channel_op(cov, "threshold").alias("cut"),
        s.channel_op(cov, "threshold_map", limit).alias("mapped"))


@register("unpivot_plates", with_(PLATE_DIM, SHIP, separated("ship"), """
SELECT image_id, plate, count(*) AS pixels, count(DISTINCT x) AS columns, CAST(sum(x * 3 + y) AS BIGINT) AS checksum
FROM cov WHERE plate <> 'yellow' GROUP BY ALL"""))
def unpivot_plates(spark, sf):
    cov = s.coverage(raster_ship(spark, sf), plates=["cyan", "magenta", "black"])
    return cov.groupBy("image_id", "plate").agg(
        F.count(F.lit(1)).alias("pixels"), F.countDistinct("x").alias("columns"),
        F.sum(F.col("x") * 3 + F.col("y")).alias("checksum"))


@register("content_bounds", with_(EVENT_RASTER, PARTS, f""",
px AS (SELECT image_id, w, h, x, y, grey AS r, grey AS g, grey AS b FROM event_raster
       UNION ALL SELECT CAST(image_id AS VARCHAR), w, h, x, y, r, g, b FROM parts)
SELECT image_id, coalesce(min(CASE WHEN {LUM} < 250 THEN x END), 0) AS min_x,
       coalesce(min(CASE WHEN {LUM} < 250 THEN y END), 0) AS min_y,
       coalesce(max(CASE WHEN {LUM} < 250 THEN x END), any_value(w) - 1) AS max_x,
       coalesce(max(CASE WHEN {LUM} < 250 THEN y END), any_value(h) - 1) AS max_y FROM px GROUP BY image_id"""))
def content_bounds(spark, sf):
    cols = ["image_id", "w", "h", "x", "y", "r", "g", "b"]
    parts = raster_parts(spark, sf).withColumn("image_id", F.col("image_id").cast("string")).select(cols)
    return s.content_bounds(raster_events(spark, sf).select(cols).unionByName(parts)).drop("w", "h")


@register("compose_cmyk", with_(COV, """,
wide AS (SELECT image_id, x, y, max(CASE WHEN i = 0 THEN cov END) AS c, max(CASE WHEN i = 1 THEN cov END) AS m,
                max(CASE WHEN i = 2 THEN cov END) AS ye, max(CASE WHEN i = 3 THEN cov END) AS k FROM cov GROUP BY ALL)
SELECT image_id, x, y, CAST(trunc((1e0 - c) * (1e0 - k) * 255e0) AS INT) AS r,
       CAST(trunc((1e0 - m) * (1e0 - k) * 255e0) AS INT) AS g, CAST(trunc((1e0 - ye) * (1e0 - k) * 255e0) AS INT) AS b FROM wide"""))
def compose_cmyk(spark, sf):
    return cp.compose_cmyk(parts_coverage(spark, sf)).select("image_id", "x", "y", "r", "g", "b")


LAYERS_SQL = """layers AS (
  SELECT heads.*, z, NOT (z = 1 AND image_id % 2 = 1) AS visible, 1e0 - 0.25e0 * z AS opacity, z AS ox, -z AS oy,
         100 - 25 * z AS scale_pct FROM heads, (SELECT CAST(unnest(range(3)) AS INT) AS z)),
sized AS (SELECT *, greatest(1, CAST(trunc(w * (scale_pct / 100e0)) AS INT)) AS tw,
                 greatest(1, CAST(trunc(h * (scale_pct / 100e0)) AS INT)) AS th FROM layers WHERE visible),
slots AS (
  SELECT g.image_id, g.w, g.h, g.x, g.y, s.z, s.opacity, tw, th,
         g.x - (CAST(floor((s.w - tw) / 2e0) AS INT) + ox) AS kx, g.y - (CAST(floor((s.h - th) / 2e0) AS INT) + oy) AS ky
  FROM grid g JOIN sized s ON s.image_id = g.image_id),
hits AS (
  SELECT s.image_id, s.x, s.y, s.z, p.r, p.g, p.b,
         trunc(((p.x * (s.z + 1) * 37 + 11 * p.y) % 256) * opacity) / 255e0 AS a
  FROM slots s JOIN parts p ON p.image_id = s.image_id AND kx >= 0 AND kx < tw AND ky >= 0 AND ky < th
   AND p.x = CAST(floor((kx + 0.5e0) * s.w / tw) AS INT) AND p.y = CAST(floor((ky + 0.5e0) * s.h / th) AS INT)),
l0 AS (SELECT * FROM hits WHERE z = 0),
o0 AS (SELECT g.image_id, g.x, g.y, coalesce(CASE WHEN a > 0 THEN r END, 0e0) AS r, coalesce(CASE WHEN a > 0 THEN l.g END, 0e0) AS g,
              coalesce(CASE WHEN a > 0 THEN b END, 0e0) AS b, coalesce(a, 0e0) AS a, l.z IS NOT NULL AS any0
       FROM grid g LEFT JOIN l0 l ON l.image_id = g.image_id AND l.x = g.x AND l.y = g.y)"""


def _over(below: str, z: int, name: str) -> str:
    al = "(t.a + u.a * (1e0 - t.a))"
    mix = lambda c: (f"CASE WHEN t.z IS NULL THEN u.{c} WHEN {al} > 0 THEN "  # noqa: E731
                     f"(t.{c} * t.a + u.{c} * (u.a * (1e0 - t.a))) / {al} ELSE 0e0 END AS {c}")
    return (f"{name} AS (SELECT u.image_id, u.x, u.y, {mix('r')}, {mix('g')}, {mix('b')}, "
            f"CASE WHEN t.z IS NULL THEN u.a ELSE {al} END AS a, u.any0 OR t.z IS NOT NULL AS any0 "
            f"FROM {below} u LEFT JOIN (SELECT * FROM hits WHERE z = {z}) t "
            f"ON t.image_id = u.image_id AND t.x = u.x AND t.y = u.y)")


@register("flatten_layers", with_(PARTS, LAYERS_SQL, _over("o0", 1, "o1"), _over("o1", 2, "o2"), """
SELECT image_id, x, y, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b, round(a * 255, 6) AS a FROM o2 WHERE any0"""))
def flatten_layers(spark, sf):
    return cp.flatten_layers(layer_headers(spark, sf).hint("shuffle_hash"), layer_pixels(spark, sf)).drop("w", "h")


@register("merge_layer_plates", with_(COV, """,
lc AS (SELECT image_id, plate, x, y, cov * (1e0 - 0.25e0 * z) AS cov, ((x * (z + 1) * 37 + 11 * y) % 256) / 255e0 AS alpha
       FROM cov, (SELECT unnest(range(3)) AS z) WHERE NOT (z = 1 AND image_id % 2 = 1))
SELECT image_id, plate, x, y, CAST(least(1e0, sum(cov * alpha)) >= 0.5 AS INT) AS ink FROM lc GROUP BY ALL"""))
def merge_layer_plates(spark, sf):
    px = layer_pixels(spark, sf).where(~((F.col("z") == 1) & (F.col("image_id") % 2 == 1)))
    cov = s.coverage(px, keep=["z", "a"])
    faded = cov.withColumns({"cov": F.col("cov") * (F.lit(1.0) - F.lit(0.25) * F.col("z")),
                             "alpha": F.col("a") / F.lit(255.0)})
    return cp.merge_layer_plates(faded)


@register("paper_fill", with_(PARTS, f"""
SELECT image_id, x, y, {half_up('(r * a + bg * (255 - a)) / 255e0')}::INT AS r,
  {half_up('(g * a + bg * (255 - a)) / 255e0')}::INT AS g, {half_up('(b * a + bg * (255 - a)) / 255e0')}::INT AS b
FROM (SELECT *, CASE WHEN x BETWEEN 2 AND 7 AND y BETWEEN 3 AND 6 THEN 255 ELSE 0 END AS bg FROM parts)"""))
def paper_fill(spark, sf):
    px = raster_parts(spark, sf).withColumns({"art_x": F.lit(2), "art_y": F.lit(3), "art_w": F.lit(6), "art_h": F.lit(4)})
    return cp.paper_fill(px, "black").drop("w", "h")


@register("plate_stats", with_(COV, """
SELECT plate, image_id, CAST(count(*) AS BIGINT) AS pixels, CAST(count(*) FILTER (cov > 0) AS BIGINT) AS ink_pixels,
       round(avg(cov), 6) AS mean_cov, count(DISTINCT round(cov, 6)) AS levels
FROM cov GROUP BY ROLLUP (plate, image_id)"""))
def plate_stats(spark, sf):
    return s.plate_stats(parts_coverage(spark, sf))


@register("plate_sketches", with_(COV, """
SELECT plate, count(DISTINCT image_id) AS images, CAST(count(*) AS BIGINT) AS pixels, CAST(count(*) FILTER (cov > 0) AS BIGINT) AS ink_pixels,
       round(avg(cov), 6) AS mean_cov, count(DISTINCT CAST(round(cov * 1000000) AS BIGINT)) AS levels
FROM cov GROUP BY plate"""))
def plate_sketches(spark, sf):
    return s.sketch_report(s.merged_sketches(s.plate_sketches(parts_coverage(spark, sf)), "plate"))
