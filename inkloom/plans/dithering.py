"""Queries over quantising, dithering and diffusion."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.fixed_values import CLUSTER_4, CLUSTER_8, DIFFUSION_KERNELS
from ..functions.numeric import six
from ..operators import dither as d
from ..operators.separate import luminance
from .fixture_sql import COV, FIELD, PARTS, PLATE_DIM, half_up, separated, unit_noise, with_
from .registry import register
from .separation import long
from .tables import field_emb, parts_coverage

GRAY = [PLATE_DIM, PARTS, separated(grayscale=True)]
MAP_MODES = ["column", "row", "dispersed", "medium", "heavy", "circuit", "tilt", "grid"]


def _list(matrix):
    return "[" + ",".join(str(v) for row in matrix for v in row) + "]"


_bit = lambda c, b: f"(({c} >> {b}) & 1)"
MAP_SQL = {
    "column": "(x % 8) / 8e0 - 0.5e0",
    "row": "(y % 8) / 8e0 - 0.5e0",
    "dispersed": "(" + " + ".join(f"{w} * xor(3 * {_bit('y', b)}, 2 * {_bit('x', b)})" for b, w in ((0, 16), (1, 4), (2, 1))) + ") / 64e0 - 0.5e0",
    "medium": f"list_extract({_list(CLUSTER_4)}, (y % 4) * 4 + x % 4 + 1) / 16e0 - 0.5e0",
    "heavy": f"list_extract({_list(CLUSTER_8)}, (y % 8) * 8 + x % 8 + 1) / 64e0 - 0.5e0",
    "circuit": "CASE WHEN y % 16 < 8 THEN (x % 8) / 8e0 ELSE (y % 8) / 8e0 END - 0.5e0",
    "tilt": "((x + y) % 8) / 8e0 - 0.5e0",
    "grid": "greatest((x % 8) / 8e0, (y % 8) / 8e0) - 0.5e0",
}
OFFSET_SQL = {
    "column": "((x % 4) - 1.5e0) / 3", "row": "((y % 4) - 1.5e0) / 3", "dispersed": "(((x * 17 + y * 31) % 7) - 3) / 3e0",
    "medium": "sin((x + y) * 0.8e0)", "heavy": "sin(x * 1.7e0 + y * 1.3e0)",
    "circuit": "CASE WHEN x % 6 = 0 THEN 1e0 ELSE 0e0 END - CASE WHEN y % 6 = 0 THEN 1e0 ELSE 0e0 END",
    "tilt": "((x - y) % 8) / 8e0",
    "grid": "CASE WHEN x % 4 = 0 THEN 1e0 ELSE 0e0 END + CASE WHEN y % 4 = 0 THEN 1e0 ELSE 0e0 END - 0.5e0",
}


@register("quantize_levels", with_(COV, """
SELECT image_id, x, y, plate, round(floor(cov * 4 + 0.5e0) / 4, 6) AS web, round(round_even(cov / (1e0 / 4), 0) * (1e0 / 4), 6) AS desktop FROM cov"""))
def quantize_levels(spark, sf):
    cov = F.col("cov")
    return parts_coverage(spark, sf).select("image_id", "x", "y", "plate", six(d.quantize_levels(cov, 5)).alias("web"),
                                            six(d.quantize_levels(cov, 5, "desktop")).alias("desktop"))


@register("threshold_maps", with_(COV, "SELECT image_id, x, y, " + ", ".join(
    f"round(({MAP_SQL[m]}) * 0.4e0, 6) + 0e0 AS map_{m}" for m in MAP_MODES) + " FROM cov WHERE plate = 'black'"))
def threshold_maps(spark, sf):
    cov = parts_coverage(spark, sf, plates=["black"])
    return cov.select("image_id", "x", "y", *[six(d.threshold_map(m, 0.8)).alias(f"map_{m}") for m in MAP_MODES])


@register("ordered_dither", with_(COV, f"""
SELECT image_id, x, y, plate, round(least(1e0, round_even(least(1e0, greatest(0e0, cov + ({MAP_SQL['heavy']}) * 0.45e0)) / (1e0 / 3), 0) * (1e0 / 3)), 6) AS cov FROM cov"""))
def ordered_dither(spark, sf):
    return long(parts_coverage(spark, sf).withColumn("cov", d.ordered_dither(F.col("cov"), "heavy", 0.9, 4)))


@register("diffusion_offset", with_(COV, "SELECT image_id, x, y, " + ", ".join(
    f"round(({OFFSET_SQL[m]}) * 0.5e0, 6) + 0e0 AS off_{m}" for m in MAP_MODES) + " FROM cov WHERE plate = 'black'"))
def diffusion_offset(spark, sf):
    cov = parts_coverage(spark, sf, plates=["black"])
    return cov.select("image_id", "x", "y", *[six(d.diffusion_offset(m, 0.5)).alias(f"off_{m}") for m in MAP_MODES])


PATTERN_SQL = {"none": "0e0", "floyd-steinberg": "CASE WHEN (x + y) % 2 = 1 THEN 1e0 ELSE -1e0 END",
               "jarvis-judice-ninke": "sin(x * 0.7e0 + y * 0.4e0)", "stucki": "cos(x * 0.5e0 - y * 0.8e0)",
               "burkes": "((x % 3) - 1) * 0.8e0", "atkinson": "sin((x + y) * 1.4e0)"}


def _positional_sql(algorithm):
    adjusted = (f"cov + (((x * 13 + y * 29) % 11) - 5) / 5e0 * 0.3e0 + (({OFFSET_SQL['tilt']}) * 0.15e0) + "
                f"({PATTERN_SQL[algorithm]}) * 0.7e0 * 0.14e0")
    tone = f"(floor(least(1e0, greatest(0e0, {adjusted})) * 5 + 0.5e0) / 5e0)"
    gain = 1 + 0.4 * 2.0 / 3
    return (f"round(least(1e0, greatest(0e0, cov * {1 - 0.7 * 0.35!r}e0 + (({tone} - 0.5e0) * {gain!r}e0 + 0.5e0) * "
            f"{0.7 * 0.65!r}e0)), 6) AS v_{algorithm.replace('-', '_')}")


@register("positional_diffusion", with_(COV, "SELECT image_id, x, y, plate, " + ", ".join(
    _positional_sql(a) for a in PATTERN_SQL) + " FROM cov"))
def positional_diffusion(spark, sf):
    cov = parts_coverage(spark, sf)
    return cov.select("image_id", "x", "y", "plate", *[six(d.positional_diffusion(
        F.col("cov"), a, 0.7, 6, denoise=0.3, modulation="tilt", mod_strength=0.6, sharpen=0.4, sharpen_radius=2.0)
    ).alias(f"v_{a.replace('-', '_')}") for a in PATTERN_SQL])


def scan_sql(base: str, kernel: str, offsets: list, top: int, intensity: float, serpentine: bool = False, overflow: float = 0.0,
             wiped: str = "FALSE") -> list[str]:
    """CTEs that carry errors pixel by pixel: one level of the recursion is one pixel step of all plates.

    ``base`` is a SELECT of (image_id, plate, i, w, h, x, y, base), ``kernel`` one of (plate, ws). The carry is three FLOAT rows
    of the frame; ``held`` is the row of errors that a wiped row took in at its start.
    """
    side = "CASE WHEN y % 2 = 1 THEN -1 ELSE 1 END" if serpentine else "1"
    at = "CASE WHEN y % 2 = 1 THEN w - 1 - x ELSE x END" if serpentine else "x"
    weight = " ".join(f"WHEN j // w = {dy} AND (j % w - x) * side = {dx} THEN ws[{k}]" for k, (dy, dx, _) in enumerate(offsets, 1))
    inside = "least(1e0, greatest(0e0, value))"
    value = "CASE WHEN wiped THEN least(1e0, greatest(0e0, base + CAST(held[x + 1] AS DOUBLE))) ELSE base END + CAST(c[x + 1] AS DOUBLE)"
    value = f"least(1e0, greatest(0e0, {value}))" if serpentine else value
    if overflow:
        inside = f"({inside} * {1 - overflow!r}e0 + (value - floor(value)) * {overflow!r}e0)"
    tone = f"floor({inside} * {top} + 0.5e0)" if serpentine else f"round_even({inside} * {top}, 0)"
    return [f"based AS ({base})", f"kern AS ({kernel})",
            f"steps AS (SELECT *, y * w + {at} AS t, {side} AS side, {wiped} AS wiped FROM based)", f"""
scan AS (SELECT image_id, plate, any_value(w) AS w, CAST(-1 AS BIGINT) AS t, CAST(NULL AS INT) AS x, CAST(NULL AS INT) AS y, 0e0 AS tone,
  [CAST(0 AS FLOAT) FOR j IN range(3 * any_value(w))] AS carry, [CAST(0 AS FLOAT) FOR j IN range(any_value(w))] AS held FROM based GROUP BY image_id, plate
  UNION ALL
  SELECT image_id, plate, w, t, x, y, tone,
    [CAST(CAST(c[j + 1] AS DOUBLE) + coalesce(CASE {weight} END, 0e0) * ((value - tone) * {intensity!r}e0) AS FLOAT) FOR j IN range(3 * w)], held
  FROM (SELECT *, {tone} / {top}e0 AS tone FROM (
    SELECT *, {value} AS value FROM (
      SELECT * EXCLUDE (moved, held), CASE WHEN wiped AND t % w = 0 THEN [CASE WHEN j < w THEN CAST(0 AS FLOAT) ELSE moved[j + 1] END FOR j IN range(3 * w)] ELSE moved END AS c,
        CASE WHEN wiped AND t % w = 0 THEN moved[1:w] ELSE held END AS held FROM (
        SELECT n.*, k.ws, s.held, CASE WHEN n.t > 0 AND n.t % n.w = 0 THEN list_concat(s.carry[n.w + 1:], [CAST(0 AS FLOAT) FOR j IN range(n.w)]) ELSE s.carry END AS moved
        FROM scan s JOIN steps n ON n.image_id = s.image_id AND n.plate = s.plate AND n.t = s.t + 1 JOIN kern k ON k.plate = n.plate)))))""",
            "SELECT image_id, x, y, plate, round(least(1e0, greatest(0e0, tone)), 6) AS cov FROM scan WHERE t >= 0"]


def even_kernel(weights: list[float]) -> str:
    return f"SELECT plate, [{', '.join(f'{v!r}e0' for v in weights)}] AS ws FROM plates"


_WEB, _WEB_SUM = DIFFUSION_KERNELS["jarvis-judice-ninke"]
_SWAY = f"sin(x * {math.cos(math.pi / 6)!r}e0 + y * {math.sin(math.pi / 6)!r}e0) * 0.4e0 * 0.08e0"


@register("error_diffusion", with_(COV, *scan_sql(f"""SELECT *, CASE WHEN y % 6 = 0 THEN cov ELSE cov + ({OFFSET_SQL['tilt']}) * 0.125e0 + {_SWAY}
  + (((x * 7 + y * 11) % 5) - 2) * 0.5e0 * 0.03e0 + CASE WHEN (x + y) % 9 = 0 THEN 0.5e0 * 0.12e0 ELSE 0e0 END END + 0.3e0 * 0.02e0 AS base FROM cov""",
    even_kernel([w / _WEB_SUM for _, _, w in _WEB]), _WEB, 3, 0.9, serpentine=True)))
def error_diffusion(spark, sf):
    return long(d.error_diffusion(parts_coverage(spark, sf), "jarvis-judice-ninke", 4, 0.9, "tilt", 0.5, bias=0.4,
                                  bias_angle=30, broken=0.5, overflow=0.5, reset=0.9, bleed=0.3, spread=False))


_STUCKI = DIFFUSION_KERNELS["stucki"][0]
_STUCKI_RAW = [w * (2.6 if (dx == 0) != (dy == 0) else 1 - 0.4 * 0.8) for dy, dx, w in _STUCKI]
_NARROW = "SELECT *, CAST(CAST(cov AS FLOAT) AS DOUBLE) AS base FROM cov"


@register("error_diffusion_desktop", with_(COV, *scan_sql(
    _NARROW, even_kernel([w / sum(_STUCKI_RAW) for w in _STUCKI_RAW]), _STUCKI, 3, 0.9)))
def error_diffusion_desktop(spark, sf):
    return long(d.error_diffusion_desktop(parts_coverage(spark, sf), "stucki", 4, 0.9, "circuit", 0.4, spread=False))


_ATKINSON = DIFFUSION_KERNELS["atkinson"][0]
_CELLS = ", ".join(f"({k}, {dy}, {dx}, {w}e0)" for k, (dy, dx, w) in enumerate(_ATKINSON))
_LEAN = "(dx * cos(radians(60)) + dy * sin(radians(60))) / sqrt(dx * dx + dy * dy)"
_DAMAGED = f"""SELECT plate, list(v / total ORDER BY k) AS ws FROM (SELECT *, sum(v) OVER (PARTITION BY plate) AS total FROM (
  SELECT plate, k, greatest(0.001e0, greatest(0.01e0, 1 + {_LEAN} * 0.5e0 * 5) * CASE WHEN {unit_noise('k', 'i', '42')} >= 0.4e0 THEN wt
    WHEN {unit_noise('k', 'i', '43')} * 3 < 1 THEN 0e0 WHEN {unit_noise('k', 'i', '43')} * 3 < 2 THEN -wt
    ELSE {unit_noise('k', 'i', '44')} * {max(w for _, _, w in _ATKINSON)} * 2 END) AS v
  FROM (VALUES {_CELLS}) c(k, dy, dx, wt), plates)) GROUP BY plate"""


@register("glitch_diffusion", with_(COV, *scan_sql(_NARROW, _DAMAGED, _ATKINSON, 3, 0.8, overflow=0.3,
                                                   wiped=f"y >= 2 AND y < h - 2 AND {unit_noise('y', 'i', '77')} < 0.8e0 / 10")))
def glitch_diffusion(spark, sf):
    return long(d.glitch_diffusion(parts_coverage(spark, sf), "atkinson", 4, 0.8, broken=0.4, bias=0.5, bias_angle=60,
                                   overflow=0.3, reset=0.8, spread=False))


def blur_sql(source: str, sigma: float, out: str) -> str:
    """CTEs for a separable blur of (image_id, plate, w, h, x, y, cov) with mirrored borders."""
    radius = int(4 * sigma + 0.5)
    mirror = lambda p, n: (f"(CASE WHEN (({p}) % (2 * {n}) + 2 * {n}) % (2 * {n}) < {n} THEN (({p}) % (2 * {n}) + 2 * {n}) % (2 * {n}) "  # noqa: E731
                           f"ELSE 2 * {n} - 1 - (({p}) % (2 * {n}) + 2 * {n}) % (2 * {n}) END)")
    return (f"{out}_k AS (SELECT k, exp(-0.5e0 * k * k / {sigma * sigma!r}e0) / sum(exp(-0.5e0 * k * k / {sigma * sigma!r}e0)) OVER () AS wt "
            f"FROM (SELECT CAST(unnest(range({-radius}, {radius + 1})) AS INT) AS k)), "
            f"{out}_v AS (SELECT a.image_id, a.plate, a.w, a.h, a.x, a.y, sum(b.cov * wt) AS cov FROM (SELECT s.*, k, wt, {mirror('y + k', 'h')} AS yy FROM {source} s, {out}_k) a "
            f"JOIN {source} b ON b.image_id = a.image_id AND b.plate = a.plate AND b.x = a.x AND b.y = a.yy GROUP BY ALL), "
            f"{out} AS (SELECT a.image_id, a.plate, a.w, a.h, a.x, a.y, sum(b.cov * wt) AS cov FROM (SELECT s.*, k, wt, {mirror('x + k', 'w')} AS xx FROM {out}_v s, {out}_k) a "
            f"JOIN {out}_v b ON b.image_id = a.image_id AND b.plate = a.plate AND b.x = a.xx AND b.y = a.y GROUP BY ALL)")


@register("gaussian_blur", with_(COV, blur_sql("cov", 1.2, "soft"),
                                 "SELECT image_id, x, y, plate, round(cov, 6) AS cov FROM soft"))
def gaussian_blur(spark, sf):
    return long(d.gaussian_blur(parts_coverage(spark, sf), 1.2))


@register("unsharp_sharpen", with_(COV, blur_sql("cov", 1.0, "soft"), """
SELECT c.image_id, c.x, c.y, c.plate, round(least(1e0, greatest(0e0, c.cov + (c.cov - s.cov) * 1.5e0)), 6) AS cov
FROM cov c JOIN soft s USING (image_id, plate, x, y)"""))
def unsharp_sharpen(spark, sf):
    return long(d.unsharp_sharpen(parts_coverage(spark, sf), 0.5, 1.0))


@register("add_noise", with_(COV, f"""
SELECT image_id, x, y, plate, round(least(1e0, greatest(0e0, cov + sqrt(-2e0 * ln(1e0 - {unit_noise('x', 'y', '42')})) * cos({2 * math.pi!r}e0 * {unit_noise('x', 'y', '43')}) * {0.5 * 0.3!r}e0)), 6) AS cov FROM cov"""))
def add_noise(spark, sf):
    return long(d.add_noise(parts_coverage(spark, sf), 0.5))


_CORNER = lambda dx, dy: unit_noise(f"(x // 8 + {dx})", f"(y // 8 + {dy})", "99")


@register("cross_channel_bleed", with_(COV, """
wide AS (SELECT image_id, x, y, [max(cov) FILTER (i = 0), max(cov) FILTER (i = 1), max(cov) FILTER (i = 2), max(cov) FILTER (i = 3)] AS v
  FROM cov GROUP BY image_id, x, y)""", f"""
near AS (SELECT *, (x % 8) / 8e0 AS tx, (y % 8) / 8e0 AS ty, {_CORNER(0, 0)} AS a, {_CORNER(1, 0)} AS b, {_CORNER(0, 1)} AS c, {_CORNER(1, 1)} AS d FROM wide)""", """
rippled AS (SELECT *, ((a * (1 - tx) + b * tx) * (1 - ty) + (c * (1 - tx) + d * tx) * ty) * 0.24e0 AS ripple FROM near)""", """
SELECT image_id, x, y, plate, round(least(1e0, greatest(0e0, v[i + 1] + (v[(i + 1) % 4 + 1] - round_even(v[(i + 1) % 4 + 1] / (1e0 / 3), 0) * (1e0 / 3)) * ripple)), 6) AS cov
FROM rippled, plates"""))
def cross_channel_bleed(spark, sf):
    return long(d.cross_channel_bleed(parts_coverage(spark, sf), 0.8, 4))


@register("coalesce_runs", with_(COV, FIELD, """,
ink AS (SELECT image_id, plate, x, y FROM cov WHERE cov >= 0.5 UNION ALL SELECT -1 - image_id, plate, x, y FROM field WHERE cov >= 0.5),
isl AS (SELECT *, x - row_number() OVER (PARTITION BY image_id, plate, y ORDER BY x) AS g FROM ink)
SELECT image_id, plate, y, min(x) AS x0, CAST(count(*) AS INT) AS length FROM isl GROUP BY image_id, plate, y, g"""))
def coalesce_runs(spark, sf):
    cols = ["image_id", "plate", "x", "y", "cov"]
    field = field_emb(spark, sf).withColumn("image_id", -1 - F.col("image_id"))
    return d.coalesce_runs(parts_coverage(spark, sf).select(cols).unionByName(field.select(cols)))
