"""Queries over sources and outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fixed_values import PLATES, REFUSALS
from ..operators.dither import coalesce_runs
from ..operators.screen import registration_marks
from ..session import deal_sheets
from ..sources import images, projects, sinks
from .fixture_sql import COV, EVENT_RASTER, JOB_PLATES, SHIP, with_
from .registry import register
from .tables import parts_coverage, part_headers, raster_events, raster_ship, read, ticket_jobs


def file_headers(spark, sf):
    """Upload headers derived from the documents table."""
    d = read(spark, sf, "documents")
    k = F.col("doc_id")
    types = F.array(*[F.lit(v) for v in ("image/png", "image/jpeg", "image/webp", "IMAGE/PNG", "image/svg+xml")])
    heads = F.array(*[F.lit(v) for v in ("89504E470D0A1A0A00000000", "FFD8FFE000104A4649460001",
                                         "52494646AABBCCDD57454250", "89504E470D0A1A0A0000000D")])
    return d.select(
        k.alias("file_id"), F.get(types, (k % 5).cast("int")).alias("declared_type"),
        F.when(k % 17 == 0, 0).otherwise(F.col("n_chars") * 4096).alias("length"),
        F.unhex(F.get(heads, F.when(k % 3 == 0, (k % 4)).otherwise(k % 5 % 4).cast("int"))).alias("head"),
        F.when(k % 19 == 0, 0).otherwise(1 + (k * 7919) % 18000).cast("int").alias("width"),
        (1 + (F.col("n_chars") * 31) % 9000).cast("int").alias("height"))


@register("intake_audit", f"""
WITH f AS (SELECT doc_id AS file_id, lower(list_extract(['image/png','image/jpeg','image/webp','IMAGE/PNG','image/svg+xml'], CAST(doc_id % 5 + 1 AS INT))) AS t,
  CASE WHEN doc_id % 17 = 0 THEN 0 ELSE n_chars * 4096 END AS len,
  list_extract(['89504E470D0A1A0A00000000','FFD8FFE000104A4649460001','52494646AABBCCDD57454250','89504E470D0A1A0A0000000D'],
    CAST(CASE WHEN doc_id % 3 = 0 THEN doc_id % 4 ELSE doc_id % 5 % 4 END + 1 AS INT)) AS head,
  CASE WHEN doc_id % 19 = 0 THEN 0 ELSE 1 + (doc_id * 7919) % 18000 END AS w, 1 + (n_chars * 31) % 9000 AS h FROM documents)
SELECT file_id, CASE WHEN t NOT IN ('image/png','image/jpeg','image/webp') THEN '{REFUSALS["type"]}'
  WHEN len = 0 THEN '{REFUSALS["empty"]}' WHEN len > 52428800 THEN '{REFUSALS["bytes"]}'
  WHEN NOT ((t = 'image/png' AND head LIKE '89504E470D0A1A0A%') OR (t = 'image/jpeg' AND head LIKE 'FFD8FF%')
            OR (t = 'image/webp' AND head LIKE '52494646%' AND substr(head, 17, 8) = '57454250')) THEN '{REFUSALS["signature"]}'
  WHEN w <= 0 OR h <= 0 THEN '{REFUSALS["invalid"]}'
  WHEN w > 16384 OR h > 16384 OR w * h > 100000000 THEN '{REFUSALS["dimensions"]}' END AS refusal FROM f""")
def intake_audit(spark, sf):
    return images.intake_audit(file_headers(spark, sf)).select("file_id", "refusal")


def project_texts(spark, sf):
    """One project document per part, as JSON text; some fields are left out and one key is unknown."""
    h = part_headers(spark, sf)
    k = F.col("image_id")
    params = F.map_from_arrays(
        F.array(F.lit("ascii_charset"), F.lit("not_a_parameter"), F.lit("pixelate_block_size")),
        F.array(F.lit("dots"), F.lit("1"), (k % 40 + 4).cast("string")))

    def layer(z):
        keep = k % (z + 2) == 0
        return F.struct(
            F.concat(F.lit("L"), F.lit(str(z))).alias("name"), F.when(keep, k % 2 == 0).alias("visible"),
            F.when(keep, (k % 7).cast("int")).alias("offset_x"), F.lit(z).alias("offset_y"),
            F.when(~keep, (50 + k % 100).cast("int")).alias("scale_pct"),
            F.when(keep, F.lit(1.0) - F.lit(0.25 * z)).alias("opacity"),
            F.when(k % 3 != z, params).alias("effect_params"))

    doc = F.struct(F.lit(2).alias("version"), F.array(layer(0), layer(1), layer(2)).alias("layers"),
                   F.when(k % 4 == 0, 0).alias("selected_layer"))
    return h.select(k.alias("project_id"), F.to_json(doc).alias("project"))


@register("project_layers", """
WITH l AS (SELECT p_partkey AS k, z, p_partkey % (z + 2) = 0 AS keep FROM part, (SELECT CAST(unnest(range(3)) AS INT) AS z))
SELECT k AS project_id, z, 'L' || z AS name, CASE WHEN keep THEN k % 2 = 0 ELSE TRUE END AS visible,
  CAST(CASE WHEN keep THEN k % 7 ELSE 0 END AS INT) AS offset_x, z AS offset_y,
  CAST(CASE WHEN NOT keep THEN 50 + k % 100 ELSE 100 END AS INT) AS scale_pct,
  CASE WHEN keep THEN 1e0 - 0.25e0 * z ELSE 1e0 END AS opacity,
  CASE WHEN k % 3 <> z THEN 'dots' END AS charset, CASE WHEN k % 3 <> z THEN CAST(k % 40 + 4 AS INT) END AS block,
  CASE WHEN k % 3 <> z THEN 60 END AS separation, CASE WHEN k % 3 <> z THEN FALSE END AS has_unknown,
  CASE WHEN k % 4 = 0 THEN z = 0 ELSE z = 2 END AS selected FROM l""")
def project_layers(spark, sf):
    out = projects.project_layers(projects.parse_projects(project_texts(spark, sf)))
    param = lambda name: F.try_element_at("params", F.lit(name))
    return out.select(
        "project_id", "z", "name", "visible", "offset_x", "offset_y", "scale_pct", "opacity",
        param("ascii_charset").alias("charset"), param("pixelate_block_size").cast("int").alias("block"),
        param("stereo_separation").cast("int").alias("separation"),
        F.map_contains_key("params", "not_a_parameter").alias("has_unknown"), "selected")


@register("bin_raster", with_(SHIP, "SELECT * FROM ship"))
def bin_raster(spark, sf):
    return raster_ship(spark, sf)


@register("densify_raster", with_(EVENT_RASTER, "SELECT image_id, w, h, x, y, n FROM event_raster"))
def densify_raster(spark, sf):
    return raster_events(spark, sf).select("image_id", "w", "h", "x", "y", "n")


def _n(expr):
    return f"printf('%.4f', round({expr}, 4) + 0e0)"


SHAPE_OF = "list_extract(['round','square','diamond','triangle','cross','line','circle-outline','custom'], CAST(image_id % 8 + 1 AS INT))"


def shaped_marks(spark, sf):
    shape = F.get(F.array(*[F.lit(v) for v in ("round", "square", "diamond", "triangle", "cross", "line",
                                               "circle-outline", "custom")]), (F.col("image_id") % 8).cast("int"))
    cov = parts_coverage(spark, sf)
    return cov.where(F.col("cov") > 0).select(
        "image_id", "plate", F.col("x").alias("u_idx"), F.col("y").alias("v_idx"),
        (F.col("x") * 4.0 + 2.0).alias("cx"), (F.col("y") * 4.0 + 2.0).alias("cy"),
        (F.sqrt("cov") * 4.16).alias("size"), shape.alias("shape"))


@register("svg_marks", with_(COV, f""",
m AS (SELECT image_id, plate, x AS u_idx, y AS v_idx, x * 4e0 + 2e0 AS cx, y * 4e0 + 2e0 AS cy, sqrt(cov) * 4.16e0 AS d,
             sqrt(cov) * 4.16e0 / 2 AS q, sqrt(cov) * 4.16e0 * 0.14e0 AS t, {SHAPE_OF} AS shape FROM cov WHERE cov > 0)
SELECT image_id, plate, u_idx, v_idx, CASE shape
 WHEN 'square' THEN '<rect x="' || {_n('cx - q')} || '" y="' || {_n('cy - q')} || '" width="' || {_n('d')} || '" height="' || {_n('d')} || '"/>'
 WHEN 'diamond' THEN '<path d="M ' || {_n('cx')} || ' ' || {_n('cy - q')} || ' L ' || {_n('cx + q')} || ' ' || {_n('cy')} || ' L ' || {_n('cx')} || ' ' || {_n('cy + q')} || ' L ' || {_n('cx - q')} || ' ' || {_n('cy')} || ' Z"/>'
 WHEN 'triangle' THEN '<path d="M ' || {_n('cx')} || ' ' || {_n('cy - q')} || ' L ' || {_n('cx + q')} || ' ' || {_n('cy + q')} || ' L ' || {_n('cx - q')} || ' ' || {_n('cy + q')} || ' Z"/>'
 WHEN 'cross' THEN '<path d="M ' || {_n('cx - t')} || ' ' || {_n('cy - q')} || ' H ' || {_n('cx + t')} || ' V ' || {_n('cy + q')} || ' H ' || {_n('cx - t')} || ' Z M ' || {_n('cx - q')} || ' ' || {_n('cy - t')} || ' H ' || {_n('cx + q')} || ' V ' || {_n('cy + t')} || ' H ' || {_n('cx - q')} || ' Z"/>'
 WHEN 'line' THEN '<rect x="' || {_n('cx - q')} || '" y="' || {_n('cy - d * 0.16e0')} || '" width="' || {_n('d')} || '" height="' || {_n('d * 0.32e0')} || '" rx="' || {_n('d * 0.16e0')} || '"/>'
 WHEN 'custom' THEN '<use href="#dot-shape" x="' || {_n('cx - q')} || '" y="' || {_n('cy - q')} || '" width="' || {_n('d')} || '" height="' || {_n('d')} || '"/>'
 ELSE CASE WHEN shape = 'circle-outline' AND 1 < q THEN '<circle cx="' || {_n('cx')} || '" cy="' || {_n('cy')} || '" r="' || {_n('greatest(0e0, q - 0.5e0)')} || '" fill="none" stroke="#000000" stroke-width="1.0000"/>'
      ELSE '<circle cx="' || {_n('cx')} || '" cy="' || {_n('cy')} || '" r="' || {_n('q')} || '"/>' END END AS fragment FROM m"""))
def svg_marks(spark, sf):
    return shaped_marks(spark, sf).select("image_id", "plate", "u_idx", "v_idx", sinks.mark_fragment().alias("fragment"))


DOT_SYMBOL = '<svg viewBox="0 0 2 2"><path d="M 0 0 L 2 1 L 0 2 Z"/></svg>'
_REG = lambda d: f"CASE WHEN k % 2 = 0 THEN {d} ELSE {{}} - {d} END"


@register("svg_documents", with_(COV, f""",
heads2 AS (SELECT DISTINCT image_id, plate, w, h, CASE WHEN image_id % 3 = 0 THEN '<symbol id="registration-shape" viewBox="0 0 2 2"><path d="M 0 0 L 2 1 L 0 2 Z"/></symbol>' ELSE '' END AS sym FROM cov),
isl AS (SELECT image_id, plate, x, y, x - row_number() OVER (PARTITION BY image_id, plate, y ORDER BY x) AS g FROM cov WHERE cov >= 0.5),
runs AS (SELECT image_id, plate, y, min(x) AS x0, count(*) AS n FROM isl GROUP BY image_id, plate, y, g),
regs AS (SELECT *, CAST(unnest(range(4)) AS INT) AS k FROM heads2),
spots AS (SELECT *, {_REG('14e0').format('w')} AS px, CASE WHEN k < 2 THEN 14e0 ELSE h - 14e0 END AS py FROM regs)
SELECT image_id, plate, 0 AS part, 0 AS a, 0 AS b, '<svg xmlns="http://www.w3.org/2000/svg" width="' || printf('%.4f', w / 240e0) || 'in" height="' || printf('%.4f', h / 240e0)
  || 'in" viewBox="0 0 ' || w || ' ' || h || '"><defs>' || sym || '</defs><g fill="#000000" stroke="none">' AS line FROM heads2
UNION ALL SELECT image_id, plate, 1, y, x0, '<rect x="' || {_n('x0')} || '" y="' || {_n('y')} || '" width="' || {_n('n + 0.25e0')} || '" height="1.2500"/>' FROM runs
UNION ALL SELECT image_id, plate, 2, 0, 0, '</g>' FROM heads2
UNION ALL SELECT image_id, plate, 2, 1, 0, CASE WHEN sym = '' THEN '<g fill="none" stroke="#000000" stroke-width="1.0000">' ELSE '<g>' END FROM heads2
UNION ALL SELECT image_id, plate, 3, k, 0, '<g opacity="0.7">' || CASE WHEN sym = '' THEN '<circle cx="' || {_n('px')} || '" cy="' || {_n('py')} || '" r="' || {_n('7 * 0.58e0')} || '"/><path d="M ' || {_n('px - 7')} || ' ' || {_n('py')}
  || ' h 14.0000 M ' || {_n('px')} || ' ' || {_n('py - 7')} || ' v 14.0000"/>' ELSE '<use href="#registration-shape" x="' || {_n('px - 3.5e0')} || '" y="' || {_n('py - 3.5e0')} || '" width="7.0000" height="7.0000"/>' END || '</g>' FROM spots
UNION ALL SELECT image_id, plate, 4, 1, 0, '</g>' FROM heads2 UNION ALL SELECT image_id, plate, 5, 0, 0, '</svg>' FROM heads2"""))
def svg_documents(spark, sf):
    cov = parts_coverage(spark, sf)
    heads = deal_sheets(part_headers(spark, sf)).select("image_id", "w", "h", F.explode(F.array(*map(F.lit, PLATES))).alias("plate"))
    heads = heads.withColumn("registration_symbol", F.when(F.col("image_id") % 3 == 0, DOT_SYMBOL))
    return sinks.svg_lines(None, heads, registration_marks(heads.drop("registration_symbol")), coalesce_runs(cov))


PLATES_TEXT = "CASE WHEN grayscale THEN 'black' ELSE 'cyan,magenta,yellow,black' END"
CLEAN = "lower(regexp_replace(regexp_replace({0}, '\\.[^.]+$', ''), '[^a-zA-Z0-9_-]+', '-', 'g'))"


TICKETS = JOB_PLATES + """,
tickets AS (SELECT * REPLACE (CASE WHEN job_id % 13 = 0 THEN 'custom' ELSE dot_shape END AS dot_shape),
  CASE WHEN job_id % 13 = 0 THEN 'Mark ' || job_id || '.svg' END AS custom_shape,
  CASE WHEN job_id % 4 <> 0 THEN 1 + (job_id % 9) * 0.5e0 ELSE 1e0 END AS stroke_width,
  CASE WHEN job_id % 5 <> 0 THEN CAST(60 + job_id % 7 * 30 AS INT) ELSE 120 END AS registration_size,
  CASE WHEN job_id % 6 <> 0 THEN CAST(90 + job_id % 3 * 15 AS INT) ELSE 120 END AS registration_offset,
  CASE WHEN job_id % 7 <> 0 THEN 0.5e0 + job_id % 4 ELSE 2e0 END AS registration_weight,
  CASE WHEN job_id % 3 = 1 THEN 'centered' ELSE 'corners' END AS registration_mode,
  CASE WHEN job_id % 10 = 3 THEN 'cross-' || job_id || '.svg' END AS registration_shape FROM loaded)"""
NUMBER = lambda c: f"regexp_replace(CAST({c} AS VARCHAR), '\\.0$', '')"


@register("job_manifest", with_(TICKETS, f"""
SELECT job_id, source_name AS source, {CLEAN.format('source_name')} || CASE WHEN grayscale THEN '-K' ELSE '-CMYK' END || '-plates.zip' AS package,
  {PLATES_TEXT} AS plates, sheet_id, orientation, scale_pct, mirror, mirror_direction, dot_shape, custom_shape, cell_size, stroke_width,
  a0 AS angle_c, a1 AS angle_m, a2 AS angle_y, a3 AS angle_k, hide_bits % 2 = 0 AS shows_c, (hide_bits >> 1) % 2 = 0 AS shows_m,
  (hide_bits >> 2) % 2 = 0 AS shows_y, (hide_bits >> 3) % 2 = 0 AS shows_k, invert, grayscale,
  registration, registration_size, registration_offset, registration_weight, registration_shape, registration_mode,
  sheet_w AS width, sheet_h AS height, 240 AS dpi, marks AS estimated_marks_per_plate, worst_plate, worst_angle FROM tickets"""))
def job_manifest(spark, sf):
    made = sinks.job_manifest(ticket_jobs(spark, sf)).select("*", "document.*", "settings.*", "output.*").drop("document", "settings", "output")
    short = {"cyan": "c", "magenta": "m", "yellow": "y", "black": "k"}
    return made.select("*", *[F.col(f"angles.{p}").alias(f"angle_{k}") for p, k in short.items()],
                       *[F.col(f"visible.{p}").alias(f"shows_{k}") for p, k in short.items()]).drop("angles", "visible")


@register("job_ticket", with_(TICKETS, f""",
lists AS (SELECT job_id, string_agg(short || ' ' || CAST(angle AS INT) || '°', ' · ' ORDER BY i) AS angles,
                 string_agg(short, ', ' ORDER BY i) FILTER (shown) AS enabled FROM job_plates GROUP BY 1)
SELECT job_id, concat_ws(chr(10), 'PRINT JOB TICKET', 'Artwork: ' || source_name, 'Source: ' || src_w || ' × ' || src_h || 'px',
  'Sheet: ' || sheet_label, 'Orientation: ' || CASE orientation WHEN 'portrait' THEN 'Portrait' ELSE 'Landscape' END,
  'Output dimensions: ' || sheet_w || ' × ' || sheet_h || 'px', 'Resolution: 240 DPI', 'Scale: ' || scale_pct || '%',
  'Mirror: ' || CASE WHEN NOT mirror THEN 'Off' WHEN mirror_direction = 'horizontal' THEN 'Horizontal' ELSE 'Vertical' END,
  'Dot: ' || dot_shape, 'Custom SVG: ' || custom_shape || ' (stretched to square)',
  'Color mode: ' || CASE WHEN grayscale THEN 'Grayscale (K)' ELSE 'CMYK' END, 'Outline stroke: ' || {NUMBER('stroke_width')} || 'px',
  'Cell size: ' || CAST(cell_size AS INT) || 'px', 'Angles: ' || angles, 'Enabled plates: ' || coalesce(enabled, 'None'),
  'Registration marks: ' || CASE WHEN registration THEN 'Included' ELSE 'Off' END, 'Registration size: ' || registration_size || 'px',
  'Registration offset: ' || registration_offset || 'px', 'Registration weight: ' || {NUMBER('registration_weight')} || 'px',
  'Registration mode: ' || CASE registration_mode WHEN 'centered' THEN 'Top/bottom centered' ELSE 'Four corners' END,
  'Registration SVG: ' || registration_shape,
  'Estimated screen load: ' || format('{{:,}}', marks) || ' marks/plate' || CASE WHEN worst_plate IS NULL THEN ''
    ELSE ' (' || upper(CASE worst_plate WHEN 'black' THEN 'k' ELSE worst_plate[1] END) || ' at ' || CAST(worst_angle AS INT) || '°)' END) AS ticket
FROM tickets JOIN lists USING (job_id)"""))
def job_ticket(spark, sf):
    return sinks.job_ticket(ticket_jobs(spark, sf))


@register("clean_name", f"""
SELECT doc_id, {CLEAN.format("name")} AS name FROM (SELECT doc_id, source || '/' || lang || ' Sheet ' || doc_id || '.final.' || CASE WHEN doc_id % 3 = 0 THEN 'PNG' ELSE 'jpeg' END AS name FROM documents)
""")
def clean_name(spark, sf):
    name = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit(" Sheet "), F.col("doc_id").cast("string"),
                    F.lit(".final."), F.when(F.col("doc_id") % 3 == 0, "PNG").otherwise("jpeg"))
    return read(spark, sf, "documents").select("doc_id", sinks.clean_name(name).alias("name"))


@register("plate_package", with_(COV, """
SELECT 'part ' || image_id || '.png' AS source_name, plate, 'part-' || image_id || '-' || any_value(short) || '-plate.png' AS file_name,
       count(*) AS pixels, CAST(count(*) FILTER (cov > 0) AS BIGINT) AS ink_pixels
FROM (SELECT c.*, p.short FROM cov c JOIN plates p USING (plate)) WHERE image_id % 11 <> 0 OR plate = 'black' GROUP BY image_id, plate"""))
def plate_package(spark, sf):
    cov = parts_coverage(spark, sf).where((F.col("image_id") % 11 != 0) | (F.col("plate") == "black"))
    named = cov.groupBy("image_id", "plate").agg(
        F.count(F.lit(1)).alias("pixels"), F.count_if(F.col("cov") > 0).alias("ink_pixels"))
    named = named.withColumn("source_name", F.concat(F.lit("part "), F.col("image_id").cast("string"), F.lit(".png")))
    return named.select("source_name", "plate", sinks.plate_file_name().alias("file_name"), "pixels", "ink_pixels")
