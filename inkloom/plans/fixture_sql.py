"""SQL text of the derived tables, written independently of the DataFrame code, for the oracle queries."""

from __future__ import annotations

from ..functions.fixed_values import ANGLE_PRESETS, DPI, PLATES, PLATE_SHORT, SHEETS


def with_(*parts: str) -> str:
    """WITH clause from CTE texts followed by the final SELECT."""
    *ctes, body = parts
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body


def half_up(expr: str) -> str:
    return f"CAST(floor(({expr}) + 0.5e0) AS BIGINT)"


def scramble(expr: str) -> str:
    return f"CAST((CAST(xor(({expr}) & 4294967295, 2654435769) AS HUGEINT) * 2654435761) % 4294967296 AS BIGINT)"


def block_hash(x: str, y: str, plate: str) -> str:
    return f"((CAST({x} AS BIGINT) * 73856093 + CAST({y} AS BIGINT) * 19349663 + CAST({plate} AS BIGINT) * 83492791) & 4294967295)"


def unit_noise(x: str, y: str, seed: str) -> str:
    first = scramble(block_hash(x, y, seed))
    return f"(({scramble(f'({first} >> 7) + {seed}')} >> 8) / 16777216e0)"


def marks_of(w: str, h: str, cell: str, angle: str) -> str:
    t = f"({angle} * 3.141592653589793e0 / 180e0)"
    return (f"greatest(1, CAST(ceil(({w} * abs(cos({t})) + {h} * abs(sin({t}))) / {cell}) AS BIGINT)) * "
            f"greatest(1, CAST(ceil(({w} * abs(sin({t})) + {h} * abs(cos({t}))) / {cell}) AS BIGINT))")


PLATE_DIM = ("plates AS (SELECT * FROM (VALUES " +
             ", ".join(f"('{p}', {i}, '{PLATE_SHORT[p]}')" for i, p in enumerate(PLATES)) + ") t(plate, i, short))")

SHIP = """ship AS (
  SELECT l_returnflag || l_linestatus AS image_id, 50 AS w, 84 AS h,
         CAST(l_quantity AS INT) - 1 AS x, CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INT) AS y,
         CAST(count(*) AS INT) AS n, CAST(sum(l_partkey) % 256 AS INT) AS r, CAST(sum(l_suppkey) % 256 AS INT) AS g,
         CAST(sum(l_orderkey) % 256 AS INT) AS b
  FROM lineitem GROUP BY ALL)"""

EVENT_RASTER = """event_cells AS (
  SELECT event_type AS image_id, CAST(hour(ts) AS INT) AS x, CAST(day(ts) - 1 AS INT) AS y, CAST(count(*) AS INT) AS n
  FROM events GROUP BY ALL),
event_raster AS (
  SELECT g.image_id, 24 AS w, 31 AS h, g.x, g.y, coalesce(c.n, 0) AS n,
         255 - least(255, 25 * coalesce(c.n, 0)) AS grey
  FROM (SELECT image_id, x, y FROM (SELECT DISTINCT image_id FROM event_cells),
        (SELECT CAST(unnest(range(24)) AS INT) AS x), (SELECT CAST(unnest(range(31)) AS INT) AS y)) g
  LEFT JOIN event_cells c ON c.image_id = g.image_id AND c.x = g.x AND c.y = g.y)"""

PARTS = """heads AS (
  SELECT p_partkey AS image_id, CAST(10 + p_partkey % 5 AS INT) AS w, CAST(8 + p_partkey % 4 AS INT) AS h,
         p_size AS size, CAST(floor(p_retailprice) AS BIGINT) AS price FROM part),
grid AS (
  SELECT *, CAST(unnest(range(w)) AS INT) AS x FROM (SELECT *, CAST(unnest(range(h)) AS INT) AS y FROM heads)),
parts AS (
  SELECT image_id, w, h, x, y,
    CAST(CASE WHEN m THEN 255 ELSE (17 * x + 3 * size) % 256 END AS INT) AS r,
    CAST(CASE WHEN m THEN 255 ELSE (23 * y + image_id) % 256 END AS INT) AS g,
    CAST(CASE WHEN m THEN 255 ELSE (11 * (x + y) + price) % 256 END AS INT) AS b,
    CAST((37 * x + 11 * y + image_id) % 256 AS INT) AS a
  FROM (SELECT *, (x < 1 OR y < 1 OR x >= w - 1 OR y >= h - 1) AS m FROM grid))"""

LUM = "(0.299e0 * r + 0.587e0 * g + 0.114e0 * b)"


def separated(source: str = "parts", invert: bool = False, grayscale: bool = False, name: str = "cov",
              keep: str = "") -> str:
    """CTEs turning a pixel table into (image_id, w, h, x, y, plate, i, cov)."""
    if grayscale:
        grey = f"floor(least(255e0, greatest(0e0, {LUM})) + 0.5e0) / 255e0"
        tone = grey if invert else f"1e0 - {grey}"
        return (f"{name} AS (SELECT {keep} image_id, w, h, x, y, 'black' AS plate, 3 AS i, "
                f"CASE WHEN {LUM} >= 250 THEN 0e0 ELSE least(1e0, greatest(0e0, pow({tone}, 0.75e0))) END AS cov "
                f"FROM {source})")
    value = "CASE i WHEN 0 THEN c - k WHEN 1 THEN m - k WHEN 2 THEN ye - k ELSE k END"
    value = f"1e0 - ({value})" if invert else value
    return (f"{name}_raw AS (SELECT *, 1e0 - r / 255e0 AS c, 1e0 - g / 255e0 AS m, 1e0 - b / 255e0 AS ye, "
            f"1e0 - greatest(r, g, b) / 255e0 AS k FROM {source}), "
            f"{name} AS (SELECT {keep} image_id, w, h, x, y, plate, i, "
            f"CASE WHEN {LUM} >= 250 THEN 0e0 ELSE {value} END AS cov FROM {name}_raw, plates)")


COV = PLATE_DIM + ",\n" + PARTS + ",\n" + separated()

FIELD = """field AS (
  SELECT CAST(label AS BIGINT) AS image_id, 64 AS w, 'black' AS plate, vec_id AS y,
         CAST(unnest(range(64)) AS INT) AS x,
         least(1e0, greatest(0e0, 0.5e0 + CAST(unnest(embedding) AS DOUBLE))) AS cov FROM embeddings)"""

SHEET_DIM = ("sheets AS (SELECT id, label, CAST(floor(w_in * " + str(DPI) + " + 0.5) AS INT) AS pw, "
             "CAST(floor(h_in * " + str(DPI) + " + 0.5) AS INT) AS ph, k FROM (VALUES " +
             ", ".join(f"('{s[0]}', '{s[1]}', {s[2]}e0, {s[3]}e0, {k})" for k, s in enumerate(SHEETS)) +
             ") t(id, label, w_in, h_in, k))")
PRESET_DIM = ("presets AS (SELECT * FROM (VALUES " +
              ", ".join(f"({k}, '{p[0]}', {p[1]}e0, {p[2]}e0, {p[3]}e0, {p[4]}e0)"
                        for k, p in enumerate(ANGLE_PRESETS)) + ") t(k, name, a0, a1, a2, a3))")

JOBS = SHEET_DIM + ",\n" + PRESET_DIM + """,
jobs AS (
  SELECT o_orderkey AS job_id, s.id AS sheet_id, s.label AS sheet_label,
         CASE WHEN o_custkey % 2 = 1 THEN 'landscape' ELSE 'portrait' END AS orientation,
         CASE WHEN o_custkey % 2 = 1 THEN ph ELSE pw END AS sheet_w,
         CASE WHEN o_custkey % 2 = 1 THEN pw ELSE ph END AS sheet_h,
         CAST(3 + o_orderkey % 62 AS DOUBLE) AS cell_size, a0, a1, a2,
         CASE WHEN o_orderkey % 5 = 0 THEN a0 ELSE a3 END AS a3,
         o_custkey % 16 AS hide_bits, o_orderstatus = 'P' AS invert, o_orderkey % 11 = 0 AS grayscale,
         o_orderpriority <> '5-LOW' AS registration, o_orderpriority AS priority,
         CAST(200 + o_custkey % 4000 AS INT) AS src_w, CAST(200 + (7 * o_orderkey) % 4000 AS INT) AS src_h,
         CAST(10 + o_orderkey % 391 AS INT) AS scale_pct, 'Art Work ' || o_orderkey || '.v2.PNG' AS source_name,
         list_extract(['round','square','diamond','line','triangle','cross','circle-outline'], CAST(o_orderkey % 7 + 1 AS INT)) AS dot_shape,
         o_custkey % 3 = 0 AS mirror, CASE WHEN o_custkey % 2 = 0 THEN 'horizontal' ELSE 'vertical' END AS mirror_direction
  FROM orders JOIN sheets s ON s.k = o_orderkey % 8 JOIN presets p ON p.k = o_orderkey % 4)"""

JOB_PLATES = PLATE_DIM + ",\n" + JOBS + """,
job_plates AS (
  SELECT *, (hide_bits >> i) % 2 = 0 AS shown, (angle % 360 + 360) % 360 AS norm,
         """ + marks_of("sheet_w", "sheet_h", "cell_size", "angle") + """ AS marks
  FROM (SELECT j.*, p.*, CASE i WHEN 0 THEN a0 WHEN 1 THEN a1 WHEN 2 THEN a2 ELSE a3 END AS angle
        FROM jobs j, plates p WHERE NOT grayscale OR i = 3)),
worst AS (
  SELECT job_id, marks, plate, angle FROM job_plates WHERE shown
  QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY marks DESC, i) = 1),
loaded AS (
  SELECT j.*, coalesce(w.marks, 0) AS marks, w.plate AS worst_plate, w.angle AS worst_angle
  FROM jobs j LEFT JOIN worst w USING (job_id)),
flags AS (
  SELECT l.*, CAST(coalesce(h.n, 0) > 0 AS INT) AS hidden, CAST(coalesce(s.n, 0) > 0 AS INT) AS shared,
         CAST(NOT registration AS INT) AS no_registration, CAST(invert AS INT) AS inverted,
         CAST(marks > 2000000 AS INT) AS dense, h.names AS hidden_names
  FROM loaded l
  LEFT JOIN (SELECT job_id, count(*) AS n, string_agg(short, ', ' ORDER BY i) AS names FROM job_plates WHERE NOT shown GROUP BY 1) h USING (job_id)
  LEFT JOIN (SELECT job_id, count(*) AS n FROM (SELECT job_id, norm FROM job_plates GROUP BY ALL HAVING count(*) > 1) GROUP BY 1) s USING (job_id))"""
