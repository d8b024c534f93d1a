"""Queries over job preflight."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import preflight as p
from .fixture_sql import JOBS, JOB_PLATES, marks_of, with_
from .registry import register
from .tables import jobs


@register("estimate_grid_points", with_(JOBS, f"""
SELECT job_id, {marks_of('src_w', 'src_h', 'cell_size', 'a0')} AS cyan_marks, {marks_of('sheet_w', 'sheet_h', 'cell_size', '90')} AS right_angle_marks FROM jobs"""))
def estimate_grid_points(spark, sf):
    from ..operators.geometry import sheet_dims
    j = sheet_dims(jobs(spark, sf))
    return j.select("job_id", p.estimate_grid_points(F.col("src_w"), F.col("src_h"), F.col("cell_size"),
                                                     F.col("angles.cyan")).alias("cyan_marks"),
                    p.estimate_grid_points(F.col("sheet_w"), F.col("sheet_h"), F.col("cell_size"), F.lit(90.0)
                                           ).alias("right_angle_marks"))


@register("mark_budget_gate", with_(JOB_PLATES, """
SELECT job_id, cell_size, marks, marks > 2000000 AS blocked, CASE WHEN marks > 2000000 THEN 'Export blocked: estimated ' || format('{:,}', marks)
  || ' marks per plate exceeds the 2,000,000 limit. Increase cell size to export.' END AS notice FROM loaded"""))
def mark_budget_gate(spark, sf):
    return p.mark_budget_gate(jobs(spark, sf)).select("job_id", "cell_size", "marks", "blocked", "notice")


@register("hidden_plates", with_(JOB_PLATES, """
SELECT job_id, count(*) AS n, string_agg(plate, ',' ORDER BY i) AS hidden FROM job_plates WHERE NOT shown GROUP BY job_id"""))
def hidden_plates(spark, sf):
    out = jobs(spark, sf).select("job_id", p.hidden_plates().alias("names")).where(F.size("names") > 0)
    return out.select("job_id", F.size("names").cast("bigint").alias("n"), F.array_join("names", ",").alias("hidden"))


@register("shared_angles", with_(JOB_PLATES, """
SELECT job_id, norm AS angle, string_agg(plate, ',' ORDER BY i) AS plates FROM job_plates GROUP BY job_id, norm HAVING count(*) > 1"""))
def shared_angles(spark, sf):
    return p.shared_angles(jobs(spark, sf)).withColumn("plates", F.array_join("plates", ","))


@register("screen_load", with_(JOB_PLATES, "SELECT job_id, marks, worst_plate, worst_angle FROM loaded"))
def screen_load(spark, sf):
    return p.screen_load(jobs(spark, sf)).select("job_id", "marks", "worst_plate", "worst_angle")


@register("preflight_count", with_(JOB_PLATES, """
SELECT job_id, hidden, shared, no_registration, inverted, dense, hidden + shared + no_registration + inverted + dense AS reviews FROM flags"""))
def preflight_count(spark, sf):
    return p.preflight_count(jobs(spark, sf)).select(
        "job_id", "hidden", "shared", "no_registration", "inverted", "dense", "reviews")


@register("preflight_report", with_(JOB_PLATES, """,
groups AS (SELECT job_id, norm, min(i) AS first, string_agg(short, '/' ORDER BY i) AS names FROM job_plates GROUP BY job_id, norm HAVING count(*) > 1),
shared_text AS (SELECT job_id, string_agg(names || ' share ' || CAST(norm AS INT) || '°', ' · ' ORDER BY first) AS txt FROM groups GROUP BY 1)
SELECT job_id, 0 AS seq, 'Plate visibility' AS label, CASE WHEN hidden = 0 THEN '4/4 enabled' ELSE hidden_names || ' hidden' END AS value, hidden = 1 AS review FROM flags
UNION ALL SELECT job_id, 1, 'Screen angles', coalesce(txt, CASE WHEN grayscale THEN 'Grayscale uses the K screen angle' ELSE 'All four angles are distinct' END), shared = 1 FROM flags LEFT JOIN shared_text USING (job_id)
UNION ALL SELECT job_id, 2, 'Registration', CASE WHEN registration THEN 'Marks included' ELSE 'Off — confirm before film' END, NOT registration FROM flags
UNION ALL SELECT job_id, 3, 'Dot polarity', CASE WHEN invert THEN 'Inverted — confirm' ELSE 'Standard positive' END, invert FROM flags
UNION ALL SELECT job_id, 4, 'Screen load', CASE WHEN worst_plate IS NULL THEN 'No enabled plates' ELSE format('{:,}', marks) || ' estimated marks/plate ('
   || upper(CASE worst_plate WHEN 'black' THEN 'k' ELSE worst_plate[1] END) || ' at ' || CAST(worst_angle AS INT) || '°)' END, dense = 1 FROM flags"""))
def preflight_report(spark, sf):
    return p.preflight_report(jobs(spark, sf))


@register("angle_presets", with_(JOBS, """
SELECT job_id, p.a0 AS cyan, p.a1 AS magenta, p.a2 AS yellow, p.a3 AS black FROM jobs JOIN presets p ON p.k = job_id % 6
UNION ALL SELECT job_id, a0, a1, a2, a3 FROM jobs WHERE job_id % 6 >= 4"""))
def angle_presets(spark, sf):
    chosen = jobs(spark, sf).withColumn("preset", F.concat(F.lit("preset-"), (F.col("job_id") % 6 + 1).cast("string")))
    return p.angle_presets(chosen).select("job_id", "angles.*")


@register("dedupe_jobs", with_(JOBS, """
SELECT sheet_id, orientation, cell_size, invert, grayscale, min(job_id) AS first_job, count(*) AS jobs FROM jobs
GROUP BY sheet_id, orientation, cell_size, invert, grayscale, a0, a1, a2, a3, hide_bits"""))
def dedupe_jobs(spark, sf):
    keys = ["sheet_id", "orientation", "cell_size", "invert", "grayscale", "angles", "visible"]
    return p.dedupe_jobs(jobs(spark, sf), keys).drop("angles", "visible", "result_key")


@register("preflight_cube", with_(JOB_PLATES, """
SELECT sheet_id, orientation, priority, count(*) AS jobs, CAST(sum(hidden) AS BIGINT) AS hidden, CAST(sum(shared) AS BIGINT) AS shared,
  CAST(sum(no_registration) AS BIGINT) AS no_registration, CAST(sum(inverted) AS BIGINT) AS inverted, CAST(sum(dense) AS BIGINT) AS dense,
  CAST(sum(hidden + shared + no_registration + inverted + dense) AS BIGINT) AS reviews,
  CAST(grouping(sheet_id) * 4 + grouping(orientation) * 2 + grouping(priority) AS INT) AS "grouping"
FROM flags GROUP BY CUBE (sheet_id, orientation, priority)"""))
def preflight_cube(spark, sf):
    return p.preflight_cube(jobs(spark, sf))
