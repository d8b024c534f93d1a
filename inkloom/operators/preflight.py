"""Job preflight: checks computed inside each job row, so no check needs a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import ANGLE_PRESETS, MAX_MARKS_PER_PLATE, PLATES, PLATE_SHORT
from ..functions.numeric import as_col, radians
from .geometry import normalize_angle, sheet_dims


def estimate_grid_points(w, h, cell, angle) -> Column:
    """Upper estimate of marks on a plate: columns times rows of the rotated box, each at least one."""
    theta = radians(angle)
    cos, sin = F.abs(F.cos(theta)), F.abs(F.sin(theta))
    size = F.greatest(F.lit(1e-6), as_col(cell).cast("double"))
    across = F.ceil((as_col(w) * cos + as_col(h) * sin) / size)
    down = F.ceil((as_col(w) * sin + as_col(h) * cos) / size)
    return F.greatest(F.lit(1), across) * F.greatest(F.lit(1), down)


def job_plates() -> Column:
    """Applicable plates of a job in print order: array of (plate, angle, visible); only black in grayscale."""
    every = F.array(*[F.struct(F.lit(p).alias("plate"), F.col(f"angles.{p}").alias("angle"),
                               F.col(f"visible.{p}").alias("visible")) for p in PLATES])
    return F.when(F.col("grayscale"), F.slice(every, 4, 1)).otherwise(every)


def hidden_plates() -> Column:
    return F.transform(F.filter(job_plates(), lambda p: ~p["visible"]), lambda p: p["plate"])


def shared_angles(jobs: DataFrame) -> DataFrame:
    """One row per job and normalised angle that more than one applicable plate uses."""
    plates = F.transform(job_plates(), lambda p: F.struct(
        p["plate"].alias("plate"), normalize_angle(p["angle"]).alias("angle")))
    groups = F.transform(
        F.array_distinct(F.transform(plates, lambda p: p["angle"])),
        lambda a: F.struct(a.alias("angle"), F.transform(
            F.filter(plates, lambda p: p["angle"] == a), lambda p: p["plate"]).alias("plates")))
    shared = F.filter(groups, lambda g: F.size(g["plates"]) > 1)
    return jobs.select("job_id", F.explode(shared).alias("g")).select("job_id", "g.angle", "g.plates")


def screen_load(jobs: DataFrame) -> DataFrame:
    """Adds the heaviest visible plate: marks, worst_plate, worst_angle. The first plate wins ties."""
    sized = sheet_dims(jobs)
    loads = F.transform(F.filter(job_plates(), lambda p: p["visible"]), lambda p: F.struct(
        estimate_grid_points(F.col("sheet_w"), F.col("sheet_h"), F.col("cell_size"), p["angle"]).alias("marks"),
        p["plate"].alias("plate"), p["angle"].alias("angle")))
    sized = sized.withColumn("_loads", loads)
    most = F.array_max(F.transform("_loads", lambda p: p["marks"]))
    worst = F.get(F.filter("_loads", lambda p: p["marks"] == most), F.lit(0))
    return sized.withColumn("_worst", worst).select(
        *sized.columns[:-1], F.coalesce(F.col("_worst.marks"), F.lit(0)).cast("bigint").alias("marks"),
        F.col("_worst.plate").alias("worst_plate"), F.col("_worst.angle").alias("worst_angle"))


def _shared_groups() -> Column:
    plates = job_plates()
    angles = F.transform(plates, lambda p: normalize_angle(p["angle"]))
    repeated = F.filter(F.array_distinct(angles), lambda a: F.size(F.filter(angles, lambda b: b == a)) > 1)
    return repeated, plates


def preflight_count(jobs: DataFrame) -> DataFrame:
    """Adds the five review flags and their sum."""
    repeated, _ = _shared_groups()
    flags = {
        "hidden": F.size(hidden_plates()) > 0, "shared": F.size(repeated) > 0,
        "no_registration": ~F.col("registration"), "inverted": F.col("invert"),
        "dense": F.col("marks") > MAX_MARKS_PER_PLATE}
    out = screen_load(jobs).withColumns({k: v.cast("int") for k, v in flags.items()})
    total = sum((F.col(k) for k in flags), F.lit(0))
    return out.withColumn("reviews", total)


def preflight_report(jobs: DataFrame) -> DataFrame:
    """Five (label, value, review) rows per job."""
    checked = preflight_count(jobs)
    short = F.create_map(*[F.lit(v) for kv in PLATE_SHORT.items() for v in kv])
    number = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    hidden = F.array_join(F.transform(hidden_plates(), lambda p: short[p]), ", ")
    repeated, plates = _shared_groups()
    shared = F.array_join(F.transform(repeated, lambda a: F.concat(
        F.array_join(F.transform(F.filter(plates, lambda p: normalize_angle(p["angle"]) == a),
                                 lambda p: short[p["plate"]]), "/"),
        F.lit(" share "), number(a), F.lit("°"))), " · ")
    load = F.when(F.col("worst_plate").isNull(), "No enabled plates").otherwise(F.concat(
        F.format_number("marks", 0), F.lit(" estimated marks/plate ("), short[F.col("worst_plate")], F.lit(" at "),
        number(F.col("worst_angle")), F.lit("°)")))
    distinct = F.when(F.col("grayscale"), "Grayscale uses the K screen angle").otherwise(
        "All four angles are distinct")
    row = lambda label, value, flag: F.struct(
        F.lit(label).alias("label"), value.alias("value"), (F.col(flag) == 1).alias("review"))
    rows = F.array(
        row("Plate visibility", F.when(F.col("hidden") == 0, "4/4 enabled").otherwise(
            F.concat(hidden, F.lit(" hidden"))), "hidden"),
        row("Screen angles", F.when(F.col("shared") == 0, distinct).otherwise(shared), "shared"),
        row("Registration", F.when(F.col("registration"), "Marks included").otherwise(
            "Off — confirm before film"), "no_registration"),
        row("Dot polarity", F.when(F.col("invert"), "Inverted — confirm").otherwise("Standard positive"), "inverted"),
        row("Screen load", load, "dense"))
    return checked.select("job_id", F.posexplode(rows).alias("seq", "c")).select("job_id", "seq", "c.*")


def mark_budget_gate(jobs: DataFrame, limit: int = MAX_MARKS_PER_PLATE) -> DataFrame:
    """Adds blocked and a notice; the cell size is never changed."""
    loaded = screen_load(jobs)
    text = F.concat(F.lit("Export blocked: estimated "), F.format_number("marks", 0),
                    F.lit(" marks per plate exceeds the "), F.format_number(F.lit(limit), 0),
                    F.lit(" limit. Increase cell size to export."))
    blocked = F.col("marks") > limit
    return loaded.withColumns({"blocked": blocked, "notice": F.when(blocked, text)})


def angle_presets(jobs: DataFrame, preset="preset") -> DataFrame:
    """Replace the angles by those of the named preset; unknown presets leave the job as it is."""
    angles = F.col("angles")
    for name, *values in reversed(ANGLE_PRESETS):
        chosen = F.struct(*[F.lit(v).alias(p) for p, v in zip(PLATES, values)])
        angles = F.when(F.col(preset) == name, chosen).otherwise(angles)
    return jobs.withColumn("angles", angles)


def dedupe_jobs(jobs: DataFrame, keys: list[str]) -> DataFrame:
    """One row per distinct parameter set: smallest job id and how many jobs share the result.

    Grouping is on the values themselves, so a hash collision can never merge two jobs; partial
    aggregation keeps a parameter set used by very many jobs cheap.
    """
    return jobs.groupBy(*keys).agg(F.min("job_id").alias("first_job"), F.count(F.lit(1)).alias("jobs")).withColumn(
        "result_key", F.xxhash64(*keys))


def preflight_cube(jobs: DataFrame) -> DataFrame:
    """Failing checks by sheet, orientation and priority with all subtotals."""
    flags = ["hidden", "shared", "no_registration", "inverted", "dense"]
    return preflight_count(jobs).cube("sheet_id", "orientation", "priority").agg(
        F.count(F.lit(1)).alias("jobs"), *[F.sum(f).cast("bigint").alias(f) for f in flags],
        F.sum("reviews").cast("bigint").alias("reviews"),
        F.grouping_id().cast("int").alias("grouping"))
