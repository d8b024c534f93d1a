"""Outputs: vector fragments, plate packages, manifests and job tickets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import DPI, JOB_DEFAULTS, PLATES, PLATE_SHORT, SHEETS
from ..functions.numeric import as_col
from ..functions.plates import short_name
from ..operators import preflight


def clean_name(name) -> Column:
    """File stem for outputs: last extension removed, other characters folded to dashes, lower case."""
    stem = F.regexp_replace(name, r"\.[^.]+$", "")
    return F.lower(F.regexp_replace(stem, r"(?i)[^a-z0-9\-_]+", "-"))


def number_text(value) -> Column:
    """A coordinate with four decimals, below 10^11: ten-thousandths as an integer, which takes a fraction of the time of a format string."""
    value = as_col(value).cast("double")
    parts = F.floor(F.abs(value) * 10000 + 0.5)
    sign = F.when((value < 0) & (parts > 0), "-").otherwise("")
    return F.concat(sign, F.floor(parts / 10000).cast("string"), F.lit("."), F.substring((parts % 10000 + 10000).cast("string"), 2, 4))


def mark_fragment(shape="shape", cx="cx", cy="cy", size="size", stroke: float | Column = 1.0) -> Column:
    """Vector element for one mark; rings are drawn with the stroke, a number or a column."""
    stroke = as_col(stroke).cast("double")
    x, y, d = F.col(cx), F.col(cy), F.col(size)
    r, n = d / 2, number_text
    cat = F.concat
    lit = F.lit

    def path(*parts):
        return cat(lit('<path d="'), *[p if isinstance(p, Column) else lit(p) for p in parts], lit('"/>'))

    def rect(left, top, width, height, extra=None):
        tail = cat(lit('" rx="'), n(extra)) if extra is not None else lit("")
        return cat(lit('<rect x="'), n(left), lit('" y="'), n(top), lit('" width="'), n(width), lit('" height="'),
                   n(height), tail, lit('"/>'))

    bar = d * 0.14
    disc = cat(lit('<circle cx="'), n(x), lit('" cy="'), n(y), lit('" r="'), n(r), lit('"/>'))
    ring = cat(lit('<circle cx="'), n(x), lit('" cy="'), n(y), lit('" r="'), n(F.greatest(lit(0.0), r - stroke / 2)),
               lit('" fill="none" stroke="#000000" stroke-width="'), n(stroke), lit('"/>'))
    diamond = path("M ", n(x), " ", n(y - r), " L ", n(x + r), " ", n(y), " L ", n(x), " ", n(y + r), " L ",
                   n(x - r), " ", n(y), " Z")
    triangle = path("M ", n(x), " ", n(y - r), " L ", n(x + r), " ", n(y + r), " L ", n(x - r), " ", n(y + r), " Z")
    cross = path("M ", n(x - bar), " ", n(y - r), " H ", n(x + bar), " V ", n(y + r), " H ", n(x - bar), " Z M ",
                 n(x - r), " ", n(y - bar), " H ", n(x + r), " V ", n(y + bar), " H ", n(x - r), " Z")
    use = use_fragment("dot-shape", cx, cy, size)
    s = F.col(shape)
    return (F.when(s == "square", rect(x - r, y - r, d, d))
            .when(s == "diamond", diamond).when(s == "triangle", triangle).when(s == "cross", cross)
            .when(s == "line", rect(x - r, y - d * 0.16, d, d * 0.32, d * 0.16))
            .when((s == "circle-outline") & (stroke < r), ring)
            .when(s == "custom", use).otherwise(disc))


def run_fragment(x="x0", y="y", length="length", pixel: float | Column = 1.0) -> Column:
    """Rectangle for a horizontal ink run, widened by the quarter-pixel overlap."""
    n, pixel = number_text, as_col(pixel).cast("double")
    return F.concat(F.lit('<rect x="'), n(F.col(x) * pixel), F.lit('" y="'), n(F.col(y) * pixel),
                    F.lit('" width="'), n(F.col(length) * pixel + 0.25), F.lit('" height="'),
                    n(pixel + 0.25), F.lit('"/>'))


def symbol(document: str, name: str) -> Column:
    """A whole vector document as a symbol that marks refer to; empty where there is none."""
    opened = F.regexp_replace(F.trim(document), r"^<svg\b", f'<symbol id="{name}"')
    return F.coalesce(F.regexp_replace(opened, r"</svg>$", "</symbol>"), F.lit(""))


def use_fragment(name: str, x="x", y="y", size="size") -> Column:
    """A reference to a symbol, centred at (x, y)."""
    n, s = number_text, F.col(size)
    return F.concat(F.lit(f'<use href="#{name}" x="'), n(F.col(x) - s / 2), F.lit('" y="'), n(F.col(y) - s / 2),
                    F.lit('" width="'), n(s), F.lit('" height="'), n(s), F.lit('"/>'))


def registration_fragment(x="x", y="y", size="size") -> Column:
    n, s, cx, cy = number_text, F.col(size), F.col(x), F.col(y)
    return F.concat(F.lit('<g opacity="0.7"><circle cx="'), n(cx), F.lit('" cy="'), n(cy), F.lit('" r="'), n(s * 0.58),
                    F.lit('"/><path d="M '), n(cx - s), F.lit(" "), n(cy), F.lit(" h "), n(2 * s), F.lit(" M "), n(cx),
                    F.lit(" "), n(cy - s), F.lit(" v "), n(2 * s), F.lit('"/></g>'))


def svg_header(w="w", h="h", symbols: Column | None = None) -> Column:
    """Opening of a vector file: size in inches, the symbols that it refers to, and the group of its marks."""
    inches = lambda c: F.format_string("%.4f", F.col(c) / F.lit(float(DPI)))
    return F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="'), inches(w), F.lit('in" height="'),
                    inches(h), F.lit('in" viewBox="0 0 '), F.col(w).cast("string"), F.lit(" "),
                    F.col(h).cast("string"), F.lit('"><defs>'), symbols if symbols is not None else F.lit(""),
                    F.lit('</defs><g fill="#000000" stroke="none">'))


def svg_lines(marks: DataFrame | None, headers: DataFrame, registration: DataFrame | None = None, runs: DataFrame | None = None) -> DataFrame:
    """Header, marks or runs, registration and footer as text lines with a sort position per plate.

    ``headers`` has one row per (image_id, plate) with w and h, so a plate without marks still gets its file, and may hold
    ``dot_symbol`` and ``registration_symbol``, whole vector documents: they become the symbols that custom marks and registration marks
    refer to, once per file. ``marks`` may hold ``stroke``, the width of rings. ``runs`` are those of ``coalesce_runs``, in pixels
    of ``pixel`` width (1 unless the column is there). Rows carry ``part`` (order within the plate) and are written by write_plate_svg.
    """
    keys = ["image_id", "plate"]
    held = lambda df, name: df is not None and name in df.columns
    symbols = [symbol(f"{n}_symbol", i) for n, i in (("dot", "dot-shape"), ("registration", "registration-shape")) if held(headers, f"{n}_symbol")]
    row = lambda df, part, a, b, line: df.select(*keys, F.lit(part).alias("part"), as_col(a).cast("int").alias("a"),
                                                 as_col(b).cast("int").alias("b"), as_col(line).alias("line"))
    out = row(headers, 0, 0, 0, svg_header(symbols=F.concat(*symbols) if symbols else None))
    if marks is not None:
        stroke = F.col("stroke") if held(marks, "stroke") else 1.0
        out = out.unionByName(row(marks, 1, F.col("u_idx"), F.col("v_idx"), mark_fragment(stroke=stroke)))
    if runs is not None:
        pixel = F.col("pixel") if held(runs, "pixel") else F.lit(1.0)
        out = out.unionByName(row(runs, 1, F.col("y"), F.col("x0"), run_fragment(pixel=pixel)))
    if registration is not None:
        own = registration.withColumn("custom", F.lit(False))
        if held(headers, "registration_symbol"):
            own = registration.join(headers.select(*keys, F.col("registration_symbol").isNotNull().alias("custom")).hint("merge"), keys)
        used = F.concat(F.lit('<g opacity="0.7">'), use_fragment("registration-shape"), F.lit("</g>"))
        opened = own.where(F.col("mark") == 0)
        drawn = F.concat(F.lit('<g fill="none" stroke="#000000" stroke-width="'), number_text(F.col("weight")), F.lit('">'))
        out = (out.unionByName(row(own, 3, F.col("mark"), 0, F.when(F.col("custom"), used).otherwise(registration_fragment())))
               .unionByName(row(opened, 2, 1, 0, F.when(F.col("custom"), "<g>").otherwise(drawn)))
               .unionByName(row(opened, 4, 1, 0, "</g>")))
    return out.unionByName(row(headers, 2, 0, 0, "</g>")).unionByName(row(headers, 5, 0, 0, "</svg>"))


def write_plate_svg(lines: DataFrame, path: str) -> None:
    """One folder per image and plate with the ordered text of its vector file.

    Range partitioning on the sort keys splits a plate with very many marks over several ordered part
    files, so no task has to hold one plate alone.
    """
    order = ["image_id", "plate", "part", "a", "b"]
    (lines.repartitionByRange(*order).sortWithinPartitions(*order)
     .select("image_id", "plate", "line").write.partitionBy("image_id", "plate").text(path))


def write_plate_package(cov: DataFrame, path: str, grayscale: bool = False) -> None:
    """Coverage stored once per plate folder; only black for grayscale jobs."""
    kept = cov.where(F.col("plate") == "black") if grayscale else cov
    kept.withColumn("ink", short_name()).write.partitionBy("ink").parquet(path)


def plate_file_name(source="source_name", plate="plate") -> Column:
    return F.concat(clean_name(F.col(source)), F.lit("-"), short_name(plate), F.lit("-plate.png"))


def _field(jobs: DataFrame, name: str) -> Column:
    """A job column, or its default where it is null or the table lacks it."""
    default = F.lit(JOB_DEFAULTS[name]) if JOB_DEFAULTS[name] is not None else F.lit(None).cast("string")
    return F.coalesce(F.col(name), default) if name in jobs.columns else default


def job_manifest(jobs: DataFrame) -> DataFrame:
    """Manifest of each job: source and package, ``document``, ``settings``, registration and ``output`` groups as structs."""
    loaded = preflight.screen_load(jobs)
    field = lambda name: _field(loaded, name)
    plates = F.when(F.col("grayscale"), F.array(F.lit("black"))).otherwise(F.array(*[F.lit(p) for p in PLATES]))
    package = F.concat(clean_name(F.col("source_name")), F.when(F.col("grayscale"), "-K").otherwise("-CMYK"),
                       F.lit("-plates.zip"))
    return loaded.select(
        "job_id", F.col("source_name").alias("source"), package.alias("package"), F.array_join(plates, ",").alias("plates"),
        F.struct("sheet_id", "orientation", "scale_pct", "mirror", "mirror_direction").alias("document"),
        F.struct("dot_shape", field("custom_shape").alias("custom_shape"), "cell_size", field("stroke_width").alias("stroke_width"), "angles",
                 "visible", "invert", "grayscale").alias("settings"),
        "registration", *[field(f"registration_{n}").alias(f"registration_{n}") for n in ("size", "offset", "weight", "shape", "mode")],
        F.struct(F.col("sheet_w").alias("width"), F.col("sheet_h").alias("height"), F.lit(DPI).alias("dpi"),
                 F.col("marks").alias("estimated_marks_per_plate"), "worst_plate", "worst_angle").alias("output"))


def write_manifest(jobs: DataFrame, path: str) -> None:
    """One JSON document per job."""
    job_manifest(jobs).write.json(path, ignoreNullFields=False)


def title_case(value) -> Column:
    return F.concat(F.upper(F.substr(value, F.lit(1), F.lit(1))), F.substr(value, F.lit(2)))


def plain_number(value) -> Column:
    """A number as text without a trailing fraction of zero."""
    return F.regexp_replace(as_text(value), r"\.0$", "")


def as_text(value) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("string")


def job_ticket(jobs: DataFrame, product: str = "PRINT") -> DataFrame:
    """Readable ticket text, one per job. Fields that the table lacks or leaves open print their defaults; lines of shapes
    appear only where a job has one."""
    loaded = preflight.screen_load(jobs)
    labels = F.create_map(*[F.lit(v) for s in SHEETS for v in (s[0], s[1])])
    plates = preflight.job_plates()
    shown = F.filter(plates, lambda p: p["visible"])
    short = F.create_map(*[F.lit(v) for kv in PLATE_SHORT.items() for v in kv])
    enabled = F.array_join(F.transform(shown, lambda p: short[p["plate"]]), ", ")
    field = lambda name: _field(loaded, name)
    angles = F.array_join(F.transform(plates, lambda p: F.concat(
        short[p["plate"]], F.lit(" "), plain_number(p["angle"]), F.lit("°"))), " · ")
    load = F.concat(F.lit("Estimated screen load: "), F.format_number("marks", 0), F.lit(" marks/plate"),
                    F.when(F.col("worst_plate").isNotNull(), F.concat(
                        F.lit(" ("), short[F.col("worst_plate")], F.lit(" at "), plain_number("worst_angle"),
                        F.lit("°)"))).otherwise(""))
    pixel = F.lit("px")
    lines = F.array(
        F.lit(f"{product} JOB TICKET"),
        F.concat(F.lit("Artwork: "), "source_name"),
        F.concat(F.lit("Source: "), as_text("src_w"), F.lit(" × "), as_text("src_h"), pixel),
        F.concat(F.lit("Sheet: "), F.coalesce(labels[F.col("sheet_id")], F.col("sheet_id"))),
        F.concat(F.lit("Orientation: "), title_case(F.col("orientation"))),
        F.concat(F.lit("Output dimensions: "), as_text("sheet_w"), F.lit(" × "), as_text("sheet_h"), pixel),
        F.lit(f"Resolution: {DPI} DPI"),
        F.concat(F.lit("Scale: "), as_text("scale_pct"), F.lit("%")),
        F.concat(F.lit("Mirror: "), F.when(F.col("mirror"), title_case(F.col("mirror_direction"))).otherwise("Off")),
        F.concat(F.lit("Dot: "), "dot_shape"),
        F.when(F.col("dot_shape") == "custom", F.concat(F.lit("Custom SVG: "), field("custom_shape"), F.lit(" (stretched to square)"))),
        F.concat(F.lit("Color mode: "), F.when(F.col("grayscale"), "Grayscale (K)").otherwise("CMYK")),
        F.concat(F.lit("Outline stroke: "), plain_number(field("stroke_width")), pixel),
        F.concat(F.lit("Cell size: "), plain_number("cell_size"), pixel),
        F.concat(F.lit("Angles: "), angles),
        F.concat(F.lit("Enabled plates: "), F.when(enabled == "", "None").otherwise(enabled)),
        F.concat(F.lit("Registration marks: "), F.when(F.col("registration"), "Included").otherwise("Off")),
        *[F.concat(F.lit(f"Registration {n}: "), plain_number(field(f"registration_{n}")), pixel) for n in ("size", "offset", "weight")],
        F.concat(F.lit("Registration mode: "), F.when(field("registration_mode") == "centered", "Top/bottom centered").otherwise("Four corners")),
        F.concat(F.lit("Registration SVG: "), field("registration_shape")),
        load)
    return loaded.select("job_id", F.array_join(F.array_compact(lines), "\n").alias("ticket"))
