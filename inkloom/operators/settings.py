"""Settings documents: ordered validation and defaults, and the markup audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import (DIFFUSION_ALGORITHMS, DIFFUSION_DEFAULTS, DIFFUSION_MODULATIONS, DOT_SHAPES,
                                      GLITCH_DEFAULTS, MAX_SVG_BYTES, PLATES, SVG_SHAPES, SVG_SKIPPED)
from .geometry import normalize_angle

MAX_CELL = 256
NUMBER = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|INT|SMALLINT|TINYINT)$"


def _field(path: str) -> Column:
    return F.variant_get("_doc", f"$.{path}", "variant")


def _type(path: str) -> Column:
    """Type name of a field; null when it is absent. Types of all fields are listed once per document."""
    *outer, name = path.split(".")
    return F.try_element_at(F.col("_" + "_".join([*outer, "types"])), F.lit(name))


def _types_of(doc: Column) -> Column:
    fields = F.try_variant_get(doc, "$", "map<string,variant>")
    return F.transform_values(fields, lambda _, v: F.schema_of_variant(v))


def _number(path: str) -> Column:
    return F.when(_type(path).rlike(NUMBER), F.try_variant_get("_doc", f"$.{path}", "double"))


def _text(path: str) -> Column:
    return F.when(_type(path) == "STRING", F.try_variant_get("_doc", f"$.{path}", "string"))


def _is(path: str, kind: type) -> Column:
    found = _type(path)
    test = found == "BOOLEAN" if kind is bool else found == "STRING" if kind is str else found.rlike(NUMBER)
    return F.coalesce(test, F.lit(False))


def _given(path: str) -> Column:
    return _type(path).isNotNull()


def _rules() -> list[tuple[str, Column]]:
    """(field, broken) in the order in which a document is checked."""
    outside = lambda f, lo, hi: ~_is(f, float) | ~F.coalesce(_number(f).between(lo, hi), F.lit(False))
    member = lambda f, names: F.coalesce(_text(f).isin(*names), F.lit(False))
    nested = lambda f: F.coalesce(_type(f).rlike("^(OBJECT|ARRAY)<"), F.lit(False))
    kind = F.schema_of_variant("_doc")
    rules = [
        ("settings", ~F.coalesce(kind.rlike("^(OBJECT|ARRAY)<"), F.lit(False))),
        ("cellSize", ~_is("cellSize", float) | (_number("cellSize") <= 0) | (_number("cellSize") > MAX_CELL)),
        ("frayedXEdge", _given("frayedXEdge") & outside("frayedXEdge", 0, 100)),
        ("frayedYEdge", _given("frayedYEdge") & outside("frayedYEdge", 0, 100))]
    rules += [(f, _given(f) & ~_is(f, type(v) if isinstance(v, (bool, str)) else float))
              for group in (DIFFUSION_DEFAULTS, GLITCH_DEFAULTS) for f, v in group.items()]
    rules += [
        ("diffusionAlgorithm", _given("diffusionAlgorithm") & ~member("diffusionAlgorithm", DIFFUSION_ALGORITHMS)),
        ("diffusionModulation", _given("diffusionModulation") & ~member("diffusionModulation", DIFFUSION_MODULATIONS)),
        ("opacity", ~_is("opacity", float)),
        ("invert", ~_is("invert", bool)),
        ("grayscale", _given("grayscale") & ~_is("grayscale", bool)),
        ("strokeWidth", _given("strokeWidth") & outside("strokeWidth", 0.25, 10)),
        ("dotShape", ~member("dotShape", DOT_SHAPES)),
        ("customShape", F.when(_given("customShape"), ~(_is("customShape.filename", str) & _is("customShape.svg", str)))
         .otherwise(_text("dotShape") == "custom")),
        ("angles", ~nested("angles")),
        ("visible", ~nested("visible"))]
    for p in PLATES:
        rules += [(f"angles.{p}", ~_is(f"angles.{p}", float)), (f"visible.{p}", ~_is(f"visible.{p}", bool))]
    return rules


def _default(field: str, fallback, present: Column) -> Column:
    """Given value, or the default when any key of the group is given; else null."""
    value = (F.try_variant_get("_doc", f"$.{field}", "boolean") if isinstance(fallback, bool)
             else _text(field) if isinstance(fallback, str) else _number(field))
    literal = F.lit(fallback if isinstance(fallback, (bool, str)) else float(fallback))
    return F.when(present, F.coalesce(value, literal))


def validate_settings(documents: DataFrame, body: str = "settings") -> DataFrame:
    """Adds ok, field (the first broken rule) and, for valid documents, the completed settings.

    The text is parsed once per row into a variant; all rules are expressions over it.
    """
    doc = documents.withColumn("_doc", F.try_parse_json(body)).withColumns({
        "_types": _types_of(F.col("_doc")),
        **{f"_{name}_types": _types_of(_field(name)) for name in ("angles", "visible", "customShape")}})
    first = F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in _rules()])
    checked = doc.withColumn("field", first).withColumn("ok", F.col("field").isNull())
    groups = {}
    for name, defaults in (("diffusion", DIFFUSION_DEFAULTS), ("glitch", GLITCH_DEFAULTS)):
        present = F.lit(False)
        for f in defaults:
            present = present | _given(f)
        groups[name] = F.when(F.col("ok") & present, F.struct(
            *[_default(f, v, F.lit(True)).alias(f) for f, v in defaults.items()]))
    plain = F.struct(
        _number("cellSize").alias("cellSize"), F.coalesce(_number("frayedXEdge"), F.lit(0.0)).alias("frayedXEdge"),
        F.coalesce(_number("frayedYEdge"), F.lit(0.0)).alias("frayedYEdge"), F.lit(1.0).alias("opacity"),
        _text("dotShape").alias("dotShape"), F.try_variant_get("_doc", "$.invert", "boolean").alias("invert"),
        F.coalesce(F.try_variant_get("_doc", "$.grayscale", "boolean"), F.lit(False)).alias("grayscale"),
        F.coalesce(_number("strokeWidth"), F.lit(1.0)).alias("strokeWidth"),
        F.struct(*[normalize_angle(_number(f"angles.{p}")).alias(p) for p in PLATES]).alias("angles"),
        F.struct(*[F.try_variant_get("_doc", f"$.visible.{p}", "boolean").alias(p) for p in PLATES]).alias("visible"))
    return checked.withColumns({"value": F.when(F.col("ok"), plain), **groups}).drop(
        "_doc", "_types", "_angles_types", "_visible_types", "_customShape_types")


def element_names(body) -> Column:
    """Lower-case names of all opening tags in a document."""
    return F.transform(F.regexp_extract_all(body, F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1)), F.lower)


def markup_audit(documents: DataFrame, body: str = "body") -> DataFrame:
    """Adds size, refusal flags and element counts of markup documents; one projection, whole texts."""
    tags = element_names(F.col(body))
    allowed = F.array(*[F.lit(v) for v in SVG_SHAPES + SVG_SKIPPED])
    size = F.octet_length(body)
    out = documents.withColumn("tags", tags)
    return out.withColumns({
        "bytes": size.cast("bigint"), "too_big": size > MAX_SVG_BYTES,
        "declaration": F.col(body).rlike(r"(?i)<!DOCTYPE|<!ENTITY|<\?xml-stylesheet"),
        "reference": F.col(body).rlike(r"(?i)url\s*\(|href\s*="),
        "text_element": F.array_contains("tags", "text"), "elements": F.size("tags"),
        "unsupported": F.size(F.array_except("tags", allowed))}).drop("tags")


def element_census(documents: DataFrame, body: str = "body") -> DataFrame:
    """Occurrences of each unsupported element and the number of documents that use it.

    Each document's tags are extracted once, sorted, and folded to one row per tag by the places where a new one begins, so
    the exchange sees one row per document and element at most, further merged by partial aggregation.
    """
    tags = documents.select(F.sort_array(element_names(F.col(body))).alias("tags"))
    firsts = F.filter(F.transform("tags", lambda t, i: F.struct(t.alias("tag"), i.alias("at"))),
                      lambda s: (s["at"] == 0) | (F.get("tags", s["at"] - 1) != s["tag"]))
    tags = tags.select("tags", firsts.alias("firsts"))
    tags = tags.select("firsts", F.size("tags").alias("all"), F.posexplode("firsts").alias("k", "e")).select(
        "e.tag", (F.coalesce(F.get("firsts", F.col("k") + 1)["at"], F.col("all")) - F.col("e.at")).alias("n"))
    return tags.where(~F.col("tag").isin(*SVG_SHAPES, *SVG_SKIPPED)).groupBy("tag").agg(
        F.sum("n").cast("bigint").alias("occurrences"), F.count(F.lit(1)).alias("documents"))
