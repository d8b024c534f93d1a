"""Project files: layers and parameters merged over defaults."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed_values import GENERATOR_DEFAULTS, PROJECT_DEFAULTS, PROJECT_REQUIRED

LAYER_SCHEMA = ("array<struct<name:string,visible:boolean,offset_x:int,offset_y:int,scale_pct:int,opacity:double,"
                "effect_params:map<string,string>,image_b64:string>>")
PROJECT_SCHEMA = (f"version int, params map<string,string>, layers {LAYER_SCHEMA}, selected_layer int, offset_x int, "
                  "offset_y int, artboard_size string, orientation string, dpi int, doc_width_in double, "
                  "doc_height_in double")


def scan_projects(spark: SparkSession, path: str) -> DataFrame:
    """Project files, one row each, read with an explicit schema."""
    return spark.read.schema(PROJECT_SCHEMA).json(path, multiLine=True).withColumn(
        "project_id", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))


def parse_projects(df: DataFrame, body: str = "project") -> DataFrame:
    """The same from a column of JSON text."""
    return df.select("project_id", F.from_json(body, PROJECT_SCHEMA).alias("p")).select("project_id", "p.*")


def merged_params(params: Column, defaults: dict | None = None) -> Column:
    """Parameter map over defaults; keys that are no parameters are dropped. Values stay JSON text. Parameters of generators
    that are not rendered are kept where a project gives them."""
    known = [*defaults] if defaults is not None else [*PROJECT_DEFAULTS, *PROJECT_REQUIRED, *GENERATOR_DEFAULTS]
    defaults = PROJECT_DEFAULTS if defaults is None else defaults
    text = {k: v if isinstance(v, str) else None if v is None else json.dumps(v) for k, v in defaults.items()}
    base = F.create_map(*[F.lit(x) for kv in text.items() for x in kv]).cast("map<string,string>")
    given = F.map_filter(F.coalesce(params, F.create_map().cast("map<string,string>")),
                         lambda k, v: k.isin(*known))
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(given, k)), given)


def project_layers(projects: DataFrame) -> DataFrame:
    """One row per layer in stacking order with the defaults of absent fields filled in."""
    rows = projects.select(
        "project_id", F.posexplode("layers").alias("z", "l"),
        F.coalesce("selected_layer", F.greatest(F.lit(0), F.size("layers") - 1)).alias("selected"))
    return rows.select(
        "project_id", "z", F.col("l.name").alias("name"),
        F.coalesce("l.visible", F.lit(True)).alias("visible"),
        F.coalesce("l.offset_x", F.lit(0)).alias("offset_x"), F.coalesce("l.offset_y", F.lit(0)).alias("offset_y"),
        F.coalesce("l.scale_pct", F.lit(100)).alias("scale_pct"),
        F.coalesce("l.opacity", F.lit(1.0)).alias("opacity"),
        F.when(F.col("l.effect_params").isNotNull(), merged_params(F.col("l.effect_params"))).alias("params"),
        (F.col("selected") == F.col("z")).alias("selected"), F.col("l.image_b64").alias("image_b64"))
