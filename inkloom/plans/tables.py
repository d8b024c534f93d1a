"""Input tables and the rasters, fields, jobs and logs that Spark derives from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed_values import ANGLE_PRESETS, PLATES, SHEETS
from ..operators.separate import coverage
from ..session import deal_sheets, fan_out, prepare
from ..sources.rasters import bin_raster, densify_raster, frame_pixels


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf}/{table}.parquet")


def raster_ship(spark: SparkSession, sf: str) -> DataFrame:
    """Shipments binned by quantity and month: sparse, noisy, few large images."""
    lines = read(spark, sf, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("image_id"),
        (F.col("l_quantity") - 1).alias("px"),
        ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).alias("py"),
        "l_partkey", "l_suppkey", "l_orderkey")
    binned = bin_raster(lines, sums={"r": "l_partkey", "g": "l_suppkey", "b": "l_orderkey"})
    return binned.select(
        "image_id", F.lit(50).alias("w"), F.lit(84).alias("h"), "x", "y", "n",
        *[(F.col(c) % 256).cast("int").alias(c) for c in ("r", "g", "b")])


def raster_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events by hour and day of month, one image per type, empty cells filled with zero."""
    points = read(spark, sf, "events").select(
        F.col("event_type").alias("image_id"), F.hour("ts").alias("px"), (F.dayofmonth("ts") - 1).alias("py"))
    binned = bin_raster(points, sums={})
    dense = densify_raster(binned, width=24, height=31)
    grey = (255 - F.least(F.lit(255), 25 * F.col("n"))).cast("int")
    return dense.select("image_id", "w", "h", "x", "y", "n", grey.alias("r"), grey.alias("g"), grey.alias("b"))


def part_headers(spark: SparkSession, sf: str) -> DataFrame:
    """One small sheet per part; sizes differ from part to part."""
    part = read(spark, sf, "part")
    return part.select(
        F.col("p_partkey").alias("image_id"),
        (10 + F.col("p_partkey") % 5).cast("int").alias("w"),
        (8 + F.col("p_partkey") % 4).cast("int").alias("h"),
        F.col("p_size").alias("size"),
        F.floor("p_retailprice").alias("price"))


def raster_parts(spark: SparkSession, sf: str) -> DataFrame:
    """A dense RGBA artwork per part with a one-pixel white margin."""
    px = frame_pixels(deal_sheets(part_headers(spark, sf)))
    x, y = F.col("x"), F.col("y")
    margin = (x < 1) | (y < 1) | (x >= F.col("w") - 1) | (y >= F.col("h") - 1)
    red = (17 * x + 3 * F.col("size")) % 256
    green = (23 * y + F.col("image_id")) % 256
    blue = (11 * (x + y) + F.col("price")) % 256
    pick = lambda c: F.when(margin, 255).otherwise(c).cast("int")
    return px.select("image_id", "w", "h", "x", "y", pick(red).alias("r"), pick(green).alias("g"),
                     pick(blue).alias("b"), ((37 * x + 11 * y + F.col("image_id")) % 256).cast("int").alias("a"))


def parts_coverage(spark: SparkSession, sf: str, **kw) -> DataFrame:
    return coverage(raster_parts(spark, sf), **kw)


def field_emb(spark: SparkSession, sf: str) -> DataFrame:
    """Embedding vectors as rows of a field: image = label, row = vector, column = dimension."""
    rows = fan_out(read(spark, sf, "embeddings")).select(
        F.col("label").cast("bigint").alias("image_id"), F.lit(64).alias("w"), F.lit("black").alias("plate"),
        F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "e"))
    cov = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(0.5) + F.col("e").cast("double")))
    return rows.select("image_id", "w", "plate", "x", "y", cov.alias("cov"))


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Print jobs derived from orders."""
    o = fan_out(read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    sheet = F.array(*[F.lit(s[0]) for s in SHEETS])
    preset = F.array(*[F.array(*[F.lit(a) for a in p[1:]]) for p in ANGLE_PRESETS])
    angle = lambda i: F.get(F.get(preset, (key % 4).cast("int")), F.lit(i))
    angles = F.struct(*[(F.when(key % 5 == 0, angle(0)).otherwise(angle(3)) if p == "black" else angle(i)).alias(p)
                        for i, p in enumerate(PLATES)])
    visible = F.struct(*[((F.shiftright((cust % 16).cast("int"), i) % 2) == 0).alias(p)
                         for i, p in enumerate(PLATES)])
    return o.select(
        key.alias("job_id"),
        F.get(sheet, (key % 8).cast("int")).alias("sheet_id"),
        F.when(cust % 2 == 1, "landscape").otherwise("portrait").alias("orientation"),
        (3 + key % 62).cast("double").alias("cell_size"),
        angles.alias("angles"), visible.alias("visible"),
        (F.col("o_orderstatus") == "P").alias("invert"),
        (key % 11 == 0).alias("grayscale"),
        (F.col("o_orderpriority") != "5-LOW").alias("registration"),
        F.col("o_orderpriority").alias("priority"),
        (200 + cust % 4000).cast("int").alias("src_w"),
        (200 + (7 * key) % 4000).cast("int").alias("src_h"),
        (10 + key % 391).cast("int").alias("scale_pct"),
        F.concat(F.lit("Art Work "), key.cast("string"), F.lit(".v2.PNG")).alias("source_name"),
        F.get(F.array(*[F.lit(s) for s in ("round", "square", "diamond", "line", "triangle", "cross",
                                           "circle-outline")]), (key % 7).cast("int")).alias("dot_shape"),
        (cust % 3 == 0).alias("mirror"),
        F.when(cust % 2 == 0, "horizontal").otherwise("vertical").alias("mirror_direction"))


def ticket_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Print jobs with outline, registration and custom shape fields; some of them are left open."""
    key = F.col("job_id")
    open_ = lambda n, value: F.when(key % n != 0, value)
    return jobs(spark, sf).withColumns({
        "dot_shape": F.when(key % 13 == 0, "custom").otherwise(F.col("dot_shape")),
        "custom_shape": F.when(key % 13 == 0, F.concat(F.lit("Mark "), key.cast("string"), F.lit(".svg"))),
        "stroke_width": open_(4, 1 + (key % 9) * F.lit(0.5)),
        "registration_size": open_(5, (60 + key % 7 * 30).cast("int")), "registration_offset": open_(6, (90 + key % 3 * 15).cast("int")),
        "registration_weight": open_(7, F.lit(0.5) + key % 4),
        "registration_mode": F.when(key % 3 == 1, "centered").otherwise("corners"),
        "registration_shape": F.when(key % 10 == 3, F.concat(F.lit("cross-"), key.cast("string"), F.lit(".svg")))})


def layer_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Three stacked layers per part; layer 1 is hidden on odd parts."""
    heads = deal_sheets(part_headers(spark, sf)).select("image_id", "w", "h")
    z = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("z")
    return heads.select("*", z).select(
        "image_id", "w", "h", "z",
        (~((F.col("z") == 1) & (F.col("image_id") % 2 == 1))).alias("visible"),
        (F.lit(1.0) - F.lit(0.25) * F.col("z")).alias("opacity"),
        F.col("z").alias("offset_x"), (-F.col("z")).alias("offset_y"),
        (F.lit(100) - 25 * F.col("z")).alias("scale_pct"))


def layer_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels of those layers: the artwork with an alpha ramp that differs per layer."""
    px = raster_parts(spark, sf)
    z = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("z")
    alpha = ((F.col("x") * (F.col("z") + 1) * 37 + 11 * F.col("y")) % 256).cast("int")
    return px.drop("a").select("*", z).withColumn("a", alpha)


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Request log: one row per event, limiter key = user and path."""
    return read(spark, sf, "events").select(
        F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"),
        F.col("event_type").alias("path"), F.col("ts"), F.col("event_id"), F.col("user_id"), F.col("value"))


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions opened by signup events, valid for seven days."""
    ev = read(spark, sf, "events").where(F.col("event_type") == "signup")
    return ev.select("user_id", F.col("event_id").alias("session_id"), F.col("ts").alias("created"),
                     (F.col("ts") + F.expr("INTERVAL 7 DAYS")).alias("expires"))


def vector_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Polylines: one path per embedding vector, one point per dimension."""
    rows = fan_out(read(spark, sf, "embeddings").select("vec_id", "embedding")).select(
        F.col("vec_id").alias("path_id"), F.posexplode("embedding").alias("seq", "e"))
    e = F.col("e").cast("double")
    return rows.select("path_id", "seq", (6.0 * F.col("seq") + 20.0 * e).alias("px"), (60.0 + 80.0 * e).alias("py"))


def path_targets(spark: SparkSession, sf: str) -> DataFrame:
    """A grid of 12 x 5 lattice points over the area of each path."""
    ids = fan_out(read(spark, sf, "embeddings").select(F.col("vec_id").alias("path_id")))
    grid = ids.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.lit(11))))
    return grid.select("path_id", (F.col("j") * 12 + F.col("i")).alias("point_id"),
                       (F.col("i") * 32.0 + 16.0).alias("x"), (F.col("j") * 24.0 + 12.0).alias("y"))
