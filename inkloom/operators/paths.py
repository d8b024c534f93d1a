"""Polylines: smoothing, tangents, arc length and angles of the nearest path segment.

Paths are tables (path_id, seq, px, py) with seq running 0, 1, 2 … . A path may be very long, so ordered work
is done in chunks of consecutive points with a copied border, and running values are carried over a narrow
table with one row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clamp, int_range, radians, truncate

CHUNK = 4096


def _chunked(points: DataFrame, border: int, chunk: int) -> DataFrame:
    """Each point in its chunk, plus copies in the neighbouring chunks it borders (home = false)."""
    own = F.floor(F.col("seq") / chunk)
    copies = F.sequence(F.floor((F.col("seq") - border) / chunk), F.floor((F.col("seq") + border) / chunk))
    return points.withColumn("own", own).withColumn("chunk", F.explode(copies)).withColumn(
        "home", F.col("own") == F.col("chunk")).drop("own")


def _first_known(cols: list[Column]) -> Column:
    return F.coalesce(*cols)


def smooth_path(points: DataFrame, spacing: float = 2.0, chunk: int = CHUNK) -> DataFrame:
    """Catmull-Rom curve through the points, about one sample per ``spacing``, at least three per segment.

    Paths with fewer than three points are returned as they are. ``step`` counts samples inside a segment.
    """
    sizes = points.groupBy("path_id").agg(F.max("seq").alias("last"))
    line = Window.partitionBy("path_id", "chunk").orderBy("seq")
    at = lambda c, k: F.lead(c, k).over(line) if k > 0 else F.lag(c, -k).over(line)
    near = _chunked(points.select("path_id", "seq", "px", "py"), 2, chunk)
    for c in ("px", "py"):
        near = near.withColumns({f"{c}0": _first_known([at(c, -1), F.col(c)]), f"{c}2": at(c, 1),
                                 f"{c}3": _first_known([at(c, 2), at(c, 1)])})
    near = near.where("home").join(sizes, "path_id")
    gap = F.sqrt(F.pow(F.col("px2") - F.col("px"), F.lit(2)) + F.pow(F.col("py2") - F.col("py"), F.lit(2)))
    pieces = F.greatest(F.lit(3), truncate(gap / F.lit(float(spacing)))).cast("int")
    short = F.col("last") < 2
    end = F.col("seq") == F.col("last")
    near = near.withColumn("pieces", F.when(short | end, 1).otherwise(pieces))
    near = near.withColumn("step", F.explode(int_range(F.col("pieces"))))
    t = F.col("step") / F.col("pieces")

    def curve(c):
        p0, p1, p2, p3 = (F.col(n) for n in (f"{c}0", c, f"{c}2", f"{c}3"))
        value = F.lit(0.5) * (2 * p1 + (p2 - p0) * t + (2 * p0 - 5 * p1 + 4 * p2 - p3) * (t * t)
                              + (3 * p1 - p0 - 3 * p2 + p3) * (t * t * t))
        return F.when(short | end, p1).otherwise(value)

    return near.select("path_id", "seq", "step", curve("px").alias("sx"), curve("py").alias("sy"))


def path_tangents(points: DataFrame, reach: int = 3, chunk: int = CHUNK) -> DataFrame:
    """Adds tangent (degrees over +-reach points, carried forward where degenerate) and arc length so far."""
    near = _chunked(points.select("path_id", "seq", "px", "py"), reach, chunk)
    line = Window.partitionBy("path_id", "chunk").orderBy("seq")
    back = lambda c: F.coalesce(*[F.lag(c, k).over(line) for k in range(reach, 0, -1)], F.col(c))
    ahead = lambda c: F.coalesce(*[F.lead(c, k).over(line) for k in range(reach, 0, -1)], F.col(c))
    near = near.withColumns({"dx": ahead("px") - back("px"), "dy": ahead("py") - back("py"),
                             "lx": F.lag("px").over(line), "ly": F.lag("py").over(line)})
    usable = (F.abs("dx") > 0.001) | (F.abs("dy") > 0.001)
    step = F.sqrt((F.col("px") - F.col("lx")) * (F.col("px") - F.col("lx"))
                  + (F.col("py") - F.col("ly")) * (F.col("py") - F.col("ly")))
    home = near.where("home").select(
        "path_id", "chunk", "seq", "px", "py", F.when(usable, F.degrees(F.atan2("dy", "dx"))).alias("own"),
        F.coalesce(step, F.lit(0.0)).alias("step"))
    so_far = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = home.withColumns({"held": F.last("own", ignorenulls=True).over(so_far), "run": F.sum("step").over(so_far)})
    # One row per chunk carries the running values into the following chunks.
    ends = home.groupBy("path_id", "chunk").agg(
        F.max_by("own", F.when(F.col("own").isNotNull(), F.col("seq"))).alias("end_angle"),
        F.sum("step").alias("length"))
    earlier = Window.partitionBy("path_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("path_id", "chunk",
                          F.last("end_angle", ignorenulls=True).over(earlier).alias("carry_angle"),
                          F.coalesce(F.sum("length").over(earlier), F.lit(0.0)).alias("carry_length"))
    return local.join(carried, ["path_id", "chunk"]).select(
        "path_id", "seq", "px", "py", F.coalesce("held", "carry_angle", F.lit(0.0)).alias("tangent"),
        (F.col("run") + F.col("carry_length")).alias("arc"))


def _segments(points: DataFrame, chunk: int) -> DataFrame:
    """Path segments in chunks: start point, end point, tangents at both ends."""
    tangents = path_tangents(points, chunk=max(chunk, 4))
    near = _chunked(tangents, 1, chunk)
    line = Window.partitionBy("path_id", "chunk").orderBy("seq")
    near = near.withColumns({"x2": F.lead("px").over(line), "y2": F.lead("py").over(line),
                             "a2": F.lead("tangent").over(line)})
    return near.where("home").where(F.col("x2").isNotNull()).select(
        "path_id", "chunk", "seq", F.col("px").alias("x1"), F.col("py").alias("y1"), "x2", "y2",
        F.col("tangent").alias("a1"), "a2")


FANOUT_BITS = 6  # a box of the tree holds at most 64 boxes


def _box(segs: Column) -> list[Column]:
    side = lambda pick, of, c: pick(F.transform(segs, lambda s: of(s[f"{c}1"], s[f"{c}2"])))
    return [side(F.array_min, F.least, "x").alias("bx0"), side(F.array_max, F.greatest, "x").alias("bx1"),
            side(F.array_min, F.least, "y").alias("by0"), side(F.array_max, F.greatest, "y").alias("by1")]


def _box_tree(boxes: DataFrame, levels: int) -> list[DataFrame]:
    """Boxes (path_id, node, bx0, bx1, by0, by1) of chunks -> for each level from the bottom the nodes with their at most 64 children."""
    tree = []
    for _ in range(levels):
        above = boxes.groupBy("path_id", F.shiftright("node", FANOUT_BITS).alias("node")).agg(
            F.collect_list(F.struct("node", "bx0", "bx1", "by0", "by1")).alias("kids"), F.min("bx0").alias("bx0"),
            F.max("bx1").alias("bx1"), F.min("by0").alias("by0"), F.max("by1").alias("by1"))
        tree.append(above.select("path_id", "node", "kids"))
        boxes = above.drop("kids")
    return tree


def tree_levels(points: DataFrame, chunk: int) -> int:
    """Levels that bring the chunks of the longest path under one box; one number is read from the table."""
    last = points.agg(F.max("seq")).first()[0] or 0
    levels = 1
    while (last // chunk) >> (FANOUT_BITS * levels):
        levels += 1
    return levels


def nearest_path_angle(targets: DataFrame, points: DataFrame, base_angle=0.0, influence: float = 1.0,
                       chunk: int = 256, levels: int | None = None) -> DataFrame:
    """Angle at each target (path_id, point_id, x, y) taken from the nearest segment of its path.

    No pairs of targets and segments are emitted. Segments are packed into arrays of ``chunk`` consecutive ones under a tree of
    bounding boxes with at most 64 children each. A target goes down the tree by one narrow join per level: of a box's children it
    keeps those that are not farther than the farthest point of the best child seen so far; in the chunks that are left the arrays are
    searched in place. So no row holds more than 64 boxes or one chunk, however long a path is. The first of equally
    near segments wins. Exact for any path length. ``levels`` of the tree are counted from the longest path unless given.
    """
    levels = levels or tree_levels(points, chunk)
    fields = ["seq", "x1", "y1", "x2", "y2", "a1", "a2"]
    # Boxes are taken from the packed arrays, and null keys, which meet nothing, are left out here: so all uses of the chunks share one exchange.
    packed = (_segments(points, chunk).where("path_id IS NOT NULL AND chunk IS NOT NULL").groupBy("path_id", "chunk")
              .agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("segs")))
    real = lambda s: ((s["x2"] - s["x1"]) * (s["x2"] - s["x1"]) + (s["y2"] - s["y1"]) * (s["y2"] - s["y1"])) >= 0.001
    boxes = packed.where(F.exists("segs", real)).select("path_id", F.col("chunk").alias("node"), *_box(F.col("segs")))
    ends = packed.groupBy("path_id").agg(F.min_by(F.get("segs", F.lit(0)), "chunk").alias("head"),
                                         F.max_by(F.get("segs", F.size("segs") - 1), "chunk").alias("tail"))
    x, y = F.col("x"), F.col("y")

    def least_to(b):
        gap_x, gap_y = F.greatest(b["bx0"] - x, x - b["bx1"], F.lit(0.0)), F.greatest(b["by0"] - y, y - b["by1"], F.lit(0.0))
        return gap_x * gap_x + gap_y * gap_y

    def most_to(b):
        gap_x, gap_y = F.greatest(F.abs(x - b["bx0"]), F.abs(x - b["bx1"])), F.greatest(F.abs(y - b["by0"]), F.abs(y - b["by1"]))
        return gap_x * gap_x + gap_y * gap_y

    asked = targets.withColumns({"node": F.lit(0).cast(boxes.schema["node"].dataType), "reach": F.lit(float("inf"))})
    for nodes in reversed(_box_tree(boxes, levels)):
        met = asked.join(nodes, ["path_id", "node"], "left").withColumn(
            "reach", F.least("reach", F.array_min(F.transform("kids", most_to))))
        # The small slack keeps boxes whose bound ties with the best one up to rounding.
        kept = F.filter("kids", lambda b: least_to(b) <= F.col("reach") * (1 + 1e-9) + 1e-9)
        asked = met.withColumn("node", F.explode_outer(F.transform(kept, lambda b: b["node"]))).drop("kids")
    got = asked.drop("reach").withColumnRenamed("node", "chunk").join(packed, ["path_id", "chunk"], "left")

    def hit(s):
        dx, dy = s["x2"] - s["x1"], s["y2"] - s["y1"]
        t = clamp(((x - s["x1"]) * dx + (y - s["y1"]) * dy) / (dx * dx + dy * dy + 1e-10))
        ex, ey = x - (s["x1"] + t * dx), y - (s["y1"] + t * dy)
        return F.struct(F.sqrt(ex * ex + ey * ey).alias("dist"), s["seq"].alias("seq"), t.alias("t"),
                        s["a1"].alias("a1"), s["a2"].alias("a2"))

    best = F.array_min(F.transform(F.filter("segs", real), hit))
    near = got.withColumn("best", best).groupBy("path_id", "point_id", "x", "y").agg(F.min("best").alias("best")).join(ends, "path_id", "left")
    a1, a2, t = F.coalesce("best.a1", "head.a1"), F.coalesce("best.a2", "head.a2"), F.coalesce("best.t", F.lit(0.0))
    turned = F.when(a2 - a1 > 180, a2 - 360).when(a2 - a1 < -180, a2 + 360).otherwise(a2)
    angle = a1 + t * (turned - a1)

    def along(s):
        dx, dy = F.col(f"{s}.x2") - F.col(f"{s}.x1"), F.col(f"{s}.y2") - F.col(f"{s}.y1")
        return (x - F.col(f"{s}.x1")) * dx + (y - F.col(f"{s}.y1")) * dy, dx * dx + dy * dy

    head, _ = along("head")
    tail, length = along("tail")
    base = F.lit(float(base_angle)) if not isinstance(base_angle, Column) else base_angle
    angle = F.when(head < 0, F.col("head.a1")).otherwise(angle)
    angle = F.when(tail > length, F.col("tail.a2")).otherwise(angle)
    if influence < 1.0:
        mix = lambda fn: fn(radians(base)) * (1 - influence) + fn(radians(angle)) * influence
        angle = F.degrees(F.atan2(mix(F.sin), mix(F.cos)))
    angle = F.when(F.col("head").isNull(), base).otherwise(angle)
    return near.select("path_id", "point_id", "x", "y", F.col("best.seq").alias("nearest"), angle.alias("angle"))
