"""Mixing sources to target weights: hash-bucket histograms of sizes, nested thresholds, no sort of documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import packed, written

WEIGHTS = (5, 2, 1)
MOST = 3  # times that a source, and so a document, is taken at most
DIGITS = 3  # hex digits of the hash per level: 4096 buckets
LEVELS = 5
SOLID_WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: Sequence[int], weights: Sequence[float], most: float = MOST) -> list[float]:
    """Shares of the total by weight; a share stops at ``most`` times its source, the excess is shared again by weight.

    In the order of the cap per weight, sources are capped until the level of the rest is below every cap left.
    """
    out = [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (most * sizes[i] / weights[i], i))
    left, weight = float(sum(sizes)), float(sum(weights))
    while order and left / weight > most * sizes[order[0]] / weights[order[0]]:
        i = order.pop(0)
        out[i] = float(most * sizes[i])
        left, weight = left - most * sizes[i], weight - weights[i]
    for i in order:
        out[i] = left / weight * weights[i]
    return out


def _bucket(level: int) -> Column:
    return F.substring("hash", 1 + DIGITS * level, DIGITS)


def _thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(key, limit): rows with a hash up to the limit come nearest to the key's budget; the limit is '' for no row.

    Each level sums sizes by key and bucket, keeps the buckets that fit whole, and only the rows of the one bucket
    that crosses the budget go on to the next level. After the last level a bucket holds one hash value.
    """
    rows, state = sized, budgets.select("key", F.col("budget").alias("left"), F.lit("").alias("prefix"))
    for level in range(LEVELS):
        before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = (rows.groupBy("key", _bucket(level).alias("bucket")).agg(F.sum("size").alias("size"))
                .withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).join(state, "key"))
        fits = F.col("before") + F.col("size") <= F.col("left")
        # The least bucket that does not fit is the boundary; a key without one takes all that is left of its rows.
        cut = sums.groupBy("key", "prefix", "left").agg(
            F.min(F.when(~fits, F.struct("bucket", "before", "size"))).alias("edge"))
        cut = written(cut.select("key", "left", F.col("edge.bucket").alias("bucket"), F.col("edge.before").alias("before"),
                                 F.col("edge.size").alias("size"), "prefix"), "boundary")
        ended = cut.where("bucket IS NULL").select("key", F.concat("prefix", F.lit("g")).alias("limit"))
        done = ended if level == 0 else done.union(ended)
        state = cut.where("bucket IS NOT NULL").select(
            "key", (F.col("left") - F.col("before")).alias("left"), F.concat("prefix", "bucket").alias("prefix"), "size")
        if level < LEVELS - 1:
            edge = state.select("key", F.col("prefix").alias("edge"))
            rows = written(rows.withColumn("edge", F.substring("hash", 1, DIGITS * (level + 1))).join(edge, ["key", "edge"])
                           .select("key", "hash", "size"), "refined")
            state = state.drop("size")
    # One hash value is left per key: it is taken where that comes nearer to the budget; limits are inclusive.
    nearer = F.col("size") - F.col("left") < F.col("left")
    return done.union(state.select("key", F.when(nearer, F.col("prefix")).otherwise(F.concat(
        F.substring("prefix", 1, DIGITS * LEVELS - 1), F.expr("translate(right(prefix, 1), '0123456789abcdef', '/0123456789abcde')")))
        .alias("limit")))


def _hashed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """The documents with ``key`` (of the source), ``size`` (words) and ``hash`` (of id and text)."""
    text, source = F.col(text_col).cast("string"), F.col(source_col).cast("string")
    identity = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.coalesce(text, F.lit("")))
    return (docs.withColumn("key", F.coalesce(F.concat(F.lit("s"), source), F.lit("n")))
            .withColumn("size", F.coalesce(F.regexp_count(text, F.lit(SOLID_WORD)), F.lit(0)).cast("bigint"))
            .withColumn("hash", F.substring(F.md5(identity.cast("binary")), 1, DIGITS * LEVELS)))


def _limits(sized: DataFrame, weights: Sequence[float], most: int) -> DataFrame:
    """A row per source: ``key, source_size, target, copies, limit``."""
    totals = sized.groupBy("key").agg(F.sum("size").alias("size")).collect()
    totals.sort(key=lambda r: (r["key"] == "n", r["key"].encode()))
    sizes = [r["size"] for r in totals]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(totals))], most)
    plan = []
    for r, size, target in zip(totals, sizes, wanted, strict=True):
        copies = min(most, int(target // size)) if size else 0
        plan.append((r["key"], size, target, copies, max(0.0, target - copies * size)))
    budgets = sized.sparkSession.createDataFrame(plan, "key string, source_size long, target double, copies int, budget double")
    return written(budgets.join(_thresholds(sized, budgets), "key", "left").drop("budget"), "limits")


def _taken(hashed: DataFrame, limits: DataFrame) -> DataFrame:
    copies = F.col("copies") + (F.col("hash") <= F.coalesce("limit", F.lit(""))).cast("int")
    return (hashed.join(limits, "key").withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))
            .drop("key", "hash", "limit"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", most: int = MOST) -> DataFrame:
    """How often each document is taken: ``doc_id, source, size, source_size, target, copies, taken`` per input row.

    Sources by code point, null last, get the weights in turn. A document is taken floor(target / source size) times, and
    once more where its hash is up to the source's threshold, found by ``_thresholds`` so that the words taken come
    nearest to the target. The hash covers id and text: reruns agree, equal rows are decided alike (they share a hash,
    and a source whose boundary hash is shared can miss its target by half of those rows). The source totals are held by
    the driver: they are as many as there are weights to set, and one row each.

    Null texts have size 0, a null source is a source of its own, null ids are hashed as such. An empty table gives
    an empty result. Further columns are ignored.
    """
    renamed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    sized = written(_hashed(renamed, "doc_id", "text", "source").drop("text"), "sized")
    return _taken(sized, _limits(sized.select("key", "hash", "size"), weights, most)).select(
        "doc_id", "source", "size", "source_size", "target", "copies", "taken")


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source", most: int = MOST) -> DataFrame:
    """The documents that the mix takes, packed as by ``store.packed``: ``doc_id, text, size, copies, taken``. The limits are
    found on narrow rows and joined to the documents; one row per source is small, so texts are not shuffled."""
    rows = packed(docs, text_col)
    hashed = _hashed(rows.withColumn("id", F.col("doc_id").getField(id_col)).withColumn("source", F.col("doc_id").getField(source_col)),
                     "id", "text", "source").drop("id", "source")
    sized = written(hashed.select("key", "hash", "size"), "sized")
    return _taken(hashed, _limits(sized, weights, most)).where("copies > 0").select("doc_id", "text", "size", "copies", "taken")
