"""Session settings the library is designed for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "inkloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC.

    Shuffle partitions and the master are left to the cluster unless given.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # The JVM does not compile methods over 8000 bytes of bytecode: wide stages are split instead.
        "spark.sql.codegen.hugeMethodLimit": "8000",
        # Joins whose partitions turn out small skip the sort; larger ones keep the spillable sort-merge join.
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "128m",
        "spark.ui.enabled": "false",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the time zone on a session made elsewhere: hours and days must not depend on the machine. Wide stages are split there as well,
    as methods that the JVM does not compile run many times slower."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def fan_out(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a narrow table over ``spark.sql.shuffle.partitions`` tasks before its rows are expanded into many.

    The rows moved are the small ones (headers), never the pixels they turn into. The explicit
    partition count keeps adaptive execution from folding them back into one task, and follows the setting that is
    sized for the data rather than the cores that happen to be up while the plan is made.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys) if keys else df.repartition(n)


SHEETS_PER_TASK = 2000


def deal_sheets(headers: DataFrame, key: str = "image_id") -> DataFrame:
    """Deal out the headers of many small sheets by sheet, at most about ``SHEETS_PER_TASK`` to a task, before they are expanded.

    Spark keeps track of that: joins, windows and aggregations whose keys contain the sheet need no exchange of pixels, and as the number
    of tasks grows with the number of sheets, a task sorts and aggregates in memory. Joins take part by a setting of the session
    (``requireAllClusterKeysForCoPartition``). Not for sheets of many megapixels, which would be one task each (see ``fan_out``).
    """
    conf = headers.sparkSession.conf
    conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    least = int(conf.get("spark.sql.shuffle.partitions"))
    return headers.repartition(max(least, -(-headers.count() // SHEETS_PER_TASK)), key)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the reliable checkpoint folder of the session.

    The folder named in ``spark.checkpoint.dir`` is used: executors must share it, so none is made up.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if folder is None:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
