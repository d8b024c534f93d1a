"""Intermediate tables in the shared folder of the session, and Arrow batches in bounded slices."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 8 << 20  # text handled at a time inside a task


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a local session without that setting gets a temporary one."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="inkloom-")
        sc.setCheckpointDir(folder)
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; every call gives another one, so that reruns never mix."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a Parquet table in the shared folder: lineage is cut, nothing is computed twice."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables of one run in a folder of its own. A table is dropped once what was made from it is written, and with it the
    shuffle files of the jobs behind it: Spark removes them when nothing refers to their plans any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, new_path(spark, name)

    def written(self, df: DataFrame, name: str, *done: str) -> DataFrame:
        """The same rows, read back from a table; the tables named in ``done`` are dropped afterwards."""
        df.write.option("compression", "zstd").parquet(f"{self.folder}/{name}")
        schema = df.schema
        del df
        for other in done:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{other}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        gc.collect()
        self.spark._jvm.System.gc()
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")


def slices(batches: Iterator[pa.RecordBatch], column: int = 0, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the string column of a slice holds about ``limit`` bytes, or one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0)
        ends = np.cumsum(np.asarray(lengths, dtype=np.int64))
        if ends[-1] <= limit:
            yield batch
            continue
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the file system that its scheme names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def schema_of(docs: DataFrame, id_col: str, ddl: str) -> T.StructType:
    """The id column, whatever its type, under the name doc_id, and the columns of ``ddl``."""
    return T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *T.StructType.fromDDL(ddl).fields])


def packed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text``, with all columns but the text packed into doc_id: operators pass them along unread, so no
    name can clash. ``unpacked`` turns a result back."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)).alias("doc_id"), F.col(text_col).alias("text"))


def unpacked(result: DataFrame, like: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of ``like`` in its order, from a result with packed doc_id and text."""
    return result.select(*(F.col("text").alias(c) if c == text_col else F.col("doc_id").getField(c).alias(c) for c in like.columns))
