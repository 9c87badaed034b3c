"""Shared helpers: the cluster's shared folder, written intermediates, Arrow row maps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: A word: a run of anything but space and the control characters TAB to CR (fixed value).
WORD = r"[^\x20\x09-\x0D]+"


#: Rows that a Python worker gets at a time; Spark's own 10,000 is made for short rows, and texts are long.
BATCH_ROWS = 1000


def short_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers, unless the session has its own number of rows per batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which driver and executors share.

    Only a session with a local master may leave it unset (tests); then a scratch folder is set.
    """
    short_batches(spark)
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def tidy(spark: SparkSession):
    """Actions in this block delete their shuffle files when they end, not when the driver happens to collect garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with tidy(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_path = path
    return out


def forget(*frames: DataFrame | None) -> None:
    """Delete what ``saved`` wrote for frames that no later step reads."""
    for df in frames:
        if df is not None:
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._saved_path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, pa.Array]], new: T.StructType,
             keep: list[str] | None = None) -> DataFrame:
    """Arrow map that adds the columns ``new`` to the columns ``keep`` (all by default)."""
    short_batches(df.sparkSession)
    keep = df.columns if keep is None else keep
    schema = T.StructType([df.schema[c] for c in keep] + list(new.fields))
    names = new.names

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            made = fn(b)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [made[n] for n in names], names=keep + names)

    return df.mapInArrow(run, schema)
