"""Session helpers: UTC clock, ANSI on, AQE on, shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job relies on for correct results (UTC day boundaries,
# Postgres-like failing casts) and for scale (AQE re-plans shuffles and
# splits skewed partitions at run time).
CORE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Shuffled rows with repeated values unpack to some 40 times their size: with Spark's 64 MB a task sorts gigabytes.
    # Partitions are merged up to this size, from the most that a map task still writes without a sort in memory.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "200",
}


def build_session(master: str | None = None, app: str = "tallyspark",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(CORE_CONF)
    conf["spark.ui.enabled"] = "false"
    conf["spark.ui.showConsoleProgress"] = "false"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_core_conf(spark)
    return spark


def apply_core_conf(spark: SparkSession) -> None:
    """Pin the runtime settings on an existing session (e.g. the driver's)."""
    for k, v in CORE_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
        if spark.conf.get(k) != v:
            raise ValueError(f"the session keeps {k}={spark.conf.get(k)}; results need {v}")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session; only when it is unset
    under a local master (tests) a scratch folder is created and registered.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    sc = None
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server owns the checkpoint dir
        pass
    if not d and sc is not None:
        d = sc.getCheckpointDir()
    if not d:
        if sc is None or not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="tallyspark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if sc is not None:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(d)
        return sc.getCheckpointDir() or d
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A writable location under the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    return os.path.join(base.replace("file:", "", 1) if base.startswith("file:") else base, name)


def written(df, name: str):
    """``df`` as a Parquet intermediate in the shared folder: computed once, read with column pruning.

    Cuts lineage and survives lost executors. It goes with the innermost ``intermediates`` block around the call, or,
    outside of one, when the driver's process ends."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    _held[-1].append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


_held: list[list] = [[]]


def _remove(paths: list) -> None:
    for spark, path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def intermediates():
    """Intermediates that are written in this block are removed at its end."""
    _held.append([])
    try:
        yield
    finally:
        _remove(_held.pop())


@atexit.register
def _remove_rest() -> None:
    """What was written outside of any block, if its session still runs."""
    for spark, path in _held[0]:
        if spark.sparkContext._jsc is not None:
            _remove([(spark, path)])
