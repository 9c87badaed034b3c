"""Structured Streaming twins of the batch landing and daily counts.

The reference lands scheduled batches with a 1-day overlap and idempotent
writes; a stream does the same continuously: file (or Kafka) source ->
``foreachBatch`` for the idempotent landing and merges into the datapoint
table by touched bucket, watermarked windows for daily and rolling counts,
written as files once they are final, or at once as a table in which a changed
window replaces its row. All checkpoints live under the shared
``spark.checkpoint.dir``; nothing is kept on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.sources import landing as A
from tallyspark.session import intermediates, written
from tallyspark.sources.datapoints import BUCKETS, upsert_datapoints
from tallyspark.sources.versions import VersionedTable


def _read_or_empty(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """What is written at ``path``; nothing before the first batch. Any other failure to read rises."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], like.schema)
    return spark.read.schema(like.schema).parquet(path)


def _started(writer, checkpoint: str, available_now: bool):
    w = writer.option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def stream_land(records: DataFrame, source: str, raw_path: str, dp_path: str, checkpoint: str,
                available_now: bool = True, buckets: int = BUCKETS):
    """L1: streaming records -> raw append + datapoint upsert (per micro-batch).

    Raw rows go to a folder of their batch id, which a replayed batch (after a failure) overwrites, so a batch is in
    it once; records that come again in a later batch are landed again, as in the scheduled landing. Datapoints are
    merged by key (events first-wins, measurements newest-wins), so neither a replay nor an overlap repeats them."""
    def write(batch: DataFrame, batch_id: int):
        raw, dps = A.land(batch, source)
        raw.write.mode("overwrite").parquet(f"{raw_path}/_batch={batch_id}")
        upsert_datapoints(dps, dp_path, buckets)
    return _started(records.writeStream.foreachBatch(write), checkpoint, available_now)


def stream_event_dedupe(datapoints: DataFrame, out_path: str, checkpoint: str, available_now: bool = True,
                        buckets: int = BUCKETS):
    """L2 (exact form): first-wins per event key across the whole history.

    A micro-batch reads and rewrites the hash buckets of its own keys in the datapoint table ``out_path``
    (``read_datapoints``). Use ``dedupe_within_watermark`` when repeats are known to fall within a day."""
    def write(batch: DataFrame, batch_id: int):
        upsert_datapoints(batch.where(F.col("kind") == "event"), out_path, buckets)
    return _started(datapoints.writeStream.foreachBatch(write), checkpoint, available_now)


def stream_restate(datapoints: DataFrame, out_path: str, checkpoint: str, available_now: bool = True,
                   buckets: int = BUCKETS):
    """L3: measurements restated as files: a strictly newer observation replaces the row of its key.

    The table is the state: no history is held in memory, and a late older row changes nothing."""
    def write(batch: DataFrame, batch_id: int):
        upsert_datapoints(batch.where(F.col("kind") == "measurement"), out_path, buckets)
    return _started(datapoints.writeStream.foreachBatch(write), checkpoint, available_now)


def write_final(windows: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Append windows to files once the watermark has passed their end; their state is then dropped."""
    return _started(windows.writeStream.outputMode("append").format("parquet").option("path", path), checkpoint, available_now)


def count_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, ["activity_date"])


def write_counts(counts: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """L4: all days, open ones too: counts that a micro-batch changed replace theirs in the table ``path`` (``count_table``).

    A batch reads and rewrites the days that it touches; one that comes again writes the same rows."""
    keys = [c for c in counts.columns if c != "n"]

    def write(batch: DataFrame, batch_id: int):
        with intermediates():
            new = written(batch, "counts")
            days = {None if r[0] is None else str(r[0]) for r in new.select("activity_date").distinct().collect()}
            if not days:
                return
            table = count_table(batch.sparkSession, path)
            covers = lambda s: s[0] in days
            if table.manifest()["number"]:
                old = table.read(covers)
                same = [old[c].eqNullSafe(new[c]) for c in keys]
                new = old.join(new, same, "left_anti").select(*new.columns).unionByName(new)
            table.replace(new, covers)
    return _started(counts.writeStream.outputMode("update").foreachBatch(write), checkpoint, available_now)


def dedupe_within_watermark(datapoints: DataFrame, delay: str = "1 day") -> DataFrame:
    """L2 (bounded form): ``dropDuplicatesWithinWatermark`` on the event key."""
    return (datapoints.withWatermark("observed_at", delay)
            .dropDuplicatesWithinWatermark(A.EVENT_KEY))


def stream_measure_restate(measurements: DataFrame) -> DataFrame:
    """L3 as keyed streaming state (``stream_restate`` keeps it in files instead).

    Declarative ``min_by`` aggregates keep one row of state per key; emit in
    ``update`` mode (changed keys only) or ``complete`` mode."""
    moving = ["occurred_at", "period_end", "observed_at", "metadata", "raw_record_id"]
    sticky = ["subject_type", "source_key"]
    newest = F.min_by(F.struct(*moving), F.struct(-F.unix_micros("observed_at"), F.col("raw_record_id")))
    first = F.min_by(F.struct(*sticky), F.col("raw_record_id"))
    return (measurements.where(F.col("kind") == "measurement").groupBy(*A.MEASURE_KEY)
            .agg(newest.alias("_n"), first.alias("_f"))
            .select(*A.MEASURE_KEY, *[F.col("_f." + c).alias(c) for c in sticky],
                    *[F.col("_n." + c).alias(c) for c in moving]))


def stream_daily_counts(events: DataFrame, time_col: str, keys: list[str], lateness: str = "1 day") -> DataFrame:
    """L4: tumbling UTC-day counts; in append mode a day comes out, once, when the watermark (the newest time seen,
    less ``lateness``) has passed its end, and rows of days that came out are dropped."""
    return (events.withWatermark(time_col, lateness)
            .groupBy(F.window(time_col, "1 day").alias("w"), *keys)
            .agg(F.count(F.lit(1)).alias("n"))
            .select(*keys, F.to_date(F.col("w.start")).alias("activity_date"), "n"))


def stream_undated_counts(events: DataFrame, time_col: str, keys: list[str]) -> DataFrame:
    """L4: rows without a time fall in no window; they are counted under a NULL day (``update`` or ``complete`` mode)."""
    return (events.where(F.col(time_col).isNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
            .select(*keys, F.lit(None).cast("date").alias("activity_date"), "n"))


def stream_rolling_counts(events: DataFrame, time_col: str, keys: list[str], days: int,
                          lateness: str = "1 day", as_of=None) -> DataFrame:
    """Trailing ``days``-day counts with a daily step, up to the step ``as_of`` (no bound if None).

    Spark windows are closed at the start; the reference's are open at both
    ends, so a row exactly on a window's start is subtracted. Windows whose
    rows all sit on the start emit nothing (empty windows give no row)."""
    t = F.col(time_col)
    x = (events.withWatermark(time_col, lateness)
         .withColumn("w", F.window(time_col, f"{days} days", "1 day"))
         .withColumn("_on_start", t == F.col("w.start")))
    agg = (x.groupBy("w", *keys)
           .agg((F.count(F.lit(1)) - F.count_if(F.col("_on_start"))).alias("n")))
    step = F.date_sub(F.to_date(F.col("w.end")), 1)
    if as_of is not None:
        agg = agg.where(step <= F.lit(as_of).cast("date"))
    return agg.where(F.col("n") > 0).select(
        *keys, step.alias("step_date"),
        F.lit(f"rolling_{days}d").alias("grain"), "n")
