"""K1-K5: ingestion run-log analytics, for every account / tenant at once."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BACKFILL_DAYS = 90
OVERLAP = dt.timedelta(days=1)


def watermark_start(runs: DataFrame, as_of, backfill_days: int = BACKFILL_DAYS) -> DataFrame:
    """K1: per (account, resource): the latest successful run's watermark minus
    one day, else ``as_of`` minus the backfill window (ISO date string)."""
    if isinstance(as_of, str):
        as_of = dt.datetime.fromisoformat(as_of)
    default = (as_of - dt.timedelta(days=backfill_days)).date().isoformat()
    ok = F.col("status") == "success"
    latest = F.max_by(F.when(ok, F.struct(F.col("watermark"))),
                      F.when(ok, F.struct("started_at", "id")))
    agg = runs.groupBy("connected_account_id", "resource_type").agg(latest.alias("_l"))
    wm = F.col("_l.watermark")
    start = F.date_format(F.to_date(wm - F.expr("INTERVAL 1 DAY")), "yyyy-MM-dd")
    return agg.select("connected_account_id", "resource_type",
                      F.coalesce(start, F.lit(default)).alias("start_date"))


def run_counts(raw: DataFrame, datapoints: DataFrame) -> DataFrame:
    """K2: raw rows and datapoints per run (datapoint -> raw row -> run)."""
    r = raw.where(F.col("run_id").isNotNull()).groupBy("run_id").agg(F.count(F.lit(1)).alias("records_pulled"))
    ids = raw.select(F.col("id").alias("raw_record_id"), "run_id")
    d = (datapoints.where(F.col("raw_record_id").isNotNull()).join(ids, "raw_record_id")
         .groupBy("run_id").agg(F.count(F.lit(1)).alias("datapoints_written")))
    return (r.join(d, "run_id", "left")
            .select("run_id", "records_pulled", F.coalesce("datapoints_written", F.lit(0)).alias("datapoints_written")))


def recent_runs(runs: DataFrame, limit: int = 20, salt_buckets: int = 64) -> DataFrame:
    """K3: the newest ``limit`` runs of every tenant (a top-k per tenant).

    Two phases so a tenant holding a third of all runs is never sorted in one
    task: the top ``limit`` within (tenant, salt) first — many parallel small
    sorts — then the top ``limit`` among those few survivors per tenant."""
    order = [F.col("started_at").desc(), F.col("id").desc()]
    salted = runs.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(salt_buckets)))
    w1 = Window.partitionBy("tenant_id", "_salt").orderBy(*order)
    pre = salted.withColumn("_rn", F.row_number().over(w1)).where(F.col("_rn") <= limit)
    w2 = Window.partitionBy("tenant_id").orderBy(*order)
    return (pre.withColumn("_rn", F.row_number().over(w2)).where(F.col("_rn") <= limit)
            .drop("_rn", "_salt"))


def datapoint_stats(datapoints: DataFrame, raw: DataFrame, runs: DataFrame) -> DataFrame:
    """K4: totals and last run per tenant (three aggregates joined on tenant)."""
    d = datapoints.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("total_datapoints"))
    r = raw.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("total_raw_records"))
    lr = runs.groupBy("tenant_id").agg(F.max("started_at").alias("last_run_at"))
    j = d.join(r, "tenant_id", "full_outer").join(lr, "tenant_id", "full_outer")
    return j.select("tenant_id", F.coalesce("total_datapoints", F.lit(0)).alias("total_datapoints"),
                    F.coalesce("total_raw_records", F.lit(0)).alias("total_raw_records"), "last_run_at")


def count_by_label(datapoints: DataFrame) -> DataFrame:
    """K5: datapoint counts by kind and by source per tenant, largest first.

    One scan: each datapoint contributes a (kind) and a (source) label row."""
    labels = F.array(F.struct(F.lit("kind").alias("label_type"), F.col("kind").alias("label")),
                     F.struct(F.lit("source").alias("label_type"), F.col("source").alias("label")))
    x = datapoints.select("tenant_id", F.explode(labels).alias("l"))
    return (x.groupBy("tenant_id", F.col("l.label_type").alias("label_type"), F.col("l.label").alias("label"))
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy("tenant_id", "label_type", F.col("count").desc(), "label"))
