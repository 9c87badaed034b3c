"""Streaming twins across several micro-batches, identity rules, registry shape."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

from tallyspark.operators import identity as J
from tallyspark.sources.datapoints import read_datapoints
from tallyspark.streaming import streams as L


def _run(spark, agg, mode="complete"):
    name = f"m_{uuid.uuid4().hex}"
    q = agg.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_daily_counts_over_many_batches_with_late_rows(spark, tmp_path):
    src = str(tmp_path / "in")
    days = [dt.datetime(2026, 1, d, 10) for d in range(1, 8)]
    schema = "tenant_id string, ts timestamp"
    for i, t in enumerate(days):   # one file per day, in time order
        spark.createDataFrame([("t", t), ("t", t + dt.timedelta(hours=3))], schema).coalesce(1) \
            .write.mode("append").parquet(src)
    # a row 12 hours late (within the 1-day lateness) arrives with the last file
    spark.createDataFrame([("t", days[5] - dt.timedelta(hours=12))], schema).coalesce(1) \
        .write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = {r.activity_date: r.n for r in _run(spark, L.stream_daily_counts(stream, "ts", ["tenant_id"])).collect()}
    batch = spark.read.parquet(src).groupBy(F.to_date("ts").alias("d")).count().collect()
    assert got == {r.d: r["count"] for r in batch}


def test_rolling_stream_matches_open_bounds(spark, tmp_path):
    src = str(tmp_path / "roll")
    pts = [dt.datetime(2026, 1, 1, 12), dt.datetime(2026, 1, 3, 0, 0), dt.datetime(2026, 1, 6, 12)]
    spark.createDataFrame([("t", p) for p in pts], "tenant_id string, ts timestamp").write.parquet(src)
    stream = spark.readStream.schema("tenant_id string, ts timestamp").parquet(src)
    got = {r.step_date: r.n for r in _run(spark, L.stream_rolling_counts(stream, "ts", ["tenant_id"], 3)).collect()}
    expect = {}
    for i in range(-3, 10):
        step = dt.date(2026, 1, 1) + dt.timedelta(days=i)
        end = dt.datetime.combine(step, dt.time()) + dt.timedelta(days=1)
        n = sum(1 for p in pts if end - dt.timedelta(days=3) < p < end)
        if n:
            expect[step] = n
    assert got == expect


def test_last_admin_is_never_demoted(spark):
    linked = spark.createDataFrame(
        [("t", "1", "member", "u1"), ("t", "2", "member", "u2"), ("s", "3", "member", "u3"), ("s", "4", "admin", "u4")],
        "tenant_id string, external_user_id string, org_role string, user_id string")
    mem = spark.createDataFrame([("t", "u1", "admin"), ("t", "u2", "admin"), ("s", "u3", "admin"),
                                 ("s", "u4", "individual")], "tenant_id string, user_id string, role string")
    got = {(r.tenant_id, r.user_id): r.role for r in J.reconcile_roles(linked, mem).collect()}
    assert got[("t", "u1")] == "individual" and got[("t", "u2")] == "admin"   # one admin must remain
    assert got[("s", "u4")] == "admin" and got[("s", "u3")] == "individual"   # promotion first, then demotion


def test_one_identity_per_user_per_tenant(spark):
    ids = spark.createDataFrame(
        [("t", "10", "a", "x@x", None, "member", None, None, "pending_email"),
         ("t", "11", "b", "X@x", None, "member", None, None, "pending_email")],
        "tenant_id string, external_user_id string, login string, email string, name string, org_role string, "
        "user_id string, link_method string, status string")
    users = spark.createDataFrame([("u1", "x@X")], "user_id string, email string")
    oauth = spark.createDataFrame([], "account_id string, user_id string")
    got = {r.external_user_id: (r.user_id, r.status) for r in J.link_identity(ids, users, oauth).collect()}
    assert got == {"10": ("u1", "linked"), "11": (None, "pending_email")}


def test_registry_keys_have_oracles():
    import __spark_entry__ as E
    from tallyq.registry import ORACLE, QUERIES
    q, o = E.queries(), E.oracle_sql()
    assert len(QUERIES) >= 150 and set(o) <= set(q)
    assert set(QUERIES) == set(ORACLE)


def test_dedupe_within_watermark_keeps_one_per_key(spark, tmp_path):
    src = str(tmp_path / "dp")
    t0 = dt.datetime(2026, 1, 1)
    rows = [("t", "github", f"k{i % 3}", t0 + dt.timedelta(hours=i)) for i in range(9)]
    spark.createDataFrame(rows, "tenant_id string, source string, source_key string, observed_at timestamp") \
        .write.parquet(src)
    stream = spark.readStream.schema("tenant_id string, source string, source_key string, observed_at timestamp") \
        .parquet(src)
    out = _run(spark, L.dedupe_within_watermark(stream), mode="append")
    assert sorted(r.source_key for r in out.collect()) == ["k0", "k1", "k2"]


def test_exact_event_dedupe_across_batches(spark, tmp_path):
    src, out = str(tmp_path / "ev"), str(tmp_path / "out")
    cols = ("id string, tenant_id string, source string, tool string, kind string, name string, "
            "subject_type string, subject_id string, occurred_at timestamp, period_start timestamp, "
            "period_end timestamp, observed_at timestamp, source_key string, metadata string, raw_record_id long")

    def batch(i, keys):
        t = dt.datetime(2026, 1, 1 + i)
        return [(f"{k}-{i}", "t" + str(j % 2), "github", "github", "event", "pr", "user", "u", t, None, None, t,
                 k, "{}", i * 100 + j) for j, k in enumerate(keys)]
    spark.createDataFrame(batch(0, ["a", "b"]), cols).coalesce(1).write.parquet(src)
    # second batch repeats key (t1, b): the first-landed row must stay the only one
    spark.createDataFrame(batch(1, ["c", "b"]), cols).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).parquet(src)
    L.stream_event_dedupe(stream, out, str(tmp_path / "ck")).awaitTermination()
    got = read_datapoints(spark, out).collect()
    assert sorted((r.tenant_id, r.source_key, r.raw_record_id) for r in got) == [
        ("t0", "a", 0), ("t0", "c", 100), ("t1", "b", 1)]
