"""Versioned tables, merges by touched bucket, and streams written to files over several micro-batches."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tallyspark.sources import sinks as SK
from tallyspark.sources.datapoints import datapoint_table, read_datapoints, upsert_datapoints
from tallyspark.sources.versions import Conflict, VersionedTable
from tallyspark.streaming import streams as L

VALUES = "tenant_id string, metric_id string, value double"
POINTS = ("id string, tenant_id string, source string, tool string, kind string, name string, subject_type string, subject_id string, "
          "occurred_at timestamp, period_start timestamp, period_end timestamp, observed_at timestamp, source_key string, metadata string, raw_record_id long")


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_reader_keeps_its_version_during_swaps(spark, tmp_path):
    base = str(tmp_path / "m")
    make = lambda v: spark.createDataFrame([("a", "m", v), ("b", "m", v)], VALUES)
    SK.sink_metric_swap(make(1.0), base, "m")
    before = SK.read_metric_values(spark, base, ["m"])
    SK.sink_metric_swap(make(2.0), base, "m")
    SK.sink_metric_swap(make(3.0), base, "m", tenants=["a"])
    assert {(r.tenant_id, r.value) for r in before.collect()} == {("a", 1.0), ("b", 1.0)}
    assert {(r.tenant_id, r.value) for r in SK.read_metric_values(spark, base, ["m"]).collect()} == {("a", 3.0), ("b", 2.0)}


def test_a_tenant_swap_writes_its_slice_only(spark, tmp_path):
    base = str(tmp_path / "m")
    SK.sink_metric_swap(spark.createDataFrame([(f"t{i}", "m", 1.0) for i in range(20)], VALUES), base, "m")
    old = files(base)
    SK.sink_metric_swap(spark.createDataFrame([("t3", "m", 9.0)], VALUES), base, "m", tenants=["t3"])
    assert all("tenant_id=t3" in f for f in files(base) - old) and len(files(base) - old) == 1


class Interrupted(VersionedTable):
    """Lets another writer publish after this one has read the manifest."""

    def replace(self, df, covers, marks=(), between=None):
        look, calls = self.manifest, []

        def manifest(number=None):
            calls.append(number)
            if len(calls) == 2:
                between()
            return look(number)
        self.manifest = manifest
        return super().replace(df, covers, marks)


@pytest.mark.parametrize("other,survives", [("b", True), ("a", False)])
def test_two_swaps_at_once(spark, tmp_path, other, survives):
    base = str(tmp_path / "m")
    one = lambda t, v: spark.createDataFrame([(t, "m", v)], VALUES)
    SK.sink_metric_swap(one("a", 0.0).union(one("b", 0.0)), base, "m")
    mine = Interrupted(spark, base, ["metric_id", "tenant_id"])
    go = lambda: mine.replace(one("a", 1.0), lambda s: s == ("m", "a"), between=lambda: SK.sink_metric_swap(one(other, 2.0), base, "m", tenants=[other]))
    if survives:
        go()
    else:
        with pytest.raises(Conflict):
            go()
    got = {r.tenant_id: r.value for r in SK.read_metric_values(spark, base, ["m"]).collect()}
    assert got == ({"a": 1.0, "b": 2.0} if survives else {"a": 2.0, "b": 0.0})


def test_old_versions_go_and_one_number_is_made_once(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["k"])
    for i in range(9):
        table.replace(spark.createDataFrame([(i, "x"), (i, None), (i, "a/b=c")], "v int, k string"), lambda s: True)
    assert table._numbers() == [5, 6, 7, 8, 9] and len(files(tmp_path / "t")) == 15
    assert not table._publish(9, {})
    assert rows(table.read()) == [("a/b=c", 8), ("x", 8), (None, 8)]
    assert rows(table.read(lambda s: s == ("a/b=c",), number=6)) == [("a/b=c", 5)]
    with pytest.raises(ValueError):
        table.replace(spark.createDataFrame([(1, "y")], "v int, k string"), lambda s: s == ("x",))
    assert len(files(tmp_path / "t")) == 15


def points(spark, items, kind="event"):
    """(tenant, key, day observed, record) -> datapoints."""
    out = []
    for t, k, day, rec in items:
        at = dt.datetime(2026, 1, 1) + dt.timedelta(days=day)
        start = dt.datetime(2026, 1, 1) if kind == "measurement" else None
        out.append((f"i{rec}", t, "s", "tool", kind, "n", "user", k, at, start, start, at, k, '{"v":%d}' % rec, rec))
    return spark.createDataFrame(out, POINTS)


def test_a_merge_reads_and_writes_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "dp")
    upsert_datapoints(points(spark, [("a", f"k{i}", 0, i) for i in range(400)] + [("b", f"k{i}", 0, i) for i in range(400)]), path, buckets=32)
    first, old = rows(read_datapoints(spark, path)), files(path)
    batch = points(spark, [("a", "k7", 1, 1000), ("a", "new", 1, 1001)])
    upsert_datapoints(batch, path, buckets=32)
    new = {os.path.dirname(f) for f in files(path) - old}
    assert 1 <= len(new) <= 2 and all("tenant_id=a" in f for f in new)
    touched = {r.bucket for r in datapoint_table(spark, path).read().where("source_key in ('k7', 'new')").collect()}
    read = datapoint_table(spark, path).read(lambda s: s[1] == "a" and int(s[2]) in touched)
    assert read.count() < 100
    after = rows(read_datapoints(spark, path))
    assert len(after) == 801 and set(first) < set(after)
    upsert_datapoints(batch, path, buckets=32)
    assert rows(read_datapoints(spark, path)) == after


def test_unknown_kinds_are_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="odd"):
        upsert_datapoints(points(spark, [("a", "k", 0, 1)], kind="odd"), str(tmp_path / "dp"))


def feed(spark, path, batches):
    for b in batches:
        b.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_restated_measurements_ignore_late_older_rows(spark, tmp_path):
    batches = [points(spark, x, "measurement") for x in (
        [("a", "u", 5, 1), ("a", "w", 5, 2)], [("a", "u", 9, 3)], [("a", "u", 7, 4), ("a", "w", 5, 5), ("b", "u", 1, 6)])]
    L.stream_restate(feed(spark, str(tmp_path / "in"), batches), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {(r.tenant_id, r.subject_id): (r.raw_record_id, r.metadata) for r in read_datapoints(spark, str(tmp_path / "out")).collect()}
    assert got == {("a", "u"): (3, '{"v":3}'), ("a", "w"): (2, '{"v":2}'), ("b", "u"): (6, '{"v":6}')}


def test_days_come_out_once_final_and_later_rows_are_dropped(spark, tmp_path):
    day = lambda d, h=1: dt.datetime(2026, 1, d, h)
    schema = "tenant_id string, ts timestamp"
    batches = [spark.createDataFrame([("t", x) for x in b], schema) for b in (
        [day(1), day(1, 5), day(2)], [day(1, 9), day(5)],                 # day 1 still open for the third row
        [day(6)], [day(1, 7), day(6, 2), day(5, 2)], [day(9)])]           # the fourth file's day 1 is final: dropped
    stream = feed(spark, str(tmp_path / "in"), batches)
    out = L.stream_daily_counts(stream, "ts", ["tenant_id"])
    q = L.write_final(out, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    got = rows(spark.read.schema(out.schema).parquet(str(tmp_path / "out")).select("activity_date", "n"))
    assert got == [(dt.date(2026, 1, 1), 3), (dt.date(2026, 1, 2), 1), (dt.date(2026, 1, 5), 2), (dt.date(2026, 1, 6), 2)]
    assert sum(o["numRowsDroppedByWatermark"] for p in q.recentProgress for o in p["stateOperators"]) == 1
    assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 1  # only the open day is held


def test_landing_stream_upserts_datapoints(spark, tmp_path):
    def records(items):
        return spark.createDataFrame([("t", "pull_requests", '{"node_id":"%s","title":"%s","created_at":"2026-01-01T00:00:00Z","user":{"login":"x"}}' % (k, k),
                                       dt.datetime(2026, 1, day)) for k, day in items], "tenant_id string, stream string, payload string, fetched_at timestamp")
    stream = feed(spark, str(tmp_path / "in"), [records([("a", 1), ("b", 1)]), records([("b", 2), ("c", 2)])])
    raw, dp = str(tmp_path / "raw"), str(tmp_path / "dp")
    L.stream_land(stream, "github", raw, dp, str(tmp_path / "ck")).awaitTermination()
    first = rows(read_datapoints(spark, dp))
    assert spark.read.parquet(raw).count() == 4 and len(first) == 3
    L.stream_land(stream, "github", raw, dp, str(tmp_path / "ck2")).awaitTermination()
    assert rows(read_datapoints(spark, dp)) == first and spark.read.parquet(raw).count() == 4


def test_open_days_and_undated_rows_are_counted_too(spark, tmp_path):
    from tallyq.registry import QUERIES
    at = [dt.datetime(2026, 1, 1, 1), dt.datetime(2026, 1, 1, 5), dt.datetime(2026, 1, 8, 9), None, None]
    spark.createDataFrame([(i, t, 4, "view", 1.0, '{"k": 1}') for i, t in enumerate(at)],
                          "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string") \
        .coalesce(1).write.parquet(str(tmp_path / "made"))
    (made,) = (tmp_path / "made").glob("*.parquet")
    made.rename(tmp_path / "events.parquet")
    got = QUERIES["stream_daily_counts"](spark, str(tmp_path)).collect()
    assert {r.activity_date: r.n for r in got} == {dt.date(2026, 1, 1): 2, dt.date(2026, 1, 8): 1, None: 2}
    assert {(r.tenant_id, r.event_type) for r in got} == {("t0", "view")} and len(got) == 3


def test_counts_table_replaces_changed_days(spark, tmp_path):
    day = lambda d, h=1: dt.datetime(2026, 1, d, h)
    batches = [spark.createDataFrame([("t", x) for x in b], "tenant_id string, ts timestamp") for b in (
        [day(1), day(2)], [day(1, 9), day(2, 3), day(3)], [day(3, 2)])]
    counts = L.stream_daily_counts(feed(spark, str(tmp_path / "in"), batches), "ts", ["tenant_id"])
    L.write_counts(counts, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {r.activity_date.day: r.n for r in L.count_table(spark, str(tmp_path / "out")).read().collect()}
    assert got == {1: 2, 2: 2, 3: 2}
