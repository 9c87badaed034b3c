"""Work is spread whatever the layout of the input files, and columns that nobody reads are not computed."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyq import registry as R
from tallyspark import fixtures as FX
from tallyspark.session import apply_core_conf
from tallyspark.sources import landing as A


def _one_file(df, folder, name):
    df.coalesce(1).write.parquet(f"{folder}/made-{name}")
    (made,) = (folder / f"made-{name}").glob("*.parquet")
    made.rename(folder / f"{name}.parquet")


@pytest.fixture
def events(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1 + i % 20), i % 9, "view", 1.0 + i, '{"k": %d}' % (i % 5)) for i in range(200)]
    _one_file(spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string"),
              tmp_path, "events")
    return str(tmp_path)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_events_of_one_row_group_make_many_tasks(spark, events):
    base = FX.event_base(spark, events)
    assert base.count() == 200
    assert base.groupBy(F.spark_partition_id()).count().count() > 1


def test_winners_ids_need_no_metadata_and_no_sort(spark, events):
    raw = FX.fx_raw_all(spark, events)
    for envelope in (A.env_github, A.env_linear):
        ev = envelope(raw)
        won = A.dp_event_first_wins(ev.where("false"), ev)
        plan = _plan(won.select("kind", "source", "raw_record_id").groupBy("kind", "source").agg(F.count("raw_record_id")))
        assert "parse_json" not in plan and "SortAggregate" not in plan, envelope.__name__
        whole, few = won.collect(), won.select("raw_record_id").collect()
        assert sorted(r.raw_record_id for r in whole) == sorted(r.raw_record_id for r in few) and whole[0].metadata


def test_first_wins_by_time_then_id_with_null_times_first(spark):
    at = lambda d: dt.datetime(2026, 1, d)
    rows = [("t", "s", "a", "event", at(2), 5, "late"), ("t", "s", "a", "event", at(1), 9, "x"), ("t", "s", "a", "event", at(1), 7, "first"),
            ("t", "s", "b", "event", at(1), 1, "dated"), ("t", "s", "b", "event", None, 8, "undated"), (None, "s", None, "event", at(1), None, "no id"),
            (None, "s", None, "event", at(1), 3, "id"), ("t", "s", "c", "measurement", at(1), 4, "other")]
    schema = "tenant_id string, source string, source_key string, kind string, observed_at timestamp, raw_record_id long, metadata string"
    df = spark.createDataFrame(rows, schema)
    got = {(r.source_key, r.raw_record_id, r.metadata, r.kind) for r in A.dp_event_first_wins(df.where("false"), df).collect()}
    assert got == {("a", 7, "first", "event"), ("b", 8, "undated", "event"), (None, None, "no id", "event")}


def test_stream_input_is_written_by_all_tasks_one_micro_batch_each(spark, tmp_path):
    parts = [spark.range(0, 60, 1, 3), spark.range(60, 70, 1, 2), spark.range(0, 5, 1, 2)]
    seen = []

    def start(stream):
        return (stream.writeStream.foreachBatch(lambda b, i: seen.append((i, sorted(r.id for r in b.collect()))))
                .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    last = R._in_turns(spark, parts, "turns", start)
    assert seen == [(i, sorted(r.id for r in p.collect())) for i, p in enumerate(parts)]
    assert len(spark.read.parquet(last).inputFiles()) == 2 and spark.read.parquet(last).count() == 5


def test_merged_shuffle_partitions_stay_small(spark):
    apply_core_conf(spark)
    assert spark._jsparkSession.sessionState().conf().getConf(
        spark._jvm.org.apache.spark.sql.internal.SQLConf.ADVISORY_PARTITION_SIZE_IN_BYTES()) <= 16 << 20


def test_orders_are_grouped_after_lines_are_dealt(spark, tmp_path):
    d = dt.date(2024, 1, 1)
    _one_file(spark.createDataFrame([(i % 50, i % 7, d) for i in range(300)], "l_orderkey long, l_partkey long, l_shipdate date"), tmp_path, "lineitem")
    _one_file(spark.createDataFrame([(i, "economy") for i in range(7)], "p_partkey long, p_type string"), tmp_path, "part")
    _one_file(spark.createDataFrame([(i, 1, "F", d, "5-LOW") for i in range(50)],
                                    "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate date, o_orderpriority string"), tmp_path, "orders")
    _one_file(spark.createDataFrame([(1, 3)], "c_custkey long, c_nationkey long"), tmp_path, "customer")
    prs = FX.fx_pr(spark, str(tmp_path))
    assert prs.where("merged_at IS NOT NULL").count() == 50
    assert "REPARTITION_BY_COL" in _plan(prs.select("pr_number", "merged_at"))
