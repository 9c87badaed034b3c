"""Exact percentiles by rank selection against plain sorting, and the plans they and the time bounds give."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators.ranks import SLICES, percentiles, rolling_percentiles
from tallyspark.plans.compile import compute_metric
from tallyspark.plans.org import preview
from tallyspark.plans.spec import Measure, Metric, Window

DAY0 = dt.date(2024, 1, 1)


def exact(values, p):
    v = sorted(values)
    at = p * (len(v) - 1)
    lo, hi = math.floor(at), math.ceil(at)
    return v[lo] if v[lo] == v[hi] else (1 - (at - lo)) * v[lo] + (at - lo) * v[hi]


def close(a, b):
    return (a is None and b is None) or a == pytest.approx(b, rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("pcts", [[0.5], [0.5, 0.9], [0.01, 0.25, 0.999]])
def test_percentiles_equal_sorting(spark, pcts):
    r = random.Random(1)
    rows = [("hot", r.choice([r.gauss(0, 1), r.expovariate(0.01), 5.0, 1 + r.random() / SLICES / 50])) for _ in range(6000)]  # 95 of 100 rows, many in one slice
    rows += [(f"t{i % 7}", r.uniform(-1e-9, 1e9) * r.choice([1, -1e-12])) for i in range(250)]
    rows += [(None, 3.0), (None, 4.0), ("one", -7.5), ("nulls", None), ("nulls", None), ("some", None), ("some", 2.0), ("zero", 0.0), ("zero", -0.0)]
    got = {x.k: x for x in percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", pcts).collect()}
    by = {}
    for k, v in rows:
        by.setdefault(k, []).append(v)
    assert set(got) == set(by)
    for k, values in by.items():
        some = [v for v in values if v is not None]
        assert (got[k].n, got[k]["rows"]) == (len(some), len(values))
        for i, p in enumerate(pcts):
            assert close(got[k][f"p{i}"], exact(some, p) if some else None), (k, p)
        assert close(got[k].mean, math.fsum(some) / len(some) if some else None) or abs(got[k].mean) > 1e6


def test_empty_input(spark):
    d = spark.createDataFrame([], "k string, v double, d date, m boolean")
    assert percentiles(d, ["k"], "v", [0.5]).collect() == []
    assert rolling_percentiles(d, ["k"], "d", "m", "v", [0.5], 7, DAY0, DAY0 + dt.timedelta(30)).collect() == []


@pytest.mark.parametrize("days,mondays", [(1, False), (3, False), (30, False), (14, True)])
def test_rolling_equals_sorting_each_window(spark, days, mondays):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), DAY0 + dt.timedelta(r.randint(-40, 60)), r.random() < 0.2,
             r.choice([None, 1.5, 1 + r.random() / SLICES, r.expovariate(0.1)])) for _ in range(900)]
    first, last = DAY0, DAY0 + dt.timedelta(50)
    got = {(x.k, x.step): x for x in rolling_percentiles(spark.createDataFrame(rows, "k string, d date, m boolean, v double"), ["k"], "d", "m", "v",
                                                         [0.5, 0.9], days, first, last, mondays).collect()}
    want = {}
    for k in ("a", "b", None):
        for s in range((last - first).days + 1):
            step = first + dt.timedelta(s)
            own = [v for q, d, m, v in rows if q == k and d <= step <= d + dt.timedelta(days - 1 - m)]
            if own and not (mondays and step.weekday()):
                want[k, step] = own
    assert set(got) == set(want)
    for key, own in want.items():
        some = [v for v in own if v is not None]
        assert (got[key].n, got[key]["rows"]) == (len(some), len(own))
        for i, p in enumerate((0.5, 0.9)):
            assert close(got[key][f"p{i}"], exact(some, p) if some else None)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def simple(**kw):
    return Metric(id="t.x", entity="e", time_field="t", **kw)


@pytest.fixture
def entity(spark, tmp_path):
    r = random.Random(3)
    rows = [(f"t{i % 3}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=r.randint(0, 24 * 900)), r.expovariate(1)) for i in range(2000)]
    spark.createDataFrame(rows, "tenant_id string, t timestamp, v double").write.parquet(f"{tmp_path}/e")
    return {"e": spark.read.parquet(f"{tmp_path}/e")}


def test_no_plan_buffers_a_group_for_a_percentile(entity):
    m = simple(measure=Measure("percentile", "v", 90.0), grains=("day", "month"), windows=(Window(30),))
    assert "percentile(" not in plan(compute_metric(m, entity, as_of="2026-06-01"))


def sent(df):
    """Rows written by the plan's shuffles."""
    df.collect()
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if node.getClass().getSimpleName() == "ShuffleExchangeExec":
                out.append(node.metrics().apply("shuffleRecordsWritten").value())
            kids = node.children()
            todo += [kids.apply(i) for i in range(kids.size())]
    return sum(out)


def test_rolling_rows_do_not_grow_with_the_window(spark):
    r = random.Random(4)
    rows = [("a", DAY0 + dt.timedelta(r.randint(0, 60)), False, r.expovariate(0.1)) for _ in range(4000)]
    d = spark.createDataFrame(rows, "k string, d date, m boolean, v double")
    at = {n: sent(rolling_percentiles(d, ["k"], "d", "m", "v", [0.5], n, DAY0, DAY0 + dt.timedelta(60))) for n in (5, 50)}
    assert at[50] < 1.3 * at[5]


@pytest.mark.parametrize("measure", [Measure("count"), Measure("percentile", "v", 50.0), Measure("count_distinct", "v")])
def test_windows_read_only_the_days_they_reach(spark, entity, measure):
    m = simple(measure=measure, grains=(), windows=(Window(7), Window(28, "week")))
    out = compute_metric(m, entity, as_of="2024-06-01", horizon_days=60)
    assert "GreaterThanOrEqual(t," in plan(out) and "LessThan(t," in plan(out)
    unbound = {"e": entity["e"].withColumn("t", F.coalesce("t", F.lit(None).cast("timestamp")))}
    assert sorted(out.collect()) == sorted(compute_metric(m, unbound, as_of="2024-06-01", horizon_days=60).collect()) != []
    # all history, cut afterwards
    whole = compute_metric(m, entity, as_of="2024-06-01", horizon_days=400).where(F.col("bucket_end") > F.lit(dt.datetime(2024, 4, 3)))
    got = out.where(F.col("bucket_end") > F.lit(dt.datetime(2024, 4, 3)))
    assert sorted(got.collect()) == sorted(whole.collect())


def test_preview_reads_only_what_it_shows(entity):
    m = simple(measure=Measure("percentile", "v", 50.0), grains=("day", "month"))
    out = preview(m, entity, as_of="2024-06-01", days=60)
    assert "GreaterThanOrEqual(t," in plan(out)
    whole = compute_metric(m.with_(grains=("month",)), entity, as_of="2024-06-01").where(F.col("bucket_start") >= F.lit(dt.datetime(2024, 4, 2)))
    assert sorted(out.collect()) == sorted(whole.collect()) != []
