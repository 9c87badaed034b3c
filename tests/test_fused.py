"""Many metrics in one pass equal each metric alone; one scan; nothing is left behind; the last admin stays."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tallyspark import session
from tallyspark.operators import identity as J
from tallyspark.operators.pipeline import publish_metrics
from tallyspark.plans import compile as CP
from tallyspark.plans.fused import compute_fused
from tallyspark.plans.org import compute_enrolled, metric_values
from tallyspark.plans.spec import MappedDim, Measure, Metric, Window
from tallyspark.sources import sinks as SK

AS_OF = "2024-04-01"


def metric(name, **kw):
    return Metric(id=name, **({"entity": "pr", "time_field": "merged"} | kw))


SPAN = dict(from_field="opened", to_field="merged")
COUNT = metric("count", measure=Measure("count"), grains=("day", "month"), windows=(Window(7),))
BIG = metric("big", measure=Measure("count"), filters=({"field": "size", "op": "gt", "value": 5.0},), grains=("month",))
REVIEWED = metric("reviewed", time_field="reviewed", measure=Measure("sum", "size"), grains=("week", "quarter"), windows=(Window(14, "week"),))
RATIO = metric("ratio", entity=None, time_field=None, kind="ratio", numerator=BIG, denominator=COUNT, grains=("day", "month"), windows=(Window(7),))
ZERO = RATIO.with_(id="zero", numerator=COUNT, denominator=BIG, zero_denominator="zero")
FORMULA = metric("formula", entity=None, time_field=None, kind="formula", inputs=(("a", COUNT), ("b", REVIEWED)), expression="a + b * 2", grains=("month",))
MEDIAN = metric("median", measure=Measure("median", **SPAN), grains=("day", "month"), windows=(Window(10),))
P90 = metric("p90", measure=Measure("percentile", percentile=90.0, **SPAN), grains=("day", "month"))
ROLLING = metric("rolling", measure=Measure("percentile", "size", 25.0), grains=(), windows=(Window(10), Window(21, "week")))
EXTREMES = [metric(a, measure=Measure(a, "size"), grains=("month",), windows=(Window(3),)) for a in ("min", "max", "avg")]
DISTINCT = metric("distinct", measure=Measure("count_distinct", "size"), grains=("month",))
DEPLOYS = metric("deploys", entity="rel", time_field="at", measure=Measure("count"), grains=("month",))
BY_REPO = COUNT.with_(id="by_repo", dimensions=("repo",))
P_BY_REPO = MEDIAN.with_(id="p_by_repo", dimensions=("repo",))
KIND = MappedDim("kind", "repo", (("r0", "core"), ("r1", "side")), "other")
MAPPED = COUNT.with_(id="mapped", dimensions=("kind",), mapped=(KIND,))
ALL = [COUNT, BIG, REVIEWED, RATIO, ZERO, FORMULA, MEDIAN, P90, ROLLING, *EXTREMES, DEPLOYS, BY_REPO, P_BY_REPO, MAPPED]


@pytest.fixture(scope="module")
def entities(spark, tmp_path_factory):
    r = random.Random(1)
    when = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(hours=r.choice([24 * r.randint(-5, 100), r.randint(-100, 2400)]))
    prs = []
    for i in range(600):
        opened = when()
        merged = opened + dt.timedelta(hours=r.randint(-5, 200)) if r.random() < 0.8 else None
        prs.append((f"t{r.choice([0, 0, 0, 1, 2])}", f"r{i % 3}" if i % 7 else None, opened, merged, when() if r.random() < 0.5 else None, r.choice([None, float(r.randint(0, 12))])))
    base = tmp_path_factory.mktemp("entities")
    spark.createDataFrame(prs, "tenant_id string, repo string, opened timestamp, merged timestamp, reviewed timestamp, size double").write.parquet(f"{base}/pr")
    spark.createDataFrame([("t1", when()) for _ in range(40)], "tenant_id string, at timestamp").withColumn("repo", F.lit("r0")).write.parquet(f"{base}/rel")
    return {k: spark.read.parquet(f"{base}/{k}") for k in ("pr", "rel")}


def rows(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def test_together_equals_alone(entities):
    alone = CP.metric_union([CP.compute_metric(m, entities, as_of=AS_OF, horizon_days=120) for m in ALL])
    assert rows(compute_fused(ALL, entities, as_of=AS_OF, horizon_days=120)) == rows(alone) != []


def test_metrics_that_cannot_share_are_added(entities):
    some = [COUNT, DISTINCT, MEDIAN]
    alone = CP.metric_union([CP.compute_metric(m, entities, as_of=AS_OF) for m in some])
    assert rows(metric_values(some, entities, as_of=AS_OF)) == rows(alone)
    with pytest.raises(ValueError, match="distinct"):
        compute_fused([DISTINCT], entities, as_of=AS_OF)


def test_enrolled_tenants_only(spark, entities):
    pairs = [("t0", "count"), ("t0", "count"), ("t1", "median"), ("t1", "ratio"), ("t2", "distinct"), ("t9", "p90"), ("t0", "p_by_repo")]
    some = [COUNT, BIG, RATIO, MEDIAN, P90, DISTINCT, P_BY_REPO]
    got = compute_enrolled(some, entities, spark.createDataFrame(pairs, "tenant_id string, metric_id string"), as_of=AS_OF)
    alone = CP.metric_union([CP.compute_metric(m, entities, as_of=AS_OF) for m in some])
    keep = F.concat_ws("|", "tenant_id", "metric_id").isin(["|".join(p) for p in pairs])
    assert rows(got) == rows(alone.where(keep)) != []


def test_each_entity_is_read_once(spark, entities, tmp_path):
    reads = []
    counted = {k: v.withColumn("_x", F.lit(1)) for k, v in entities.items()}
    log = session.written

    def spy(df, name):
        reads.append(df._jdf.queryExecution().executedPlan().toString())
        return log(df, name)
    from tallyspark.plans import fused
    fused.written, before = spy, fused.written
    try:
        out = compute_fused([COUNT, BIG, REVIEWED, RATIO, FORMULA, MEDIAN, P90, ROLLING], counted, as_of=AS_OF)
    finally:
        fused.written = before
    assert len(reads) == 1 and reads[0].count("FileScan") == 1 and "partial_count" in reads[0]
    place = entities["pr"].inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert place not in out._jdf.queryExecution().executedPlan().toString()


def test_publishing_leaves_no_intermediates(spark, entities, tmp_path):
    shared = session.checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(shared))
    base = str(tmp_path / "m")
    publish_metrics([COUNT, MEDIAN, DISTINCT], entities, base, as_of=AS_OF)
    publish_metrics([COUNT, MEDIAN], entities, base, as_of=AS_OF, tenants=["t1"])
    assert set(os.listdir(shared)) == before
    alone = CP.metric_union([CP.compute_metric(m, entities, as_of=AS_OF) for m in (COUNT, MEDIAN, DISTINCT)])
    assert rows(SK.read_metric_values(spark, base, ["count", "median", "distinct"])) == rows(alone)


def test_the_last_admin_in_order_stays(spark):
    linked = spark.createDataFrame([(t, f"{k}", "member" if k < 4 else "admin", f"u{k}") for t in "ab" for k in range(5)] + [("c", "1", "member", "u1")],
                                   "tenant_id string, external_user_id string, org_role string, user_id string")
    roles = spark.createDataFrame([("a", f"u{k}", "admin") for k in range(4)] + [("b", f"u{k}", "admin") for k in range(5)] + [("c", "u1", "admin"), ("d", "u7", "admin"), ("a", "u8", "manager")],
                                  "tenant_id string, user_id string, role string")
    out = J.reconcile_roles(linked, roles)
    got = {(r.tenant_id, r.user_id): r.role for r in out.collect()}
    want = {("a", f"u{k}"): "individual" for k in range(3)} | {("a", "u3"): "admin", ("a", "u8"): "manager", ("b", "u4"): "admin", ("c", "u1"): "admin", ("d", "u7"): "admin"}
    assert got == want | {("b", f"u{k}"): "individual" for k in range(4)}
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
