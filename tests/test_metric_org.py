"""Enrollment, per-tenant parameters, preview, stage counts, IC visibility, serving helpers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import serving as I
from tallyspark.plans import org as G
from tallyspark.plans.compile import compute_metric
from tallyspark.plans.spec import MappedDim, Measure, Metric, Param, Window, bind_params, definition_version

T = dt.datetime


@pytest.fixture(scope="module")
def prs(spark):
    rows = [("a", "1", "alice", 0, T(2026, 5, 1), T(2026, 5, 2)), ("a", "2", "bob", 2, T(2026, 5, 3), T(2026, 5, 5)),
            ("b", "3", "carol", 1, T(2026, 5, 1), T(2026, 5, 1, 12)), ("b", "4", "dave", 3, T(2026, 6, 1), None)]
    return spark.createDataFrame(rows, "tenant_id string, id string, author_id string, review_count int, "
                                       "opened_at timestamp, merged_at timestamp")


MERGED = Metric(id="std.merged", entity="pr", time_field="merged_at", measure=Measure("count"), grains=("month",))


def test_enrolled_pairs_modes(spark):
    enr = spark.createDataFrame(
        [("a", "default_on", None, ["std.x"], None), ("b", "explicit", ["std.x", "std.zzz"], None, ["c.1"])],
        "tenant_id string, mode string, enabled array<string>, disabled array<string>, custom array<string>")
    got = sorted((r.tenant_id, r.metric_id) for r in G.enrolled_pairs(enr, ["std.x", "std.y"]).collect())
    assert got == [("a", "std.y"), ("b", "c.1"), ("b", "std.x")]


def test_enrolled_metric_filters_tenants(spark, prs):
    pairs = spark.createDataFrame([("a", "std.merged")], "tenant_id string, metric_id string")
    out = G.compute_enrolled([MERGED], {"pr": prs}, pairs, as_of="2026-07-01")
    assert {r.tenant_id for r in out.collect()} == {"a"}


def test_shared_plan_per_tenant_params(spark, prs):
    m = MERGED.with_(params=(Param("min_reviews", "integer", "review_count", "gte", default=0, has_default=True),))
    vals = spark.createDataFrame([("a", 1), ("b", None)], "tenant_id string, min_reviews int")
    out = {r.tenant_id: r for r in G.compute_shared(m, {"pr": prs}, vals, as_of="2026-07-01").collect()}
    assert out["a"].value == 1.0 and out["b"].value == 1.0   # a: only bob (2 >= 1); b: default 0
    assert out["a"].definition_version != out["b"].definition_version
    static = compute_metric(bind_params(m, {"min_reviews": 1}), {"pr": prs}, as_of="2026-07-01")
    assert {r.tenant_id: r.value for r in static.collect()} == {"a": 1.0, "b": 1.0}


def test_bind_params_errors():
    m = MERGED.with_(params=(Param("p", "integer", "review_count", "gte"),))
    with pytest.raises(ValueError):
        bind_params(m, None)
    with pytest.raises(ValueError):
        bind_params(m, {"q": 1})


def test_definition_version_is_stable_and_sensitive():
    assert definition_version(MERGED) == definition_version(MERGED.with_())
    assert definition_version(MERGED) != definition_version(MERGED.with_(grains=("week",)))


def test_preview_coarsest_grain_and_window_fallback(prs):
    m = MERGED.with_(grains=("day", "month"))
    out = G.preview(m, {"pr": prs}, as_of="2026-06-15").collect()
    assert {r.grain for r in out} == {"month"}
    w = MERGED.with_(grains=(), windows=(Window(60),))
    (last,) = {r.bucket_end for r in G.preview(w, {"pr": prs}, as_of="2026-05-10").collect()}
    assert last == T(2026, 5, 11)


def test_stage_counts_find_vanishing_rows(prs):
    got = {r.stage: r.row_count for r in G.stage_counts(MERGED, {"pr": prs}, as_of="2026-07-01").collect()}
    assert got["value:entity"] == 4 and got["value:value_rows"] == 3 and got["final"] == 2


def test_stage_counts_follow_excluded_labels_and_tenants(spark, prs):
    m = MERGED.with_(dimensions=("squad",), mapped=(MappedDim("squad", "author_id", (("alice", "red"), ("carol", "blue"))),))
    count = lambda **kw: {r.stage: r.row_count for r in G.stage_counts(m, {"pr": prs}, as_of="2026-07-01", **kw).collect()}
    got = count()
    assert (got["value:entity"], got["value:filtered"], got["value:value_rows"]) == (4, 4, 2)
    got = count(tenants=["a"])
    assert (got["value:entity"], got["value:value_rows"]) == (2, 1)
    table = spark.createDataFrame([("bob", "green")], "from_value string, label string")
    assert count(mappings={"squad": table})["value:value_rows"] == 1


def test_ic_rows_only_callers_own(spark, prs):
    m = MERGED.with_(dimensions=("author_id",))
    vals = compute_metric(m, {"pr": prs}, as_of="2026-07-01")
    ids = spark.createDataFrame([("a", "me@x", "alice")], "tenant_id string, caller string, key string")
    got = G.ic_rows(vals, ids, ["author_id"]).collect()
    assert [(r.dim_author_id, r.caller) for r in got] == [("alice", "me@x")]


def test_resample_last_and_avg(spark):
    pts = spark.createDataFrame([("t", dt.date(2026, 6, 1), 1.0), ("t", dt.date(2026, 6, 3), 5.0),
                                 ("t", dt.date(2026, 6, 9), 2.0)], "tenant_id string, date date, value double")
    last = {r.date: r.value for r in I.resample(pts, now="2026-06-10T12:00:00", range_name="month",
                                                granularity="weekly", how="last").collect()}
    avg = {r.date: r.value for r in I.resample(pts, now="2026-06-10T12:00:00", range_name="month",
                                               granularity="weekly", how="avg").collect()}
    assert last == {dt.date(2026, 6, 1): 5.0, dt.date(2026, 6, 8): 2.0}
    assert avg[dt.date(2026, 6, 1)] == 3.0


def test_display_value_units(spark):
    pts = spark.createDataFrame([(7200.0,), (None,)], "value double")
    assert [r.display_value for r in I.display_value(pts, "duration").collect()] == [2.0]
    pct = spark.createDataFrame([(0.25,), (30.0,)], "value double")
    assert [r.display_value for r in I.display_value(pct, "percent").collect()] == [25.0, 30.0]


def test_default_range():
    assert I.default_range("2026-06-30") == (dt.date(2026, 4, 1), dt.date(2026, 6, 30))
    with pytest.raises(ValueError):
        I.default_range("2026-06-30", start=dt.date(2026, 7, 1))


def test_step_spine_week_steps_may_precede(spark):
    df = spark.createDataFrame([(T(2026, 6, 10, 9),)], "t timestamp")     # a Wednesday
    sp = G.step_spine(df, "t", horizon_days=3).collect()
    days = sorted(r.step_date for r in sp if r.step == "day")
    weeks = sorted(r.step_date for r in sp if r.step == "week")
    assert days == [dt.date(2026, 6, 7), dt.date(2026, 6, 8), dt.date(2026, 6, 9), dt.date(2026, 6, 10)]
    assert weeks == [dt.date(2026, 6, 1), dt.date(2026, 6, 8)]
    _ = F
