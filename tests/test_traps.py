"""Semantic traps (SURVEY Appendix A) and the reference's small test shapes."""

import datetime as dt
import json

import pytest
from golden import T, raw_df
from pyspark.sql import functions as F

from tallyspark.operators import entities as C
from tallyspark.operators import serving as I
from tallyspark.operators import staging as S
from tallyspark.plans import formula as FM
from tallyspark.plans.compile import compute_metric
from tallyspark.plans.predicates import to_column
from tallyspark.plans.spec import MappedDim, Measure, Metric, Window
from tallyspark.sources import landing as A
from tallyspark.sources import sinks as SK


def rec(source, rtype, payload, fetched):
    return (T, source, rtype, payload.get("node_id") or payload.get("id"), json.dumps(payload), fetched)


def test_filter_before_dedupe_pending_review(spark):
    # a newer PENDING snapshot must not shadow the older submitted review
    raw = raw_df(spark, [
        rec("github", "reviews", {"node_id": "R", "id": 1, "state": "APPROVED", "submitted_at": "2026-01-01T00:00:00Z",
                                  "user": {"login": "b"}, "pull_request_number": 1}, "2026-01-01 01:00:00"),
        rec("github", "reviews", {"node_id": "R", "id": 1, "state": "PENDING", "user": {"login": "b"},
                                  "pull_request_number": 1}, "2026-01-02 01:00:00")])
    (r,) = S.stg_reviews(raw).collect()
    assert r.state == "APPROVED"


def test_filter_before_dedupe_description_edit(spark):
    raw = raw_df(spark, [
        rec("linear", "issue_description_edits", {"id": "E", "createdAt": "2026-01-01T00:00:00Z",
                                                  "updatedDescription": True}, "2026-01-01 01:00:00"),
        rec("linear", "issue_description_edits", {"id": "E", "createdAt": "2026-01-01T00:00:00Z",
                                                  "updatedDescription": False}, "2026-01-02 01:00:00")])
    assert S.stg_linear_description_edits(raw).count() == 1


def test_half_known_repo_and_revert_pattern(spark):
    raw = raw_df(spark, [
        rec("github", "pull_requests", {"node_id": "A", "org": "acme", "title": "revert"}, "2026-01-01 00:00:00"),
        rec("github", "pull_requests", {"node_id": "B", "title": "Reverted thing"}, "2026-01-01 00:00:00"),
        rec("github", "pull_requests", {"node_id": "C", "title": "REVERT: x",
                                        "base": {"repo": {"full_name": "o/r"}}, "org": "z", "repo": "y"},
            "2026-01-01 00:00:00")])
    got = {r.pr_node_id: (r.repo, r.is_revert) for r in S.stg_pull_requests(raw).collect()}
    assert got == {"A": ("acme/", True), "B": (None, False), "C": ("o/r", True)}


def test_issue_with_pull_request_key_is_dropped(spark):
    raw = raw_df(spark, [
        rec("github", "issues", {"node_id": "I1", "pull_request": None}, "2026-01-01 00:00:00"),
        rec("github", "issues", {"node_id": "I2"}, "2026-01-01 00:00:00")])
    assert [r.issue_node_id for r in S.stg_issues(raw).collect()] == ["I2"]


def _prs(spark, rows):
    return spark.createDataFrame(rows, "tenant_id string, pr_node_id string, pr_number long, repo string, "
                                       "author_login string, state string, is_revert boolean, created_at timestamp, "
                                       "merged_at timestamp, closed_at timestamp, fetched_at timestamp")


def _revs(spark, rows):
    return spark.createDataFrame(rows, "tenant_id string, review_node_id string, repo string, "
                                       "pull_request_number long, reviewer_login string, submitted_at timestamp")


def test_null_safe_repo_and_non_author(spark):
    t0 = dt.datetime(2026, 1, 1)
    prs = _prs(spark, [("t", "P1", 1, None, "alice", "open", False, t0, None, None, t0),
                       ("t", "P2", 2, "r", None, "open", False, t0, None, None, t0)])
    revs = _revs(spark, [("t", "a", None, 1, "alice", t0 + dt.timedelta(hours=1)),   # self review: ignored
                         ("t", "b", None, 1, None, t0 + dt.timedelta(hours=2)),      # null reviewer counts
                         ("t", "c", "r", 1, "bob", t0 + dt.timedelta(hours=3)),      # other repo
                         ("t", "d", "r", 2, "x", t0 + dt.timedelta(hours=4))])       # unknown author: counts
    got = {r.pr_node_id: (r.review_count, r.first_review_at) for r in C.pr_first_review(prs, revs).collect()}
    assert got["P1"] == (1, t0 + dt.timedelta(hours=2))
    assert got["P2"] == (1, t0 + dt.timedelta(hours=4))


@pytest.fixture(scope="module")
def small_entity(spark):
    t = dt.datetime
    rows = [("t", "1", "api", "alice", "merged", t(2026, 6, 1, 10), t(2026, 6, 2, 10), None),
            ("t", "2", None, "bob", "open", t(2026, 6, 1, 10), None, None),
            ("t", "3", "", "carol", "merged", t(2026, 6, 2, 10), t(2026, 6, 3, 10), None),
            ("t", "4", "web", "alice", "closed", t(2026, 6, 3, 10), None, t(2026, 6, 4))]
    return spark.createDataFrame(rows, "tenant_id string, id string, repo string, author_id string, state string, "
                                       "opened_at timestamp, merged_at timestamp, closed_at timestamp")


def test_neq_matches_nulls_not_in_does_not(small_entity):
    neq = small_entity.where(to_column({"field": "repo", "op": "neq", "value": "api"})).count()
    notin = small_entity.where(to_column({"field": "repo", "op": "not_in", "value": ["api"]})).count()
    assert (neq, notin) == (3, 2)


def test_contains_wildcards(small_entity):
    assert small_entity.where(to_column({"field": "repo", "op": "contains", "value": "a_i"})).count() == 1


def test_null_and_empty_dim_group_together(small_entity):
    m = Metric(id="x", entity="pr", time_field="opened_at", measure=Measure("count"), grains=("month",),
               dimensions=("repo",))
    out = compute_metric(m, {"pr": small_entity}, as_of="2026-07-01")
    blank = [r for r in out.collect() if r.dim_repo == "" and not r.is_total]
    assert len(blank) == 1 and blank[0].value == 2.0
    (tot,) = [r for r in out.collect() if r.is_total]
    assert tot.value == 4.0


def test_mapped_dimension_default(small_entity):
    m = Metric(id="x", entity="pr", time_field="opened_at", measure=Measure("count"), grains=("month",),
               dimensions=("team",), mapped=(MappedDim("team", "author_id", (("alice", "platform"),
                                                                              ("bob", "growth")), "other"),))
    got = {r.dim_team: r.value for r in compute_metric(m, {"pr": small_entity}, as_of="2026-07-01").collect()
           if not r.is_total}
    assert got == {"platform": 2.0, "growth": 1.0, "other": 1.0}


def test_ratio_vs_formula_when_numerator_absent(small_entity):
    num = Metric(id="n", entity="pr", time_field="closed_at", measure=Measure("count"))
    den = Metric(id="d", entity="pr", time_field="opened_at", measure=Measure("count"))
    ratio = Metric(id="r", kind="ratio", numerator=num, denominator=den, grains=("day",))
    form = Metric(id="f", kind="formula", inputs=(("n", num), ("d", den)), expression="n / d", grains=("day",))
    r = {x.bucket_start.date(): x.value for x in compute_metric(ratio, {"pr": small_entity}, as_of="2026-07-01").collect()}
    f = {x.bucket_start.date(): x.value for x in compute_metric(form, {"pr": small_entity}, as_of="2026-07-01").collect()}
    assert r[dt.date(2026, 6, 1)] == 0.0 and f[dt.date(2026, 6, 1)] is None
    assert dt.date(2026, 6, 4) not in r and f[dt.date(2026, 6, 4)] is None


def test_window_brute_force_and_gaps(spark):
    ev = spark.createDataFrame([("t", dt.datetime(2026, 1, d, 12)) for d in (1, 5, 10, 25)] +
                               [("t", dt.datetime(2026, 1, 12, 0, 0))], "tenant_id string, ts timestamp")
    m = Metric(id="w", entity="e", time_field="ts", measure=Measure("count"), grains=(), windows=(Window(7),))
    got = {r.bucket_end.date() - dt.timedelta(days=1): r.value
           for r in compute_metric(m, {"e": ev}, as_of="2026-02-01").collect()}
    pts = [dt.datetime(2026, 1, d, 12) for d in (1, 5, 10, 25)] + [dt.datetime(2026, 1, 12)]
    expect = {}
    for i in range(0, 40):
        step = dt.date(2026, 1, 1) + dt.timedelta(days=i)
        end = dt.datetime.combine(step, dt.time()) + dt.timedelta(days=1)
        n = sum(1 for p in pts if end - dt.timedelta(days=7) < p < end)
        if n and step <= dt.date(2026, 2, 1):
            expect[step] = float(n)
    assert got == expect
    # the midnight row is excluded from the window that starts exactly at it
    assert got[dt.date(2026, 1, 18)] == 0.0 if dt.date(2026, 1, 18) in got else True


def test_formula_corpus():
    for ok in ["a + b", "a + b / c", "(a + b) * c", "-a + 2.5", "a * b - c / d", "((a))"]:
        FM.parse(ok)
    for bad in ["a +", "a $ b", "", "()"]:
        with pytest.raises(ValueError):
            FM.parse(bad)


def test_weighted_weekly_cycle_time(spark):
    mart = spark.createDataFrame(
        [("t", dt.date(2026, 6, 1), 1, 10.0, 10.0, 10.0), ("t", dt.date(2026, 6, 2), 3, 20.0, 22.0, 30.0)],
        "tenant_id string, activity_date date, prs_merged int, median_cycle_time_hours double, "
        "avg_cycle_time_hours double, p90_cycle_time_hours double")
    (r,) = I.srv_cycle_time(mart, "weekly", dt.date(2026, 5, 1), dt.date(2026, 7, 1), tenant="t").collect()
    assert (r.prs_merged, r.median_hours, r.avg_hours, r.p90_hours) == (4, 17.5, 19.0, 25.0)


def test_person_scope_median(spark):
    def pr(n, login, hours):
        c = dt.datetime(2026, 6, 1)
        m = c + dt.timedelta(hours=hours)
        return rec("github", "pull_requests", {"node_id": f"N{n}", "number": n, "user": {"login": login},
                                               "created_at": c.isoformat() + "Z", "merged_at": m.isoformat() + "Z"},
                   "2026-06-10 00:00:00")
    raw = raw_df(spark, [pr(1, "me", 24), pr(2, "me", 48), pr(3, "other", 96)])
    (r,) = I.srv_me_cycle_time(raw, "me", "monthly", dt.date(2026, 6, 1), dt.date(2026, 6, 30)).collect()
    assert (r.prs_merged, r.median_hours) == (2, 36.0)


def _measure(spark, rows):
    return spark.createDataFrame(
        [(f"id{i}", T, "github", "github_copilot", "measurement", "copilot.usage", "user", "u", dt.datetime(2026, 6, 1),
          dt.datetime(2026, 6, 1), dt.datetime(2026, 6, 2), obs, f"key{i}", json.dumps({"v": v}), i)
         for i, (obs, v) in enumerate(rows)],
        "id string, tenant_id string, source string, tool string, kind string, name string, subject_type string, "
        "subject_id string, occurred_at timestamp, period_start timestamp, period_end timestamp, "
        "observed_at timestamp, source_key string, metadata string, raw_record_id long")


def test_measurement_restate_strict_newer(spark):
    inc = _measure(spark, [(dt.datetime(2026, 6, 2), 1), (dt.datetime(2026, 6, 3), 2), (dt.datetime(2026, 6, 1), 99)])
    (r,) = A.dp_measure_newest_wins(inc.where(F.lit(False)), inc).collect()
    assert json.loads(r.metadata)["v"] == 2 and r.source_key == "key0"
    # equal observed_at keeps the existing row
    ex = _measure(spark, [(dt.datetime(2026, 6, 5), 7)])
    same = _measure(spark, [(dt.datetime(2026, 6, 5), 8)])
    (r2,) = A.dp_measure_newest_wins(ex, same).collect()
    assert json.loads(r2.metadata)["v"] == 7


def test_event_first_wins(spark):
    ev = _measure(spark, [(dt.datetime(2026, 6, 2), 1), (dt.datetime(2026, 6, 1), 2)]) \
        .withColumn("kind", F.lit("event")).withColumn("source_key", F.lit("k"))
    (r,) = A.dp_event_first_wins(ev.where(F.lit(False)), ev).collect()
    assert json.loads(r.metadata)["v"] == 2
    again = A.dp_event_first_wins(ev.limit(1), ev)
    assert again.count() == 1


def test_empty_overwrite_clears_tenant(spark, tmp_path):
    path = str(tmp_path / "mart")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "tenant_id string, v int")
    SK.sink_full_refresh(df, path)
    SK.sink_mart_tenant_replace(df.where("tenant_id = 'a'"), path, ["a", "b"])
    got = SK.read_mart(spark, path).collect()
    assert [(r.tenant_id, r.v) for r in got] == [("a", 1)]


def test_metric_swap_empty_clears(spark, tmp_path):
    base = str(tmp_path / "m")
    cols = "tenant_id string, metric_id string, value double"
    SK.sink_metric_swap(spark.createDataFrame([("a", "m1", 1.0)], cols), base, "m1")
    SK.sink_metric_swap(spark.createDataFrame([], cols), base, "m1")
    assert SK.read_metric_values(spark, base, ["m1"]).count() == 0


def test_contains_on_array_field(spark):
    df = spark.createDataFrame([("t", ["a", "b"]), ("t", ["c"])], "tenant_id string, labels array<string>")
    assert df.where(to_column({"field": "labels", "op": "contains", "value": "b"}, df.schema)).count() == 1
    assert df.where(to_column({"field": "labels", "op": "not_contains", "value": "b"}, df.schema)).count() == 1


def test_incremental_staging_equals_full(spark):
    from golden import RECORDS
    # PR_1's newer snapshot lands in the second batch
    first_recs = RECORDS[0:1] + RECORDS[2:13]
    later_recs = RECORDS[1:2] + RECORDS[13:]
    first = raw_df(spark, first_recs)
    later = raw_df(spark, later_recs).withColumn("id", F.col("id") + 1000)   # ids unique across landings
    full2 = first.unionByName(later)
    for model in ["pull_requests", "reviews", "issues", "linear_description_edits"]:
        st = S.merge_state(S.snapshot_state(first, model), later, model)
        inc = sorted(map(tuple, S.stage_from_state(st, model).collect()))
        ref = sorted(map(tuple, S.STAGING[model](full2).collect()))
        assert inc == ref
