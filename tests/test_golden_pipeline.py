"""Every mart and the shipped metrics on the records of ``golden``, against rows worked out by hand."""

import datetime as dt

import pytest
from golden import raw_df

from tallyspark.operators import entities as C
from tallyspark.operators import marts as D
from tallyspark.operators import staging as S
from tallyspark.plans import catalog as H
from tallyspark.plans.compile import compute_metric

d = dt.date


@pytest.fixture(scope="module")
def raw(spark):
    return raw_df(spark).cache()


@pytest.fixture(scope="module")
def prs(raw):
    return S.stg_pull_requests(raw)


@pytest.fixture(scope="module")
def reviews(raw):
    return S.stg_reviews(raw)


def rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def day(n):
    return d(2025, 3, n) if n > 0 else d(2025, 2, 28 + n)


def test_latest_snapshot_picks_newest_fetch(prs):
    (pr,) = [r for r in prs.collect() if r.pr_node_id == "P-10"]
    assert pr.state == "open" and pr.closed_at is None


def test_pr_activity(prs):
    out = rows(D.mart_pr_activity(prs), ["activity_date", "prs_opened", "prs_merged", "prs_closed"])
    assert out == [(day(3), 2, 0, 0), (day(4), 3, 3, 0), (day(5), 0, 0, 1)]


def test_cycle_time(prs):
    (r,) = D.mart_pr_cycle_time(prs).collect()  # 1.5, 4 and 30 hours
    assert r.activity_date == day(4) and r.prs_merged == 3
    assert (r.median_cycle_time_hours, r.avg_cycle_time_hours, r.p90_cycle_time_hours) == (
        pytest.approx(4.0), pytest.approx(35.5 / 3), pytest.approx(4 + 0.8 * 26))


def test_review_latency(prs, reviews):
    out = rows(D.mart_review_latency(prs, reviews),
               ["activity_date", "prs_first_reviewed", "median_time_to_first_review_hours", "reviews_submitted"])
    assert out == [(day(3), 1, pytest.approx(4.0), 3), (day(4), 1, pytest.approx(0.25), 1)]


def test_first_review_joins_on_repo(prs, reviews):
    got = {r.pr_node_id: (r.first_review_at, r.review_count) for r in C.pr_first_review(prs, reviews).collect()}
    assert got["P-12"] == (None, 0) and got["P-13"] == (None, 0) and got["P-11"][1] == 2 and got["P-14"][1] == 1


def test_change_failure(prs):
    (r,) = D.mart_change_failure(prs).collect()
    assert (r.activity_date, r.prs_merged, r.prs_reverted) == (day(4), 3, 1)
    assert r.change_failure_rate == pytest.approx(1 / 3)


def test_deployments(raw):
    out = rows(D.mart_deployment_frequency(S.stg_releases(raw)),
               ["activity_date", "releases_published", "production_releases"])
    assert out == [(day(4), 1, 1), (day(5), 1, 0)]


def test_review_comments(raw):
    out = rows(D.mart_review_comments(S.stg_review_comments(raw)), ["activity_date", "review_comments_created"])
    assert out == [(day(3), 1), (day(4), 1)]


def test_workflow_runs(raw):
    out = rows(D.mart_workflow_runs(S.stg_workflow_runs(raw)),
               ["activity_date", "runs_started", "runs_completed", "runs_success", "runs_failure"])
    assert out == [(day(4), 1, 1, 1, 0), (day(5), 2, 1, 0, 1)]


def test_ticket_activity(raw):
    out = rows(D.mart_ticket_activity(S.stg_issues(raw), S.stg_linear_issues(raw)),
               ["activity_date", "source", "tickets_created", "tickets_completed", "tickets_canceled"])
    assert out == [
        (day(0), "linear", 1, 0, 0), (day(1), "github", 1, 0, 0), (day(2), "github", 1, 0, 0), (day(2), "linear", 1, 0, 0),
        (day(3), "github", 0, 0, 1), (day(3), "linear", 0, 0, 1), (day(4), "linear", 0, 1, 0)]


def test_ticket_comments(raw):
    out = rows(D.mart_ticket_comments(S.stg_issue_comments(raw), S.stg_linear_comments(raw)),
               ["activity_date", "source", "comments_created"])
    assert out == [(day(2), "github", 1), (day(3), "linear", 1), (day(4), "linear", 1)]


def test_projects(raw):
    out = rows(D.mart_project_activity(S.stg_linear_projects(raw)),
               ["activity_date", "source", "projects_created", "projects_completed", "projects_canceled"])
    assert out == [(day(-1), "linear", 1, 0, 0), (day(4), "linear", 0, 1, 0)]


def test_description_edits(raw):
    out = rows(D.mart_description_edits(S.stg_linear_description_edits(raw)),
               ["activity_date", "source", "description_edits"])
    assert out == [(day(3), "linear", 1)]


def test_fct_tickets_github_canceled_has_completed_at(raw):
    t = {r.ticket_uid: r for r in D.fct_tickets(S.stg_issues(raw), S.stg_linear_issues(raw)).collect()}
    g = t["github:I-2"]
    assert g.status == "canceled" and g.completed_at is not None and g.canceled_at is None
    assert t["linear:L-1"].status == "done" and t["github:I-1"].external_key == "fjord/hull#30"


@pytest.fixture(scope="module")
def entity(prs, reviews):
    return {"pull_request": C.entity_pull_request(prs, reviews)}


def _day_total(df, when):
    return [r for r in df.collect() if r.grain == "day" and r.is_total and r.bucket_start.date() == when]


def test_metric_cycle_time_seconds(entity):
    (r,) = _day_total(compute_metric(H.CYCLE_TIME, entity, as_of="2025-04-01"), day(4))
    assert r.value == pytest.approx(4 * 3600.0)


def test_metric_change_failure_rate(entity):
    (r,) = _day_total(compute_metric(H.CHANGE_FAILURE_RATE, entity, as_of="2025-04-01"), day(4))
    assert (r.value, r.numerator, r.denominator) == (pytest.approx(1 / 3), 1.0, 3.0)


def test_metric_trailing_window(entity):
    out = compute_metric(H.CYCLE_TIME_TRAILING_30D, entity, as_of="2025-04-01")
    (r,) = [x for x in out.collect() if x.bucket_end == dt.datetime(2025, 3, 5)]
    assert r.value == pytest.approx(4 * 3600.0) and r.grain == "rolling_30d"


def test_build_marts_pipeline(spark, raw, tmp_path):
    from tallyspark.operators.pipeline import build_marts, write_marts
    m = build_marts(raw)
    assert rows(m["fct_pr_activity_daily"], ["activity_date", "prs_opened"]) == [(day(3), 2), (day(4), 3), (day(5), 0)]
    assert m["fct_tickets"].count() == 4 and m["pull_request"].count() == 5
    write_marts(m, str(tmp_path / "marts"))
    back = spark.read.parquet(str(tmp_path / "marts" / "fct_change_failure_daily"))
    assert back.count() == 1
