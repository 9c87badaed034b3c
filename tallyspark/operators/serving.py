"""Serving queries over marts, metric values and raw records.

Every function serves one tenant when ``tenant`` is given, or all tenants at
once (tenant_id becomes a key column) — the same plan either way.
Person-scope functions likewise serve one login or every author.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.jsonx import with_json
from tallyspark.functions.pgcompat import epoch_seconds, org_repo, revert_title, utc_date
from tallyspark.operators.ranks import percentiles
from tallyspark.operators.snapshot import latest_landed

TRUNC = {"daily": "day", "weekly": "week", "monthly": "month"}
RANGES = {"day": 1, "week": 7, "month": 30, "quarter": 90, "half_year": 182, "year": 365}


def default_range(today, start=None, end=None, days: int = 90) -> tuple[dt.date, dt.date]:
    """End defaults to today, start to end - 90 days; start <= end required."""
    if isinstance(today, str):
        today = dt.date.fromisoformat(today)
    end = end or today
    start = start or (end - dt.timedelta(days=days))
    if start > end:
        raise ValueError("start must be on or before end")
    return start, end


def _period(col: Column, granularity: str) -> Column:
    return F.date_trunc(TRUNC[granularity], col).cast("date")


def _scope(df: DataFrame, tenant) -> tuple[DataFrame, list[str]]:
    if tenant is None:
        return df, ["tenant_id"]
    return df.where(F.col("tenant_id") == tenant), []


def _rebucket(mart: DataFrame, sums: list[str], granularity, start, end, tenant, extra=()) -> DataFrame:
    df, keys = _scope(mart, tenant)
    df = df.where((F.col("activity_date") >= F.lit(start)) & (F.col("activity_date") <= F.lit(end)))
    aggs = [F.coalesce(F.sum(m), F.lit(0)).cast("int").alias(m) for m in sums] + list(extra)
    return (df.groupBy(*keys, _period(F.col("activity_date"), granularity).alias("period_start"))
            .agg(*aggs).orderBy(*keys, "period_start"))


def srv_pr_activity(mart, granularity="weekly", start=None, end=None, tenant=None):
    """I1."""
    out = _rebucket(mart, ["prs_opened", "prs_merged", "prs_closed"], granularity, start, end, tenant)
    return out.withColumnsRenamed({"prs_opened": "opened", "prs_merged": "merged", "prs_closed": "closed"})


def srv_deployment_frequency(mart, granularity="weekly", start=None, end=None, tenant=None):
    """I2."""
    return _rebucket(mart, ["releases_published", "production_releases"], granularity, start, end, tenant)


def _wmean(x: str, w: str) -> Column:
    return F.try_divide(F.sum(F.col(x) * F.col(w)), F.nullif(F.sum(w), F.lit(0))).cast("double")


def srv_cycle_time(mart, granularity="weekly", start=None, end=None, tenant=None):
    """Merge-weighted mean of the daily median / avg / p90."""
    return _rebucket(mart, ["prs_merged"], granularity, start, end, tenant, extra=[
        _wmean("median_cycle_time_hours", "prs_merged").alias("median_hours"),
        _wmean("avg_cycle_time_hours", "prs_merged").alias("avg_hours"),
        _wmean("p90_cycle_time_hours", "prs_merged").alias("p90_hours")])


def srv_review_latency(mart, granularity="weekly", start=None, end=None, tenant=None):
    """I4: weighted median; the weight counts only days that have a median."""
    med, n = F.col("median_time_to_first_review_hours"), F.col("prs_first_reviewed")
    wmed = F.try_divide(F.sum(med * n),
                        F.nullif(F.sum(F.when(med.isNull(), 0).otherwise(n)), F.lit(0))).cast("double")
    return _rebucket(mart, ["prs_first_reviewed", "reviews_submitted"], granularity, start, end, tenant,
                     extra=[wmed.alias("median_hours_to_first_review")])


def srv_change_failure(mart, granularity="weekly", start=None, end=None, tenant=None):
    """I5."""
    rate = F.try_divide(F.sum("prs_reverted").cast("double"), F.nullif(F.sum("prs_merged"), F.lit(0)))
    return _rebucket(mart, ["prs_merged", "prs_reverted"], granularity, start, end, tenant,
                     extra=[rate.cast("double").alias("change_failure_rate")])


def srv_review_comments(mart, granularity="weekly", start=None, end=None, tenant=None):
    """I6."""
    return _rebucket(mart, ["review_comments_created"], granularity, start, end, tenant)


def srv_workflow_runs(mart, granularity="weekly", start=None, end=None, tenant=None):
    """I7."""
    return _rebucket(mart, ["runs_started", "runs_completed", "runs_success", "runs_failure"],
                     granularity, start, end, tenant)


def srv_ticket_activity(mart, granularity="weekly", start=None, end=None, tenant=None):
    """I8: summed over all sources."""
    return _rebucket(mart, ["tickets_created", "tickets_completed", "tickets_canceled"],
                     granularity, start, end, tenant)


def srv_ticket_comments(mart, granularity="weekly", start=None, end=None, tenant=None):
    """I9."""
    return _rebucket(mart, ["comments_created"], granularity, start, end, tenant)


def srv_project_activity(mart, granularity="weekly", start=None, end=None, tenant=None):
    """I10."""
    return _rebucket(mart, ["projects_created", "projects_completed", "projects_canceled"],
                     granularity, start, end, tenant)


def srv_description_edits(mart, granularity="weekly", start=None, end=None, tenant=None):
    """I11."""
    return _rebucket(mart, ["description_edits"], granularity, start, end, tenant)


def _metric_values(values, metric_id, granularity, start, end, tenant, total: Column):
    df, keys = _scope(values, tenant)
    ps = F.to_date("bucket_start")
    return (df.where((F.col("metric_id") == metric_id) & (F.col("grain") == TRUNC[granularity]) & total
                     & (ps >= F.lit(start)) & (ps <= F.lit(end)))
            .select(*keys, ps.alias("period_start"), "value").orderBy(*keys, "period_start"))


def srv_metric_values(values, metric_id, granularity="weekly", start=None, end=None, tenant=None):
    """One metric, one grain, tenant totals; never re-aggregates."""
    return _metric_values(values, metric_id, granularity, start, end, tenant, F.col("is_total"))


def srv_metric_values_by_dims(values, metric_id, granularity="weekly", start=None, end=None, tenant=None):
    """Legacy totals = rows whose dims are all ''."""
    dims = [c for c in values.columns if c in ("dim_repo", "dim_team")]
    cond = F.lit(True)
    for d in dims:
        cond = cond & (F.col(d) == "")
    return _metric_values(values, metric_id, granularity, start, end, tenant, cond)


# --- person scope: straight from raw records -----------------------------------------
P = "payload"


def my_prs(raw, login=None, tenant=None) -> DataFrame:
    """Latest snapshot of each PR *among the author's own rows* (author filter
    precedes the dedupe). Without ``login`` every author is served at once:
    the dedupe key then includes the author."""
    df, _ = _scope(raw, tenant)
    r = df.where((F.col("source") == "github") & (F.col("resource_type") == "pull_requests"))

    def pre(g):
        ok = g("node_id").isNotNull() & g("user.login").isNotNull()
        if login is not None:
            ok = ok & (g("user.login") == login)
        return [F.col("tenant_id"), g("user.login").alias("author_login"), g("node_id").alias("pr_node_id"),
                F.col("fetched_at"), F.col("id"), ok.alias("_ok")]
    s = latest_landed(r, with_json(r, P, pre), ["tenant_id", "author_login", "pr_node_id"], "_ok")

    def build(g):
        created, merged = g("created_at").cast("timestamp"), g("merged_at").cast("timestamp")
        return [F.col("tenant_id"), F.col("author_login"), F.col("pr_node_id"),
                g("number").cast("int").alias("pr_number"), created.alias("created_at"),
                g("closed_at").cast("timestamp").alias("closed_at"), merged.alias("merged_at"),
                F.coalesce(g("base.repo.full_name"), org_repo(g("org"), g("repo"))).alias("repo"),
                revert_title(g("title")).alias("is_revert"),
                F.when(merged.isNotNull() & created.isNotNull(),
                       epoch_seconds(merged, created) / F.lit(3600.0)).alias("cycle_time_hours")]
    return with_json(s, P, build)


def _in_range(d: Column, start, end) -> Column:
    return (d >= F.lit(start)) & (d <= F.lit(end))


def srv_me_pr_activity(raw, login=None, granularity="weekly", start=None, end=None, tenant=None):
    """I14."""
    prs = my_prs(raw, login, tenant)
    arr = F.array(
        F.when(F.col("created_at").isNotNull(), F.struct(utc_date(F.col("created_at")).alias("d"),
               F.lit(1).alias("o"), F.lit(0).alias("m"), F.lit(0).alias("c"))),
        F.when(F.col("merged_at").isNotNull(), F.struct(utc_date(F.col("merged_at")).alias("d"),
               F.lit(0).alias("o"), F.lit(1).alias("m"), F.lit(0).alias("c"))),
        F.when(F.col("closed_at").isNotNull() & F.col("merged_at").isNull(),
               F.struct(utc_date(F.col("closed_at")).alias("d"), F.lit(0).alias("o"), F.lit(0).alias("m"),
                        F.lit(1).alias("c"))))
    ev = prs.select("tenant_id", "author_login", F.explode(arr).alias("e")).where(
        F.col("e").isNotNull() & _in_range(F.col("e.d"), start, end))
    return (ev.groupBy("tenant_id", "author_login", _period(F.col("e.d"), granularity).alias("period_start"))
            .agg(F.sum("e.o").cast("int").alias("opened"), F.sum("e.m").cast("int").alias("merged"),
                 F.sum("e.c").cast("int").alias("closed")))


def srv_me_cycle_time(raw, login=None, granularity="weekly", start=None, end=None, tenant=None):
    """True per-period percentiles from PR rows."""
    prs = my_prs(raw, login, tenant)
    d = utc_date(F.col("merged_at"))
    m = prs.where(F.col("merged_at").isNotNull() & F.col("cycle_time_hours").isNotNull()
                  & (F.col("cycle_time_hours") >= 0) & _in_range(d, start, end))
    m = m.select("tenant_id", "author_login", _period(d, granularity).alias("period_start"), "cycle_time_hours")
    return percentiles(m, ["tenant_id", "author_login", "period_start"], "cycle_time_hours", [0.5, 0.9]).select(
        "tenant_id", "author_login", "period_start", F.col("n").cast("int").alias("prs_merged"),
        F.col("p0").alias("median_hours"), F.col("mean").alias("avg_hours"), F.col("p1").alias("p90_hours"))


def _latest_reviews(raw, tenant=None):
    df, _ = _scope(raw, tenant)
    r = df.where((F.col("source") == "github") & (F.col("resource_type") == "reviews"))
    rows = with_json(r, P, lambda g: [
        F.col("tenant_id"), g("node_id").alias("_k"), F.col("fetched_at"), F.col("id"),
        (g("node_id").isNotNull() & g("submitted_at").isNotNull()
         & (F.coalesce(g("state"), F.lit("")) != "PENDING")).alias("_ok")])
    s = latest_landed(r, rows, ["tenant_id", "_k"], "_ok")
    return with_json(s, P, lambda g: [
        F.col("tenant_id"), g("submitted_at").cast("timestamp").alias("submitted_at"),
        g("user.login").alias("reviewer_login"), g("pull_request_number").cast("int").alias("pull_request_number"),
        org_repo(g("org"), g("repo")).alias("r_repo")])


def srv_me_review_latency(raw, login=None, granularity="weekly", start=None, end=None, tenant=None):
    """I16: my PRs; reviews_submitted = non-self reviews left on my PRs."""
    prs = my_prs(raw, login, tenant).where(F.col("created_at").isNotNull())
    rv = _latest_reviews(raw, tenant).withColumnRenamed("tenant_id", "_rt")
    cond = ((prs.tenant_id == rv._rt) & (prs.pr_number == rv.pull_request_number)
            & rv.r_repo.eqNullSafe(prs.repo)
            & ~rv.reviewer_login.eqNullSafe(prs.author_login))
    pr_reviews = prs.join(rv, cond).select("tenant_id", "author_login", "pr_node_id", "created_at", "submitted_at")
    first = (pr_reviews.groupBy("tenant_id", "author_login", "pr_node_id", "created_at")
             .agg(F.min("submitted_at").alias("first_at"))
             .withColumn("h", epoch_seconds(F.col("first_at"), F.col("created_at")) / F.lit(3600.0)))
    fd = utc_date(F.col("first_at"))
    fp = first.where(F.col("h").isNotNull() & (F.col("h") >= 0) & _in_range(fd, start, end)).select(
        "tenant_id", "author_login", _period(fd, granularity).alias("period_start"), "h")
    fp = percentiles(fp, ["tenant_id", "author_login", "period_start"], "h", [0.5]).select(
        "tenant_id", "author_login", "period_start", F.col("n").cast("int").alias("prs_first_reviewed"),
        F.col("p0").alias("median_hours_to_first_review"))
    sd = utc_date(F.col("submitted_at"))
    rp = (pr_reviews.where(_in_range(sd, start, end))
          .groupBy("tenant_id", "author_login", _period(sd, granularity).alias("period_start"))
          .agg(F.count(F.lit(1)).cast("int").alias("reviews_submitted")))
    j = fp.join(rp, ["tenant_id", "author_login", "period_start"], "full_outer")
    return j.select("tenant_id", "author_login", "period_start",
                    F.coalesce("prs_first_reviewed", F.lit(0)).cast("int").alias("prs_first_reviewed"),
                    "median_hours_to_first_review",
                    F.coalesce("reviews_submitted", F.lit(0)).cast("int").alias("reviews_submitted"))


def srv_me_change_failure(raw, login=None, granularity="weekly", start=None, end=None, tenant=None):
    """I17."""
    prs = my_prs(raw, login, tenant)
    d = utc_date(F.col("merged_at"))
    m = prs.where(F.col("merged_at").isNotNull() & _in_range(d, start, end))
    agg = (m.groupBy("tenant_id", "author_login", _period(d, granularity).alias("period_start"))
           .agg(F.count(F.lit(1)).alias("_n"), F.count_if("is_revert").alias("_r")))
    return agg.select("tenant_id", "author_login", "period_start", F.col("_n").cast("int").alias("prs_merged"),
                      F.col("_r").cast("int").alias("prs_reverted"),
                      F.try_divide(F.col("_r").cast("double"), F.col("_n").cast("double")).alias("change_failure_rate"))


def srv_resolve_login(identities: DataFrame, callers: DataFrame | None = None) -> DataFrame:
    """Caller -> their GitHub login per tenant; unlinked callers get no row.

    identities: (tenant_id, user_id, provider, external_login). The smallest
    login wins when a caller holds several (the reference takes any one).
    """
    ids = identities.where((F.col("provider") == "github") & F.col("user_id").isNotNull()
                           & F.col("external_login").isNotNull())
    if callers is not None:
        ids = ids.join(callers.select("tenant_id", "user_id").distinct(), ["tenant_id", "user_id"], "left_semi")
    return ids.groupBy("tenant_id", "user_id").agg(F.min("external_login").alias("login"))


def resample(points: DataFrame, *, now, range_name: str = "quarter", granularity: str = "weekly",
             how: str = "sum", keys=("tenant_id",), date_col: str = "date", value_col: str = "value") -> DataFrame:
    """Range filter (start floored to midnight, end = now) + bucket + combine."""
    if isinstance(now, str):
        now = dt.datetime.fromisoformat(now)
    start = dt.datetime.combine((now - dt.timedelta(days=RANGES[range_name])).date(), dt.time())
    t = F.col(date_col).cast("timestamp")
    df = points.where((t >= F.lit(start)) & (t <= F.lit(now)))
    v = F.col(value_col)
    agg = {"sum": F.sum(v), "avg": F.avg(v), "max": F.max(v), "last": F.max_by(v, t)}[how]
    return (df.groupBy(*keys, _period(t, granularity).alias("date"))
            .agg(F.coalesce(agg.cast("double"), F.lit(0.0)).alias("value")))


def display_value(points: DataFrame, unit: str, value_col: str = "value") -> DataFrame:
    """Durations (seconds) shown in hours, ratios <= 1 as percent; NULL points dropped."""
    v = F.col(value_col)
    if unit == "duration":
        shown = v / F.lit(3600.0)
    elif unit == "percent":
        shown = F.when(v <= 1, v * 100).otherwise(v)
    else:
        shown = v
    return points.where(v.isNotNull()).withColumn("display_value", shown.cast("double"))
