"""Daily marts per tenant.

Multi-branch ``union all`` models of the reference become one scan that
emits an array of (day, flags) per row and explodes it; the sums then run as
ordinary partial aggregation keyed by (tenant_id, activity_date[, source]).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.pgcompat import utc_date
from tallyspark.operators.ranks import percentiles


def scope(df: DataFrame, tenants=None) -> DataFrame:
    """Optional tenant scope (incremental rebuild of some tenants)."""
    if tenants is None:
        return df
    if isinstance(tenants, str):
        tenants = [tenants]
    return df.where(F.col("tenant_id").isin(list(tenants)))


def _explode(df: DataFrame, keys: list[str], items: list[tuple[Column, Column, dict]],
             measures: list[str]) -> DataFrame:
    """Each row -> its lifecycle events (keys, e: struct(activity_date, flags)).

    items: (day column, condition, {measure: value}) — one per event kind.
    """
    arr = F.array(*[
        F.when(cond & day.isNotNull(),
               F.struct(day.alias("activity_date"),
                        *[F.lit(vals.get(m, 0)).alias(m) if not isinstance(vals.get(m, 0), Column)
                          else vals[m].alias(m) for m in measures]))
        for day, cond, vals in items])
    return df.select(*keys, F.explode(arr).alias("e")).where(F.col("e").isNotNull())


def _sum_events(ev: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    return (ev.groupBy(*keys, F.col("e.activity_date").alias("activity_date"))
            .agg(*[F.sum(f"e.{m}").cast("int").alias(m) for m in measures]))


def _events(df: DataFrame, keys: list[str], items: list[tuple[Column, Column, dict]],
            measures: list[str]) -> DataFrame:
    """Explode each row into its lifecycle events and sum the flags per day."""
    return _sum_events(_explode(df, keys, items, measures), keys, measures)


def mart_pr_activity(prs: DataFrame, tenants=None) -> DataFrame:
    """Opened / merged / closed-without-merge per tenant-day."""
    p = scope(prs, tenants)
    t = F.lit(True)
    return _events(p, ["tenant_id"], [
        (utc_date(F.col("created_at")), t, {"prs_opened": 1}),
        (utc_date(F.col("merged_at")), t, {"prs_merged": 1}),
        (utc_date(F.col("closed_at")), F.col("merged_at").isNull(), {"prs_closed": 1}),
    ], ["prs_opened", "prs_merged", "prs_closed"])


def mart_pr_cycle_time(prs: DataFrame, tenants=None) -> DataFrame:
    """Merged PRs per day with exact median / avg / p90 hours."""
    m = scope(prs, tenants).where(
        F.col("merged_at").isNotNull() & F.col("cycle_time_hours").isNotNull()
        & (F.col("cycle_time_hours") >= 0))
    day = m.select("tenant_id", utc_date(F.col("merged_at")).alias("activity_date"), "cycle_time_hours")
    return percentiles(day, ["tenant_id", "activity_date"], "cycle_time_hours", [0.5, 0.9]).select(
        "tenant_id", "activity_date", F.col("n").cast("int").alias("prs_merged"),
        F.col("p0").alias("median_cycle_time_hours"), F.col("mean").alias("avg_cycle_time_hours"), F.col("p1").alias("p90_cycle_time_hours"))


def mart_review_latency(prs: DataFrame, reviews: DataFrame, tenants=None) -> DataFrame:
    """D3: PRs first reviewed per day (median hours) full-outer reviews submitted."""
    from tallyspark.operators.entities import first_review_join
    p = scope(prs, tenants).where(F.col("created_at").isNotNull())
    # one pass over the reviews: (tenant, repo, PR, reviewer, day) -> earliest
    # submission and review count feeds both the first-review join and the
    # daily count (the two branches reuse the same exchange)
    per_day = (scope(reviews, tenants)
               .groupBy("tenant_id", "repo", "pull_request_number", "reviewer_login",
                        utc_date(F.col("submitted_at")).alias("_d"))
               .agg(F.min("submitted_at").alias("submitted_at"), F.count(F.lit(1)).alias("_rows")))
    r = per_day.select("tenant_id", "repo", "pull_request_number", "reviewer_login", "submitted_at",
                       F.col("_rows").alias("review_node_id"))
    fr = first_review_join(p, r, "inner", ["created_at"])
    hours = ((F.unix_micros("first_review_at") - F.unix_micros("created_at")) / F.lit(3.6e9))
    fr = fr.select("tenant_id", "first_review_at", hours.alias("h")).where(
        F.col("first_review_at").isNotNull() & F.col("h").isNotNull() & (F.col("h") >= 0))
    day = fr.select("tenant_id", utc_date(F.col("first_review_at")).alias("activity_date"), "h")
    first_daily = percentiles(day, ["tenant_id", "activity_date"], "h", [0.5]).select(
        "tenant_id", "activity_date", F.col("n").cast("int").alias("prs_first_reviewed"), F.col("p0").alias("median_time_to_first_review_hours"))
    reviews_daily = (per_day.where(F.col("_d").isNotNull())
                     .groupBy("tenant_id", F.col("_d").alias("activity_date"))
                     .agg(F.sum("_rows").cast("int").alias("reviews_submitted")))
    j = first_daily.join(reviews_daily, ["tenant_id", "activity_date"], "full_outer")
    return j.select("tenant_id", "activity_date",
                    F.coalesce("prs_first_reviewed", F.lit(0)).cast("int").alias("prs_first_reviewed"),
                    "median_time_to_first_review_hours",
                    F.coalesce("reviews_submitted", F.lit(0)).cast("int").alias("reviews_submitted"))


def mart_change_failure(prs: DataFrame, tenants=None) -> DataFrame:
    """Merges, reverts and their rate per day."""
    m = scope(prs, tenants).where(F.col("merged_at").isNotNull())
    agg = (m.groupBy("tenant_id", utc_date(F.col("merged_at")).alias("activity_date"))
           .agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("is_revert")).alias("_r")))
    return agg.select("tenant_id", "activity_date",
                      F.col("_n").cast("int").alias("prs_merged"),
                      F.col("_r").cast("int").alias("prs_reverted"),
                      F.try_divide(F.col("_r").cast("double"), F.col("_n").cast("double"))
                      .alias("change_failure_rate"))


def mart_deployment_frequency(releases: DataFrame, tenants=None) -> DataFrame:
    """Published non-draft releases; production = not prerelease."""
    p = scope(releases, tenants).where(~F.col("is_draft") & F.col("published_at").isNotNull())
    return (p.groupBy("tenant_id", utc_date(F.col("published_at")).alias("activity_date"))
            .agg(F.count(F.lit(1)).cast("int").alias("releases_published"),
                 F.count_if(~F.col("is_prerelease")).cast("int").alias("production_releases")))


def mart_review_comments(comments: DataFrame, tenants=None) -> DataFrame:
    """Review comments created per day."""
    c = scope(comments, tenants).where(F.col("created_at").isNotNull())
    return (c.groupBy("tenant_id", utc_date(F.col("created_at")).alias("activity_date"))
            .agg(F.count(F.lit(1)).cast("int").alias("review_comments_created")))


FAILURE_CONCLUSIONS = ["failure", "timed_out", "cancelled"]


def mart_workflow_runs(runs: DataFrame, tenants=None) -> DataFrame:
    """Started by created day; completed / success / failure by updated day."""
    r = scope(runs, tenants)
    concl = F.lower(F.coalesce(F.col("conclusion"), F.lit("")))
    done = F.lower(F.coalesce(F.col("run_status"), F.lit(""))) == "completed"
    return _events(r, ["tenant_id"], [
        (utc_date(F.col("created_at")), F.lit(True), {"runs_started": 1}),
        (utc_date(F.col("updated_at")), done,
         {"runs_completed": 1,
          "runs_success": F.when(concl == "success", 1).otherwise(0),
          "runs_failure": F.when(concl.isin(FAILURE_CONCLUSIONS), 1).otherwise(0)}),
    ], ["runs_started", "runs_completed", "runs_success", "runs_failure"])


TICKET_MEASURES = ["tickets_created", "tickets_completed", "tickets_canceled"]


def mart_ticket_activity(gh_issues: DataFrame, linear_issues: DataFrame, tenants=None) -> DataFrame:
    """Created / completed / canceled tickets per tenant, day and source.

    A GitHub issue closed as ``not_planned`` counts as canceled.
    """
    np_ = F.coalesce(F.col("state_reason"), F.lit("")) == "not_planned"
    keys = ["tenant_id", "source"]
    gh = _explode(scope(gh_issues, tenants).withColumn("source", F.lit("github")), keys, [
        (utc_date(F.col("created_at")), F.lit(True), {"tickets_created": 1}),
        (utc_date(F.col("closed_at")), ~np_, {"tickets_completed": 1}),
        (utc_date(F.col("closed_at")), np_, {"tickets_canceled": 1}),
    ], TICKET_MEASURES)
    ln = _explode(scope(linear_issues, tenants).withColumn("source", F.lit("linear")), keys, [
        (utc_date(F.col("created_at")), F.lit(True), {"tickets_created": 1}),
        (utc_date(F.col("completed_at")), F.lit(True), {"tickets_completed": 1}),
        (utc_date(F.col("canceled_at")), F.lit(True), {"tickets_canceled": 1}),
    ], TICKET_MEASURES)
    # both trackers' events in one aggregation (one shuffle)
    return _sum_events(gh.unionByName(ln), keys, TICKET_MEASURES).select(
        "tenant_id", "activity_date", "source", *TICKET_MEASURES)


def mart_ticket_comments(gh_comments: DataFrame, linear_comments: DataFrame, tenants=None) -> DataFrame:
    """Comments per tenant, day and source."""
    u = (scope(gh_comments, tenants).select("tenant_id", F.lit("github").alias("source"), "created_at")
         .unionByName(scope(linear_comments, tenants)
                      .select("tenant_id", F.lit("linear").alias("source"), "created_at"))
         .where(F.col("created_at").isNotNull()))
    return (u.groupBy("tenant_id", utc_date(F.col("created_at")).alias("activity_date"), "source")
            .agg(F.count(F.lit(1)).cast("int").alias("comments_created")))


def mart_project_activity(projects: DataFrame, tenants=None) -> DataFrame:
    """Projects created / completed / canceled per tenant-day."""
    ms = ["projects_created", "projects_completed", "projects_canceled"]
    t = F.lit(True)
    out = _events(scope(projects, tenants).withColumn("source", F.lit("linear")), ["tenant_id", "source"], [
        (utc_date(F.col("created_at")), t, {"projects_created": 1}),
        (utc_date(F.col("completed_at")), t, {"projects_completed": 1}),
        (utc_date(F.col("canceled_at")), t, {"projects_canceled": 1}),
    ], ms)
    return out.select("tenant_id", "activity_date", "source", *ms)


def mart_description_edits(edits: DataFrame, tenants=None) -> DataFrame:
    """Description edits per tenant-day."""
    e = scope(edits, tenants).where(F.col("edited_at").isNotNull())
    return (e.groupBy("tenant_id", utc_date(F.col("edited_at")).alias("activity_date"))
            .agg(F.count(F.lit(1)).cast("int").alias("description_edits"))
            .select("tenant_id", "activity_date", F.lit("linear").alias("source"), "description_edits"))


def fct_tickets(gh_issues: DataFrame, linear_issues: DataFrame, tenants=None) -> DataFrame:
    """Both trackers in one ticket schema; ``ticket_uid = source:external_id``."""
    g = scope(gh_issues, tenants)
    gh = g.select(
        "tenant_id", F.lit("github").alias("source"), F.col("issue_node_id").alias("external_id"),
        F.concat_ws("", F.col("repo"), F.lit("#"), F.col("issue_number").cast("string")).alias("external_key"),
        "title", F.col("html_url").alias("url"), F.col("state").alias("raw_state"),
        F.when(F.col("state") == "open", "open")
         .when((F.col("state") == "closed") & (F.col("state_reason") == "not_planned"), "canceled")
         .when(F.col("state") == "closed", "done").otherwise("open").alias("status"),
        F.col("author_login").alias("creator"), F.col("assignee_login").alias("assignee"),
        "created_at", "updated_at", F.col("closed_at").alias("completed_at"),
        F.lit(None).cast("timestamp").alias("canceled_at"), F.lit(None).cast("string").alias("team"),
        F.lit(None).cast("int").alias("priority"), F.lit(None).cast("decimal(18,4)").alias("estimate"))
    li = scope(linear_issues, tenants)
    ln = li.select(
        "tenant_id", F.lit("linear").alias("source"), F.col("issue_id").alias("external_id"),
        F.col("identifier").alias("external_key"), "title", "url",
        F.coalesce("state_name", "state_type").alias("raw_state"),
        F.when(F.col("state_type") == "started", "in_progress")
         .when(F.col("state_type") == "completed", "done")
         .when(F.col("state_type") == "canceled", "canceled").otherwise("open").alias("status"),
        "creator", "assignee", "created_at", "updated_at", "completed_at", "canceled_at",
        F.col("team_key").alias("team"), "priority", "estimate")
    u = gh.unionByName(ln)
    return u.select("tenant_id", F.concat(F.col("source"), F.lit(":"), F.col("external_id")).alias("ticket_uid"),
                    *[c for c in u.columns if c != "tenant_id"])
