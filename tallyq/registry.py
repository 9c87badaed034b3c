"""Query registry: binds library operators to the driver's test tables.

``QUERIES[key](spark, sf_dir) -> DataFrame`` and ``ORACLE[key] -> DuckDB SQL``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyq import oracle as O
from tallyspark import fixtures as FX
from tallyspark.operators import staging as S
from tallyspark.operators.snapshot import latest_snapshot

QUERIES: dict = {}
ORACLE: dict = {}


def q(key, sql=None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql() if callable(sql) else sql
        return fn
    return deco


# --- B0-B11 staging ------------------------------------------------------------
@q("latest_snapshot", lambda: f"""
select * from (
  select event_id as id, 't' || cast(user_id % 4 as varchar) as tenant_id, 'github' as source,
         event_type as resource_type, json_extract_string(props, '$.k') as source_id, props as payload,
         ts as fetched_at, cast(event_id // 500 as bigint) as run_id
  from events) r
qualify row_number() over (partition by tenant_id, resource_type, source_id
                           order by fetched_at desc, id desc) = 1""")
def _b0(spark, sf):
    return latest_snapshot(FX.fx_raw(spark, sf), ["tenant_id", "resource_type", "source_id"])


_STG_KEYS = {
    "stg_pull_requests": "pull_requests",
    "stg_reviews": "reviews",
    "stg_releases": "releases",
    "stg_issues": "issues",
    "stg_issue_comments": "issue_comments",
    "stg_review_comments": "pull_request_review_comments",
    "stg_workflow_runs": "workflow_runs",
    "stg_linear_issues": "linear_issues",
    "stg_linear_comments": "linear_comments",
    "stg_linear_projects": "linear_projects",
    "stg_linear_description_edits": "linear_description_edits",
}


def _stg_query(resource):
    def run(spark, sf):
        return S.STAGING[resource](FX.fx_raw_resource(spark, sf, resource))
    return run


for _key, _res in _STG_KEYS.items():
    QUERIES[_key] = _stg_query(_res)
    ORACLE[_key] = O.stg(_res)


def raw_stage(spark, sf, resource):
    """Staging model over the landed fixture for ``resource``."""
    return S.STAGING[resource](FX.fx_raw_resource(spark, sf, resource))


_ = F  # re-exported helpers for later sections


# --- C1-C4 entities, D1-D12 marts ---------------------------------------------------
from tallyspark.operators import entities as C  # noqa: E402
from tallyspark.operators import marts as D  # noqa: E402


def prs_reviews(spark, sf):
    return FX.fx_pr(spark, sf), FX.fx_review(spark, sf)


def pr_entity(spark, sf):
    return C.entity_pull_request(*prs_reviews(spark, sf))


q("pr_first_review", O.FIRST_REVIEW)(lambda s, sf: C.pr_first_review(*prs_reviews(s, sf)))
q("entity_pull_request", O.PR_ENTITY)(pr_entity)
q("entity_release", f"""
select tenant_id, release_node_id as id, repo, author_login as author_id, tag_name, release_name,
  is_draft, is_prerelease, created_at, published_at, fetched_at from ({O.stg('releases')}) s""")(
    lambda s, sf: C.entity_release(raw_stage(s, sf, "releases")))
q("entity_review", f"""
select tenant_id, review_node_id as id, review_id, state, submitted_at, reviewer_login as reviewer_id,
  pull_request_number, repo, fetched_at from ({O.stg('reviews')}) s""")(
    lambda s, sf: C.entity_review(raw_stage(s, sf, "reviews")))

q("mart_pr_activity", f"""
with prs as ({O.FX_PR}), a as (
  select tenant_id, cast(created_at as date) as d, 1 as o, 0 as m, 0 as c from prs where created_at is not null
  union all select tenant_id, cast(merged_at as date), 0, 1, 0 from prs where merged_at is not null
  union all select tenant_id, cast(closed_at as date), 0, 0, 1 from prs where closed_at is not null and merged_at is null)
select tenant_id, d as activity_date, cast(sum(o) as integer) as prs_opened,
  cast(sum(m) as integer) as prs_merged, cast(sum(c) as integer) as prs_closed
from a group by tenant_id, d""")(lambda s, sf: D.mart_pr_activity(FX.fx_pr(s, sf)))

q("mart_pr_cycle_time", f"""
select tenant_id, cast(merged_at as date) as activity_date, cast(count(*) as integer) as prs_merged,
  quantile_cont(cycle_time_hours, 0.5) as median_cycle_time_hours,
  avg(cycle_time_hours) as avg_cycle_time_hours,
  quantile_cont(cycle_time_hours, 0.9) as p90_cycle_time_hours
from ({O.FX_PR}) p
where merged_at is not null and cycle_time_hours is not null and cycle_time_hours >= 0
group by tenant_id, cast(merged_at as date)""")(lambda s, sf: D.mart_pr_cycle_time(FX.fx_pr(s, sf)))

q("mart_review_latency", f"""
with prs as ({O.FX_PR}), reviews as ({O.FX_REVIEW}),
fr as (
  select p.tenant_id, p.pr_node_id, p.created_at, min(r.submitted_at) as first_reviewed_at,
    (epoch_us(min(r.submitted_at)) - epoch_us(p.created_at)) / 3.6e9 as h
  from prs p join reviews r on {O.REVIEW_MATCH}
  where p.created_at is not null
  group by p.tenant_id, p.pr_node_id, p.created_at),
fd as (
  select tenant_id, cast(first_reviewed_at as date) as activity_date, cast(count(*) as integer) as n,
    quantile_cont(h, 0.5) as med
  from fr where first_reviewed_at is not null and h is not null and h >= 0
  group by tenant_id, cast(first_reviewed_at as date)),
rd as (
  select tenant_id, cast(submitted_at as date) as activity_date, cast(count(*) as integer) as n
  from reviews where submitted_at is not null group by tenant_id, cast(submitted_at as date))
select coalesce(f.tenant_id, r.tenant_id) as tenant_id, coalesce(f.activity_date, r.activity_date) as activity_date,
  cast(coalesce(f.n, 0) as integer) as prs_first_reviewed, f.med as median_time_to_first_review_hours,
  cast(coalesce(r.n, 0) as integer) as reviews_submitted
from fd f full outer join rd r on f.tenant_id = r.tenant_id and f.activity_date = r.activity_date""")(
    lambda s, sf: D.mart_review_latency(*prs_reviews(s, sf)))

q("mart_change_failure", f"""
select tenant_id, cast(merged_at as date) as activity_date, cast(count(*) as integer) as prs_merged,
  cast(count(*) filter (where is_revert) as integer) as prs_reverted,
  case when count(*) = 0 then null else (count(*) filter (where is_revert))::double / count(*)::double end
    as change_failure_rate
from ({O.FX_PR}) p where merged_at is not null group by tenant_id, cast(merged_at as date)""")(
    lambda s, sf: D.mart_change_failure(FX.fx_pr(s, sf)))

q("mart_deployment_frequency", f"""
select tenant_id, cast(published_at as date) as activity_date, cast(count(*) as integer) as releases_published,
  cast(count(*) filter (where not is_prerelease) as integer) as production_releases
from ({O.stg('releases')}) s where not is_draft and published_at is not null
group by tenant_id, cast(published_at as date)""")(
    lambda s, sf: D.mart_deployment_frequency(raw_stage(s, sf, "releases")))

q("mart_review_comments", f"""
select tenant_id, cast(created_at as date) as activity_date, cast(count(*) as integer) as review_comments_created
from ({O.stg('pull_request_review_comments')}) s where created_at is not null
group by tenant_id, cast(created_at as date)""")(
    lambda s, sf: D.mart_review_comments(raw_stage(s, sf, "pull_request_review_comments")))

q("mart_workflow_runs", f"""
with runs as ({O.stg('workflow_runs')}), a as (
  select tenant_id, cast(created_at as date) as d, 1 as st, 0 as co, 0 as su, 0 as fa from runs where created_at is not null
  union all
  select tenant_id, cast(updated_at as date), 0, 1,
    case when lower(coalesce(conclusion, '')) = 'success' then 1 else 0 end,
    case when lower(coalesce(conclusion, '')) in ('failure', 'timed_out', 'cancelled') then 1 else 0 end
  from runs where updated_at is not null and lower(coalesce(run_status, '')) = 'completed')
select tenant_id, d as activity_date, cast(sum(st) as integer) as runs_started,
  cast(sum(co) as integer) as runs_completed, cast(sum(su) as integer) as runs_success,
  cast(sum(fa) as integer) as runs_failure
from a group by tenant_id, d""")(lambda s, sf: D.mart_workflow_runs(raw_stage(s, sf, "workflow_runs")))

q("mart_ticket_activity", f"""
with g as ({O.stg('issues')}), l as ({O.stg('linear_issues')}), a as (
  select tenant_id, 'github' as source, cast(created_at as date) as d, 1 as cr, 0 as cp, 0 as ca from g where created_at is not null
  union all select tenant_id, 'github', cast(closed_at as date), 0, 1, 0 from g
    where closed_at is not null and coalesce(state_reason, '') <> 'not_planned'
  union all select tenant_id, 'github', cast(closed_at as date), 0, 0, 1 from g
    where closed_at is not null and state_reason = 'not_planned'
  union all select tenant_id, 'linear', cast(created_at as date), 1, 0, 0 from l where created_at is not null
  union all select tenant_id, 'linear', cast(completed_at as date), 0, 1, 0 from l where completed_at is not null
  union all select tenant_id, 'linear', cast(canceled_at as date), 0, 0, 1 from l where canceled_at is not null)
select tenant_id, d as activity_date, source, cast(sum(cr) as integer) as tickets_created,
  cast(sum(cp) as integer) as tickets_completed, cast(sum(ca) as integer) as tickets_canceled
from a group by tenant_id, d, source""")(
    lambda s, sf: D.mart_ticket_activity(raw_stage(s, sf, "issues"), raw_stage(s, sf, "linear_issues")))

q("mart_ticket_comments", f"""
with a as (
  select tenant_id, 'github' as source, cast(created_at as date) as d from ({O.stg('issue_comments')}) g
  where created_at is not null
  union all
  select tenant_id, 'linear', cast(created_at as date) from ({O.stg('linear_comments')}) l
  where created_at is not null)
select tenant_id, d as activity_date, source, cast(count(*) as integer) as comments_created
from a group by tenant_id, d, source""")(
    lambda s, sf: D.mart_ticket_comments(raw_stage(s, sf, "issue_comments"), raw_stage(s, sf, "linear_comments")))

q("mart_project_activity", f"""
with p as ({O.stg('linear_projects')}), a as (
  select tenant_id, cast(created_at as date) as d, 1 as cr, 0 as cp, 0 as ca from p where created_at is not null
  union all select tenant_id, cast(completed_at as date), 0, 1, 0 from p where completed_at is not null
  union all select tenant_id, cast(canceled_at as date), 0, 0, 1 from p where canceled_at is not null)
select tenant_id, d as activity_date, 'linear' as source, cast(sum(cr) as integer) as projects_created,
  cast(sum(cp) as integer) as projects_completed, cast(sum(ca) as integer) as projects_canceled
from a group by tenant_id, d""")(lambda s, sf: D.mart_project_activity(raw_stage(s, sf, "linear_projects")))

q("mart_description_edits", f"""
select tenant_id, cast(edited_at as date) as activity_date, 'linear' as source,
  cast(count(*) as integer) as description_edits
from ({O.stg('linear_description_edits')}) e where edited_at is not null
group by tenant_id, cast(edited_at as date)""")(
    lambda s, sf: D.mart_description_edits(raw_stage(s, sf, "linear_description_edits")))

FCT_TICKETS_SQL = f"""
with g as ({O.stg('issues')}), l as ({O.stg('linear_issues')}), c as (
  select tenant_id, 'github' as source, issue_node_id as external_id,
    concat(repo, '#', cast(issue_number as varchar)) as external_key, title, html_url as url,
    state as raw_state,
    case when state = 'open' then 'open' when state = 'closed' and state_reason = 'not_planned' then 'canceled'
         when state = 'closed' then 'done' else 'open' end as status,
    author_login as creator, assignee_login as assignee, created_at, updated_at, closed_at as completed_at,
    cast(null as timestamp) as canceled_at, cast(null as varchar) as team, cast(null as integer) as priority,
    cast(null as decimal(18,4)) as estimate
  from g
  union all
  select tenant_id, 'linear', issue_id, identifier, title, url, coalesce(state_name, state_type),
    case when state_type = 'started' then 'in_progress' when state_type = 'completed' then 'done'
         when state_type = 'canceled' then 'canceled' else 'open' end,
    creator, assignee, created_at, updated_at, completed_at, canceled_at, team_key, priority, estimate
  from l)
select tenant_id, source || ':' || external_id as ticket_uid, source, external_id, external_key, title, url,
  raw_state, status, creator, assignee, created_at, updated_at, completed_at, canceled_at, team, priority, estimate
from c"""
q("fct_tickets", FCT_TICKETS_SQL)(
    lambda s, sf: D.fct_tickets(raw_stage(s, sf, "issues"), raw_stage(s, sf, "linear_issues")))


# --- E, F, G, H: metric layer ---------------------------------------------------------
from tallyq.metric_sql import metric_sql  # noqa: E402
from tallyspark.plans import catalog as H  # noqa: E402
from tallyspark.plans.compile import compute_metric  # noqa: E402
from tallyspark.plans.spec import MappedDim, Measure, Metric, Window  # noqa: E402

ORDERS_AS_OF = "2001-12-31"
EVENTS_AS_OF = "2024-02-01"
ENTITY_SQL = {"pull_request": O.PR_ENTITY, "release": O.RELEASE_ENTITY, "incident": O.FX_INCIDENT}


def entities_for(spark, sf, names):
    out = {}
    for n in names:
        if n == "pull_request":
            out[n] = pr_entity(spark, sf)
        elif n == "release":
            out[n] = C.entity_release(raw_stage(spark, sf, "releases"))
        elif n == "incident":
            out[n] = FX.fx_incident(spark, sf)
    return out


def _entity_names(m: Metric) -> set:
    if m.kind == "simple":
        return {m.entity}
    if m.kind == "ratio":
        return {m.numerator.entity, m.denominator.entity}
    return {x.entity for _, x in m.inputs}


def mq(key, metric: Metric, as_of=ORDERS_AS_OF, **kw):
    names = _entity_names(metric)

    def run(spark, sf):
        return compute_metric(metric, entities_for(spark, sf, names), as_of=as_of, **kw)
    QUERIES[key] = run
    ORACLE[key] = metric_sql(metric, ENTITY_SQL, as_of, tenants=kw.get("tenants"))
    return metric


PR_COUNT = Metric(id="t.pr_count", entity="pull_request", time_field="opened_at",
                  measure=Measure("count"), grains=("month",))

FILTERS = {
    "flt_eq": {"field": "repo", "op": "eq", "value": "1-URGENT"},
    "flt_neq": {"field": "repo", "op": "neq", "value": "1-URGENT"},
    "flt_in": {"field": "repo", "op": "in", "value": ["1-URGENT", "2-HIGH"]},
    "flt_not_in": {"field": "repo", "op": "not_in", "value": ["1-URGENT", "2-HIGH"]},
    "flt_gt": {"field": "review_count", "op": "gt", "value": 3},
    "flt_gte": {"field": "review_count", "op": "gte", "value": 3},
    "flt_lt": {"field": "review_count", "op": "lt", "value": 2},
    "flt_lte": {"field": "review_count", "op": "lte", "value": 2},
    "flt_contains": {"field": "repo", "op": "contains", "value": "N_T"},
    "flt_not_contains": {"field": "repo", "op": "not_contains", "value": "HIGH"},
    "flt_starts_with": {"field": "repo", "op": "starts_with", "value": "3"},
    "flt_ends_with": {"field": "repo", "op": "ends_with", "value": "LOW"},
    "flt_is_null": {"field": "repo", "op": "is_null"},
    "flt_is_not_null": {"field": "first_review_at", "op": "is_not_null"},
    "flt_any_of": {"any_of": [{"field": "repo", "op": "eq", "value": "1-URGENT"},
                              {"field": "is_revert", "op": "eq", "value": True}]},
    "flt_all_of": {"all_of": [{"field": "state", "op": "eq", "value": "merged"},
                              {"field": "review_count", "op": "gte", "value": 2}]},
    "flt_not": {"not": {"field": "repo", "op": "eq", "value": "5-LOW"}},
    "flt_sql": {"sql": "review_count % 2 = 0 and author_id like '1%'"},
}
for _k, _f in FILTERS.items():
    mq(_k, PR_COUNT.with_(id=f"t.{_k}", filters=(_f,)))

# F: measures
IV = dict(from_field="opened_at", to_field="first_review_at")
mq("msr_count", H.MERGED_PRS.with_(id="t.msr_count"))
mq("msr_count_distinct", PR_COUNT.with_(id="t.msr_count_distinct", measure=Measure("count_distinct", "author_id")))
mq("msr_sum", PR_COUNT.with_(id="t.msr_sum", measure=Measure("sum", "review_count")))
mq("msr_avg", PR_COUNT.with_(id="t.msr_avg", measure=Measure("avg", "review_count")))
mq("msr_min", PR_COUNT.with_(id="t.msr_min", measure=Measure("min", "review_count")))
mq("msr_max", PR_COUNT.with_(id="t.msr_max", measure=Measure("max", "review_count")))
mq("msr_percentile", PR_COUNT.with_(id="t.msr_percentile", measure=Measure("percentile", "review_count", 75.0)))
mq("msr_interval_median", H.CYCLE_TIME.with_(id="t.msr_interval_median", grains=("week",)))
mq("msr_interval_percentile", PR_COUNT.with_(id="t.msr_interval_percentile",
                                            measure=Measure("percentile", percentile=90.0, **IV)))
mq("msr_interval_avg", PR_COUNT.with_(id="t.msr_interval_avg", measure=Measure(
    "avg", from_field="opened_at", to_field="closed_at")))
mq("msr_interval_exclude_negative", PR_COUNT.with_(id="t.msr_iv_excl", measure=Measure("avg", **IV)))
mq("msr_interval_clamp_zero", PR_COUNT.with_(id="t.msr_iv_clamp", measure=Measure("avg", negative="clamp_zero", **IV)))
mq("msr_interval_allow", PR_COUNT.with_(id="t.msr_iv_allow", measure=Measure("sum", negative="allow", **IV)))
mq("msr_interval_null_exclude", PR_COUNT.with_(id="t.msr_iv_null", measure=Measure(
    "max", from_field="opened_at", to_field="merged_at", negative="allow")))
mq("msr_ratio", H.CHANGE_FAILURE_RATE.with_(id="t.msr_ratio", grains=("month",)))
_REVIEWS_SUM = PR_COUNT.with_(id="t.rev_sum", time_field="merged_at", measure=Measure("sum", "review_count"),
                              filters=({"field": "merged_at", "op": "is_not_null"},))
mq("msr_ratio_zero", Metric(id="t.msr_ratio_zero", kind="ratio", numerator=H.REVERTED_PRS,
                            denominator=_REVIEWS_SUM, zero_denominator="zero", grains=("day",)))
mq("msr_ratio_override", Metric(id="t.msr_ratio_override", kind="ratio", numerator=H.MERGED_PRS,
                                denominator=H.MERGED_PRS, grains=("month",),
                                numerator_filters=({"field": "review_count", "op": "gte", "value": 2},)))
_OPENED = PR_COUNT.with_(id="t.opened")
_CLOSED = PR_COUNT.with_(id="t.closed", time_field="closed_at", filters=(
    {"field": "state", "op": "eq", "value": "closed"},))
mq("msr_formula", Metric(id="t.msr_formula", kind="formula", grains=("month",),
                         inputs=(("a", H.MERGED_PRS), ("b", _CLOSED), ("c", _OPENED)),
                         expression="(a + b) / c"))
mq("msr_additive_prefix", H.MERGED_PRS.with_(id="t.msr_additive", grains=(), windows=(Window(7, "day"),)))

# G: grains, windows, dims
for _g in ("day", "week", "month", "quarter"):
    mq(f"grain_{_g}", H.MERGED_PRS.with_(id=f"t.grain_{_g}", grains=(_g,)))
mq("bucket_end", H.MERGED_PRS.with_(id="t.bucket_end", grains=("day", "week", "month", "quarter")))
mq("is_complete", H.MERGED_PRS.with_(id="t.is_complete", grains=("week", "month", "quarter")), as_of="2000-06-15")
mq("win_rolling_simple", PR_COUNT.with_(id="t.win_simple", measure=Measure("count_distinct", "author_id"),
                                        grains=(), windows=(Window(7, "day"),)))
mq("win_rolling_week_step", H.MERGED_PRS.with_(id="t.win_week", grains=(), windows=(Window(28, "week"),)))
mq("win_rolling_ratio", H.CHANGE_FAILURE_RATE.with_(id="t.win_ratio", grains=(), windows=(Window(30, "day"),)))
mq("win_rolling_formula", Metric(id="t.win_formula", kind="formula", grains=(), windows=(Window(14, "day"),),
                                 inputs=(("a", H.MERGED_PRS), ("b", _CLOSED)), expression="a - b / 2"))
mq("dim_native", H.MERGED_PRS.with_(id="t.dim_native", grains=("month",), dimensions=("repo",)))
TEAM_MAP = (("1-URGENT", "platform"), ("2-HIGH", "growth"), ("3-MEDIUM", "platform"))
mq("dim_mapped", H.MERGED_PRS.with_(id="t.dim_mapped", grains=("month",), dimensions=("team",),
                                    mapped=(MappedDim("team", "repo", TEAM_MAP, "other"),)))
mq("dim_mapped_exclude", H.MERGED_PRS.with_(id="t.dim_mapped_excl", grains=("month",), dimensions=("team",),
                                            mapped=(MappedDim("team", "repo", TEAM_MAP, "exclude"),)))
mq("dim_grouping_sets", H.CYCLE_TIME.with_(id="t.dim_gsets", grains=("quarter",), dimensions=("repo", "state")))
mq("dim_is_total", H.MERGED_PRS.with_(id="t.dim_is_total", grains=("quarter",), dimensions=("repo",)))
mq("dim_placeholder", PR_COUNT.with_(id="t.dim_placeholder", grains=("quarter",), dimensions=("state",)))
mq("dim_ratio", H.CHANGE_FAILURE_RATE.with_(id="t.dim_ratio", grains=("quarter",), dimensions=("repo",)))
mq("dim_formula", Metric(id="t.dim_formula", kind="formula", grains=("quarter",), dimensions=("repo",),
                         inputs=(("a", H.MERGED_PRS), ("b", _CLOSED)), expression="-a + 2.5 * b"))
mq("tenant_scope", H.CYCLE_TIME.with_(id="t.tenant_scope"), tenants=["1", "7", "12"])

# H: shipped metrics
for _key, _m, _as_of in [
        ("metric_merged_prs", H.MERGED_PRS, ORDERS_AS_OF),
        ("metric_reverted_prs", H.REVERTED_PRS, ORDERS_AS_OF),
        ("metric_change_failure_rate", H.CHANGE_FAILURE_RATE, ORDERS_AS_OF),
        ("metric_cycle_time", H.CYCLE_TIME, ORDERS_AS_OF),
        ("metric_cycle_time_p90", H.CYCLE_TIME_P90, ORDERS_AS_OF),
        ("metric_cycle_time_trailing_30d", H.CYCLE_TIME_TRAILING_30D, ORDERS_AS_OF),
        ("metric_deployment_frequency", H.DEPLOYMENT_FREQUENCY, EVENTS_AS_OF),
        ("metric_review_latency", H.REVIEW_LATENCY, ORDERS_AS_OF),
        ("metric_mttr", H.MTTR, ORDERS_AS_OF)]:
    mq(_key, _m, as_of=_as_of)


# --- G7, G20, G22-G26, E18 ----------------------------------------------------------
from tallyspark.plans import org as G  # noqa: E402
from tallyspark.plans.spec import Param, bind_params  # noqa: E402

q("step_spine", f"""
with b as (select cast(max(opened_at) as date) as hi from ({O.PR_ENTITY}) e),
d as (select cast(unnest(generate_series(cast(hi as timestamp) - interval 730 day, cast(hi as timestamp),
      interval 1 day)) as date) as step_date from b)
select step_date, 'day' as step from d
union all select distinct cast(date_trunc('week', step_date) as date), 'week' from d""")(
    lambda s, sf: G.step_spine(pr_entity(s, sf), "opened_at"))

_UNION = [H.MERGED_PRS, H.CHANGE_FAILURE_RATE, H.CYCLE_TIME, H.REVIEW_LATENCY]
q("metric_union", "\nunion all\n".join(f"select * from ({metric_sql(m, ENTITY_SQL, ORDERS_AS_OF)}) u{i}"
                                        for i, m in enumerate(_UNION)))(
    lambda s, sf: compute_metric_union(s, sf))


def compute_metric_union(spark, sf):
    return G.metric_values(_UNION, entities_for(spark, sf, ["pull_request"]), as_of=ORDERS_AS_OF)


CUSTOM = PR_COUNT.with_(id="t.custom")
_ENROLL_METRICS = [H.MERGED_PRS, H.REVERTED_PRS, H.CHANGE_FAILURE_RATE, H.CYCLE_TIME, H.CYCLE_TIME_P90,
                   H.REVIEW_LATENCY, CUSTOM]
_STD_IDS = [m.id for m in _ENROLL_METRICS if m.id.startswith("std.")]
ENROLL_PAIRS_SQL = f"""
select cast(n_nationkey as varchar) as tenant_id, s.metric_id
from nation, (values {', '.join(f"('{i}')" for i in _STD_IDS)}) s(metric_id)
where (n_nationkey % 2 = 0 and not (n_nationkey % 4 = 0 and s.metric_id = 'std.cycle_time_p90'))
   or (n_nationkey % 2 = 1 and s.metric_id in ('std.merged_prs', 'std.cycle_time'))
union
select cast(n_nationkey as varchar), 't.custom' from nation where n_nationkey % 5 = 0"""


def _enrolled_sql():
    parts = []
    for i, m in enumerate(_ENROLL_METRICS):
        ps = f"select tenant_id from ({ENROLL_PAIRS_SQL}) p where metric_id = '{m.id}'"
        parts.append(f"select * from ({metric_sql(m, ENTITY_SQL, ORDERS_AS_OF, params_sql=ps)}) u{i}")
    return "\nunion all\n".join(parts)


q("enrolled_metric", _enrolled_sql)(
    lambda s, sf: G.compute_enrolled(_ENROLL_METRICS, entities_for(s, sf, ["pull_request"]),
                                     G.enrolled_pairs(FX.fx_enroll(s, sf), _STD_IDS), as_of=ORDERS_AS_OF))

PARAM_METRIC = H.MERGED_PRS.with_(id="t.param_merged", grains=("month",), params=(
    Param("min_reviews", "integer", "review_count", "gte", default=0, has_default=True),))


def _shared_sql():
    from tallyspark.plans.spec import definition_version
    base = definition_version(PARAM_METRIC)
    bound = PARAM_METRIC.with_(filters=PARAM_METRIC.filters + (
        {"field": "review_count", "op": "gte", "value_col": "_p_min_reviews"},), params=())
    ps = ("select cast(n_nationkey as varchar) as tenant_id, "
          "coalesce(case when n_nationkey % 7 <> 0 then n_nationkey % 3 end, 0) as _p_min_reviews from nation")
    inner = metric_sql(bound, ENTITY_SQL, ORDERS_AS_OF, params_sql=ps, version=base)
    return (f"select m.* replace (substr(sha256('{base}' || ':' || cast(p._p_min_reviews as varchar)), 1, 12) "
            f"as definition_version) from ({inner}) m join ({ps}) p on m.tenant_id = p.tenant_id")


q("shared_plan", _shared_sql)(
    lambda s, sf: G.compute_shared(PARAM_METRIC, entities_for(s, sf, ["pull_request"]),
                                   FX.fx_enroll(s, sf).select("tenant_id", "min_reviews"), as_of=ORDERS_AS_OF))

_BOUND = bind_params(PARAM_METRIC, {"min_reviews": 2})
mq("flt_param_bound", _BOUND)

_PREVIEW = H.MERGED_PRS.with_(id="t.preview", dimensions=("repo",))
q("metric_preview", lambda: f"""
select * from ({metric_sql(_PREVIEW.with_(grains=('month',)), ENTITY_SQL, '2000-03-01',
                           version=__import__('tallyspark.plans.spec', fromlist=['x']).definition_version(
                               _PREVIEW.with_(grains=('month',), windows=())))}) p
where bucket_start >= timestamp '2000-03-01' - interval 90 day
order by bucket_start, tenant_id, dim_repo, dim_team, is_total limit 500""")(
    lambda s, sf: G.preview(_PREVIEW, entities_for(s, sf, ["pull_request"]), as_of="2000-03-01"))


def _stage_sql():
    m = H.CYCLE_TIME
    e = O.PR_ENTITY
    return f"""
select 'value:entity' as stage, cast(count(*) as bigint) as row_count from ({e}) x
union all select 'value:filtered', count(*) filter (where merged_at is not null) from ({e}) x
union all select 'value:value_rows', count(*) filter (where merged_at is not null and opened_at is not null
  and merged_at >= opened_at) from ({e}) x
union all select 'block:' || grain, count(*) from ({metric_sql(m, ENTITY_SQL, ORDERS_AS_OF)}) o group by grain
union all select 'final', count(*) from ({metric_sql(m, ENTITY_SQL, ORDERS_AS_OF)}) o"""


q("metric_stage_counts", _stage_sql)(
    lambda s, sf: G.stage_counts(H.CYCLE_TIME, entities_for(s, sf, ["pull_request"]), as_of=ORDERS_AS_OF))

IC_METRIC = H.MERGED_PRS.with_(id="t.ic_merged", grains=("quarter",), dimensions=("author_id",), visibility="ic")


def _ic_identities(spark, sf):
    r = FX.fx_roster(spark, sf).where(F.col("email").isNotNull())
    ids = r.select("tenant_id", F.col("email").alias("caller"), F.col("external_id").alias("key"))
    logins = r.select("tenant_id", F.col("email").alias("caller"), F.col("login").alias("key"))
    return ids.unionByName(logins)


q("ic_row_filter", lambda: f"""
with ident as (
  select cast(c_nationkey as varchar) as tenant_id, 'u' || cast(c_custkey % 150 as varchar) || '@x' as caller,
         cast(c_custkey as varchar) as key from customer where c_custkey % 11 <> 0
  union
  select cast(c_nationkey as varchar), 'u' || cast(c_custkey % 150 as varchar) || '@x', c_name
  from customer where c_custkey % 11 <> 0)
select distinct m.*, i.caller from ({metric_sql(IC_METRIC, ENTITY_SQL, ORDERS_AS_OF)}) m
join ident i on m.tenant_id = i.tenant_id and m.dim_author_id = i.key""")(
    lambda s, sf: G.ic_rows(compute_metric(IC_METRIC, entities_for(s, sf, ["pull_request"]), as_of=ORDERS_AS_OF),
                            _ic_identities(s, sf), ["author_id"]))


# --- I: serving -------------------------------------------------------------------
import datetime as _dt  # noqa: E402

from tallyspark.operators import serving as I  # noqa: E402

_R98 = (_dt.date(1998, 1, 1), _dt.date(1998, 12, 31))
_RJ = (_dt.date(2024, 1, 3), _dt.date(2024, 1, 25))
_TRUNC = {"daily": "day", "weekly": "week", "monthly": "month"}


def _srv_sql(mart_key, sums, gran, rng, extra=""):
    s = ", ".join(f"cast(coalesce(sum({m}), 0) as integer) as {a}" for m, a in sums)
    return (f"select tenant_id, cast(date_trunc('{_TRUNC[gran]}', activity_date) as date) as period_start, {s}"
            f"{extra} from ({ORACLE[mart_key]}) m where activity_date >= date '{rng[0]}' and activity_date <= date "
            f"'{rng[1]}' group by 1, 2")


def _srv(key, fn, mart_key, mart_fn, sums, gran, rng, extra=""):
    q(key, _srv_sql(mart_key, sums, gran, rng, extra))(
        lambda s, sf: fn(mart_fn(s, sf), gran, rng[0], rng[1]))


_srv("srv_pr_activity", I.srv_pr_activity, "mart_pr_activity", QUERIES["mart_pr_activity"],
     [("prs_opened", "opened"), ("prs_merged", "merged"), ("prs_closed", "closed")], "weekly", _R98)
_srv("srv_deployment_frequency", I.srv_deployment_frequency, "mart_deployment_frequency",
     QUERIES["mart_deployment_frequency"],
     [("releases_published", "releases_published"), ("production_releases", "production_releases")], "weekly", _RJ)
_W = "sum({x} * prs_merged) / nullif(sum(prs_merged), 0)"
_srv("srv_cycle_time", I.srv_cycle_time, "mart_pr_cycle_time", QUERIES["mart_pr_cycle_time"],
     [("prs_merged", "prs_merged")], "weekly", _R98,
     extra=", " + ", ".join(f"cast({_W.format(x=x)} as double) as {a}" for x, a in [
         ("median_cycle_time_hours", "median_hours"), ("avg_cycle_time_hours", "avg_hours"),
         ("p90_cycle_time_hours", "p90_hours")]))
_srv("srv_review_latency", I.srv_review_latency, "mart_review_latency", QUERIES["mart_review_latency"],
     [("prs_first_reviewed", "prs_first_reviewed"), ("reviews_submitted", "reviews_submitted")], "monthly",
     (_dt.date(1997, 6, 1), _dt.date(1999, 6, 30)),
     extra=", cast(sum(median_time_to_first_review_hours * prs_first_reviewed) / nullif(sum(case when "
           "median_time_to_first_review_hours is null then 0 else prs_first_reviewed end), 0) as double) "
           "as median_hours_to_first_review")
_srv("srv_change_failure", I.srv_change_failure, "mart_change_failure", QUERIES["mart_change_failure"],
     [("prs_merged", "prs_merged"), ("prs_reverted", "prs_reverted")], "weekly", _R98,
     extra=", cast(sum(prs_reverted)::double / nullif(sum(prs_merged), 0) as double) as change_failure_rate")
_srv("srv_review_comments", I.srv_review_comments, "mart_review_comments", QUERIES["mart_review_comments"],
     [("review_comments_created", "review_comments_created")], "weekly", _RJ)
_srv("srv_workflow_runs", I.srv_workflow_runs, "mart_workflow_runs", QUERIES["mart_workflow_runs"],
     [(m, m) for m in ["runs_started", "runs_completed", "runs_success", "runs_failure"]], "weekly", _RJ)
_srv("srv_ticket_activity", I.srv_ticket_activity, "mart_ticket_activity", QUERIES["mart_ticket_activity"],
     [(m, m) for m in ["tickets_created", "tickets_completed", "tickets_canceled"]], "daily", _RJ)
_srv("srv_ticket_comments", I.srv_ticket_comments, "mart_ticket_comments", QUERIES["mart_ticket_comments"],
     [("comments_created", "comments_created")], "weekly", _RJ)
_srv("srv_project_activity", I.srv_project_activity, "mart_project_activity", QUERIES["mart_project_activity"],
     [(m, m) for m in ["projects_created", "projects_completed", "projects_canceled"]], "monthly", _RJ)
_srv("srv_description_edits", I.srv_description_edits, "mart_description_edits",
     QUERIES["mart_description_edits"], [("description_edits", "description_edits")], "weekly", _RJ)

_START, _END = I.default_range("2001-12-31")
_srv("srv_default_range", I.srv_pr_activity, "mart_pr_activity", QUERIES["mart_pr_activity"],
     [("prs_opened", "opened"), ("prs_merged", "merged"), ("prs_closed", "closed")], "weekly", (_START, _END))

q("srv_metric_values", f"""
select tenant_id, cast(bucket_start as date) as period_start, value from ({ORACLE['metric_cycle_time']}) m
where metric_id = 'std.cycle_time' and grain = 'week' and is_total
  and cast(bucket_start as date) between date '1998-01-01' and date '1998-12-31'""")(
    lambda s, sf: I.srv_metric_values(QUERIES["metric_cycle_time"](s, sf), "std.cycle_time", "weekly",
                                      _dt.date(1998, 1, 1), _dt.date(1998, 12, 31)))
q("srv_metric_values_by_dims", f"""
select tenant_id, cast(bucket_start as date) as period_start, value from ({ORACLE['dim_native']}) m
where metric_id = 't.dim_native' and grain = 'month' and dim_repo = '' and dim_team = ''
  and cast(bucket_start as date) between date '1997-01-01' and date '1999-12-31'""")(
    lambda s, sf: I.srv_metric_values_by_dims(QUERIES["dim_native"](s, sf), "t.dim_native", "monthly",
                                              _dt.date(1997, 1, 1), _dt.date(1999, 12, 31)))

_MY_PRS = f"""
select tenant_id, p_user_login as author_login, p_node_id as pr_node_id, cast(p_number as integer) as pr_number,
  p_created_at as created_at, p_closed_at as closed_at, p_merged_at as merged_at,
  coalesce(p_base_repo_full_name, {O.REPO}) as repo,
  regexp_matches(coalesce(p_title, ''), '^revert([[:space:][:punct:]]|$)', 'i') as is_revert,
  case when p_merged_at is not null and p_created_at is not null
       then (epoch_us(p_merged_at) - epoch_us(p_created_at)) / 3.6e9 end as cycle_time_hours
from ({O.src_sql('pull_requests')}) s where p_node_id is not null and p_user_login is not null
qualify row_number() over (partition by tenant_id, p_user_login, p_node_id order by fetched_at desc, id desc) = 1"""
_MY_REVIEWS = f"""
select tenant_id, p_submitted_at as submitted_at, p_user_login as reviewer_login,
  cast(p_pull_request_number as integer) as pull_request_number, {O.REPO} as r_repo
from ({O.latest('reviews', 'p_node_id', "p_submitted_at is not null and coalesce(p_state, '') <> 'PENDING'")}) r"""


def raw_prs_reviews(spark, sf):
    return FX.fx_raw_all(spark, sf, ["pull_requests", "reviews"])


_RJ2 = (_dt.date(2024, 1, 5), _dt.date(2024, 1, 28))
_IN = f"between date '{_RJ2[0]}' and date '{_RJ2[1]}'"
q("srv_me_pr_activity", f"""
with prs as ({_MY_PRS}), a as (
  select tenant_id, author_login, cast(created_at as date) as d, 1 as o, 0 as m, 0 as c from prs where created_at is not null
  union all select tenant_id, author_login, cast(merged_at as date), 0, 1, 0 from prs where merged_at is not null
  union all select tenant_id, author_login, cast(closed_at as date), 0, 0, 1 from prs
    where closed_at is not null and merged_at is null)
select tenant_id, author_login, cast(date_trunc('week', d) as date) as period_start,
  cast(sum(o) as integer) as opened, cast(sum(m) as integer) as merged, cast(sum(c) as integer) as closed
from a where d {_IN} group by 1, 2, 3""")(
    lambda s, sf: I.srv_me_pr_activity(raw_prs_reviews(s, sf), None, "weekly", *_RJ2))
q("srv_me_cycle_time", f"""
select tenant_id, author_login, cast(date_trunc('week', cast(merged_at as date)) as date) as period_start,
  cast(count(*) as integer) as prs_merged, quantile_cont(cycle_time_hours, 0.5) as median_hours,
  avg(cycle_time_hours) as avg_hours, quantile_cont(cycle_time_hours, 0.9) as p90_hours
from ({_MY_PRS}) p where merged_at is not null and cycle_time_hours is not null and cycle_time_hours >= 0
  and cast(merged_at as date) {_IN} group by 1, 2, 3""")(
    lambda s, sf: I.srv_me_cycle_time(raw_prs_reviews(s, sf), None, "weekly", *_RJ2))
q("srv_me_review_latency", f"""
with prs as ({_MY_PRS}), reviews as ({_MY_REVIEWS}),
pr_reviews as (
  select p.tenant_id, p.author_login, p.pr_node_id, p.created_at, r.submitted_at from prs p join reviews r
  on p.tenant_id = r.tenant_id and r.r_repo is not distinct from p.repo and r.pull_request_number = p.pr_number
  and r.reviewer_login is distinct from p.author_login where p.created_at is not null),
fr as (select tenant_id, author_login, pr_node_id, min(submitted_at) as first_at,
  (epoch_us(min(submitted_at)) - epoch_us(created_at)) / 3.6e9 as h
  from pr_reviews group by tenant_id, author_login, pr_node_id, created_at),
fp as (select tenant_id, author_login, cast(date_trunc('week', cast(first_at as date)) as date) as period_start,
  cast(count(*) as integer) as n, quantile_cont(h, 0.5) as med from fr
  where h is not null and h >= 0 and cast(first_at as date) {_IN} group by 1, 2, 3),
rp as (select tenant_id, author_login, cast(date_trunc('week', cast(submitted_at as date)) as date) as period_start,
  cast(count(*) as integer) as n from pr_reviews where cast(submitted_at as date) {_IN} group by 1, 2, 3)
select coalesce(fp.tenant_id, rp.tenant_id) as tenant_id, coalesce(fp.author_login, rp.author_login) as author_login,
  coalesce(fp.period_start, rp.period_start) as period_start, cast(coalesce(fp.n, 0) as integer) as prs_first_reviewed,
  fp.med as median_hours_to_first_review, cast(coalesce(rp.n, 0) as integer) as reviews_submitted
from fp full outer join rp on fp.tenant_id = rp.tenant_id and fp.author_login = rp.author_login
  and fp.period_start = rp.period_start""")(
    lambda s, sf: I.srv_me_review_latency(raw_prs_reviews(s, sf), None, "weekly", *_RJ2))
q("srv_me_change_failure", f"""
select tenant_id, author_login, cast(date_trunc('week', cast(merged_at as date)) as date) as period_start,
  cast(count(*) as integer) as prs_merged, cast(count(*) filter (where is_revert) as integer) as prs_reverted,
  (count(*) filter (where is_revert))::double / count(*)::double as change_failure_rate
from ({_MY_PRS}) p where merged_at is not null and cast(merged_at as date) {_IN} group by 1, 2, 3""")(
    lambda s, sf: I.srv_me_change_failure(raw_prs_reviews(s, sf), None, "weekly", *_RJ2))

q("resample", f"""
select tenant_id, cast(date_trunc('week', activity_date) as date) as date,
  cast(coalesce(arg_max(prs_opened, activity_date), 0) as double) as value
from ({ORACLE['mart_pr_activity']}) m
where cast(activity_date as timestamp) >= timestamp '1997-12-30 00:00:00'
  and cast(activity_date as timestamp) <= timestamp '1998-06-30 12:00:00'
group by 1, 2""")(
    lambda s, sf: I.resample(QUERIES["mart_pr_activity"](s, sf).select(
        "tenant_id", F.col("activity_date").alias("date"), F.col("prs_opened").alias("value")),
        now="1998-06-30T12:00:00", range_name="half_year", granularity="weekly", how="last"))
q("display_value", f"""
select *, value / 3600.0 as display_value from ({ORACLE['metric_cycle_time']}) m where value is not null""")(
    lambda s, sf: I.display_value(QUERIES["metric_cycle_time"](s, sf), "duration"))


# --- J: identity, I18 ----------------------------------------------------------------
from tallyspark.functions.jsonx import jstr as _jstr  # noqa: E402
from tallyspark.operators import identity as J  # noqa: E402


def _j1(s, sf):
    p = J.latest_payload_by_login(FX.fx_identity_raw(s, sf), "user_profiles")
    return p.select("tenant_id", "login", _jstr("payload", "email").alias("email"), _jstr("payload", "name").alias("name"))


def _roster(s, sf):
    raw = FX.fx_identity_raw(s, sf)
    return J.build_roster(J.latest_payload_by_login(raw, "organization_members"),
                          J.latest_payload_by_login(raw, "user_profiles"), FX.fx_admins(s, sf))


def _j3(s, sf):
    return J.upsert_identity(FX.fx_existing_identities(s, sf), _roster(s, sf))


def _j4(s, sf):
    u = FX.fx_users(s, sf)
    oauth = u.where(F.col("oauth_id").isNotNull()).select(F.col("oauth_id").alias("account_id"), "user_id")
    return J.link_identity(_j3(s, sf), u.select("user_id", "email"), oauth)


def _j7(s, sf):
    return J.ensure_membership(_j4(s, sf), FX.fx_memberships(s, sf), _j3(s, sf))


q("latest_payload_by_login", O.PROFILES_LATEST)(_j1)
q("build_roster", O.ROSTER)(_roster)
q("upsert_identity", O.J3)(_j3)
q("link_identity", O.J4)(_j4)
q("link_one_per_user", f"""
select tenant_id, user_id, count(*) as identities from ({O.J4}) j where user_id is not null group by 1, 2""")(
    lambda s, sf: _j4(s, sf).where(F.col("user_id").isNotNull()).groupBy("tenant_id", "user_id")
    .agg(F.count(F.lit(1)).alias("identities")))
q("provision_users", f"""
select min(user_id) as user_id, lower(email) as email, min(name) as name from ({O.J4}) j
where link_method = 'provisioned' group by lower(email)""")(lambda s, sf: J.provision_users(_j4(s, sf)))
def _pipeline(s, sf):
    u = FX.fx_users(s, sf)
    oauth = u.where(F.col("oauth_id").isNotNull()).select(F.col("oauth_id").alias("account_id"), "user_id")
    return J.sync_and_link(FX.fx_identity_raw(s, sf), FX.fx_admins(s, sf), FX.fx_existing_identities(s, sf),
                           u.select("user_id", "email"), oauth, FX.fx_memberships(s, sf))


q("ensure_membership", O.J7)(lambda s, sf: _pipeline(s, sf)["new_memberships"])
q("reconcile_roles", O.J8)(lambda s, sf: _pipeline(s, sf)["roles"])
q("claim_pending", O.J9)(lambda s, sf: J.claim_pending(_pipeline(s, sf)["identities"], FX.fx_signups(s, sf)))
q("member_logins", f"select distinct tenant_id, login from ({O.ID_MEMBERS}) m")(
    lambda s, sf: J.member_logins(FX.fx_identity_raw(s, sf)))
q("srv_resolve_login", f"""
select tenant_id, user_id, min(login) as login from ({O.J4}) j where user_id is not null and login is not null
group by 1, 2""")(
    lambda s, sf: I.srv_resolve_login(_j4(s, sf).select("tenant_id", "user_id", F.lit("github").alias("provider"),
                                                        F.col("login").alias("external_login"))))


# --- A: landing, sinks ------------------------------------------------------------------
import uuid as _uuid  # noqa: E402

from tallyspark.session import intermediates, scratch_path, written  # noqa: E402
from tallyspark.sources import landing as A  # noqa: E402
from tallyspark.sources import sinks as SK  # noqa: E402
from tallyspark.sources.datapoints import read_datapoints, upsert_datapoints  # noqa: E402

_GH_LAND = ["pull_requests", "reviews", "releases", "workflow_runs"]


def _records(spark, sf, resources):
    raw = FX.fx_raw_all(spark, sf, resources)
    return raw.select("tenant_id", F.col("resource_type").alias("stream"), "payload", "fetched_at", "id", "run_id")


def _landed(spark, sf):
    path = scratch_path(spark, f"landing-{_uuid.uuid4().hex}")
    A.write_raw(A.land_raw_append(_records(spark, sf, _GH_LAND), "github"), path)
    return spark.read.parquet(path)


def _land_sql(resources, where="true"):
    parts = []
    for r in resources:
        nat = "coalesce(" + ", ".join(O._nz(r, "p_node_id", "p_id", "p_sha") + ["null"]) + ")"
        parts.append(f"select id, tenant_id, {nat} as source_id, fetched_at, run_id, 'github' as source, "
                     f"'{FX.RESOURCES[r][1]}' as resource_type from ({O.src_sql(r)}) s")
    return "select * from (" + " union all ".join(parts) + f") x where {where}"


q("land_raw_append", _land_sql(_GH_LAND))(lambda s, sf: _landed(s, sf).drop("payload"))
q("scan_resource", _land_sql(["reviews"]))(
    lambda s, sf: A.scan_resource(_landed(s, sf), "github", "reviews").drop("payload"))

_PAGE_NODES = f"""
select {FX.TENANT} as tenant_id, event_id // 50 as page_id, 'iss-' || cast(event_id as varchar) as id,
  'ENG-' || cast(k as varchar) as identifier, ts as updated_at, event_id, value, k, ts
from ({O.EV}) ev"""


def _nodes(spark, sf):
    n = A.flatten_pages(FX.fx_pages(spark, sf), "issues")
    return n


q("src_flatten_pages", f"select tenant_id, page_id, id, identifier, updated_at from ({_PAGE_NODES}) n")(
    lambda s, sf: _nodes(s, sf).select("tenant_id", "page_id", _jstr("payload", "id").alias("id"),
                                       _jstr("payload", "identifier").alias("identifier"),
                                       _jstr("payload", "updatedAt").cast("timestamp").alias("updated_at")))
q("src_flatten_history", f"""
select tenant_id, page_id, 'e' || cast(event_id as varchar) as edit_id, ts as created_at, id as issue_id,
  identifier as issue_identifier from ({_PAGE_NODES}) n where value > 20
union all
select tenant_id, page_id, 'f' || cast(event_id as varchar), ts, id, identifier from ({_PAGE_NODES}) n
where k % 3 <> 0""")(
    lambda s, sf: A.flatten_history(_nodes(s, sf).drop("node_pos")).select(
        "tenant_id", "page_id", _jstr("payload", "id").alias("edit_id"),
        _jstr("payload", "createdAt").cast("timestamp").alias("created_at"),
        _jstr("payload", "issue.id").alias("issue_id"), _jstr("payload", "issue.identifier").alias("issue_identifier")))
q("src_updated_since", f"""
select tenant_id, page_id, id from ({_PAGE_NODES}) n where updated_at >= timestamp '2024-01-15 00:00:00'""")(
    lambda s, sf: A.updated_since(_nodes(s, sf), "2024-01-15").select(
        "tenant_id", "page_id", _jstr("payload", "id").alias("id")))

_ENV_COLS = ["tenant_id", "source", "tool", "kind", "name", "subject_type", "subject_id", "occurred_at",
             "observed_at", "source_key", "raw_record_id"]
_GH_ALL = ["pull_requests", "reviews", "releases", "issues", "issue_comments", "pull_request_review_comments",
           "workflow_runs"]
_LN_ALL = ["linear_issues", "linear_comments", "linear_projects", "linear_description_edits"]
q("env_github", " union all ".join(O.env_sql(r) for r in _GH_ALL))(
    lambda s, sf: A.env_github(FX.fx_raw_all(s, sf, _GH_ALL)).select(
        *_ENV_COLS, _jstr("metadata", "repo").alias("meta_repo")))
q("env_linear", " union all ".join(O.env_sql(r) for r in _LN_ALL))(
    lambda s, sf: A.env_linear(FX.fx_raw_all(s, sf, _LN_ALL)).select(*_ENV_COLS))
q("env_copilot", O.env_sql("copilot_usage"))(
    lambda s, sf: A.env_copilot(FX.fx_raw_resource(s, sf, "copilot_usage")).select(
        *_ENV_COLS, "period_start", "period_end", _jstr("metadata", "total_suggestions_count").alias("meta_total")))

_SPLIT = "2024-01-15 00:00:00"


def _merged(spark, dps, name):
    """Two landings of datapoints merged into a table; the second repeats a part of the first."""
    path = scratch_path(spark, f"{name}-{_uuid.uuid4().hex}")
    split = F.lit(_SPLIT).cast("timestamp")
    upsert_datapoints(dps.where(F.col("observed_at") < split), path)
    upsert_datapoints(dps.where(F.col("observed_at") >= split - F.expr("INTERVAL 1 DAY")), path)
    return read_datapoints(spark, path)


def _a9(spark, sf):
    dps = A.env_github(FX.fx_raw_all(spark, sf, ["pull_requests", "reviews"]))
    return _merged(spark, dps, "events").select(*_ENV_COLS)


q("dp_event_first_wins", " union all ".join(
    f"select * exclude (meta_repo) from ({O.env_sql(r)}) e" for r in ["pull_requests", "reviews"]).join(
    ["select * from (", ") x qualify row_number() over (partition by tenant_id, source, source_key "
                        "order by observed_at, raw_record_id) = 1"]))(_a9)


def _a10(spark, sf):
    dps = A.env_copilot(FX.fx_raw_resource(spark, sf, "copilot_usage"))
    return _merged(spark, dps, "measures").select(
        "tenant_id", "tool", "name", "subject_id", "period_start", "subject_type", "source_key", "occurred_at",
        "period_end", "observed_at", "raw_record_id", _jstr("metadata", "total_suggestions_count").alias("meta_total"))


q("dp_measure_newest_wins", f"""
with c as ({O.env_sql('copilot_usage')}),
n as (select * from c qualify row_number() over (partition by tenant_id, tool, name, subject_id, period_start
      order by observed_at desc, raw_record_id) = 1),
f as (select * from c qualify row_number() over (partition by tenant_id, tool, name, subject_id, period_start
      order by raw_record_id) = 1)
select n.tenant_id, n.tool, n.name, n.subject_id, n.period_start, f.subject_type, f.source_key, n.occurred_at,
  n.period_end, n.observed_at, n.raw_record_id, n.meta_total
from n join f using (tenant_id, tool, name, subject_id, period_start)""")(_a10)


def _a11(spark, sf):
    path = scratch_path(spark, f"mart-{_uuid.uuid4().hex}")
    prs = FX.fx_pr(spark, sf)
    SK.sink_full_refresh(D.mart_pr_activity(prs), path)
    # tenant 2's PRs vanished upstream; tenants 1 and 2 are rebuilt
    m2 = D.mart_pr_activity(prs.where(F.col("tenant_id") != "2"), tenants=["1", "2"])
    SK.sink_mart_tenant_replace(m2, path, ["1", "2"])
    return SK.read_mart(spark, path)


q("sink_mart_tenant_replace", f"select * from ({ORACLE['mart_pr_activity']}) m where tenant_id <> '2'")(_a11)


def _a12(spark, sf):
    base = scratch_path(spark, f"metrics-{_uuid.uuid4().hex}")
    ents = entities_for(spark, sf, ["pull_request"])
    SK.sink_metric_swap(compute_metric(H.CYCLE_TIME, ents, as_of=ORDERS_AS_OF), base, H.CYCLE_TIME.id)
    ents2 = {"pull_request": ents["pull_request"].where(F.col("tenant_id") != "3")}
    SK.sink_metric_swap(compute_metric(H.CYCLE_TIME, ents2, as_of=ORDERS_AS_OF), base, H.CYCLE_TIME.id,
                        tenants=["3", "4"])
    return SK.read_metric_values(spark, base, [H.CYCLE_TIME.id])


q("sink_metric_swap", f"select * from ({ORACLE['metric_cycle_time']}) m where tenant_id <> '3'")(_a12)


def _a13(spark, sf):
    path = scratch_path(spark, f"full-{_uuid.uuid4().hex}")
    prs = FX.fx_pr(spark, sf)
    SK.sink_full_refresh(D.mart_change_failure(prs.where(F.col("tenant_id") == "0")), path)
    m = D.mart_change_failure(prs)
    SK.sink_full_refresh(m, path)
    return SK.read_mart(spark, path)


q("sink_full_refresh", ORACLE["mart_change_failure"])(_a13)


# --- K: run log ------------------------------------------------------------------------
from tallyspark.operators import runlog as K  # noqa: E402

FX_RUNLOG_SQL = """
select o_orderkey as id, 't' || cast(o_custkey % 4 as varchar) as tenant_id,
  cast(o_custkey % 20 as varchar) as connected_account_id, o_orderpriority as resource_type,
  o_orderdate + (o_orderkey % 86400) * interval 1 second as started_at,
  case o_orderstatus when 'F' then 'success' when 'P' then 'error' else 'running' end as status,
  case when o_orderstatus = 'F' then o_orderdate + interval 12 hour end as watermark
from orders"""

q("watermark_start", f"""
with r as ({FX_RUNLOG_SQL}),
pairs as (select distinct connected_account_id, resource_type from r),
l as (select connected_account_id, resource_type, watermark from r where status = 'success'
      qualify row_number() over (partition by connected_account_id, resource_type order by started_at desc, id desc) = 1)
select p.connected_account_id, p.resource_type,
  coalesce(strftime(cast(l.watermark - interval 1 day as date), '%Y-%m-%d'), '2001-10-02') as start_date
from pairs p left join l using (connected_account_id, resource_type)""")(
    lambda s, sf: K.watermark_start(FX.fx_runlog(s, sf), "2001-12-31"))
q("recent_runs", f"""
select * from ({FX_RUNLOG_SQL}) r
qualify row_number() over (partition by tenant_id order by started_at desc, id desc) <= 20""")(
    lambda s, sf: K.recent_runs(FX.fx_runlog(s, sf)))

_ALL_RES = list(FX.RESOURCES)


def _dp_table(spark, sf):
    raw = FX.fx_raw_all(spark, sf, _ALL_RES)
    ev = A.env_github(raw).unionByName(A.env_linear(raw))
    ms = A.env_copilot(raw)
    return raw, A.dp_event_first_wins(ev.where(F.lit(False)), ev).unionByName(
        A.dp_measure_newest_wins(ms.where(F.lit(False)), ms))


_EV_SQL = " union all ".join(
    f"select tenant_id, source, kind, source_key, observed_at, raw_record_id from ({O.env_sql(r)}) e"
    for r in _GH_ALL + _LN_ALL)
DP_SQL = f"""
select tenant_id, source, kind, raw_record_id from ({_EV_SQL}) x
qualify row_number() over (partition by tenant_id, source, source_key order by observed_at, raw_record_id) = 1
union all
select tenant_id, source, kind, raw_record_id from ({O.env_sql('copilot_usage')}) c
qualify row_number() over (partition by tenant_id, tool, name, subject_id, period_start
                           order by observed_at desc, raw_record_id) = 1"""
RAW_ALL_SQL = " union all ".join(f"select tenant_id, id, run_id from ({O.src_sql(r)}) s" for r in _ALL_RES)

q("run_counts", f"""
with raw as ({RAW_ALL_SQL}), dp as ({DP_SQL}),
r as (select run_id, count(*) as records_pulled from raw group by run_id),
d as (select raw.run_id, count(*) as n from dp join raw on dp.raw_record_id = raw.id group by raw.run_id)
select r.run_id, r.records_pulled, coalesce(d.n, 0) as datapoints_written from r left join d using (run_id)""")(
    lambda s, sf: K.run_counts(*_dp_table(s, sf)))
q("datapoint_stats", f"""
with d as (select tenant_id, count(*) as n from ({DP_SQL}) x group by 1),
r as (select tenant_id, count(*) as n from ({RAW_ALL_SQL}) x group by 1),
l as (select tenant_id, max(started_at) as last_run_at from ({FX_RUNLOG_SQL}) x group by 1)
select coalesce(d.tenant_id, r.tenant_id, l.tenant_id) as tenant_id, coalesce(d.n, 0) as total_datapoints,
  coalesce(r.n, 0) as total_raw_records, l.last_run_at
from d full outer join r on d.tenant_id = r.tenant_id
full outer join l on coalesce(d.tenant_id, r.tenant_id) = l.tenant_id""")(
    lambda s, sf: K.datapoint_stats(_dp_table(s, sf)[1], FX.fx_raw_all(s, sf, _ALL_RES), FX.fx_runlog(s, sf)))
q("count_by_label", f"""
select tenant_id, 'kind' as label_type, kind as label, count(*) as count from ({DP_SQL}) x group by 1, 3
union all
select tenant_id, 'source', source, count(*) from ({DP_SQL}) x group by 1, 3""")(
    lambda s, sf: K.count_by_label(_dp_table(s, sf)[1]))


# --- Q: data quality ----------------------------------------------------------------------
from tallyspark.operators import quality as Q  # noqa: E402

_TICKET_COLS = ["tenant_id", "ticket_uid", "source", "status", "created_at", "title", "external_key", "completed_at"]
q("dq_not_null", " union all ".join(
    f"select '{c}' as column, count(*) filter (where {c} is null) as null_rows from ({FCT_TICKETS_SQL}) t"
    for c in _TICKET_COLS))(lambda s, sf: Q.dq_not_null(QUERIES["fct_tickets"](s, sf), _TICKET_COLS))
_CONCL = ["success", "failure", "timed_out", "cancelled"]
q("dq_accepted_values", f"""
select cast(conclusion as varchar) as value, count(*) as rows from ({O.stg('workflow_runs')}) w
where conclusion is not null and conclusion not in ('success', 'failure', 'timed_out', 'cancelled')
group by 1""")(lambda s, sf: Q.dq_accepted_values(raw_stage(s, sf, "workflow_runs"), "conclusion", _CONCL))
q("dq_unique", f"""
select tenant_id, pull_request_number, reviewer_login, count(*) as rows from ({O.FX_REVIEW}) r
group by 1, 2, 3 having count(*) > 1""")(
    lambda s, sf: Q.dq_unique(FX.fx_review(s, sf), ["tenant_id", "pull_request_number", "reviewer_login"]))
_MPA = ORACLE["mart_pr_activity"]
q("dq_reconcile", f"""
with e as ({_MPA}), a as (select * from ({_MPA}) x where cast(tenant_id as integer) <= 12)
select coalesce(e.tenant_id, a.tenant_id) as tenant_id, coalesce(e.activity_date, a.activity_date) as activity_date,
  e.prs_opened as exp_prs_opened, a.prs_opened as act_prs_opened, e.prs_merged as exp_prs_merged,
  a.prs_merged as act_prs_merged,
  case when a.tenant_id is null then 'missing' when e.tenant_id is null then 'unexpected' else 'different' end as problem
from e full outer join a on e.tenant_id = a.tenant_id and e.activity_date = a.activity_date
where a.tenant_id is null or e.tenant_id is null or e.prs_opened is distinct from a.prs_opened
   or e.prs_merged is distinct from a.prs_merged""")(
    lambda s, sf: Q.dq_reconcile(
        QUERIES["mart_pr_activity"](s, sf),
        D.mart_pr_activity(FX.fx_pr(s, sf), tenants=[str(i) for i in range(13)]),
        ["tenant_id", "activity_date"], ["prs_opened", "prs_merged"]))
q("dq_dual_run", f"""
with m as (select tenant_id, activity_date as day, median_cycle_time_hours * 3600 as s from ({ORACLE['mart_pr_cycle_time']}) x),
v as (select tenant_id, cast(bucket_start as date) as day, value as s from ({ORACLE['metric_cycle_time']}) y
      where grain = 'day' and is_total)
select coalesce(m.tenant_id, v.tenant_id) as tenant_id, coalesce(m.day, v.day) as day, m.s as exp_seconds,
  v.s as act_seconds,
  case when v.tenant_id is null then 'missing' when m.tenant_id is null then 'unexpected' else 'different' end as problem
from m full outer join v on m.tenant_id = v.tenant_id and m.day = v.day
where m.tenant_id is null or v.tenant_id is null or (m.s is null) <> (v.s is null) or abs(m.s - v.s) > 0.001""")(
    lambda s, sf: Q.dq_dual_run(QUERIES["mart_pr_cycle_time"](s, sf), QUERIES["metric_cycle_time"](s, sf),
                                H.CYCLE_TIME.id))
_V2 = H.MERGED_PRS.with_(grains=("week",))
q("dq_single_version", lambda: f"""
select metric_id, count(distinct definition_version) as versions from (
  select * from ({metric_sql(H.MERGED_PRS, ENTITY_SQL, ORDERS_AS_OF)}) a
  union all select * from ({metric_sql(_V2, ENTITY_SQL, ORDERS_AS_OF)}) b) u
group by 1 having count(distinct definition_version) > 1""")(
    lambda s, sf: Q.dq_single_version(QUERIES["metric_merged_prs"](s, sf).unionByName(
        compute_metric(_V2, entities_for(s, sf, ["pull_request"]), as_of=ORDERS_AS_OF))))
q("dq_cardinality", f"""
select d.dimension, d.distinct_values,
  case when d.distinct_values > 5000 then 'error' when d.distinct_values > 500 then 'warn' else 'ok' end as level
from (select 'repo' as dimension, count(distinct repo) as distinct_values from ({O.PR_ENTITY}) e
      union all select 'author_id', count(distinct author_id) from ({O.PR_ENTITY}) e
      union all select 'state', count(distinct state) from ({O.PR_ENTITY}) e) d""")(
    lambda s, sf: Q.dq_cardinality(pr_entity(s, sf), ["repo", "author_id", "state"]))


# --- L: streaming ----------------------------------------------------------------------------
from tallyspark.streaming import streams as L  # noqa: E402


def _in_turns(spark, parts, name, start):
    """Land batch DataFrames one by one, oldest first, each by all tasks in a folder of its own (scratch); after each,
    ``start(stream)`` takes up the new files as one micro-batch and stops. Returns the last batch's folder."""
    base = scratch_path(spark, f"{name}-{_uuid.uuid4().hex}")
    for i, p in enumerate(parts):
        p.write.parquet(f"{base}/batch-{i}")
        start(_stream_of(spark, f"{base}/batch-*", parts[0].schema)).awaitTermination()
    return f"{base}/batch-{len(parts) - 1}"


def _stream_of(spark, path, schema):
    return spark.readStream.schema(schema).parquet(path)


def _l1(spark, sf):
    """Two micro-batches that overlap by a day, then the second one again by another run."""
    rec = _records(spark, sf, _GH_LAND)
    split = F.lit(_SPLIT).cast("timestamp")
    late = rec.where(F.col("fetched_at") >= split - F.expr("INTERVAL 1 DAY"))
    base = scratch_path(spark, f"l1-{_uuid.uuid4().hex}")
    again = _in_turns(spark, [rec.where(F.col("fetched_at") < split), late], "l1-in",
                      lambda s: L.stream_land(s, "github", f"{base}/raw", f"{base}/dp", f"{base}/_ckpt"))
    L.stream_land(_stream_of(spark, again, rec.schema), "github", f"{base}/raw-again", f"{base}/dp", f"{base}/_ckpt-again").awaitTermination()
    raw = spark.read.parquet(f"{base}/raw").groupBy("id", "tenant_id", "source", "resource_type", "source_id", "fetched_at", "run_id").agg(
        F.count(F.lit(1)).alias("times"), F.count_distinct("payload").alias("payloads"))
    dps = read_datapoints(spark, f"{base}/dp")
    return raw.select(F.lit("raw").alias("part"), "tenant_id", "source", F.col("resource_type").alias("name"), F.col("source_id").alias("key"),
                      F.col("fetched_at").alias("at"), F.col("id").alias("raw_record_id"), "times", "payloads").unionByName(
        dps.select(F.lit("datapoint").alias("part"), "tenant_id", "source", "name", F.col("source_key").alias("key"),
                   F.col("observed_at").alias("at"), "raw_record_id", F.lit(1).cast("long").alias("times"), F.lit(1).cast("long").alias("payloads")))


q("stream_land", f"""
select 'raw' as part, tenant_id, source, resource_type as name, source_id as key, fetched_at as at, id as raw_record_id,
  cast(case when fetched_at >= timestamp '{_SPLIT}' - interval 1 day and fetched_at < timestamp '{_SPLIT}' then 2 else 1 end as bigint) as times,
  cast(1 as bigint) as payloads
from ({_land_sql(_GH_LAND)}) r
union all
select 'datapoint', tenant_id, source, name, source_key, observed_at, raw_record_id, cast(1 as bigint), cast(1 as bigint)
from ({" union all ".join(f"select * exclude (meta_repo) from ({O.env_sql(r)}) e" for r in _GH_LAND)}) d
qualify row_number() over (partition by tenant_id, source, source_key order by observed_at, raw_record_id) = 1""")(_l1)


def _in_three(dps):
    """Three batches: the newest half first, the rest after it, and a part of both again."""
    split = F.lit(_SPLIT).cast("timestamp")
    return [dps.where(F.col("observed_at") >= split), dps.where(F.col("observed_at") < split), dps.where(F.pmod(F.xxhash64("source_key"), F.lit(3)) == 0)]


def _l2(spark, sf):
    dps = A.env_github(FX.fx_raw_all(spark, sf, ["pull_requests", "reviews"]))
    split = F.lit(_SPLIT).cast("timestamp")
    base = scratch_path(spark, f"l2-{_uuid.uuid4().hex}")
    with intermediates():
        dps = written(dps, "l2-dps")
        _in_turns(spark, [dps.where(F.col("observed_at") < split), dps], "l2-in",
                  lambda s: L.stream_event_dedupe(s, f"{base}/out", f"{base}/_ckpt"))
    return read_datapoints(spark, f"{base}/out").select(*_ENV_COLS)


q("stream_event_dedupe", ORACLE["dp_event_first_wins"])(_l2)


def _l3(spark, sf):
    """Restated out of order: older rows come after newer ones. Sticky columns are those of the first landed row, so
    the oracle takes them by batch."""
    dps = A.env_copilot(FX.fx_raw_resource(spark, sf, "copilot_usage"))
    base = scratch_path(spark, f"l3-{_uuid.uuid4().hex}")
    with intermediates():
        _in_turns(spark, _in_three(written(dps, "l3-dps")), "l3-in",
                  lambda s: L.stream_restate(s, f"{base}/out", f"{base}/_ckpt"))
    return read_datapoints(spark, f"{base}/out").select(
        "tenant_id", "tool", "name", "subject_id", "period_start", "subject_type", "source_key",
        "occurred_at", "period_end", "observed_at", "raw_record_id",
        _jstr("metadata", "total_suggestions_count").alias("meta_total"))


q("stream_measure_restate", f"""
with c as (select *, case when observed_at >= timestamp '{_SPLIT}' then 0 else 1 end as batch from ({O.env_sql('copilot_usage')}) e),
n as (select * from c qualify row_number() over (partition by tenant_id, tool, name, subject_id, period_start
      order by observed_at desc, batch, raw_record_id) = 1),
f as (select * from c qualify row_number() over (partition by tenant_id, tool, name, subject_id, period_start
      order by batch, raw_record_id) = 1)
select n.tenant_id, n.tool, n.name, n.subject_id, n.period_start, f.subject_type, f.source_key, n.occurred_at,
  n.period_end, n.observed_at, n.raw_record_id, n.meta_total
from n join f using (tenant_id, tool, name, subject_id, period_start)""")(_l3)


def _event_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    ev = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return ev.select(F.concat(F.lit("t"), (F.col("user_id") % 4).cast("string")).alias("tenant_id"),
                     "event_type", F.col("ts").cast("timestamp").alias("ts"))


def _final(spark, windows, name):
    """The windows that became final, from the files they were written to."""
    base = scratch_path(spark, f"{name}-{_uuid.uuid4().hex}")
    L.write_final(windows, f"{base}/out", f"{base}/_ckpt").awaitTermination()
    return spark.read.schema(windows.schema).parquet(f"{base}/out")


def _l4(spark, sf):
    """Every day of the table, open ones too; events without a time under a NULL day."""
    base = scratch_path(spark, f"l4-{_uuid.uuid4().hex}")
    for name, counts in (("days", L.stream_daily_counts), ("undated", L.stream_undated_counts)):
        windows = counts(_event_stream(spark, sf), "ts", ["tenant_id", "event_type"])
        L.write_counts(windows, f"{base}/out", f"{base}/_ckpt-{name}").awaitTermination()
    table = L.count_table(spark, f"{base}/out")
    rows = table.read() if table.manifest()["number"] else spark.createDataFrame([], windows.schema)
    return rows.select(*windows.columns)


q("stream_daily_counts", """
select 't' || cast(user_id % 4 as varchar) as tenant_id, event_type, cast(ts as date) as activity_date,
  count(*) as n from events group by 1, 2, 3""")(_l4)
#: With one day of lateness, windows that end a day before the newest event are final.
q("stream_rolling_counts", """
with r as (select 't' || cast(user_id % 4 as varchar) as tenant_id, event_type, ts from events),
b as (select cast(min(ts) as date) as low, max(ts) as high from events),
s as (select cast(gs as date) as step_date from (select unnest(generate_series(cast(low as timestamp), high, interval 1 day)) as gs from b))
select r.tenant_id, r.event_type, s.step_date, 'rolling_7d' as grain, count(*) as n
from s join r on r.ts > s.step_date + interval 1 day - interval 7 day and r.ts < s.step_date + interval 1 day
where s.step_date + interval 2 day <= (select high from b)
group by 1, 2, 3""")(
    lambda s, sf: _final(s, L.stream_rolling_counts(_event_stream(s, sf), "ts", ["tenant_id", "event_type"], 7), "l5"))
