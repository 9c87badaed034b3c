"""Records -> marts as one batch run (the scheduled rebuild of the reference).

``build_marts`` stages every resource from one raw landing table, builds the
canonical entities and all daily marts, and returns them as DataFrames.
Staging outputs read by several marts are written to the shared folder so
each is computed once. ``write_marts`` publishes them with the tenant-slice
sink (or a full refresh when ``tenants`` is None). ``rebuild`` does both, and
``publish_metrics`` the same for metric values; neither leaves intermediates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyspark.operators import entities as C
from tallyspark.operators import marts as D
from tallyspark.operators import staging as S
from tallyspark.plans import org
from tallyspark.plans.spec import Metric
from tallyspark.session import intermediates, written
from tallyspark.sources import sinks as SK

SHARED_STAGING = ("pull_requests", "reviews", "issues", "linear_issues", "releases")


def build_marts(raw: DataFrame, tenants=None, checkpoint: bool = True) -> dict[str, DataFrame]:
    """All staging models, entities and daily marts for ``tenants`` (or all)."""
    if tenants is not None:
        from pyspark.sql import functions as F
        raw = raw.where(F.col("tenant_id").isin(list(tenants)))
    stg = {name: fn(raw) for name, fn in S.STAGING.items()}
    if checkpoint:
        for name in SHARED_STAGING:
            stg[name] = written(stg[name], f"stg-{name}")
    prs, reviews = stg["pull_requests"], stg["reviews"]
    out = {f"stg_{k}": v for k, v in stg.items()}
    out.update({
        "pull_request": C.entity_pull_request(prs, reviews),
        "release": C.entity_release(stg["releases"]),
        "review": C.entity_review(reviews),
        "fct_pr_activity_daily": D.mart_pr_activity(prs),
        "fct_pr_cycle_time_daily": D.mart_pr_cycle_time(prs),
        "fct_review_latency_daily": D.mart_review_latency(prs, reviews),
        "fct_change_failure_daily": D.mart_change_failure(prs),
        "fct_deployment_frequency_daily": D.mart_deployment_frequency(stg["releases"]),
        "fct_review_comments_daily": D.mart_review_comments(stg["pull_request_review_comments"]),
        "fct_workflow_runs_daily": D.mart_workflow_runs(stg["workflow_runs"]),
        "fct_ticket_activity_daily": D.mart_ticket_activity(stg["issues"], stg["linear_issues"]),
        "fct_ticket_comments_daily": D.mart_ticket_comments(stg["issue_comments"], stg["linear_comments"]),
        "fct_project_activity_daily": D.mart_project_activity(stg["linear_projects"]),
        "fct_ticket_description_edits_daily": D.mart_description_edits(stg["linear_description_edits"]),
        "fct_tickets": D.fct_tickets(stg["issues"], stg["linear_issues"]),
    })
    return out


def write_marts(marts: dict[str, DataFrame], base_path: str, tenants=None) -> None:
    """Publish every ``fct_*`` mart: tenant-slice replace, or full refresh."""
    for name, df in marts.items():
        if not name.startswith("fct_"):
            continue
        path = f"{base_path}/{name}"
        if tenants is None:
            SK.sink_full_refresh(df, path)
        else:
            SK.sink_mart_tenant_replace(df, path, list(tenants))


def rebuild(raw: DataFrame, base_path: str, tenants=None) -> None:
    """Records -> published marts of ``tenants`` (or of all)."""
    with intermediates():
        write_marts(build_marts(raw, tenants), base_path, tenants)


def publish_metrics(metrics: list[Metric], entities: dict[str, DataFrame], base: str, *, as_of, tenants=None, pairs=None, **kw) -> None:
    """Compute ``metrics`` together and publish all of their rows as one version, of ``tenants`` only if given."""
    scope = {} if tenants is None else {"tenants": list(tenants)}
    with intermediates():
        if pairs is None:
            values = org.metric_values(metrics, entities, as_of=as_of, **scope, **kw)
        else:
            values = org.compute_enrolled(metrics, entities, pairs, as_of=as_of, **scope, **kw)
        SK.sink_metrics_swap(values, base, [m.id for m in metrics], tenants)
