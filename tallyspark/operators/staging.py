"""Latest-snapshot staging models over the raw landing table.

Each model: partition-pruning filter on (source, resource_type), the
pre-filters that must precede the dedupe, ``latest_landed`` on
(tenant_id, natural id) carrying only the payload, then JSON projection.
Payloads are parsed once per row for the key and pre-filters (before the
dedupe) and once per surviving key for the projection (after it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.jsonx import has_key, with_json
from tallyspark.functions.pgcompat import epoch_seconds, org_repo, revert_title
from tallyspark.operators.snapshot import latest_landed

P = "payload"


def _keyed_rows(raw: DataFrame, source: str, resource: str, id_path: str, extra=None) -> DataFrame:
    """Landed rows of one resource as (tenant_id, _key, fetched_at, id, _ok)."""
    r = raw.where((F.col("source") == source) & (F.col("resource_type") == resource))

    def build(g):
        ok = g(id_path).isNotNull()
        if extra is not None:
            ok = ok & extra(g)
        return [F.col("tenant_id"), g(id_path).alias("_key"), F.col("fetched_at"), F.col("id"), ok.alias("_ok")]
    return with_json(r, P, build)


def _staged(raw: DataFrame, source: str, resource: str, id_path: str, extra=None) -> DataFrame:
    """Filter, key and dedupe; returns (tenant_id, _key, payload, fetched_at).

    ``raw`` may also be a snapshot state (see ``snapshot_state``): it carries
    ``_key`` already and is passed through unchanged."""
    if "_key" in raw.columns:
        return raw
    rows = _keyed_rows(raw, source, resource, id_path, extra)
    landed = raw.where((F.col("source") == source) & (F.col("resource_type") == resource))
    return latest_landed(landed, rows, ["tenant_id", "_key"], "_ok")


def _project(s: DataFrame, key_name: str, build) -> DataFrame:
    return with_json(s, P, lambda g: [F.col("tenant_id"), F.col("_key").alias(key_name), *build(g),
                                      F.col("fetched_at")])


def ts(g, path) -> Column:
    return g(path).cast("timestamp")


def repo_of(g) -> Column:
    return org_repo(g("org"), g("repo"))


def stg_pull_requests(raw: DataFrame) -> DataFrame:
    def build(g):
        created, merged = ts(g, "created_at"), ts(g, "merged_at")
        return [
            g("number").cast("int").alias("pr_number"), g("title").alias("title"), g("state").alias("state"),
            created.alias("created_at"), ts(g, "closed_at").alias("closed_at"), merged.alias("merged_at"),
            F.when(merged.isNotNull() & created.isNotNull(),
                   epoch_seconds(merged, created) / F.lit(3600.0)).alias("cycle_time_hours"),
            revert_title(g("title")).alias("is_revert"),
            g("user.login").alias("author_login"),
            F.coalesce(g("base.repo.full_name"), repo_of(g)).alias("repo"),
        ]
    return _project(_staged(raw, "github", "pull_requests", "node_id"), "pr_node_id", build)


def stg_reviews(raw: DataFrame) -> DataFrame:
    pre = lambda g: g("submitted_at").isNotNull() & (F.coalesce(g("state"), F.lit("")) != "PENDING")
    return _project(_staged(raw, "github", "reviews", "node_id", pre), "review_node_id", lambda g: [
        g("id").cast("bigint").alias("review_id"), g("state").alias("state"),
        ts(g, "submitted_at").alias("submitted_at"), g("user.login").alias("reviewer_login"),
        g("pull_request_number").cast("int").alias("pull_request_number"), repo_of(g).alias("repo")])


def stg_releases(raw: DataFrame) -> DataFrame:
    return _project(_staged(raw, "github", "releases", "node_id"), "release_node_id", lambda g: [
        g("id").cast("bigint").alias("release_id"), g("tag_name").alias("tag_name"),
        g("name").alias("release_name"),
        F.coalesce(g("draft").cast("boolean"), F.lit(False)).alias("is_draft"),
        F.coalesce(g("prerelease").cast("boolean"), F.lit(False)).alias("is_prerelease"),
        ts(g, "created_at").alias("created_at"), ts(g, "published_at").alias("published_at"),
        g("author.login").alias("author_login"), repo_of(g).alias("repo")])


def stg_issues(raw: DataFrame) -> DataFrame:
    # GitHub lists pull requests as issues too; those carry a `pull_request` key.
    pre = lambda g: ~has_key(P, "pull_request")
    return _project(_staged(raw, "github", "issues", "node_id", pre), "issue_node_id", lambda g: [
        g("number").cast("int").alias("issue_number"), g("title").alias("title"), g("state").alias("state"),
        g("state_reason").alias("state_reason"), ts(g, "created_at").alias("created_at"),
        ts(g, "updated_at").alias("updated_at"), ts(g, "closed_at").alias("closed_at"),
        g("user.login").alias("author_login"), g("assignee.login").alias("assignee_login"),
        g("html_url").alias("html_url"), repo_of(g).alias("repo")])


def stg_issue_comments(raw: DataFrame) -> DataFrame:
    pre = lambda g: g("created_at").isNotNull()
    return _project(_staged(raw, "github", "issue_comments", "node_id", pre), "comment_node_id", lambda g: [
        g("id").cast("bigint").alias("comment_id"), ts(g, "created_at").alias("created_at"),
        ts(g, "updated_at").alias("updated_at"), g("user.login").alias("author_login"),
        g("issue_number").cast("int").alias("issue_number"), repo_of(g).alias("repo")])


def stg_review_comments(raw: DataFrame) -> DataFrame:
    pre = lambda g: g("created_at").isNotNull()
    s = _staged(raw, "github", "pull_request_review_comments", "node_id", pre)
    return _project(s, "comment_node_id", lambda g: [
        g("id").cast("bigint").alias("comment_id"), ts(g, "created_at").alias("created_at"),
        ts(g, "updated_at").alias("updated_at"), g("user.login").alias("author_login"),
        g("pull_request_number").cast("int").alias("pull_request_number"),
        g("pull_request_review_id").cast("bigint").alias("pull_request_review_id"),
        g("path").alias("file_path"), repo_of(g).alias("repo")])


def stg_workflow_runs(raw: DataFrame) -> DataFrame:
    return _project(_staged(raw, "github", "workflow_runs", "node_id"), "run_node_id", lambda g: [
        g("id").cast("bigint").alias("run_id"), g("name").alias("workflow_name"), g("status").alias("run_status"),
        g("conclusion").alias("conclusion"), g("event").alias("trigger_event"),
        g("run_number").cast("int").alias("run_number"), ts(g, "created_at").alias("created_at"),
        ts(g, "updated_at").alias("updated_at"),
        F.coalesce(g("actor.login"), g("triggering_actor.login")).alias("actor_login"),
        g("head_branch").alias("head_branch"), g("head_sha").alias("head_sha"), repo_of(g).alias("repo")])


def _person(g, path: str, *fields: str) -> Column:
    return F.coalesce(*[g(f"{path}.{f}") for f in fields])


def stg_linear_issues(raw: DataFrame) -> DataFrame:
    return _project(_staged(raw, "linear", "issues", "id"), "issue_id", lambda g: [
        g("identifier").alias("identifier"), g("title").alias("title"), g("state.name").alias("state_name"),
        g("state.type").alias("state_type"), ts(g, "createdAt").alias("created_at"),
        ts(g, "updatedAt").alias("updated_at"), ts(g, "completedAt").alias("completed_at"),
        ts(g, "canceledAt").alias("canceled_at"), g("priority").cast("int").alias("priority"),
        g("estimate").cast("decimal(18,4)").alias("estimate"), g("url").alias("url"),
        g("team.key").alias("team_key"),
        _person(g, "creator", "email", "displayName", "name").alias("creator"),
        _person(g, "assignee", "email", "displayName", "name").alias("assignee")])


def stg_linear_comments(raw: DataFrame) -> DataFrame:
    return _project(_staged(raw, "linear", "comments", "id"), "comment_id", lambda g: [
        ts(g, "createdAt").alias("created_at"), ts(g, "updatedAt").alias("updated_at"),
        ts(g, "editedAt").alias("edited_at"), F.coalesce(g("issueId"), g("issue.id")).alias("issue_id"),
        g("issue.identifier").alias("issue_identifier"),
        F.coalesce(g("projectId"), g("project.id")).alias("project_id"),
        F.coalesce(g("user.id"), g("user.email"), g("externalUser.id")).alias("author_id")])


def stg_linear_projects(raw: DataFrame) -> DataFrame:
    return _project(_staged(raw, "linear", "projects", "id"), "project_id", lambda g: [
        g("name").alias("project_name"), g("url").alias("url"), ts(g, "createdAt").alias("created_at"),
        ts(g, "updatedAt").alias("updated_at"), ts(g, "startedAt").alias("started_at"),
        ts(g, "completedAt").alias("completed_at"), ts(g, "canceledAt").alias("canceled_at"),
        g("status.name").alias("status_name"), g("status.type").alias("status_type"),
        F.coalesce(g("lead.id"), g("lead.email")).alias("lead_id")])


def stg_linear_description_edits(raw: DataFrame) -> DataFrame:
    # An edit flagged false must not shadow an older true one: filter first.
    pre = lambda g: F.coalesce(g("updatedDescription").cast("boolean"), F.lit(False))
    s = _staged(raw, "linear", "issue_description_edits", "id", pre)
    return _project(s, "edit_id", lambda g: [
        ts(g, "createdAt").alias("edited_at"), F.coalesce(g("issue.id"), g("issueId")).alias("issue_id"),
        g("issue.identifier").alias("issue_identifier"),
        F.coalesce(g("descriptionUpdatedBy[0].id"), g("actor.id"), g("actor.email")).alias("editor_id")])


STAGING = {
    "pull_requests": stg_pull_requests,
    "reviews": stg_reviews,
    "releases": stg_releases,
    "issues": stg_issues,
    "issue_comments": stg_issue_comments,
    "pull_request_review_comments": stg_review_comments,
    "workflow_runs": stg_workflow_runs,
    "linear_issues": stg_linear_issues,
    "linear_comments": stg_linear_comments,
    "linear_projects": stg_linear_projects,
    "linear_description_edits": stg_linear_description_edits,
}


# --- incremental staging ------------------------------------------------------------------
# Model -> (source, resource_type, natural id path, pre-filter).
STATE_SPECS = {
    "pull_requests": ("github", "pull_requests", "node_id", None),
    "reviews": ("github", "reviews", "node_id",
                lambda g: g("submitted_at").isNotNull() & (F.coalesce(g("state"), F.lit("")) != "PENDING")),
    "releases": ("github", "releases", "node_id", None),
    "issues": ("github", "issues", "node_id", lambda g: ~has_key(P, "pull_request")),
    "issue_comments": ("github", "issue_comments", "node_id", lambda g: g("created_at").isNotNull()),
    "pull_request_review_comments": ("github", "pull_request_review_comments", "node_id",
                                     lambda g: g("created_at").isNotNull()),
    "workflow_runs": ("github", "workflow_runs", "node_id", None),
    "linear_issues": ("linear", "issues", "id", None),
    "linear_comments": ("linear", "comments", "id", None),
    "linear_projects": ("linear", "projects", "id", None),
    "linear_description_edits": ("linear", "issue_description_edits", "id",
                                 lambda g: F.coalesce(g("updatedDescription").cast("boolean"), F.lit(False))),
}


def snapshot_state(raw: DataFrame, model: str) -> DataFrame:
    """The latest raw snapshot per key of one staging model (before projection):
    (tenant_id, _key, payload, fetched_at, id). Persist it; later runs merge
    only newly landed rows into it with ``merge_state``."""
    source, rtype, id_path, pre = STATE_SPECS[model]
    return _staged(raw, source, rtype, id_path, pre)


def merge_state(state: DataFrame, new_raw: DataFrame, model: str) -> DataFrame:
    """Incremental dedupe: newest of (current state, new landings) per key.

    Work is proportional to keys + new rows, not to the whole landing history;
    the result equals ``snapshot_state`` over all raw rows (same ordering and
    tie-break, pre-filters applied to the new rows before they compete)."""
    source, rtype, id_path, pre = STATE_SPECS[model]
    new = _keyed_rows(new_raw, source, rtype, id_path, pre)
    old = state.select("tenant_id", "_key", "fetched_at", "id", F.lit(True).alias("_ok"))
    landed = new_raw.where((F.col("source") == source) & (F.col("resource_type") == rtype))
    both = [d.select("tenant_id", P, "fetched_at", "id") for d in (state, landed)]
    return latest_landed(both[0].unionByName(both[1]), old.unionByName(new), ["tenant_id", "_key"], "_ok")


def stage_from_state(state: DataFrame, model: str) -> DataFrame:
    """Project a snapshot state into the staging model's columns."""
    return STAGING[model](state)
