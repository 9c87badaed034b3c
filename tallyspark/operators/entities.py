"""Canonical entities.

First review per PR joins reviews on (tenant, PR number, repo), the repo being
equal or NULL on both sides, where the reviewer is not the author. Reviews are first collapsed to one row
per (tenant, repo, PR number, reviewer) with (min submitted_at, count): a PR
with a huge review thread shuffles one row per distinct reviewer, not one per
review.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PR_KEY = ["tenant_id", "pr_number", "pr_node_id"]


def first_review_join(prs: DataFrame, reviews: DataFrame, how: str = "left",
                      carry: list[str] | None = None) -> DataFrame:
    """Per PR: min(submitted_at) and count of non-author reviews.

    ``carry`` lists PR columns kept on the output (unique per PR key).
    """
    carry = [c for c in (carry or []) if c not in PR_KEY]
    per_reviewer = (reviews
                    .groupBy("tenant_id", "repo", "pull_request_number", "reviewer_login")
                    .agg(F.min("submitted_at").alias("_first"),
                         F.count("review_node_id").alias("_n"))
                    .withColumnRenamed("tenant_id", "_r_tenant")
                    .withColumnRenamed("repo", "_r_repo"))
    p = prs.select(*PR_KEY, *[c for c in {"repo", "author_login", *carry} if c not in PR_KEY])
    cond = ((p.tenant_id == per_reviewer._r_tenant)
            & (p.pr_number == per_reviewer.pull_request_number)
            & per_reviewer._r_repo.eqNullSafe(p.repo)
            & (p.author_login.isNull() | ~per_reviewer.reviewer_login.eqNullSafe(p.author_login)))
    j = p.join(per_reviewer, cond, how)
    return (j.groupBy(*PR_KEY)
            .agg(F.min("_first").alias("first_review_at"),
                 F.coalesce(F.sum("_n"), F.lit(0)).cast("int").alias("review_count"),
                 *[F.any_value(c).alias(c) for c in carry]))


def pr_first_review(prs: DataFrame, reviews: DataFrame) -> DataFrame:
    """(tenant_id, pr_node_id, first_review_at, review_count); unreviewed PRs kept."""
    return first_review_join(prs, reviews).select(
        "tenant_id", "pr_node_id", "first_review_at", "review_count")


ENTITY_COLS = ["tenant_id", "id", "repo", "author_id", "state", "additions", "deletions",
               "review_count", "is_revert", "opened_at", "first_review_at", "merged_at",
               "closed_at", "fetched_at"]


def entity_pull_request(prs: DataFrame, reviews: DataFrame) -> DataFrame:
    """Canonical pull_request entity (one row per PR)."""
    carry = ["repo", "author_login", "state", "is_revert", "created_at", "merged_at",
             "closed_at", "fetched_at"]
    fr = first_review_join(prs, reviews, "left", carry)
    return fr.select(
        "tenant_id",
        F.col("pr_node_id").alias("id"),
        "repo",
        F.col("author_login").alias("author_id"),
        F.when(F.col("merged_at").isNotNull(), "merged")
         .when(F.col("state") == "closed", "closed").otherwise("open").alias("state"),
        F.lit(None).cast("int").alias("additions"),
        F.lit(None).cast("int").alias("deletions"),
        "review_count",
        "is_revert",
        F.col("created_at").alias("opened_at"),
        "first_review_at",
        "merged_at",
        "closed_at",
        "fetched_at",
    )


def entity_release(stg_releases: DataFrame) -> DataFrame:
    """Release entity (projection)."""
    return stg_releases.select(
        "tenant_id", F.col("release_node_id").alias("id"), "repo", F.col("author_login").alias("author_id"),
        "tag_name", "release_name", "is_draft", "is_prerelease", "created_at", "published_at", "fetched_at")


def entity_review(stg_reviews: DataFrame) -> DataFrame:
    """C4: review entity with the catalog's names (``id``, ``reviewer_id``)."""
    return stg_reviews.select(
        "tenant_id", F.col("review_node_id").alias("id"), "review_id", "state", "submitted_at",
        F.col("reviewer_login").alias("reviewer_id"), "pull_request_number", "repo", "fetched_at")
