"""H1-H9: the shipped standard metrics, written out flat (no inheritance).

Fixed values: names, filters, grains and windows of the metrics below."""

from __future__ import annotations

from tallyspark.plans.spec import Measure, Metric, Window

MONTHLY = ("day", "week", "month")

MERGED_PRS = Metric(
    id="std.merged_prs", entity="pull_request", time_field="merged_at",
    measure=Measure("count"), filters=({"field": "merged_at", "op": "is_not_null"},), grains=MONTHLY)

REVERTED_PRS = Metric(
    id="std.reverted_prs", entity="pull_request", time_field="merged_at", measure=Measure("count"),
    filters=({"field": "merged_at", "op": "is_not_null"}, {"field": "is_revert", "op": "eq", "value": True}),
    grains=MONTHLY)

CHANGE_FAILURE_RATE = Metric(
    id="std.change_failure_rate", kind="ratio", numerator=REVERTED_PRS, denominator=MERGED_PRS,
    zero_denominator="null", grains=MONTHLY)

CYCLE_TIME = Metric(
    id="std.cycle_time", entity="pull_request", time_field="merged_at",
    measure=Measure("median", from_field="opened_at", to_field="merged_at"),
    filters=({"field": "merged_at", "op": "is_not_null"},), grains=MONTHLY)

CYCLE_TIME_P90 = CYCLE_TIME.with_(
    id="std.cycle_time_p90", measure=Measure("percentile", percentile=90.0, from_field="opened_at",
                                             to_field="merged_at"))

CYCLE_TIME_TRAILING_30D = CYCLE_TIME.with_(
    id="std.cycle_time_trailing_30d", grains=(), windows=(Window(30, "day"),))

DEPLOYMENT_FREQUENCY = Metric(
    id="std.deployment_frequency", entity="release", time_field="published_at", measure=Measure("count"),
    filters=({"field": "is_draft", "op": "eq", "value": False},
             {"field": "is_prerelease", "op": "eq", "value": False},
             {"field": "published_at", "op": "is_not_null"}),
    grains=MONTHLY)

REVIEW_LATENCY = Metric(
    id="std.review_latency", entity="pull_request", time_field="first_review_at",
    measure=Measure("median", from_field="opened_at", to_field="first_review_at"),
    filters=({"field": "first_review_at", "op": "is_not_null"},), grains=MONTHLY)

# Draft in the reference (no incident source); the one spec with dims + window.
MTTR = Metric(
    id="std.mttr", entity="incident", time_field="resolved_at",
    measure=Measure("avg", from_field="started_at", to_field="resolved_at"),
    filters=({"field": "resolved_at", "op": "is_not_null"},), grains=("week", "month"),
    windows=(Window(30, "day"),), dimensions=("service",))

STANDARD = {m.id: m for m in [MERGED_PRS, REVERTED_PRS, CHANGE_FAILURE_RATE, CYCLE_TIME, CYCLE_TIME_P90,
                              CYCLE_TIME_TRAILING_30D, DEPLOYMENT_FREQUENCY, REVIEW_LATENCY]}
