"""Plan-shape checks: the shapes chosen for scale stay in place."""

import pytest

BAD = ["BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython"]
SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def qs():
    import __spark_entry__ as E
    return E.queries()


@pytest.mark.parametrize("key", ["win_rolling_simple", "win_rolling_ratio", "metric_cycle_time_trailing_30d",
                                 "metric_mttr", "dim_grouping_sets", "entity_pull_request", "mart_review_latency",
                                 "stg_pull_requests", "link_identity", "srv_me_review_latency", "enrolled_metric"])
def test_no_nested_loops_or_python(spark, qs, key):
    plan = _plan(qs[key](spark, SF))
    assert not [b for b in BAD if b in plan]


def test_rolling_window_is_an_explode_not_a_range_join(spark, qs):
    plan = _plan(qs["metric_cycle_time_trailing_30d"](spark, SF))
    assert "Generate explode(" in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("key", ["latest_snapshot", "stg_pull_requests", "stg_reviews", "stg_linear_description_edits",
                                 "latest_payload_by_login", "srv_me_pr_activity"])
def test_latest_snapshot_aggregates_numbers_only(spark, qs, key):
    """Partial hash aggregation of an order number; no payload is sorted before an aggregate or a join."""
    plan = _plan(qs[key](spark, SF))
    assert "partial_max(_order" in plan and "SortAggregate" not in plan and "max_by" not in plan
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("key", ["mart_pr_cycle_time", "mart_review_latency", "msr_percentile", "msr_interval_median", "msr_interval_percentile",
                                 "metric_cycle_time", "metric_cycle_time_p90", "metric_review_latency", "metric_cycle_time_trailing_30d",
                                 "srv_me_cycle_time", "srv_me_review_latency", "win_rolling_simple", "enrolled_metric", "metric_union"])
def test_no_percentile_buffers(spark, qs, key):
    assert "percentile(" not in _plan(qs[key](spark, SF))


def test_parquet_scan_is_pruned(spark, qs):
    plan = _plan(qs["metric_cycle_time"](spark, SF))
    # orders is read with only the columns the metric needs
    assert "o_totalprice" not in plan
