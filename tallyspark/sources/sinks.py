"""Mart and metric sinks.

All are versioned tables (``versions.py``): new slices are written in full beside the old ones and become visible
together, by one manifest. So a reader sees one version, a failed job changes nothing, and of two writers of the same
slice at once one raises ``Conflict``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.sources.versions import VersionedTable


def mart_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, ["tenant_id"])


def sink_full_refresh(df: DataFrame, path: str) -> int:
    """Rebuild every tenant; tenants without rows vanish, whatever the session's overwrite mode."""
    return mart_table(df.sparkSession, path).replace(df, lambda s: True)


def sink_mart_tenant_replace(df: DataFrame, path: str, tenants: list[str]) -> int:
    """Replace exactly the slices of ``tenants``; only these are written.

    Tenants in scope that produced no rows lose their slice, so a vanished day or tenant never stays stale. ``df`` may
    read ``path`` itself."""
    scope = set(tenants)
    return mart_table(df.sparkSession, path).replace(df.where(F.col("tenant_id").isin(sorted(scope))), lambda s: s[0] in scope)


def read_mart(spark: SparkSession, path: str) -> DataFrame:
    """The published rows of a mart."""
    return mart_table(spark, path).read()


def metric_table(spark: SparkSession, base: str) -> VersionedTable:
    return VersionedTable(spark, base, ["metric_id", "tenant_id"])


def sink_metric_swap(values: DataFrame, base: str, metric_id: str, tenants: list[str] | None = None) -> int:
    """Publish one metric's rows, of all tenants or of ``tenants`` only; other slices are neither read nor written.

    A metric with no rows still publishes (an empty version clears it)."""
    return sink_metrics_swap(values, base, [metric_id], tenants)


def sink_metrics_swap(values: DataFrame, base: str, metric_ids: list[str], tenants: list[str] | None = None) -> int:
    """A12 for several metrics, which become visible together."""
    ids = set(metric_ids)
    new = values.where(F.col("metric_id").isin(sorted(ids)))
    scope = None if tenants is None else set(tenants)
    if scope is not None:
        new = new.where(F.col("tenant_id").isin(sorted(scope)))
    return metric_table(values.sparkSession, base).replace(
        new, lambda s: s[0] in ids and (scope is None or s[1] in scope), marks=sorted(ids))


def read_metric_values(spark: SparkSession, base: str, metric_ids: list[str], missing_ok: bool = False) -> DataFrame:
    """The published fact table: the current rows of each metric.

    A metric that was never published is an error, unless ``missing_ok``."""
    table, wanted = metric_table(spark, base), set(metric_ids)
    published = wanted & set(table.manifest()["marks"])
    missing = sorted(wanted - published)
    if missing and not (missing_ok and published):
        raise LookupError(f"no published version of {', '.join(missing)}")
    return table.read(lambda s: s[0] in published)
