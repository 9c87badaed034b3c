"""Q1-Q7: data-quality checks; each returns violations (empty = pass) or a
one-pass summary, never a collected Python loop over rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Dimension cardinality thresholds (warn, error) per dimension.
CARDINALITY_WARN = 500
CARDINALITY_ERROR = 5000


def _unpivot(df: DataFrame, names: list[str], value_name: str) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).cast("bigint").alias(value_name)) for n in names])
    return df.select(F.explode(arr).alias("x")).select("x.*")


def dq_not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Q1: (column, null_rows) for each column, one pass; failing = null_rows > 0."""
    agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return _unpivot(agg, columns, "null_rows")


def dq_accepted_values(df: DataFrame, column: str, accepted: list) -> DataFrame:
    """Q2: values outside the accepted set, with counts (NULL is not checked)."""
    bad = df.where(F.col(column).isNotNull() & ~F.col(column).isin(list(accepted)))
    return bad.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("rows"))


def dq_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Q3: keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def dq_reconcile(expected: DataFrame, actual: DataFrame, keys: list[str], values: list[str],
                 tolerance: float | None = None) -> DataFrame:
    """Q4: rows missing on either side or whose values differ (null-safe;
    numeric values within ``tolerance`` count as equal)."""
    e = expected.select(*keys, *[F.col(v).alias(f"exp_{v}") for v in values], F.lit(True).alias("_e"))
    a = actual.select(*keys, *[F.col(v).alias(f"act_{v}") for v in values], F.lit(True).alias("_a"))
    j = e.join(a, keys, "full_outer")

    def differs(v) -> Column:
        x, y = F.col(f"exp_{v}"), F.col(f"act_{v}")
        if tolerance is None:
            return ~x.eqNullSafe(y)
        return (x.isNull() != y.isNull()) | (F.abs(x - y) > F.lit(tolerance))
    bad = F.col("_e").isNull() | F.col("_a").isNull() | reduce(lambda p, q: p | q, [differs(v) for v in values])
    return j.where(F.coalesce(bad, F.lit(True))).select(
        *keys, *[c for v in values for c in (f"exp_{v}", f"act_{v}")],
        F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "unexpected")
         .otherwise("different").alias("problem"))


def dq_dual_run(mart: DataFrame, metric_values: DataFrame, metric_id: str, tolerance: float = 1e-3) -> DataFrame:
    """Q5: hand-written daily cycle-time mart vs the declarative metric
    (hours x 3600 = seconds) — violations only."""
    m = mart.select("tenant_id", F.col("activity_date").alias("day"),
                    (F.col("median_cycle_time_hours") * 3600).alias("seconds"))
    v = (metric_values.where((F.col("metric_id") == metric_id) & (F.col("grain") == "day") & F.col("is_total"))
         .select("tenant_id", F.to_date("bucket_start").alias("day"), F.col("value").alias("seconds")))
    return dq_reconcile(m, v, ["tenant_id", "day"], ["seconds"], tolerance)


def dq_single_version(metric_values: DataFrame) -> DataFrame:
    """Q6: metrics whose rows mix definition versions."""
    return (metric_values.groupBy("metric_id")
            .agg(F.count_distinct("definition_version").alias("versions"))
            .where(F.col("versions") > 1))


def dq_cardinality(df: DataFrame, dims: list[str], warn: int = CARDINALITY_WARN,
                   error: int = CARDINALITY_ERROR, approx: bool = False) -> DataFrame:
    """Q7: measured distinct values per dimension with a warn / error level.

    Exact by default; ``approx`` uses HyperLogLog (fixed memory per column)."""
    fn = F.approx_count_distinct if approx else F.count_distinct
    agg = df.agg(*[fn(F.col(d)).alias(d) for d in dims])
    out = _unpivot(agg, dims, "distinct_values").withColumnRenamed("column", "dimension")
    n = F.col("distinct_values")
    return out.withColumn("level", F.when(n > error, "error").when(n > warn, "warn").otherwise("ok"))
