"""Spine, enrollment, shared plans, preview, stage
counts and individual-contributor visibility.

Per-tenant configuration (enrollment, parameter values) is a DataFrame keyed
by tenant_id. It is joined, never collected: one job serves every tenant,
and a tenant's own parameter values arrive as columns for its predicates.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.plans import compile as CP
from tallyspark.plans.fused import compute_fused, fusable
from tallyspark.plans.predicates import to_column
from tallyspark.plans.spec import GRAINS, Metric, definition_version
from tallyspark.session import written


def step_spine(df: DataFrame, time_col: str, horizon_days: int = 730) -> DataFrame:
    """Day steps for the last ``horizon_days`` up to the data's last day,
    plus week steps (distinct Mondays of those days; the first may precede)."""
    b = df.agg(F.max(F.to_date(F.col(time_col))).alias("hi"))
    days = b.select(F.explode(F.sequence(F.date_sub("hi", horizon_days), F.col("hi"))).alias("step_date"))
    day = days.select("step_date", F.lit("day").alias("step"))
    week = (days.select(F.date_trunc("week", "step_date").cast("date").alias("step_date")).distinct()
            .select("step_date", F.lit("week").alias("step")))
    return day.unionByName(week)


def enrolled_pairs(enrollment: DataFrame, standard_ids: list[str]) -> DataFrame:
    """(tenant_id, metric_id) each tenant gets.

    enrollment columns: tenant_id, mode ('default_on' | 'explicit'),
    enabled, disabled, custom (array<string>, may be NULL).
    """
    std = F.array(*[F.lit(i) for i in standard_ids])
    empty = F.array().cast("array<string>")
    ids = F.when(F.col("mode") == "explicit",
                 F.array_intersect(F.coalesce("enabled", empty), std)) \
           .otherwise(F.array_except(std, F.coalesce("disabled", empty)))
    allm = F.array_union(ids, F.coalesce("custom", empty))
    return enrollment.select("tenant_id", F.explode(allm).alias("metric_id"))


def materialize(entities: dict, metrics: list[Metric]) -> dict:
    """Write every entity read by two or more of ``metrics`` to the shared folder, so it is computed once per run and a
    lost executor recomputes from the files rather than from the raw landing. Readers take only the columns they need."""
    uses: dict[str, int] = {}
    for m in metrics:
        for e in {op.entity for _, op, _ in CP.inputs_of(m)}:
            uses[e] = uses.get(e, 0) + 1
    return {e: written(df, f"entity-{e}") if uses.get(e, 0) > 1 else df for e, df in entities.items()}


def _all_values(metrics: list[Metric], entities: dict, pairs: DataFrame | None, *, as_of, **kw) -> DataFrame:
    """Metrics that can share a pass do; the others are computed one by one."""
    together = [m for m in metrics if fusable(m)]
    alone = [m for m in metrics if not fusable(m)]
    if alone:
        entities = materialize(entities, [*alone, *together[:1]])
    outs = [compute_fused(together, entities, as_of=as_of, pairs=pairs, **kw)] if together else []
    for m in alone:
        t = None if pairs is None else pairs.where(F.col("metric_id") == m.id).select("tenant_id").distinct()
        outs.append(CP.compute_metric(m, entities, as_of=as_of, tenant_params=t, **kw))
    return CP.metric_union(outs)


def metric_values(metrics: list[Metric], entities: dict, *, as_of, **kw) -> DataFrame:
    """The fact table for ``metrics`` (G20): one scan of each entity for all that can share it."""
    return _all_values(metrics, entities, None, as_of=as_of, **kw)


def compute_enrolled(metrics: list[Metric], entities: dict, pairs: DataFrame, *, as_of, **kw) -> DataFrame:
    """Every metric, for its enrolled tenants only."""
    return _all_values(metrics, entities, pairs, as_of=as_of, **kw)


def compute_shared(metric: Metric, entities: dict, tenant_values: DataFrame, *, as_of, **kw) -> DataFrame:
    """G23 + E18: one job for all tenants of ``metric`` whatever their params.

    ``tenant_values`` has tenant_id and one column per declared param (NULL =
    default). Each param becomes a predicate against the tenant's own column;
    the definition version folds in the tenant's bound values.
    """
    base_version = definition_version(metric)
    cols, filters, tags = [F.col("tenant_id")], [], []
    for p in metric.params:
        c = F.col(p.name)
        if p.has_default:
            c = F.coalesce(c, F.lit(p.default))
        cols.append(c.alias(f"_p_{p.name}"))
        filters.append({"field": p.field, "op": p.op, "value_col": f"_p_{p.name}"})
        tags.append(F.col(f"_p_{p.name}").cast("string"))
    bound = metric.with_(filters=tuple(metric.filters) + tuple(filters), params=())
    tv = tenant_values.select(*cols)
    out = CP.compute_metric(bound, entities, as_of=as_of, tenant_params=tv, version=base_version, **kw)
    ver = (tv.select("tenant_id", F.substring(F.sha2(F.concat_ws(":", F.lit(base_version), *tags), 256), 1, 12)
                     .alias("_ver")))
    return (out.join(ver, "tenant_id").withColumn("definition_version", F.col("_ver")).drop("_ver")
            .select(*CP.output_columns(metric)))


def preview(metric: Metric, entities: dict, *, as_of, days: int = 90, row_limit: int = 500, **kw) -> DataFrame:
    """Coarsest grain only, no windows, last ``days`` days, at most
    ``row_limit`` rows in a fixed order. A window-only metric shows the latest step of each window."""
    as_of_ts = CP._as_ts(as_of)
    since = as_of_ts - dt.timedelta(days=days)
    if metric.grains:
        coarse = max(metric.grains, key=GRAINS.index)
        m = metric.with_(grains=(coarse,), windows=())
        out = CP.compute_metric(m, entities, as_of=as_of, since=since, **kw)
    else:
        out = CP.compute_metric(metric, entities, as_of=as_of, **(kw | {"horizon_days": 0}))
        out = out.where(F.col("bucket_end") == F.lit(as_of_ts + dt.timedelta(days=1)))
    dims = [c for c in out.columns if c.startswith("dim_")]
    return (out.where(F.col("bucket_start") >= F.lit(since))
            .orderBy("bucket_start", "tenant_id", *dims, "is_total").limit(row_limit))


def stage_counts(metric: Metric, entities: dict, *, as_of, **kw) -> DataFrame:
    """Rows left after each stage, to find where rows vanish.

    Entity-side stages are counted in one pass with conditional counts, over the
    rows and conditions that the metric itself uses (tenants, mappings, excluded
    labels); the output side counts rows per block of the computed metric.
    """
    stages = []
    scope = {k: kw.get(k) for k in ("tenants", "mappings", "tenant_params")}
    excluded = CP._dim_columns(metric, scope["mappings"])[1]
    for name, op, extra in CP.inputs_of(metric):
        base = CP.input_rows(entities[op.entity], metric, **scope)
        conds = [("entity", F.lit(True))]
        f = reduce(lambda a, b: a & b, [to_column(x, base.schema) for x in list(op.filters) + list(extra)], F.lit(True))
        conds.append(("filtered", f))
        conds.append((f"{name}_rows", CP._operand_cond(op, extra, excluded, base.schema)))
        agg = base.agg(*[F.count_if(c).alias(s) for s, c in conds])
        stages.append(agg.select(F.explode(F.array(*[
            F.struct(F.lit(f"{name}:{s}").alias("stage"), F.col(s).cast("bigint").alias("row_count"))
            for s, _ in conds])).alias("x")).select("x.*"))
    out = CP.compute_metric(metric, entities, as_of=as_of, **kw)
    blocks = out.groupBy(F.concat(F.lit("block:"), F.col("grain")).alias("stage")).agg(
        F.count(F.lit(1)).alias("row_count"))
    final = out.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit("final").alias("stage"), "row_count")
    return reduce(lambda a, b: a.unionByName(b), stages + [blocks, final])


def ic_rows(values: DataFrame, identities: DataFrame, person_dims: list[str]) -> DataFrame:
    """Metric rows visible to each caller under ``visibility: ic``.

    identities: (tenant_id, caller, key) — every id/login of each caller.
    A row is visible to a caller when one of its person dims equals one of the
    caller's keys; rows of a metric without person dims come once, with a null
    caller: everyone may see them.
    Equi-joins only (one per person dim), so no pairs are formed per tenant.
    """
    if not person_dims:
        return values.withColumn("caller", F.lit(None).cast(identities.schema["caller"].dataType))
    parts = []
    for d in person_dims:
        ids = identities.select("tenant_id", "caller", F.col("key").alias(f"dim_{d}")).distinct()
        parts.append(values.join(ids, ["tenant_id", f"dim_{d}"]))
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()
