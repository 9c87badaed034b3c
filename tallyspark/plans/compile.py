"""F*, G*: compile a Metric spec into one DataFrame of metric values.

Plan shape (chosen here because Catalyst will not find it on its own):

* all inputs of a metric (the value, ratio operands, formula inputs) are read
  in ONE scan when they share an entity and time field, otherwise as a union;
  each row carries a match flag and a value per input, and a single
  aggregation computes every input with conditional aggregates — ratio and
  formula need no joins;
* all calendar grains come from one pass: each row explodes into its
  (grain, bucket) pairs and one grouping-sets aggregation produces detail
  rows per dimension plus the tenant total;
* rolling windows never join a step spine (a theta join, i.e. nested loops):
  each row explodes to the few steps whose window contains it, then an
  ordinary equi-aggregation runs. Additive measures are first reduced to one
  row per (tenant, dims, day, is-midnight) so the explode is over days, not
  events;
* exact percentiles are selected by rank (``operators.ranks``), so no task
  buffers a group's values, and rolling ones slide over days instead of
  exploding rows;
* where only windows are asked for, the days that no window reaches are cut
  off on the raw time column, which a file scan can skip.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.pgcompat import epoch_seconds
from tallyspark.operators.ranks import percentiles, rolling_percentiles
from tallyspark.plans import formula as FM
from tallyspark.plans.predicates import to_column
from tallyspark.plans.spec import Metric, Window, definition_version

KNOWN_DIMS = ("repo", "team")
ADDITIVE = ("count", "sum", "avg", "min", "max")
INTERVALS = {"day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAYS",
             "month": "INTERVAL 1 MONTH", "quarter": "INTERVAL 3 MONTHS"}
OUT_HEAD = ["tenant_id", "metric_id", "definition_version", "grain", "bucket_start", "bucket_end",
            "is_complete", "is_total"]
OUT_TAIL = ["value", "numerator", "denominator"]


def plan_dims(metric: Metric) -> list[str]:
    return list(KNOWN_DIMS) + [d for d in metric.dimensions if d not in KNOWN_DIMS]


def output_columns(metric: Metric) -> list[str]:
    return OUT_HEAD + [f"dim_{d}" for d in plan_dims(metric)] + OUT_TAIL


def _as_ts(as_of) -> dt.datetime:
    if isinstance(as_of, str):
        as_of = dt.datetime.fromisoformat(as_of)
    if isinstance(as_of, dt.date) and not isinstance(as_of, dt.datetime):
        as_of = dt.datetime(as_of.year, as_of.month, as_of.day)
    return as_of


def inputs_of(metric: Metric) -> list[tuple[str, Metric, tuple]]:
    if metric.kind == "simple":
        return [("value", metric, ())]
    if metric.kind == "ratio":
        return [("num", metric.numerator, tuple(metric.numerator_filters)),
                ("den", metric.denominator, tuple(metric.denominator_filters))]
    return [(n, m, ()) for n, m in metric.inputs]


def _operand_cond(op: Metric, extra: tuple, mapped_excl: list[Column], schema=None) -> Column:
    conds = [to_column(f, schema) for f in list(op.filters) + list(extra)]
    m = op.measure
    if m.is_interval:
        # rows with either end NULL are dropped; F11: negative excluded by default
        conds += [F.col(m.from_field).isNotNull(), F.col(m.to_field).isNotNull()]
        if m.negative == "exclude":
            conds.append(F.col(m.to_field) >= F.col(m.from_field))
    conds += mapped_excl
    conds.append(F.col(op.time_field).isNotNull())
    return reduce(lambda a, b: a & b, conds)


def _operand_value(op: Metric) -> Column:
    m = op.measure
    if m.is_interval:
        v = epoch_seconds(F.col(m.to_field), F.col(m.from_field))
        if m.negative == "clamp_zero":           # F12
            v = F.greatest(v, F.lit(0.0))
        return v.cast("double")
    if m.agg == "count":
        return F.lit(1)
    return F.col(m.field)


def _dim_columns(metric: Metric, mappings: dict | None) -> tuple[list[Column], list[Column]]:
    """Dim columns (NULL coalesced to '' before grouping) and exclude-conditions."""
    mapped = {m.name: m for m in metric.mapped}
    cols, excl = [], []
    for d in plan_dims(metric):
        if d not in metric.dimensions:
            cols.append(F.lit("").alias(f"dim_{d}"))
            continue
        if d in mapped:
            md = mapped[d]
            if mappings and d in mappings:       # large mapping table: joined by caller
                lab = F.col(f"_map_{d}")
            else:                                # spec-sized mapping: JVM map literal
                kv = [x for pair in md.mapping for x in (F.lit(pair[0]), F.lit(pair[1]))]
                lab = F.try_element_at(F.create_map(*kv), F.col(md.from_field).cast("string"))
            if md.default == "exclude":
                excl.append(lab.isNotNull())
                cols.append(F.coalesce(lab, F.lit("")).alias(f"dim_{d}"))
            else:
                cols.append(F.coalesce(lab, F.lit(md.default)).alias(f"dim_{d}"))
        else:
            cols.append(F.coalesce(F.col(d).cast("string"), F.lit("")).alias(f"dim_{d}"))
    return cols, excl


def _join_mappings(df: DataFrame, metric: Metric, mappings: dict | None) -> DataFrame:
    """Mapping tables given as DataFrames (from_value, label): plain left join;
    AQE turns it into a broadcast at run time when the table is small."""
    for md in metric.mapped:
        if mappings and md.name in mappings and md.name in metric.dimensions:
            m = mappings[md.name].toDF("_mk", f"_map_{md.name}")
            df = df.join(m, F.col(md.from_field).cast("string") == F.col("_mk"), "left").drop("_mk")
    return df


def input_rows(base: DataFrame, metric: Metric, *, tenants=None, mappings: dict | None = None,
               tenant_params: DataFrame | None = None) -> DataFrame:
    """Entity rows that an input of ``metric`` sees, with mapping labels and tenant parameters joined."""
    if tenants is not None:                      # G21: pruned before anything else
        base = base.where(F.col("tenant_id").isin(list(tenants)))
    if tenant_params is not None:                # E18/G22/G23: enrollment + per-tenant params
        base = base.join(tenant_params, "tenant_id", "inner")
    return _join_mappings(base, metric, mappings)


def metric_rows(metric: Metric, entities: dict[str, DataFrame], *, tenants=None,
                mappings: dict | None = None, tenant_params: DataFrame | None = None, bounds: tuple | None = None) -> DataFrame:
    """Rows (tenant_id, _t, dim_*, _c<i>, _v<i>) for every input of ``metric``.

    ``bounds``: first time and time after the last that can count; either may be None. They are put on the raw
    time column, so that a file scan skips what lies outside.
    """
    ins = inputs_of(metric)
    groups: dict[tuple, list[int]] = {}
    for i, (_, op, _) in enumerate(ins):
        groups.setdefault((op.entity, op.time_field), []).append(i)
    parts = []
    for (entity, time_field), idx in groups.items():
        source = entities[entity]
        for edge, after in zip(bounds or (), (True, False)):
            if edge is not None:
                t = F.col(time_field).cast("timestamp")
                source = source.where(t >= F.lit(edge) if after else t < F.lit(edge))
        base = input_rows(source, metric, tenants=tenants, mappings=mappings, tenant_params=tenant_params)
        dims, excl = _dim_columns(metric, mappings)
        flags = []
        for i, (_, op, extra) in enumerate(ins):
            if i in idx:
                flags += [_operand_cond(op, extra, excl, base.schema).alias(f"_c{i}"),
                          _operand_value(op).cast("double").alias(f"_v{i}")]
            else:
                flags += [F.lit(False).alias(f"_c{i}"), F.lit(None).cast("double").alias(f"_v{i}")]
        any_c = reduce(lambda a, b: a | b, [F.col(f"_c{i}") for i in idx])
        part = (base.select("tenant_id", F.col(time_field).cast("timestamp").alias("_t"), *dims, *flags)
                .where(any_c))
        parts.append(part)
    return reduce(lambda a, b: a.unionByName(b), parts)


def _agg_expr(op: Metric, c: Column, v: Column) -> Column:
    m = op.measure
    x = F.when(c, v)
    meth = m.method
    if meth == "count":
        return F.count(x).cast("double")
    if meth == "count_distinct":
        return (F.approx_count_distinct(x) if m.approx else F.count_distinct(x)).cast("double")
    if meth in ("sum", "avg", "min", "max"):
        return getattr(F, meth)(x).cast("double")
    p = F.lit(m.pct / 100.0)
    if m.approx:
        return F.percentile_approx(x, p, F.lit(10000)).cast("double")
    raise ValueError("exact percentiles are selected by rank")


def _by_rank(metric: Metric) -> list[int]:
    """Inputs whose measure is an exact percentile."""
    return [i for i, (_, op, _) in enumerate(inputs_of(metric)) if op.measure.method == "percentile" and not op.measure.approx]


def _detail_and_total(df: DataFrame, active: list[str]) -> DataFrame:
    """Each row once for its dimensions and once for the tenant's total, as grouping sets do."""
    if not active:
        return df.withColumn("is_total", F.lit(True))
    dims = [f"dim_{d}" for d in active]
    sets = F.array(F.struct(*dims, F.lit(False).alias("is_total")),
                   F.struct(*[F.lit(None).cast(df.schema[d].dataType).alias(d) for d in dims], F.lit(True).alias("is_total")))
    return df.withColumn("_set", F.explode(sets)).select(*[c for c in df.columns if c not in dims], "_set.*")


def _joined_inputs(metric: Metric, agg: DataFrame | None, ranked: dict[int, DataFrame], keys: list[str]) -> DataFrame:
    """Aggregates of the other inputs (or none) with ``_a<i>`` and ``_n<i>`` of the ranked ones; keys may be NULL."""
    parts = [] if agg is None else [agg]
    n = len(inputs_of(metric))
    for i, r in ranked.items():
        parts.append(r.select(*keys, F.col("p0").alias(f"_a{i}"), F.col("rows").alias(f"_n{i}")))
    if len(parts) == 1:
        return parts[0]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return both.groupBy(*keys).agg(*[F.max(f"_a{i}").alias(f"_a{i}") for i in range(n)],
                                   *[F.coalesce(F.max(f"_n{i}"), F.lit(0)).alias(f"_n{i}") for i in range(n)])


def _aggregate(df: DataFrame, keys: list[Column], active: list[str], aggs: list[Column]) -> DataFrame:
    """Group by ``keys`` (+ active dims); with dims, grouping sets add the total."""
    if active:
        dimc = [F.col(f"dim_{d}") for d in active]
        is_total = reduce(lambda a, b: a & b, [F.grouping(c) == 1 for c in dimc])
        g = df.groupingSets([keys + dimc, keys], *keys, *dimc)
        return g.agg(*aggs, is_total.alias("is_total"))
    return df.groupBy(*keys).agg(*aggs, F.lit(True).alias("is_total"))


def _combine(metric: Metric, agg: DataFrame, n_inputs: int) -> DataFrame:
    a = {name: F.col(f"_a{i}") for i, (name, _, _) in enumerate(inputs_of(metric))}
    n = {name: F.col(f"_n{i}") for i, (name, _, _) in enumerate(inputs_of(metric))}
    nul = F.lit(None).cast("double")
    if metric.kind == "simple":
        return agg.select("*", a["value"].alias("value"), nul.alias("numerator"), nul.alias("denominator"))
    if metric.kind == "ratio":
        # the denominator drives the buckets; a missing numerator is 0
        num = F.coalesce(a["num"], F.lit(0.0))
        if metric.zero_denominator == "zero":    # F16
            val = F.when(a["den"] == 0, F.lit(0.0)).otherwise(F.try_divide(num, a["den"]))
        else:
            val = F.try_divide(num, a["den"])
        return (agg.where(n["den"] > 0)
                .select("*", val.alias("value"), num.alias("numerator"), a["den"].alias("denominator")))
    # union of input buckets; an absent input is NULL
    cols = {name: F.when(n[name] > 0, a[name]) for name in a}
    return agg.select("*", FM.to_column(metric.expression, cols).alias("value"),
                      nul.alias("numerator"), nul.alias("denominator"))


def _aggs(metric: Metric, src: str = "raw") -> list[Column]:
    out = []
    for i, (_, op, _) in enumerate(inputs_of(metric)):
        if i in _by_rank(metric):
            continue
        c, v = F.col(f"_c{i}"), F.col(f"_v{i}")
        if src == "raw":
            out += [_agg_expr(op, c, v).alias(f"_a{i}"), F.count_if(c).alias(f"_n{i}")]
        elif src == "freq":
            out += [F.count_distinct(v).cast("double").alias(f"_a{i}"), F.sum("_f").alias(f"_n{i}")]
        else:                                   # re-aggregate pre-aggregated day states
            meth = op.measure.method
            s, k = F.col(f"_s{i}"), F.col(f"_k{i}")
            if meth in ("count", "sum"):
                val = F.sum(s)
            elif meth == "avg":
                val = F.try_divide(F.sum(s), F.sum(k))
            else:
                val = getattr(F, meth)(s)
            out += [val.cast("double").alias(f"_a{i}"), F.sum(F.col(f"_p{i}")).alias(f"_n{i}")]
    return out


def _finish(metric: Metric, df: DataFrame, version: str, as_of_ts) -> DataFrame:
    cols = []
    for name in output_columns(metric):
        if name == "metric_id":
            cols.append(F.lit(metric.id).alias(name))
        elif name == "definition_version":
            cols.append(F.lit(version).alias(name))
        elif name == "is_complete":
            cols.append((F.col("bucket_end") <= F.lit(as_of_ts)).alias(name))
        elif name.startswith("dim_"):
            cols.append(F.coalesce(F.col(name), F.lit("")).alias(name))
        else:
            cols.append(F.col(name))
    return df.select(*cols)


def calendar_block(metric: Metric, rows: DataFrame, grains) -> DataFrame:
    """Every grain in one pass via explode, then one aggregation."""
    if _additive(metric):
        src, base, t = "pre", day_states(metric, rows), F.col("_d").cast("timestamp")
    else:
        src, base, t = "raw", rows, F.col("_t")
    pairs = F.array(*[F.struct(F.lit(g).alias("g"), F.date_trunc(g, t).alias("b")) for g in grains])
    x = base.withColumn("_gb", F.explode(pairs)).select(
        "*", F.col("_gb.g").alias("grain"), F.col("_gb.b").alias("bucket_start")).drop("_gb")
    active = [d for d in plan_dims(metric) if d in metric.dimensions]
    keys = ["tenant_id", "grain", "bucket_start"]
    ranked = _by_rank(metric)
    rest = len(ranked) < len(inputs_of(metric))
    agg = _aggregate(x, [F.col(k) for k in keys], active, _aggs(metric, src)) if rest else None
    if ranked:
        group = [*keys, *[f"dim_{d}" for d in active], "is_total"]
        each = _detail_and_total(x, active)
        agg = _joined_inputs(metric, agg, {i: percentiles(each.where(F.col(f"_c{i}")), group, f"_v{i}", [inputs_of(metric)[i][1].measure.pct / 100.0]) for i in ranked}, group)
    agg = agg.select("*", *[F.lit("").alias(f"dim_{d}") for d in plan_dims(metric) if d not in active])
    end = reduce(lambda acc, g: acc.when(F.col("grain") == g, F.col("bucket_start") + F.expr(INTERVALS[g])),
                 grains[1:], F.when(F.col("grain") == grains[0], F.col("bucket_start") + F.expr(INTERVALS[grains[0]])))
    agg = agg.withColumn("bucket_end", end)
    return _combine(metric, agg, len(inputs_of(metric)))


def _first_step(w: Window, lo: dt.date) -> dt.date:
    """A day spine starts at ``lo``, a week spine on the Monday of its week."""
    return lo if w.step == "day" else lo - dt.timedelta(days=lo.weekday())


def _step_array(d0: Column, midnight: Column, w: Window, lo, hi) -> Column:
    """Steps whose open window (step+1-N days, step+1 day) contains the row."""
    last = F.date_add(d0, F.lit(w.days - 1) - midnight.cast("int"))
    hi_c = F.least(last, F.lit(hi))
    if w.step == "day":
        first = F.greatest(d0, F.lit(lo))
        return F.when(first <= hi_c, F.sequence(first, hi_c))
    first = F.next_day(F.date_sub(F.greatest(d0, F.lit(_first_step(w, lo))), 1), "Mon")
    return F.when(first <= hi_c, F.sequence(first, hi_c, F.expr("INTERVAL 7 DAYS")))


def _additive(metric: Metric) -> bool:
    return all(op.measure.method in ADDITIVE for _, op, _ in inputs_of(metric))


def day_states(metric: Metric, rows: DataFrame) -> DataFrame:
    """one row per (tenant, dims, day, is-midnight) with mergeable states
    per input (sum/count/min/max + match count). Calendar grains and rolling
    windows of an additive metric both start from this same aggregate, so the
    entity is scanned and shuffled once (the exchange is reused)."""
    dims = [f"dim_{d}" for d in plan_dims(metric)]
    d0 = F.to_date("_t")
    midnight = F.col("_t") == d0.cast("timestamp")
    states = []
    for i, (_, op, _) in enumerate(inputs_of(metric)):
        c, v = F.col(f"_c{i}"), F.col(f"_v{i}")
        meth = op.measure.method
        x = F.when(c, v)
        if meth == "count":
            s = F.count(x)
        elif meth in ("sum", "avg"):
            s = F.sum(x)
        else:
            s = getattr(F, meth)(x)
        states += [s.alias(f"_s{i}"), F.count(x).alias(f"_k{i}"), F.count_if(c).alias(f"_p{i}")]
    return rows.groupBy("tenant_id", *dims, d0.alias("_d"), midnight.alias("_m")).agg(*states)


def window_block(metric: Metric, rows: DataFrame, w: Window, spine_lo: dt.date, spine_hi: dt.date) -> DataFrame:
    """Trailing N-day windows on a day (or Monday) step spine."""
    active = [d for d in plan_dims(metric) if d in metric.dimensions]
    dims = [f"dim_{d}" for d in plan_dims(metric)]
    ins = inputs_of(metric)
    d0 = F.to_date("_t")
    midnight = F.col("_t") == d0.cast("timestamp")
    ranked = _by_rank(metric)
    agg = None
    if _additive(metric):
        pre = day_states(metric, rows)
        src = "pre"
    elif len(ins) == 1 and not ins[0][1].measure.approx:
        # distinct count: explode one row per distinct (tenant, dims, day, midnight, value) with its frequency
        pre = (rows.where(F.col("_c0"))
               .groupBy("tenant_id", *dims, d0.alias("_d"), midnight.alias("_m"), F.col("_v0"))
               .agg(F.count(F.lit(1)).alias("_f")))
        src = "freq"
    else:
        pre = rows.select("*", d0.alias("_d"), midnight.alias("_m"))
        src = "raw"
    if len(ranked) < len(ins):
        steps = _step_array(F.col("_d"), F.col("_m"), w, spine_lo, spine_hi)
        x = pre.withColumn("step", F.explode(steps))
        agg = _aggregate(x, [F.col("tenant_id"), F.col("step")], active, _aggs(metric, src))
    if ranked:
        group = ["tenant_id", *[f"dim_{d}" for d in active], "is_total"]
        each = _detail_and_total(rows.withColumns({"_d": d0, "_m": midnight}), active)
        first = _first_step(w, spine_lo)
        agg = _joined_inputs(metric, agg, {i: rolling_percentiles(each.where(F.col(f"_c{i}")), group, "_d", "_m", f"_v{i}", [ins[i][1].measure.pct / 100.0],
                                                                  w.days, first, spine_hi, w.step == "week") for i in ranked}, [*group, "step"])
    agg = agg.select("*", *[F.lit("").alias(f"dim_{d}") for d in plan_dims(metric) if d not in active])
    end = F.date_add(F.col("step"), 1).cast("timestamp")
    agg = agg.select("*", F.lit(w.label).alias("grain"),
                     F.date_sub(F.col("step"), w.days - 1).cast("timestamp").alias("bucket_start"),
                     end.alias("bucket_end"))
    return _combine(metric, agg, len(ins))


def window_bounds(windows, lo: dt.date, hi: dt.date) -> tuple[dt.datetime, dt.datetime]:
    """The times that the windows' steps from ``lo`` to ``hi`` can reach."""
    first = min(_first_step(w, lo) - dt.timedelta(days=w.days - 1) for w in windows)
    day = lambda d: dt.datetime(d.year, d.month, d.day)
    return day(first), day(hi + dt.timedelta(days=1))


def compute_metric(metric: Metric, entities: dict[str, DataFrame], *, as_of,
                   tenants=None, mappings: dict | None = None, horizon_days: int = 730,
                   tenant_params: DataFrame | None = None, version: str | None = None,
                   since: dt.datetime | None = None) -> DataFrame:
    """All grain and window blocks of ``metric`` as rows of the metric-values schema.

    ``since`` leaves out calendar buckets that begin earlier, and does not read their rows.
    """
    as_of_ts = _as_ts(as_of)
    version = version or definition_version(metric)
    scope = dict(tenants=tenants, mappings=mappings, tenant_params=tenant_params)
    hi = as_of_ts.date()
    lo = hi - dt.timedelta(days=horizon_days)
    blocks, rows = [], None
    if metric.grains:
        rows = metric_rows(metric, entities, **scope, bounds=(since, None))
        block = calendar_block(metric, rows, list(metric.grains))
        blocks.append(block if since is None else block.where(F.col("bucket_start") >= F.lit(since)))
    if metric.windows and (rows is None or since is not None or not _additive(metric)):
        # additive measures with grains share one aggregate by day over all rows; else only what the windows reach is read
        rows = metric_rows(metric, entities, **scope, bounds=window_bounds(metric.windows, lo, hi))
    for w in metric.windows:
        blocks.append(window_block(metric, rows, w, lo, hi))
    out = [_finish(metric, b, version, as_of_ts) for b in blocks]
    return reduce(lambda a, b: a.unionByName(b), out)


def metric_union(frames: list[DataFrame]) -> DataFrame:
    """The uniform fact table over many metrics (extra dims become '')."""
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    dims = [c for c in u.columns if c.startswith("dim_")]
    return u.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in dims else F.col(c) for c in u.columns])
