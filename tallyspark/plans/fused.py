"""Many metrics in one pass.

Inputs of all metrics are told apart by number. A row of an entity becomes one small row per input that it matches
(tenant, dimensions, input, time, value), whatever the inputs' time fields, and these are reduced at once, by partial
aggregation, to frequencies per (tenant, dimensions, input, day, is-midnight, value). This is the only scan and the only
shuffle of the entity; the result is a narrow intermediate that every later step reads:

* additive metrics sum it to day states, fan out to the metrics that use an input, and one aggregate makes all grains and
  windows of all of them;
* exact percentiles are selected by rank, for all metrics over an input at once.

Enrolment is one join of (tenant, input) before the reduction and one of (tenant, metric) at the end.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.ranks import percentiles, rolling_percentiles
from tallyspark.plans import compile as CP
from tallyspark.plans import formula as FM
from tallyspark.plans.spec import Metric, Window, definition_version
from tallyspark.session import written


def fusable(m: Metric) -> bool:
    """Without parameters; all inputs additive, or one exact percentile."""
    ins = CP.inputs_of(m)
    return not m.params and (CP._additive(m) or (m.kind == "simple" and bool(CP._by_rank(m)) and len(ins) == 1))


def _cases(metric: Column, values: dict[str, Column]) -> Column:
    """The value of the row's metric."""
    out = None
    for k, v in values.items():
        out = F.when(metric == k, v) if out is None else out.when(metric == k, v)
    return out


def _step_bucket(w: Window):
    return lambda s: F.struct(F.lit(w.label).alias("grain"), F.date_sub(s, w.days - 1).cast("timestamp").alias("bucket_start"),
                              F.date_add(s, 1).cast("timestamp").alias("bucket_end"))


class _Group:
    """Metrics with the same dimensions, and their numbered inputs."""

    def __init__(self, metrics: list[Metric]):
        self.metrics = metrics
        self.inputs: list[tuple[Metric, tuple]] = []
        self.of: dict[str, list[int]] = {}
        for m in metrics:
            self.of[m.id] = []
            for _, op, extra in CP.inputs_of(m):
                # what tells inputs apart: rows, time and value, not the percentile asked of them
                key = (op.entity, op.time_field, repr(op.filters), repr(extra), repr(CP._operand_value(op)), op.measure.negative, op.measure.is_interval)
                known = [self._key(o, e) for o, e in self.inputs]
                if key not in known:
                    self.inputs.append((op, extra))
                    known.append(key)
                self.of[m.id].append(known.index(key))
        self.dims = [f"dim_{d}" for d in CP.plan_dims(metrics[0])]
        self.active = [d for d in CP.plan_dims(metrics[0]) if d in metrics[0].dimensions]

    @staticmethod
    def _key(op: Metric, extra: tuple):
        return (op.entity, op.time_field, repr(op.filters), repr(extra), repr(CP._operand_value(op)), op.measure.negative, op.measure.is_interval)

    def rows(self, entities: dict[str, DataFrame], pairs: DataFrame | None, **scope) -> DataFrame:
        """Frequencies by tenant, dimensions, input, day, is-midnight and value: one scan of each entity."""
        parts = []
        for entity in dict.fromkeys(op.entity for op, _ in self.inputs):
            base = CP.input_rows(entities[entity], self.metrics[0], **scope)
            dims, excl = CP._dim_columns(self.metrics[0], scope.get("mappings"))
            hits = F.array(*[
                F.when(CP._operand_cond(op, extra, excl, base.schema),
                       F.struct(F.lit(i).alias("input"), F.col(op.time_field).cast("timestamp").alias("t"), CP._operand_value(op).cast("double").alias("v")))
                for i, (op, extra) in enumerate(self.inputs) if op.entity == entity])
            hit = base.select("tenant_id", *dims, F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h"))
            parts.append(hit.select("tenant_id", *self.dims, "h.input", F.to_date("h.t").alias("_d"),
                                    (F.col("h.t") == F.to_date("h.t").cast("timestamp")).alias("_m"), F.col("h.v").alias("v")))
        rows = reduce(lambda a, b: a.unionByName(b), parts)
        if pairs is not None:
            use = F.explode(_cases(F.col("metric_id"), {m: F.array(*[F.lit(i) for i in ids]) for m, ids in self.of.items()}))
            rows = rows.join(pairs.select("tenant_id", use.alias("input")).distinct(), ["tenant_id", "input"], "left_semi")
        return rows.groupBy("tenant_id", *self.dims, "input", "_d", "_m", "v").agg(F.count(F.lit(1)).alias("f"))

    def buckets(self, m: Metric, lo: dt.date, hi: dt.date) -> Column:
        """The calendar buckets and window steps that a day's rows count in."""
        t = F.col("_d").cast("timestamp")
        out = [F.array(*[F.struct(F.lit(g).alias("grain"), F.date_trunc(g, t).alias("bucket_start"),
                                  (F.date_trunc(g, t) + F.expr(CP.INTERVALS[g])).alias("bucket_end")) for g in m.grains])] if m.grains else []
        for w in m.windows:
            steps = F.coalesce(CP._step_array(F.col("_d"), F.col("_m"), w, lo, hi), F.array().cast("array<date>"))
            out.append(F.transform(steps, _step_bucket(w)))
        return F.concat(*out)

    def additive(self, freq: DataFrame, lo: dt.date, hi: dt.date) -> DataFrame | None:
        ms = [m for m in self.metrics if CP._additive(m)]
        if not ms:
            return None
        used = sorted({i for m in ms for i in self.of[m.id]})
        some = F.col("v").isNotNull()
        day = (freq.where(F.col("input").isin(used)).groupBy("tenant_id", *self.dims, "input", "_d", "_m")
               .agg(F.sum(F.col("v") * F.col("f")).alias("s"), F.min("v").alias("low"), F.max("v").alias("high"),
                    F.sum(F.when(some, F.col("f")).otherwise(0)).alias("k"), F.sum("f").alias("p")))
        fan = F.explode(_cases(F.col("input"), {i: F.array(*[F.struct(F.lit(m.id).alias("metric_id"), F.lit(j).alias("slot"))
                                                             for m in ms for j, x in enumerate(self.of[m.id]) if x == i]) for i in used}))
        x = day.withColumn("_u", fan).select("*", "_u.*").drop("_u", "input")
        x = x.withColumn("_b", F.explode(_cases(F.col("metric_id"), {m.id: self.buckets(m, lo, hi) for m in ms}))).select("*", "_b.*").drop("_b")
        slots = range(max(len(self.of[m.id]) for m in ms))
        aggs = []
        for j in slots:
            own = F.col("slot") == j
            aggs += [fn(F.when(own, F.col(c))).alias(f"_{c}{j}") for c, fn in (("s", F.sum), ("low", F.min), ("high", F.max), ("k", F.sum), ("p", F.sum))]
        keys = [F.col(c) for c in ("metric_id", "tenant_id", "grain", "bucket_start", "bucket_end")]
        agg = CP._aggregate(x, keys, self.active, aggs)
        value, num, den, keep = {}, {}, {}, {}
        null = F.lit(None).cast("double")
        for m in ms:
            a, n = {}, {}
            for j, (name, op, _) in enumerate(CP.inputs_of(m)):
                meth = op.measure.method
                s, k = F.col(f"_s{j}"), F.col(f"_k{j}")
                a[name] = {"count": k.cast("double"), "sum": s, "avg": F.try_divide(s, k), "min": F.col(f"_low{j}"), "max": F.col(f"_high{j}")}[meth]
                n[name] = F.coalesce(F.col(f"_p{j}"), F.lit(0))
            value[m.id], num[m.id], den[m.id], keep[m.id] = null, null, null, F.lit(True)
            if m.kind == "simple":
                value[m.id] = a["value"]
            elif m.kind == "ratio":
                top, low = F.coalesce(a["num"], F.lit(0.0)), a["den"]
                share = F.try_divide(top, low)
                value[m.id] = F.when(low == 0, F.lit(0.0)).otherwise(share) if m.zero_denominator == "zero" else share
                num[m.id], den[m.id], keep[m.id] = top, low, n["den"] > 0
            else:
                value[m.id] = FM.to_column(m.expression, {name: F.when(n[name] > 0, a[name]) for name in a})
        k = F.col("metric_id")
        return agg.where(_cases(k, keep)).select(*[c for c in agg.columns if not c.startswith("_")], _cases(k, value).alias("value"),
                                                 _cases(k, num).alias("numerator"), _cases(k, den).alias("denominator"))

    def ranked(self, freq: DataFrame, lo: dt.date, hi: dt.date) -> list[DataFrame]:
        """Percentile metrics: those with the same grains, and those with the same window, together."""
        ms = [m for m in self.metrics if not CP._additive(m)]
        blocks: dict = {}
        for m in ms:
            for b in ([tuple(m.grains)] if m.grains else []) + list(m.windows):
                blocks.setdefault(b, []).append(m)
        out = []
        dims = [f"dim_{d}" for d in self.active]
        for b, own in blocks.items():
            pcts = sorted({m.measure.pct / 100.0 for m in own})
            x = CP._detail_and_total(freq.where(F.col("input").isin([self.of[m.id][0] for m in own])), self.active)
            if isinstance(b, tuple):
                group = ["tenant_id", *dims, "is_total", "input", "grain", "bucket_start", "bucket_end"]
                x = x.withColumn("_b", F.explode(self.buckets(own[0].with_(grains=b, windows=()), lo, hi))).select("*", "_b.*")
                got = percentiles(x, group, "v", pcts, "f")
            else:
                group = ["tenant_id", *dims, "is_total", "input"]
                got = rolling_percentiles(x, group, "_d", "_m", "v", pcts, b.days, CP._first_step(b, lo), hi, b.step == "week", "f")
                got = got.select("*", F.lit(b.label).alias("grain"), F.date_sub("step", b.days - 1).cast("timestamp").alias("bucket_start"),
                                 F.date_add("step", 1).cast("timestamp").alias("bucket_end"))
            each = F.explode(_cases(F.col("input"), {
                i: F.array(*[F.struct(F.lit(m.id).alias("metric_id"), F.col(f"p{pcts.index(m.measure.pct / 100.0)}").alias("value")) for m in own if self.of[m.id][0] == i])
                for i in {self.of[m.id][0] for m in own}}))
            got = got.withColumn("_u", each).select("_u.*", "tenant_id", *dims, "is_total", "grain", "bucket_start", "bucket_end")
            out.append(got.select("*", *[F.lit(None).cast("double").alias(c) for c in ("numerator", "denominator")]))
        return out


def compute_fused(metrics: list[Metric], entities: dict[str, DataFrame], *, as_of, pairs: DataFrame | None = None,
                  horizon_days: int = 730, **scope) -> DataFrame:
    """The values of all ``metrics``, each for the tenants that ``pairs`` (tenant_id, metric_id) gives it, or all."""
    as_of_ts = CP._as_ts(as_of)
    hi = as_of_ts.date()
    lo = hi - dt.timedelta(days=horizon_days)
    groups: dict = {}
    for m in metrics:
        if not fusable(m):
            raise ValueError(f"{m.id} has parameters or mixes percentiles with other inputs")
        groups.setdefault((m.dimensions, repr(m.mapped)), []).append(m)
    outs = []
    for ms in groups.values():
        g = _Group(ms)
        freq = written(g.rows(entities, pairs, **scope), "metric-inputs")
        blocks = [b for b in [g.additive(freq, lo, hi), *g.ranked(freq, lo, hi)] if b is not None]
        values = reduce(lambda a, b: a.unionByName(b), blocks)
        if pairs is not None:
            values = values.join(pairs.select("tenant_id", "metric_id").distinct(), ["tenant_id", "metric_id"], "left_semi")
        version = _cases(F.col("metric_id"), {m.id: F.lit(definition_version(m)) for m in ms})
        missing = [F.lit("").alias(d) for d in g.dims if d not in values.columns]
        values = values.select("*", *missing, version.alias("definition_version"), (F.col("bucket_end") <= F.lit(as_of_ts)).alias("is_complete"))
        outs.append(values.select(*[F.coalesce(c, F.lit("")).alias(c) if c.startswith("dim_") else F.col(c) for c in CP.output_columns(ms[0])]))
    return CP.metric_union(outs)
