"""Exact percentiles by distributed rank selection.

An exact percentile aggregate keeps every value of a group in one task's buffer. Here a group is never gathered:

* rows become frequencies of distinct (group, value) pairs by partial aggregation;
* values fall into slices of a fixed logarithmic scale (a monotone function of the value), and only the counts per
  (group, slice), at most some ten thousand numbers, meet in a window that finds the slices of the wanted ranks;
* only the values of those slices are read again and ranked.

A rolling percentile does the same over days. Its slice counts per (group, day) go to blocks of as many days as the
window has; a window that ends in a block needs that block and the one before, so each count is sent twice, whatever
the window's length, and slides through the block in order. Values are again read in the wanted slices only.

Ranks are interpolated linearly. NULL values do not count; a group of NULLs only has a NULL percentile.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Slices of the value scale for each factor e.
SLICES = 1 << 14
TOP_SLICE = (1 << 63) - 1


def value_slice(v: Column) -> Column:
    """Number of the slice of a double: never falls as the value grows; NaN is above all numbers."""
    return F.when(F.isnan(v), F.lit(TOP_SLICE)).otherwise(F.floor(F.signum(v) * F.log1p(F.abs(v)) * F.lit(float(SLICES))))


def _join_same(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join on equal or both-NULL columns, which are kept once."""
    r = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    cond = [left[c].eqNullSafe(r[f"_r_{c}"]) for c in on]
    return left.join(r, cond).drop(*[f"_r_{c}" for c in on])


def _rank_pairs(pcts: Sequence[float], total: Column) -> Column:
    """(number, rank) of the two neighbours of each wanted rank, counted from 0."""
    pairs = []
    for k, p in enumerate(pcts):
        at = F.lit(float(p)) * (total - 1)
        pairs += [F.struct(F.lit(2 * k).alias("i"), F.floor(at).cast("long").alias("r")),
                  F.struct(F.lit(2 * k + 1).alias("i"), F.ceil(at).cast("long").alias("r"))]
    return F.array(*pairs)


def _interpolated(picked: DataFrame, keys: Sequence[str], pcts: Sequence[float]) -> DataFrame:
    """One row per group out of rows (keys, i, v) and totals in the rows with i = -1."""
    one = picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("i") == i, F.col("v"))).alias(f"_v{i}") for i in range(2 * len(pcts))],
        *[F.max(F.when(F.col("i") == -1, F.col(c))).alias(c) for c in ("n", "rows", "total")])
    out = []
    for k, p in enumerate(pcts):
        at = F.lit(float(p)) * (F.col("n") - 1)
        part = at - F.floor(at)
        low, high = F.col(f"_v{2 * k}"), F.col(f"_v{2 * k + 1}")
        out.append(F.when(low == high, low).otherwise((F.lit(1.0) - part) * low + part * high).alias(f"p{k}"))
    return one.select(*keys, *out, "n", "rows", F.try_divide(F.col("total"), F.col("n")).alias("mean"))


def _within(open_slices: DataFrame, freq: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Values at ranks ``wanted`` of slices (keys, slice); ``freq`` has (keys, slice, v, f)."""
    on = [*keys, "slice"]
    got = _join_same(freq, open_slices, on)
    upto = F.sum("f").over(Window.partitionBy(*on).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    got = got.withColumn("upto", upto)
    hit = F.filter("wanted", lambda t: (t["r"] >= F.col("upto") - F.col("f")) & (t["r"] < F.col("upto")))
    return got.withColumn("t", F.explode(hit)).select(*keys, F.col("t.i").alias("i"), "v")


def _times(weight: str | None) -> Column:
    return F.count(F.lit(1)) if weight is None else F.sum(weight)


def percentiles(rows: DataFrame, keys: Sequence[str], value: str, pcts: Sequence[float], weight: str | None = None) -> DataFrame:
    """Per group: ``p0``, ``p1`` .. (exact, interpolated), ``n`` values, ``rows`` with NULL values too, ``mean``.

    ``weight``: how many times each row counts."""
    keys = list(keys)
    v = F.col(value).cast("double")
    extra = [] if weight is None else [weight]
    freq = (rows.select(*keys, *extra, v.alias("v"), value_slice(v).alias("slice"))
            .groupBy(*keys, "slice", "v").agg(_times(weight).alias("f")))
    valued = F.col("v").isNotNull()
    slices = freq.groupBy(*keys, "slice").agg(
        F.sum(F.when(valued, F.col("f")).otherwise(0)).alias("n"), F.sum("f").alias("rows"), F.sum(F.col("v") * F.col("f")).alias("s"),
        F.min("v").alias("low"), F.max("v").alias("high"))
    group = Window.partitionBy(*keys)
    order = group.orderBy(F.asc_nulls_last("slice"))
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = slices.select(*keys, "slice", "low", "high", "n", F.sum("n").over(run).alias("upto"), F.sum("n").over(group).alias("all_n"),
                       F.sum("rows").over(group).alias("all_rows"), F.sum("s").over(group).alias("all_s"), F.row_number().over(order).alias("first"))
    before = F.col("upto") - F.col("n")
    inside = F.filter(_rank_pairs(pcts, F.col("all_n")), lambda t: (t["r"] >= before) & (t["r"] < F.col("upto")))
    inside = F.transform(inside, lambda t: F.struct(t["i"].alias("i"), (t["r"] - before).alias("r")))
    at = at.withColumn("wanted", inside)
    # the totals stand in each group's first row; a slice with one value gives its ranks at once
    head = F.when(F.col("first") == 1, F.array(F.struct(F.lit(-1).alias("i"), F.lit(0).cast("long").alias("r"))))
    known = F.when(F.col("low") == F.col("high"), F.col("wanted"))
    none = F.array().cast("array<struct<i:int,r:bigint>>")
    plain = at.select(*keys, "low", "all_n", "all_rows", "all_s", F.explode(F.concat(F.coalesce(head, none), F.coalesce(known, none))).alias("t"))
    plain = plain.select(*keys, F.col("t.i").alias("i"), F.col("low").alias("v"), F.col("all_n").alias("n"),
                         F.col("all_rows").alias("rows"), F.col("all_s").alias("total"))
    dense = at.where("low < high AND size(wanted) > 0").select(*keys, "slice", "wanted")
    return _interpolated(plain.unionByName(_within(dense, freq, keys), allowMissingColumns=True), keys, pcts)


def _slide(keys: Sequence[str], schema: T.StructType, pcts: Sequence[float], days: int, monday: bool, first: int, last: int):
    """Slice counts of two blocks of days -> the slices of the wanted ranks at each step of the second."""

    def run(t: pa.Table) -> pa.Table:
        head = {k: t[k][0] for k in keys}
        block = t["block"][0].as_py()
        day, n, rows, total = (t[c].to_numpy() for c in ("day", "n", "rows", "s"))
        low, high = (t[c].to_numpy() for c in ("low", "high"))
        until = day + days - 1 - t["midnight"].to_numpy(zero_copy_only=False).astype(np.int64)  # last step of each row
        has = n > 0
        names, at = np.unique(np.where(has, t["slice"].fill_null(0).to_numpy(), 0), return_inverse=True)
        enter, leave = np.argsort(day, kind="stable"), np.argsort(until, kind="stable")
        count, in_n, in_rows, in_s = np.zeros(len(names), np.int64), 0, 0, 0.0
        i = j = 0
        out = []
        for step in range(max(block * days, first), min((block + 1) * days - 1, last) + 1):
            while i < len(enter) and day[enter[i]] <= step:
                r = enter[i]
                if until[r] >= day[r]:
                    count[at[r]] += n[r]
                    in_n, in_rows = in_n + n[r], in_rows + rows[r]
                i += 1
            while j < len(leave) and until[leave[j]] < step:
                r = leave[j]
                if until[r] >= day[r]:
                    count[at[r]] -= n[r]
                    in_n, in_rows = in_n - n[r], in_rows - rows[r]
                j += 1
            if not in_rows or (monday and (step + 3) % 7):
                continue
            now = (day <= step) & (until >= step)
            in_s = float(total[now & has].sum())
            out.append((step, None, -1, 0, None, None, int(in_n), int(in_rows), in_s))
            if not in_n:
                continue
            upto = np.cumsum(count)
            for k, p in enumerate(pcts):
                pos = p * (in_n - 1)
                for side, r in enumerate((int(np.floor(pos)), int(np.ceil(pos)))):
                    s = int(np.searchsorted(upto, r, "right"))
                    own = now & has & (at == s)
                    out.append((step, int(names[s]), 2 * k + side, r - int(upto[s] - count[s]), float(low[own].min()), float(high[own].max()), None, None, None))
        cols = list(zip(*out)) or [()] * 9
        made = dict(zip(("step", "slice", "i", "r", "low", "high", "n", "rows", "total"), cols))
        made |= {k: [head[k].as_py()] * len(out) for k in keys} | {"block": [block] * len(out)}
        kind = {T.LongType(): pa.int64(), T.DoubleType(): pa.float64()}
        return pa.table({f.name: pa.array(made[f.name], t.schema.field(f.name).type if f.name in keys else kind[f.dataType]) for f in schema.fields})

    return run


def rolling_percentiles(rows: DataFrame, keys: Sequence[str], day: str, midnight: str, value: str, pcts: Sequence[float],
                        days: int, first: dt.date, last: dt.date, mondays: bool = False, weight: str | None = None) -> DataFrame:
    """Per group and ``step`` (a date from ``first`` to ``last``): percentiles of the rows of the last ``days`` days.

    A row counts from its day on for ``days`` steps, one fewer if ``midnight`` is true (windows are open at both ends).
    Output as of ``percentiles``; steps without rows are absent.
    """
    keys = list(keys)
    epoch = F.lit("1970-01-01").cast("date")
    v = F.col(value).cast("double")
    extra = [] if weight is None else [weight]
    base = rows.select(*keys, *extra, F.datediff(F.col(day), epoch).cast("long").alias("day"), F.col(midnight).alias("midnight"), v.alias("v"), value_slice(v).alias("slice"))
    freq = base.groupBy(*keys, "day", "midnight", "slice", "v").agg(_times(weight).alias("f"))
    block = F.floor(F.col("day") / F.lit(days)).cast("long")
    blocks = F.explode(F.array(block, block + 1)).alias("block")
    hist = freq.groupBy(*keys, "day", "midnight", "slice").agg(
        F.sum(F.when(F.col("v").isNotNull(), F.col("f")).otherwise(0)).alias("n"), F.sum("f").alias("rows"),
        F.sum(F.col("v") * F.col("f")).alias("s"), F.min("v").alias("low"), F.max("v").alias("high"))
    key_fields = [freq.schema[k] for k in keys]
    schema = T.StructType([*key_fields, T.StructField("block", T.LongType()), T.StructField("step", T.LongType()),
                           T.StructField("slice", T.LongType()), T.StructField("i", T.LongType()), T.StructField("r", T.LongType()),
                           T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType()), T.StructField("n", T.LongType()),
                           T.StructField("rows", T.LongType()), T.StructField("total", T.DoubleType())])
    lo, hi = ((x - dt.date(1970, 1, 1)).days for x in (first, last))
    slid = (hist.select("*", blocks).groupBy(*keys, "block")
            .applyInArrow(_slide(keys, schema, pcts, days, mondays, lo, hi), schema))
    totals = slid.where("i = -1").select(*keys, "step", "i", F.lit(None).cast("double").alias("v"), "n", "rows", "total")
    plain = slid.where("i >= 0 AND low = high").select(*keys, "step", "i", F.col("low").alias("v"))
    # the steps that want a slice, together; their values are read once per block
    dense = (slid.where("i >= 0 AND low < high").groupBy(*keys, "block", "slice")
             .agg(F.collect_list(F.struct("step", "i", "r")).alias("steps")))
    values = _join_same(freq.select(*keys, "day", "midnight", "slice", "v", "f", blocks), dense, [*keys, "block", "slice"])
    until = F.col("day") + days - 1 - F.col("midnight").cast("int")
    held = F.filter("steps", lambda t: (t["step"] >= F.col("day")) & (t["step"] <= until))
    at = values.select(*keys, "v", "f", F.explode(held).alias("t"))
    upto = F.sum("f").over(Window.partitionBy(*keys, "t.step", "t.i").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = at.withColumn("upto", upto).where((F.col("t.r") >= F.col("upto") - F.col("f")) & (F.col("t.r") < F.col("upto")))
    picked = plain.unionByName(at.select(*keys, "t.step", "t.i", "v"))
    out = _interpolated(totals.unionByName(picked, allowMissingColumns=True), [*keys, "step"], pcts)
    return out.withColumn("step", F.date_add(epoch, F.col("step").cast("int")))
