"""DuckDB oracle for metric specs, in the reference's literal SQL form:
one block per grain with ``grouping sets``, ratio as den LEFT JOIN num,
formula over the union of input buckets, windows as a range join on a spine."""

from __future__ import annotations

import ast
import datetime as dt

from tallyspark.plans.compile import INTERVALS, inputs_of, plan_dims
from tallyspark.plans.spec import Metric, definition_version


def lit(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("'", "''") + "'"


def filt(node: dict) -> str:
    if "sql" in node:
        return f"({node['sql']})"
    if "any_of" in node:
        return "(" + " or ".join(filt(c) for c in node["any_of"]) + ")"
    if "all_of" in node:
        return "(" + " and ".join(filt(c) for c in node["all_of"]) + ")"
    if "not" in node:
        return "(not " + filt(node["not"]) + ")"
    c, op, v = f"base.{node['field']}", node["op"], node.get("value")
    if "value_col" in node:
        v_sql = f"base.{node['value_col']}"
    else:
        v_sql = lit(v)
    return {
        "eq": lambda: f"({c} = {v_sql})",
        "neq": lambda: f"({c} is distinct from {v_sql})",
        "in": lambda: f"({c} in ({', '.join(lit(x) for x in v)}))",
        "not_in": lambda: f"({c} not in ({', '.join(lit(x) for x in v)}))",
        "gt": lambda: f"({c} > {v_sql})", "gte": lambda: f"({c} >= {v_sql})",
        "lt": lambda: f"({c} < {v_sql})", "lte": lambda: f"({c} <= {v_sql})",
        "contains": lambda: f"({c} like '%' || {v_sql} || '%')",
        "not_contains": lambda: f"({c} not like '%' || {v_sql} || '%')",
        "starts_with": lambda: f"({c} like {v_sql} || '%')",
        "ends_with": lambda: f"({c} like '%' || {v_sql})",
        "is_null": lambda: f"({c} is null)", "is_not_null": lambda: f"({c} is not null)",
    }[op]()


def _dim_sql(metric: Metric, d: str) -> str:
    mapped = {m.name: m for m in metric.mapped}
    if d not in metric.dimensions:
        return "''"
    if d in mapped:
        m = mapped[d]
        whens = " ".join(f"when {lit(a)} then {lit(b)}" for a, b in m.mapping)
        els = "null" if m.default == "exclude" else lit(m.default)
        return f"coalesce(case cast(base.{m.from_field} as varchar) {whens} else {els} end, '')"
    return f"coalesce(cast(base.{d} as varchar), '')"


def _rows(metric: Metric, op: Metric, extra, entity_sql: dict[str, str], tenants=None, params_sql=None) -> str:
    m = op.measure
    where = [filt(f) for f in list(op.filters) + list(extra)]
    if m.is_interval:
        e = f"(epoch_us(base.{m.to_field}) - epoch_us(base.{m.from_field})) / 1e6"
        val = f"greatest({e}, 0)" if m.negative == "clamp_zero" else e
        where += [f"base.{m.from_field} is not null", f"base.{m.to_field} is not null"]
        if m.negative == "exclude":
            where.append(f"base.{m.to_field} >= base.{m.from_field}")
    elif m.agg == "count":
        val = "1"
    else:
        val = f"base.{m.field}"
    for md in metric.mapped:
        if md.name in metric.dimensions and md.default == "exclude":
            whens = " ".join(f"when {lit(a)} then {lit(b)}" for a, b in md.mapping)
            where.append(f"(case cast(base.{md.from_field} as varchar) {whens} else null end) is not null")
    if tenants is not None:
        where.append(f"base.tenant_id in ({', '.join(lit(t) for t in tenants)})")
    where.append(f"base.{op.time_field} is not null")
    dims = ", ".join(f"{_dim_sql(metric, d)} as dim_{d}" for d in plan_dims(metric))
    src = entity_sql[op.entity]
    if params_sql:
        src = f"select e.*, p.* exclude (tenant_id) from ({src}) e join ({params_sql}) p on e.tenant_id = p.tenant_id"
    return (f"select base.tenant_id, cast(base.{op.time_field} as timestamp) as t, {dims}, "
            f"cast({val} as double) as _value from ({src}) base where " + " and ".join(where))


def _agg(op: Metric) -> str:
    m = op.measure
    meth, p = m.method, m.pct
    if meth == "count":
        return "cast(count(*) as double)"
    if meth == "count_distinct":
        return "cast(count(distinct _value) as double)"
    if meth == "percentile":
        return f"cast(quantile_cont(_value, {p / 100.0}) as double)"
    return f"cast({meth}(_value) as double)"


def _group(metric: Metric, keys: list[str]) -> tuple[str, str]:
    active = [d for d in plan_dims(metric) if d in metric.dimensions]
    if not active:
        return "group by " + ", ".join(keys + [f"r.dim_{d}" for d in plan_dims(metric)]), "true"
    dims = [f"r.dim_{d}" for d in active]
    gs = f"group by grouping sets (({', '.join(keys + dims)}), ({', '.join(keys)}))"
    tot = "(" + " and ".join(f"grouping({d}) = 1" for d in dims) + ")"
    return gs, tot


def _dim_out(metric: Metric, alias: str) -> str:
    return ", ".join(f"coalesce({alias}.dim_{d}, '') as dim_{d}" if d in metric.dimensions
                     else f"'' as dim_{d}" for d in plan_dims(metric))


def formula_sql(expr: str, cols: dict[str, str]) -> str:
    def emit(n):
        if isinstance(n, ast.BinOp):
            a, b = emit(n.left), emit(n.right)
            if isinstance(n.op, ast.Div):
                return f"({a} / nullif({b}, 0))"
            return f"({a} {'+' if isinstance(n.op, ast.Add) else '-' if isinstance(n.op, ast.Sub) else '*'} {b})"
        if isinstance(n, ast.UnaryOp):
            return f"(-{emit(n.operand)})" if isinstance(n.op, ast.USub) else emit(n.operand)
        if isinstance(n, ast.Name):
            return cols[n.id]
        return f"cast({float(n.value)!r} as double)"
    return f"cast({emit(ast.parse(expr, mode='eval').body)} as double)"


def metric_sql(metric: Metric, entity_sql: dict[str, str], as_of, horizon_days: int = 730,
               tenants=None, params_sql=None, version=None) -> str:
    if isinstance(as_of, str):
        as_of = dt.datetime.fromisoformat(as_of)
    ts = f"timestamp '{as_of:%Y-%m-%d %H:%M:%S}'"
    hi = as_of.date()
    lo = hi - dt.timedelta(days=horizon_days)
    ver = version or definition_version(metric)
    ins = inputs_of(metric)
    ctes = [f"rows_{n} as ({_rows(metric, op, ex, entity_sql, tenants, params_sql)})" for n, op, ex in ins]
    ctes.append(f"""day_spine as (select cast(gs as date) as step_date, 'day' as step
      from generate_series(timestamp '{lo}', timestamp '{hi}', interval 1 day) g(gs))""")
    ctes.append("""spine as (select step_date, step from day_spine union all
      select distinct cast(date_trunc('week', step_date) as date), 'week' from day_spine)""")
    dimcols = ", ".join(f"dim_{d}" for d in plan_dims(metric))
    using = f"tenant_id, {dimcols}, is_total, bucket"
    blocks = []
    head = f"'{metric.id}' as metric_id, '{ver}' as definition_version"
    for g in metric.grains:
        bs = f"date_trunc('{g}', r.t)"
        gb, tot = _group(metric, ["r.tenant_id", bs])
        per = {}
        for n, op, _ in ins:
            per[n] = (f"select r.tenant_id, {_dim_out(metric, 'r')}, {bs} as bucket, {tot} as is_total, "
                      f"{_agg(op)} as v, count(*) as n from rows_{n} r {gb}")
        blocks.append(_combine_sql(metric, per, using, f"'{g}'", "x.bucket",
                                  f"x.bucket + interval {INTERVALS[g].split(' ', 1)[1]}", head, ts, dimcols))
    for w in metric.windows:
        lower = f"r.t > (s.step_date + interval 1 day - interval {w.days} day)"
        upper = "r.t < (s.step_date + interval 1 day)"
        gb, tot = _group(metric, ["r.tenant_id", "s.step_date"])
        per = {}
        for n, op, _ in ins:
            per[n] = (f"select r.tenant_id, {_dim_out(metric, 'r')}, s.step_date as bucket, {tot} as is_total, "
                      f"{_agg(op)} as v, count(*) as n from spine s join rows_{n} r on {lower} and {upper} "
                      f"where s.step = '{w.step}' {gb}")
        blocks.append(_combine_sql(metric, per, using, f"'{w.label}'",
                                  f"cast(x.bucket as timestamp) + interval 1 day - interval {w.days} day",
                                  "cast(x.bucket as timestamp) + interval 1 day", head, ts, dimcols))
    body = "\nunion all\n".join(blocks)
    return "with " + ",\n".join(ctes) + "\n" + body


def _combine_sql(metric, per, using, grain, bs, be, head, ts, dimcols):
    dims_x = ", ".join(f"x.dim_{d}" for d in plan_dims(metric))
    common = (f"select x.tenant_id, {head}, {grain} as grain, cast({bs} as timestamp) as bucket_start, "
              f"cast({be} as timestamp) as bucket_end, (cast({be} as timestamp) <= {ts}) as is_complete, "
              f"x.is_total, {dims_x}, ")
    if metric.kind == "simple":
        return f"({common} x.v as value, cast(null as double) as numerator, cast(null as double) as denominator from ({per['value']}) x)"
    if metric.kind == "ratio":
        if metric.zero_denominator == "zero":
            val = "case when x.v = 0 then 0.0 else coalesce(num.v, 0) / x.v end"
        else:
            val = "coalesce(num.v, 0) / nullif(x.v, 0)"
        return (f"({common} cast({val} as double) as value, cast(coalesce(num.v, 0) as double) as numerator, "
                f"x.v as denominator from ({per['den']}) x left join ({per['num']}) num using ({using}))")
    names = [n for n, _, _ in inputs_of(metric)]
    buckets = " union ".join(f"select tenant_id, {dimcols}, is_total, bucket from ({per[n]}) q" for n in names)
    joins = " ".join(f"left join ({per[n]}) in_{n} using ({using})" for n in names)
    val = formula_sql(metric.expression, {n: f"in_{n}.v" for n in names})
    return (f"({common} {val} as value, cast(null as double) as numerator, cast(null as double) as denominator "
            f"from ({buckets}) x {joins})")
