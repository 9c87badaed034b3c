"""Filter documents -> Column predicates (top-level list = AND)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _lit(v):
    return F.lit(v)


def _is_array(schema, field: str) -> bool:
    if schema is None:
        return False
    from pyspark.sql.types import ArrayType
    try:
        return isinstance(schema[field].dataType, ArrayType)
    except (KeyError, IndexError):
        return False


def to_column(node: dict, schema=None) -> Column:
    """``schema`` (the entity's StructType, optional) lets ``contains`` test
    membership on array fields instead of a substring match."""
    if "sql" in node:
        return F.expr(node["sql"])
    if "any_of" in node:
        return reduce(lambda a, b: a | b, [to_column(c, schema) for c in node["any_of"]])
    if "all_of" in node:
        return reduce(lambda a, b: a & b, [to_column(c, schema) for c in node["all_of"]])
    if "not" in node:
        return ~to_column(node["not"], schema)
    c = F.col(node["field"]) if "col" not in node else node["col"]
    op, v = node["op"], node.get("value")
    if "value_col" in node:              # per-tenant bound parameter (E18)
        v = F.col(node["value_col"])
    if op == "eq":
        return c == _lit(v) if not isinstance(v, Column) else c == v
    if op == "neq":                      # `is distinct from`: NULL rows match
        return ~c.eqNullSafe(v if isinstance(v, Column) else _lit(v))
    if op == "in":
        return c.isin(list(v))
    if op == "not_in":                   # NULL input is excluded (three-valued)
        return ~c.isin(list(v))
    if op in ("gt", "gte", "lt", "lte"):
        w = v if isinstance(v, Column) else _lit(v)
        return {"gt": c > w, "gte": c >= w, "lt": c < w, "lte": c <= w}[op]
    if op == "contains":                 # `%`/`_` in the value act as wildcards
        if _is_array(schema, node["field"]):
            return F.array_contains(c, F.lit(v))
        return c.like(f"%{v}%")
    if op == "not_contains":
        if _is_array(schema, node["field"]):
            return ~F.array_contains(c, F.lit(v))
        return ~c.like(f"%{v}%")
    if op == "starts_with":
        return c.like(f"{v}%")
    if op == "ends_with":
        return c.like(f"%{v}")
    if op == "is_null":
        return c.isNull()
    if op == "is_not_null":
        return c.isNotNull()
    raise ValueError(f"unsupported op {op!r}")


def all_filters(nodes, schema=None) -> Column | None:
    cols = [to_column(n, schema) for n in (nodes or [])]
    if not cols:
        return None
    return reduce(lambda a, b: a & b, cols)
