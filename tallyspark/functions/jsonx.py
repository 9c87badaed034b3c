"""Typed JSON path extraction over a STRING payload column.

``get_json_object`` returns NULL both for a missing key and for a JSON null,
which is exactly the meaning of Postgres ``->>``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def jstr(col, path: str) -> Column:
    """``payload ->> 'a' ->> 'b'`` written as path ``a.b`` (``a[0].b`` for arrays)."""
    return F.get_json_object(_c(col), "$." + path)


def jts(col, path: str) -> Column:
    return jstr(col, path).cast("timestamp")


def jint(col, path: str) -> Column:
    return jstr(col, path).cast("int")


def jlong(col, path: str) -> Column:
    return jstr(col, path).cast("bigint")


def jbool(col, path: str) -> Column:
    return jstr(col, path).cast("boolean")


def jdec(col, path: str, precision: int = 18, scale: int = 4) -> Column:
    return jstr(col, path).cast(f"decimal({precision},{scale})")


def has_key(col, key: str) -> Column:
    """Postgres ``payload ? key``: the top-level object has the key (even if null)."""
    return F.coalesce(F.array_contains(F.json_object_keys(_c(col)), F.lit(key)), F.lit(False))


# --- parse once ---------------------------------------------------------------------------
# ``get_json_object`` tokenizes the document on every call; a staging model
# reading a dozen paths would parse each payload a dozen times. ``with_json``
# records the paths a projection needs, builds one struct schema (all leaves
# STRING, which keeps ``->>`` semantics: numbers/booleans as text, objects as
# JSON text) and parses each payload once with ``from_json``.

def _split(path: str) -> list[tuple[str, bool]]:
    """'a.b[0].c' -> [('a', False), ('b', True), ('c', False)] (True = array, take [0])."""
    out = []
    for part in path.split("."):
        if part.endswith("[0]"):
            out.append((part[:-3], True))
        else:
            out.append((part, False))
    return out


def _schema(paths):
    from pyspark.sql import types as T
    tree: dict = {}
    for p in paths:
        node = tree
        parts = _split(p)
        for i, (name, arr) in enumerate(parts):
            last = i == len(parts) - 1
            key = (name, arr)
            if last and not arr:
                node.setdefault(key, None)
            else:
                nxt = node.get(key)
                if nxt is None:
                    nxt = {}
                    node[key] = nxt
                node = nxt

    def build(node) -> "T.StructType":
        fields = {}
        for (name, arr), child in node.items():
            if child is None:
                dt = T.StringType()
            else:
                dt = build(child)
            if arr:
                dt = T.ArrayType(dt if child is not None else T.StringType())
            if name in fields and isinstance(fields[name], T.StructType) and isinstance(dt, T.StructType):
                dt = T.StructType(list(fields[name].fields) + [f for f in dt.fields
                                                               if f.name not in fields[name].fieldNames()])
            fields[name] = dt
        return T.StructType([T.StructField(n, d, True) for n, d in fields.items()])
    return build(tree)


def _access(root: Column, path: str) -> Column:
    c = root
    for name, arr in _split(path):
        c = c.getField(name)
        if arr:
            c = F.get(c, 0)
    return c


def with_json(df, col: str, build, alias: str = "_j", variant: str | None = None):
    """``df.select(*build(get))`` where ``get(path)`` reads the parsed payload.

    ``build`` is called twice: once to record the paths, once for real. ``variant`` names a column with the payload as
    a variant, parsed once for all that read it (NULL where the payload is no JSON)."""
    seen: list[str] = []

    def record(path):
        seen.append(path)
        return F.lit(None).cast("string")
    build(record)
    parsed = df.withColumn(alias, F.from_json(F.col(col), _schema(seen)))
    if variant is not None:
        parsed = parsed.withColumn(variant, F.try_parse_json(F.col(col)))
    root = F.col(alias)
    return parsed.select(*build(lambda p: _access(root, p)))


def where_json(df, col: str, cond_builder, alias: str = "_w"):
    """Filter on payload paths with one parse; the parsed column is dropped."""
    seen: list[str] = []

    def record(path):
        seen.append(path)
        return F.lit(None).cast("string")
    cond_builder(record)
    parsed = df.withColumn(alias, F.from_json(F.col(col), _schema(seen)))
    root = F.col(alias)
    return parsed.where(cond_builder(lambda p: _access(root, p))).drop(alias)
