"""Newest row per key in two steps, without sorting or buffering whole rows.

An aggregate that carries a payload has no fixed-width buffer, so Spark sorts all payload rows before it. Here the order
of a row is one fixed-width number, made of its time and its landing id. Its maximum per key is a hash aggregate with
partial sums on the map side, so a key with a third of all snapshots ships one number per task. The winning rows are then
fetched by a hash join whose small side is these numbers; payload rows stream past it unsorted.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: An id has 64 bits, and NULL comes before all ids; a NULL time comes before all times.
IDS, FIRST_ID, NO_TIME = Decimal(2**64 + 1), Decimal(2**63 + 1), -(10**18)
ORDER = "decimal(38,0)"


def packable(df: DataFrame, order: str, tie: str) -> bool:
    """Whether the order of rows fits one number: a time and a whole number."""
    return (isinstance(df.schema[order].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
            and isinstance(df.schema[tie].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)))


def order_number(order: str, tie: str) -> Column:
    """Grows with (time, id) as a pair does; NULLs first."""
    time = F.coalesce(F.unix_micros(F.col(order).cast("timestamp")), F.lit(NO_TIME)).cast("decimal(19,0)")
    place = F.coalesce(F.col(tie).cast("decimal(19,0)") + F.lit(FIRST_ID), F.lit(0).cast("decimal(20,0)"))
    return (time * F.lit(IDS) + place).cast(ORDER)


def newest(rows: DataFrame, keys: Sequence[str], order: str, tie: str, keep: str | None = None) -> DataFrame:
    """(keys, _order): the largest order number of each key; keys without a kept row are absent."""
    number = order_number(order, tie)
    best = rows.select(*keys, (number if keep is None else F.when(F.col(keep), number)).alias("_order"))
    return best.groupBy(*keys).agg(F.max("_order").alias("_order")).where("_order IS NOT NULL")


def fetch(rows: DataFrame, best: DataFrame, same: Sequence[str], tie_break: Sequence[str], equal: Sequence[str] = ("_order",)) -> DataFrame:
    """Rows of ``best``, joined on ``equal`` columns and on ``same`` (equal or both NULL); of rows equal there, one."""
    on = [*equal, *same]
    b = best.withColumnsRenamed({c: f"_b_{c}" for c in on}).hint("shuffle_hash")
    got = rows.join(b, [*[rows[c] == b[f"_b_{c}"] for c in equal], *[rows[c].eqNullSafe(b[f"_b_{c}"]) for c in same]])
    # only winners come here, one row for nearly every key
    one = Window.partitionBy(*[f"_b_{c}" for c in on]).orderBy(*[F.xxhash64(F.col(c)) for c in tie_break])
    return got.withColumn("_one", F.row_number().over(one)).where("_one = 1").drop("_one", *[f"_b_{c}" for c in on])


def latest_snapshot(df: DataFrame, keys: Sequence[str],
                    order_cols: Sequence[str] = ("fetched_at",),
                    tie_cols: Sequence[str] = ("id",),
                    keep: str | None = None) -> DataFrame:
    """Keep, per ``keys``, the row with the greatest (order_cols, tie_cols).

    Reference ties are arbitrary; here the tie-break columns make it
    deterministic. Pre-filters must act *before* the choice (a pending review
    must not shadow an older submitted one): pass them as the boolean column
    ``keep``; keys with no kept row vanish. Orders other than a time and a
    whole number are compared as structs, in one aggregate.
    """
    keys, order, tie = list(keys), list(order_cols), list(tie_cols)
    rest = [c for c in df.columns if c not in keys and c != keep]
    if len(order) == len(tie) == 1 and packable(df, order[0], tie[0]):
        best = newest(df, keys, order[0], tie[0], keep)
        rows = df.withColumn("_order", order_number(order[0], tie[0]))
        if keep is not None:
            rows = rows.where(F.col(keep))
        return fetch(rows, best, keys, rest).select(*keys, *rest)
    rank = F.struct(*[F.col(c) for c in order + tie])
    if keep is not None:
        rank = F.when(F.col(keep), rank)
    out = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in rest]), rank).alias("_row"))
    if keep is not None:
        out = out.where(F.col("_row").isNotNull())
    return out.select(*keys, *[F.col("_row." + c).alias(c) for c in rest])


def latest_landed(raw: DataFrame, keyed: DataFrame, keys: Sequence[str], keep: str) -> DataFrame:
    """(keys, payload, fetched_at, id) of each key's newest landed row; ``keys`` begin with tenant_id.

    ``keyed`` has the keys of ``raw``'s rows, parsed from the payload, with fetched_at and id. Payloads are fetched by
    time and landing id, which tell the landed rows of a tenant's resource apart; so they are parsed for the keys once
    and carried through no aggregate."""
    best = newest(keyed, keys, "fetched_at", "id", keep)
    rows = raw.select("tenant_id", "id", "payload", "fetched_at").withColumn("_order", order_number("fetched_at", "id"))
    return fetch(rows, best, ["tenant_id"], ["payload"]).select(*keys, "payload", "fetched_at", "id")
