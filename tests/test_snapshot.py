"""Newest rows by order numbers against sorting: ties, NULLs, repeats, extreme ids."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tallyspark.operators.snapshot import latest_landed, latest_snapshot, order_number

COLS = "k string, fetched_at timestamp, id long, payload string, ok boolean"
LOW, HIGH = -(2**63), 2**63 - 1


def made(n=400):
    r = random.Random(1)
    when = lambda: r.choice([None, *[dt.datetime(2024, 1, d) + dt.timedelta(microseconds=m) for d in (1, 2) for m in (0, 1)], dt.datetime(1, 1, 2), dt.datetime(9999, 12, 30)])
    rows = [(r.choice(["a", "b", "c", None]), when(), r.choice([None, LOW, -1, 0, 1, HIGH, r.randint(0, 99)]), f"p{i}", r.random() < 0.7) for i in range(n)]
    return rows + rows[:50]


def place(row):
    return (row[1] is not None, row[1] or dt.datetime.min, row[2] is not None, row[2] or 0)


def test_order_numbers_compare_as_pairs(spark):
    rows = made()
    got = spark.createDataFrame(rows, COLS).select("fetched_at", "id", order_number("fetched_at", "id").alias("o")).collect()
    by = sorted(got, key=lambda x: place((None, x.fetched_at, x.id)))
    assert all((a.o < b.o) == (place((0, a.fetched_at, a.id)) < place((0, b.fetched_at, b.id))) for a, b in zip(by, by[1:]))


def best(rows):
    out = {}
    for r in rows:
        if r[4] and (r[0] not in out or place(r) > out[r[0]]):
            out[r[0]] = place(r)
    return out


def test_newest_row_of_each_key(spark):
    rows = made()
    got = latest_snapshot(spark.createDataFrame(rows, COLS), ["k"], keep="ok").collect()
    want = best(rows)
    assert len(got) == len(want) and {r.k: place((0, r.fetched_at, r.id)) for r in got} == want
    assert all((r.k, r.fetched_at, r.id, r.payload) in {x[:4] for x in rows} for r in got)
    again = latest_snapshot(spark.createDataFrame(rows[::-1], COLS).repartition(5), ["k"], keep="ok").collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_other_orders_are_compared_as_structs(spark):
    d = spark.createDataFrame([("a", "x", "1"), ("a", "y", "0"), ("a", "y", "2")], "k string, o string, t string")
    assert [tuple(r) for r in latest_snapshot(d, ["k"], ["o"], ["t"]).collect()] == [("a", "y", "2")]


def test_landed_rows_of_several_tenants_may_share_ids(spark):
    raw = spark.createDataFrame([(t, i, f"{t}{i}", dt.datetime(2024, 1, 1 + i % 3)) for t in ("a", "b", None) for i in range(9)] + [("a", 8, "a8", dt.datetime(2024, 1, 3))],
                                "tenant_id string, id long, payload string, fetched_at timestamp")
    keyed = raw.select("tenant_id", (F.col("id") % 2).alias("q"), "fetched_at", "id", (F.col("id") != 7).alias("ok"))
    got = sorted((repr(r.tenant_id), r.q, r.payload) for r in latest_landed(raw, keyed, ["tenant_id", "q"], "ok").collect())
    assert got == sorted((repr(t), q, f"{t}{i}") for t in ("a", "b", None) for q, i in ((0, 8), (1, 5)))
    assert latest_landed(raw.where("false"), keyed.where("false"), ["tenant_id", "q"], "ok").collect() == []
