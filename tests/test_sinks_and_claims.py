"""Sinks that keep readers right, joins on repository, identity claims, loud failures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import identity as J
from tallyspark.plans import org as G
from tallyspark.sources import landing as A
from tallyspark.sources import sinks as SK
from tallyspark.streaming import streams as L

IDS = "tenant_id string, external_user_id string, login string, email string, name string, org_role string, user_id string, link_method string, status string"


def read(spark, path, like):
    return sorted((r.tenant_id, r.v) for r in SK.read_mart(spark, path).collect())


def test_full_refresh_removes_vanished_tenants(spark, tmp_path):
    path = str(tmp_path / "m")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "v int, tenant_id string")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        SK.sink_full_refresh(df, path)
        SK.sink_full_refresh(df.where("tenant_id = 'a'"), path)
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    assert read(spark, path, df) == [("a", 1)]


def test_tenant_replace_escapes_failures_and_self_reads(spark, tmp_path):
    path = str(tmp_path / "m")
    df = spark.createDataFrame([(1, "x:1"), (2, "b"), (3, "c d/e")], "v int, tenant_id string")
    SK.sink_full_refresh(df, path)
    SK.sink_mart_tenant_replace(df.withColumn("v", F.col("v") + 10), path, ["x:1", "c d/e"])
    assert read(spark, path, df) == [("b", 2), ("c d/e", 13), ("x:1", 11)]
    bad = df.withColumn("v", F.raise_error(F.lit("broken")).cast("int"))
    with pytest.raises(Exception, match="broken"):
        SK.sink_mart_tenant_replace(bad, path, ["b"])
    assert read(spark, path, df) == [("b", 2), ("c d/e", 13), ("x:1", 11)]
    again = SK.read_mart(spark, path).withColumn("v", F.col("v") * 2)
    SK.sink_mart_tenant_replace(again, path, ["b", "gone"])
    assert read(spark, path, df) == [("b", 4), ("c d/e", 13), ("x:1", 11)]


def test_metric_pointer_is_replaced_and_missing_metrics_raise(spark, tmp_path):
    base, cols = str(tmp_path / "m"), "tenant_id string, metric_id string, value double"
    for v in (1.0, 2.0):
        SK.sink_metric_swap(spark.createDataFrame([("a", "m1", v)], cols), base, "m1")
        assert [r.value for r in SK.read_metric_values(spark, base, ["m1"]).collect()] == [v]
    with pytest.raises(LookupError, match="m2"):
        SK.read_metric_values(spark, base, ["m1", "m2"])
    assert SK.read_metric_values(spark, base, ["m1", "m2"], missing_ok=True).count() == 1


def test_linked_users_leave_an_identity_to_the_next_claim(spark):
    ids = spark.createDataFrame([("t", "X", "x", "x@m", "X", "member", None, None, "pending_email"),
                                 ("t", "Y", "y", "y@m", "Y", "member", "u1", "email", "linked")], IDS)
    signups = spark.createDataFrame([("u1", "X", None), ("u2", None, "X@m")], "user_id string, oauth_id string, email string")
    got = {r.external_user_id: (r.user_id, r.link_method) for r in J.claim_pending(ids, signups).collect()}
    assert got == {"X": ("u2", "email"), "Y": ("u1", "email")}


def test_membership_is_for_new_links_only(spark):
    before = spark.createDataFrame([("t", "A", "a", None, "A", "admin", "u1", "email", "linked"), ("t", "B", "b", None, "B", "member", None, None, "pending_email")], IDS)
    linked = before.withColumn("user_id", F.coalesce("user_id", F.lit("u2")))
    none = spark.createDataFrame([], "tenant_id string, user_id string, role string")
    assert [tuple(r) for r in J.ensure_membership(linked, none, before).collect()] == [("t", "u2", "individual")]


def test_rows_without_person_dims_come_once(spark):
    values = spark.createDataFrame([("t", 1.0), ("t", 2.0)], "tenant_id string, value double")
    ids = spark.createDataFrame([("t", c, c) for c in "abc"], "tenant_id string, caller string, key string")
    assert sorted((r.value, r.caller) for r in G.ic_rows(values, ids, []).collect()) == [(1.0, None), (2.0, None)]


def test_record_ids_repeat_on_replay(spark):
    rec = spark.createDataFrame([("t", "s", '{"a":1}', dt.datetime(2024, 1, 1)), ("t", "s", '{"a":2}', dt.datetime(2024, 1, 1))],
                                "tenant_id string, stream string, payload string, fetched_at timestamp")
    one, two = (sorted(r.id for r in A.land_raw_append(d, "github", 5).collect()) for d in (rec, rec.repartition(2)))
    assert one == two and len(set(one)) == 2


def test_unreadable_output_is_an_error(spark, tmp_path):
    like = spark.createDataFrame([(1,)], "v int")
    assert L._read_or_empty(spark, str(tmp_path / "none"), like).count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        L._read_or_empty(spark, str(tmp_path / "bad"), like).count()
