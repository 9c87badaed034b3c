"""Operator 10, mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies, target / source size; the whole part is
sure, the fraction is rounded. Two documents at a time trade words (one gains what the other loses, in a
random direction that keeps both expectations) until one of them has a whole number. Buckets of a source do
so side by side; the one open document that each leaves goes up a reduction tree, and only the last open
document of a source is rounded on its own. A trade is bounded by the shorter document, so the one left open may be long; a
source misses its target by that document's size at most.

Buckets come from hashes and the random numbers from the bucket's name, so reruns agree whatever the
partitioning. A source with any share of all rows is cut into buckets of about ``bucket_rows`` rows.

Defined cases: null text has size 0 and takes 0; null sources are one source, last; null or repeated ids are
documents of their own; equal sources share one target; an empty table gives no rows.
"""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import WORD, saved

#: Weights of the sources in code point order, repeating (fixed values of the contract).
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size, target``, one row per source of ``sizes(source, size)``.

    Targets share the sum of all sizes by weight; one that passes ``most`` times its source's size stops
    there and the excess is shared again by weight among the others, until none is above. The order of the
    sources comes from a distributed sort, the sharing from one aggregate per round.
    """
    spark = sizes.sparkSession
    s = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    ranked = s.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[0][2], float(weights[x[1] % len(weights)])))
    s = saved(spark.createDataFrame(ranked, "source string, source_size long, n_rows long, weight double"), "mix-sources")
    cap = F.col("source_size") * float(most)
    total = s.agg(F.sum("source_size")).first()[0] or 0
    rate, stopped = 0.0, -1
    while True:  # the rate only rises, so sources only stop
        over = F.lit(stopped >= 0) & (F.col("weight") * rate > cap)
        n, used, free = s.agg(F.count(F.when(over, 1)), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == stopped or not free:
            break
        rate, stopped = (total - (used or 0.0)) / free, n
    target = F.least(F.col("weight") * rate, cap) if stopped >= 0 else F.lit(0.0)
    return s.select("source", "source_size", "n_rows", target.alias("target"))


def _trade(rows, rng: random.Random):
    """Pivotal rounding of ``rows`` (key, size, fraction): the settled keys, and the open row if any."""
    settled, open_row = {}, None
    for key, size, p in rows:
        if p <= 0.0 or p >= 1.0:
            settled[key] = int(p >= 1.0)
            continue
        if open_row is None:
            open_row = (key, size, p)
            continue
        k, s, q = open_row
        up, down = min(s * (1 - q), size * p), min(s * q, size * (1 - p))
        if rng.random() * (up + down) < down:  # the open row gains ``up`` words
            done = s * (1 - q) <= size * p
            if done:
                settled[k] = 1
                open_row = (key, size, p - up / size)
            else:
                settled[key] = 0
                open_row = (k, s, q + up / s)
        else:
            done = s * q <= size * (1 - p)
            if done:
                settled[k] = 0
                open_row = (key, size, p + down / size)
            else:
                settled[key] = 1
                open_row = (k, s, q - down / s)
        if not 1e-12 < open_row[2] < 1 - 1e-12:
            settled[open_row[0]] = int(open_row[2] > 0.5)
            open_row = None
    return settled, open_row


LEAF = "doc_id long, source string, size long, row_hash long, source_size long, target double, sure int, bucket long, up int, left double"
NODE = "source string, leaf long, bucket long, size long, p double, up int"


def _leaf(seed: int):
    """Rounds one bucket of documents; ``up`` is -1 and ``left`` the fraction of the one that stays open."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("size", "descending"), ("row_hash", "ascending"), ("doc_id", "ascending")])
        name = f"{seed}/{t['source'][0].as_py()}/{t['bucket'][0].as_py()}"
        settled, rest = _trade(zip(range(len(t)), t["size"].to_pylist(), t["p"].to_pylist()), random.Random(name))
        left = [0.0] * len(t)
        if rest is not None:
            left[rest[0]] = rest[2]
        up = pa.array([settled.get(i, -1) for i in range(len(t))], pa.int32())
        return t.drop_columns(["p"]).append_column("up", up).append_column("left", pa.array(left, pa.float64()))

    return run


def _node(seed: int, level: int, fan_in: int, top: bool):
    """Rounds the open rows of ``fan_in`` buckets; at the top of the tree the last one goes to the nearer side."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("size", "descending"), ("leaf", "ascending")])
        group = t["bucket"][0].as_py() // fan_in
        p = t["p"].to_pylist()
        settled, last = _trade(zip(range(len(t)), t["size"].to_pylist(), p), random.Random(f"{seed}/{t['source'][0].as_py()}/{level}/{group}"))
        if last is not None:
            p[last[0]] = last[2]
            if top:
                settled[last[0]] = int(last[2] >= 0.5)
        up = [settled.get(i, -1) for i in range(len(t))]
        return pa.table({"source": t["source"], "leaf": t["leaf"], "bucket": pa.array([group] * len(t), pa.int64()), "size": t["size"],
                         "p": pa.array(p, pa.float64()), "up": pa.array(up, pa.int32())})

    return run


def mix(docs: DataFrame, bucket_rows: int = 4_000, fan_in: int = 64, seed: int = 0) -> DataFrame:
    """``doc_id, source, size, row_hash, source_size, target, copies`` for every row of ``docs(doc_id, source, text)``."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                    F.xxhash64("doc_id", "text").alias("row_hash"))
    d = saved(d, "mix-sizes")
    t = source_targets(d.select("source", "size"))
    few = t.withColumn("buckets", F.ceil(F.col("n_rows") / bucket_rows)).withColumnRenamed("source", "of")
    d = d.join(few, d["source"].eqNullSafe(few["of"])).drop("of", "n_rows")
    x = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    d = (d.withColumn("sure", F.when(F.col("size") > 0, F.floor(x)).otherwise(0).cast("int"))
         .withColumn("p", F.when(F.col("size") > 0, x - F.floor(x)).otherwise(0.0))
         .withColumn("bucket", F.pmod(F.xxhash64("row_hash", F.lit(seed)), F.col("buckets")).cast("long")))

    leaves = saved(d.select("doc_id", "source", "size", "row_hash", "source_size", "target", "sure", "bucket", "p").groupBy("source", "bucket").applyInArrow(_leaf(seed), LEAF), "mix-leaves")
    # The tree above the leaves: one open row per bucket, ``fan_in`` of them at a time.
    rest = leaves.where("up < 0").select("source", F.col("bucket").alias("leaf"), "bucket", "size", F.col("left").alias("p"))
    decided, top = [], False
    while not top:
        top = (rest.agg(F.max("bucket")).first()[0] or 0) < fan_in  # one group per source
        group = F.floor(F.col("bucket") / fan_in)
        made = saved(rest.groupBy("source", group).applyInArrow(_node(seed, len(decided), fan_in, top), NODE), "mix-tree")
        decided.append(made.where("up >= 0").select(F.col("source").alias("of"), "leaf", F.col("up").alias("raised")))
        rest = made.where("up < 0").drop("up")
    last = decided[0]
    for more in decided[1:]:
        last = last.unionByName(more)
    out = leaves.join(last, leaves["source"].eqNullSafe(last["of"]) & (leaves["bucket"] == last["leaf"]) & (leaves["up"] < 0), "left")
    return out.select("doc_id", "source", "size", "row_hash", "source_size", "target",
                      (F.col("sure") + F.when(F.col("up") < 0, F.coalesce("raised", F.lit(0))).otherwise(F.col("up"))).cast("int").alias("copies"))


def take_mix(docs: DataFrame) -> DataFrame:
    """Pipeline stage: each document as many times as the mix takes it.

    Rows of one hash (equal in id and text) share the list of their copies, one number each.
    """
    key, copies, n = "__mix_key", "__mix_copies", "__mix_n"
    lists = mix(docs).groupBy(F.col("row_hash").alias(key)).agg(F.sort_array(F.collect_list("copies")).alias(copies))
    d = docs.withColumn(key, F.xxhash64("doc_id", "text")).join(lists, key)
    d = d.withColumn(n, F.row_number().over(Window.partitionBy(key).orderBy(key)))
    d = d.withColumn(copies, F.element_at(copies, F.col(n))).where(F.col(copies) > 0)
    return d.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")

