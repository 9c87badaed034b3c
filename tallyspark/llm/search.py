"""Operator 6, exact top-k inner products with block-at-a-time pruning.

Vectors are put in an order in which neighbours look alike (signs of fixed random projections) and cut into
blocks, each with its forward index (the integer components of its rows) and the largest and smallest value
of every component. A block's bound for a query is the sum over components of the larger product with those
two. Each query visits blocks by falling bound and stops once the bound is below its k-th best score; its
first k-th score comes from the block that it stands in itself, so blocks of far regions need not be visited;
on vectors without clusters every block may be.

The stated queries meet all rows in cells of a bounded number of queries and blocks; a cell is one task's
work, and each returns at most k rows per query to the final merge.

Defined cases: vectors that are null or hold null or non-finite components, and rows without an id, take no
part; missing components of shorter vectors count as 0; equal scores go to the smaller id; rows equal in id
and vector count once; scores beyond 64 bits stop at the limits; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import saved

#: Rows of a block; most rows and most queries of a cell; bits of the order.
BLOCK, CELL_ROWS, CELL_QUERIES, BITS = 128, 1 << 18, 1 << 14, 16
EXACT = 2.0**53


def _padded(rows: list[np.ndarray], dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _codes(m: np.ndarray) -> np.ndarray:
    """Signs of fixed random projections as one number."""
    planes = np.random.default_rng(7).standard_normal((BITS, m.shape[1]))
    with np.errstate(over="ignore", invalid="ignore"):
        return ((m @ planes.T) > 0) @ (1 << np.arange(BITS, dtype=np.int64))


def products(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products, in floats where these are exact and in whole numbers where not."""
    if float(np.abs(rows).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, len(q)) < EXACT:
        return rows @ q
    whole = [int(x) for x in q]
    return np.array([sum(int(a) * b for a, b in zip(r, whole)) for r in rows], dtype=object)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, ties to the smaller id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], int)
    return np.lexsort((ids, -scores))[:k]


def prepare(vectors: DataFrame) -> DataFrame:
    """``vec_id, code, v``: scaled whole components (as doubles) of the vectors that take part."""
    d = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    d = d.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & ~bad)

    def run(batches):
        for b in batches:
            rows = [np.floor(256.0 * np.array(x, float)) for x in b.column("e").to_pylist()]
            dim = max((len(r) for r in rows), default=0)
            codes = _codes(_padded(rows, dim)) if dim else np.zeros(len(rows), np.int64)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(codes, pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["vec_id", "code", "v"])

    return d.mapInArrow(run, "vec_id long, code long, v binary")


BLOCKS = "block long, dim int, ids binary, v binary, q_ids binary, q_v binary, q_least binary"


def build_blocks(prepared: DataFrame, every: int, k: int, block: int = BLOCK) -> DataFrame:
    """Blocks in code order; each carries its queries (ids divisible by ``every``) with a first k-th score."""
    d = prepared.repartitionByRange("code", "vec_id").sortWithinPartitions("code", "vec_id", "v")

    def run(batches):
        ids, rows, last, n = [], [], None, 0
        out = []

        def cut():
            dim = max(len(r) for r in rows)
            m, own = _padded(rows, dim), np.array(ids, np.int64)
            at = np.flatnonzero(own % every == 0)
            least = []
            for i in at:
                other = np.flatnonzero(own != own[i])
                s = products(m[other], m[i])
                best = _best(own[other], s, k)
                least.append(float(s[best[-1]]) if len(best) == k and s.dtype != object else -np.inf)
            out.append((dim, own.tobytes(), m.tobytes(), own[at].tobytes(), m[at].tobytes(), np.array(least, float).tobytes()))

        def batch():
            cols = list(zip(*out))
            types = [pa.int32()] + [pa.binary()] * 5
            return pa.RecordBatch.from_arrays([pa.array(range(n, n + len(out)), pa.int64())] + [pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in BLOCKS.split(", ")])

        for b in batches:
            for vec, v in zip(b.column("vec_id").to_pylist(), b.column("v").to_pylist()):
                if (vec, v) == last:
                    continue
                last = (vec, v)
                ids.append(vec)
                rows.append(np.frombuffer(v))
                if len(ids) == block:
                    cut()
                    ids, rows = [], []
            if len(out) >= 64:
                yield batch()
                n += len(out)
                out.clear()
        if ids:
            cut()
        if out:
            yield batch()

    return d.mapInArrow(run, BLOCKS).withColumn("block", F.monotonically_increasing_id())


def _cell(k: int):
    """Best k of a cell's blocks for each of its queries."""

    def run(blocks: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if len(blocks) and len(queries):
            dims = blocks["dim"].to_pylist()
            dim = max(max(dims), max(queries["dim"].to_pylist()))
            widen = lambda m: np.pad(m, ((0, 0), (0, dim - m.shape[1])))
            ids = [np.frombuffer(x, np.int64) for x in blocks["ids"].to_pylist()]
            index = [widen(np.frombuffer(x).reshape(len(i), d)) for x, i, d in zip(blocks["v"].to_pylist(), ids, dims)]
            top, low = np.array([m.max(0) for m in index]), np.array([m.min(0) for m in index])
            for qd, q_ids, q_v, q_least in zip(*(queries[c].to_pylist() for c in ("dim", "q_ids", "q_v", "q_least"))):
                own, least = np.frombuffer(q_ids, np.int64), np.frombuffer(q_least)
                m = widen(np.frombuffer(q_v).reshape(len(own), qd))
                bound = np.maximum(m, 0) @ top.T + np.minimum(m, 0) @ low.T
                bound = bound + np.abs(bound) * 1e-9  # never below the true one
                for i, name in enumerate(own):
                    kth, best_ids, best = least[i], np.zeros(0, np.int64), np.zeros(0)
                    for j in np.argsort(-bound[i], kind="stable"):
                        if bound[i, j] < kth:
                            break
                        s = products(index[j], m[i])
                        keep = (s >= kth) & (ids[j] != name)
                        if not keep.any():
                            continue
                        best_ids, best = np.concatenate([best_ids, ids[j][keep]]), np.concatenate([best, s[keep]])
                        at = _best(best_ids, best, k)
                        best_ids, best = best_ids[at], best[at]
                        if len(best) == k:
                            kth = max(kth, float(best[-1]) if best.dtype != object else float(best[-1]) * (1 - 1e-12 * np.sign(float(best[-1]))))
                    found += [(int(name), int(v), int(min(max(s, -(2**63)), 2**63 - 1))) for v, s in zip(best_ids, best)]
        cols = list(zip(*found)) or [(), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), cols)})

    return run


def search(vectors: DataFrame, every: int, k: int, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best other rows of each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    blocks = saved(build_blocks(prepare(vectors), every, k, block), "search-blocks")
    n, queries = blocks.agg(F.count(F.lit(1)), F.sum(F.length("q_ids")) / 8).first()
    tasks = max(8, 2 * spark.sparkContext.defaultParallelism)
    per_group = max(1, min(CELL_ROWS // block, -(-n // tasks)))
    groups, sets = max(1, -(-n // per_group)), max(1, -(-int(queries or 0) // CELL_QUERIES))
    part = F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")
    left = blocks.select("dim", "ids", "v", part.alias("g"), F.explode(F.sequence(F.lit(0), F.lit(sets - 1))).alias("s"))
    right = (blocks.where(F.length("q_ids") > 0)
             .select("dim", "q_ids", "q_v", "q_least", F.pmod(F.xxhash64("block", F.lit(1)), F.lit(sets)).cast("int").alias("s"),
                     F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g")))
    found = left.groupBy("g", "s").cogroup(right.groupBy("g", "s")).applyInArrow(_cell(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=50, k=5)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0),
r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
