"""Operator 11, ranked lexical search by Block-Max MaxScore.

Documents are dealt into shards, each with an inverted index: one row per shard and term with the term's postings in
document order, cut into blocks. A block keeps its last document and its largest impact in the open; documents (as
differences) and frequencies are packed and only unpacked when a block is needed.

A query runs on every shard, window by window of documents. Its lists are put in order of their largest possible score
(weight times largest impact): the lists whose bounds together do not exceed the k-th best score so far are
non-essential, since a document found in these alone cannot enter. Candidates come from the essential lists. Each then
gets, for every non-essential list, the bound of the one block that could hold it; a candidate whose score and bounds
do not exceed the k-th best is rejected before any of these blocks is unpacked. The rest is completed list by list, and
rejected as soon as what is left cannot lift it. Each shard returns its k best, and these heaps are merged.

Scores are whole numbers, and a bound must be exceeded by a strictly better one to be pruned, so results are exact.

Defined cases: a null text or one without terms holds no term and does not count; rows are documents of their own, also
when they repeat an id; a null id ranks last among equals; an item's terms are those of all its rows, items without an
id or without terms give no rows; equal scores go to the smaller id; empty tables give no rows. Columns other than
id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import saved, short_batches

#: Postings of a block; documents of a window; documents and text bytes at which a shard is closed; queries of a set.
BLOCK, SPAN, SHARD_DOCS, SHARD_BYTES, SET = 128, 512, 1 << 15, 1 << 23, 1 << 12
#: Fixed values of the score: scale of weight and impact, the length's share in hundredths, scaled by 8.
W_SCALE, SCALE, LENGTH_SHARE, K_SCALE = 1000, 10**9, 90, 8

_KEPT = set(range(0x30, 0x3A)) | set(range(0x41, 0x5B)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _KEPT else 0x20 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Letters, digits and all beyond ASCII, only A-Z lower-cased."""
    return text.translate(_FOLD).split() if text else []


def _utf8(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    return batch.column(name).cast(pa.binary()).to_pylist()


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Documents with at least one term, and all their terms with repeats."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            n = [len(terms(t)) for t in _utf8(b)]
            yield pa.RecordBatch.from_pydict({"docs": [sum(x > 0 for x in n)], "words": [sum(n)]})

    row = docs.select("text").mapInArrow(run, "docs long, words long").agg(F.sum("docs"), F.sum("words")).first()
    return row[0] or 0, row[1] or 0


def length_part(n, n_docs: int, n_words: int):
    """A document's m."""
    return 100 - LENGTH_SHARE + (LENGTH_SHARE * n * n_docs) // n_words


def impact(tf, m):
    return (SCALE * tf) // (1000 * tf + K_SCALE * m)


#: A row without a term holds the shard's documents: ids (with a mark for those that have one) and m.
INDEX = "shard long, term binary, df int, top int, last binary, tops binary, docs binary, tfs binary"


def _packed(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Bytes of ``values`` cut at ``starts``."""
    offsets = (np.append(starts, len(values)) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _shard(shard: int, ids: list, lists: list[list[bytes]], n_docs: int, n_words: int) -> Iterator[pa.RecordBatch]:
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    n = np.array([len(lists[i]) for i in order], np.int64)
    m = length_part(n, n_docs, n_words)
    known: dict[bytes, int] = {}
    words = np.fromiter((known.setdefault(t, len(known)) for i in order for t in lists[i]), np.int64, int(n.sum()))
    pair, tf = np.unique(words * len(ids) + np.repeat(np.arange(len(ids)), n), return_counts=True)
    term, doc = np.divmod(pair, len(ids))
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    at = np.arange(len(doc)) - np.repeat(starts, np.diff(np.append(starts, len(doc))))
    cut = np.flatnonzero(at % BLOCK == 0)
    ends = np.append(cut[1:], len(doc)) - 1
    tops = np.maximum.reduceat(impact(tf, m[doc]), cut).astype(np.int32)
    steps = np.diff(doc, prepend=0)
    steps[cut] = doc[cut]
    first = np.searchsorted(cut, starts)
    names = list(known)
    cols = [pa.array(np.full(len(starts), shard)), pa.array(names, pa.binary()),
            pa.array(np.diff(np.append(starts, len(doc))).astype(np.int32)), pa.array(np.maximum.reduceat(tops, first)),
            _packed(doc[ends].astype(np.uint16), first), _packed(tops, first), _packed(steps.astype(np.uint16), starts),
            _packed(tf.astype(np.uint8 if tf.max() < 256 else np.uint32), starts)]
    fields = [x.split()[0] for x in INDEX.split(", ")]
    yield pa.RecordBatch.from_arrays(cols, names=fields)
    held = np.array([i is not None for i in (ids[j] for j in order)])
    own = np.array([ids[j] or 0 for j in order], np.int64)
    row = [[shard], [None], [len(ids)], [0], [held.tobytes()], [b""], [own.tobytes()], [m.tobytes()]]
    yield pa.RecordBatch.from_arrays([pa.array(v, c.type) for v, c in zip(row, cols)], names=fields)


def build_index(docs: DataFrame, n_docs: int, n_words: int) -> DataFrame:
    """Inverted index of all documents with a term, by shard and term."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]):
        shard, ids, lists, size = TaskContext.get().partitionId() << 32, [], [], 0
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), _utf8(b)):
                if found := terms(t):
                    ids.append(i)
                    lists.append(found)
                    size += len(t)
                    if size >= SHARD_BYTES or len(ids) == SHARD_DOCS:
                        yield from _shard(shard, ids, lists, n_docs, n_words)
                        shard, ids, lists, size = shard + 1, [], [], 0
        if ids:
            yield from _shard(shard, ids, lists, n_docs, n_words)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX)


class _List:
    """One term's postings in a shard; blocks are unpacked when first asked for."""

    def __init__(self, top, last, tops, docs, tfs, m):
        self.top, self.m, self.opened = top, m, {}
        self.last, self.tops = np.frombuffer(last, np.uint16), np.frombuffer(tops, np.int32)
        self.steps = np.frombuffer(docs, np.uint16)
        self.tfs = np.frombuffer(tfs, np.uint8 if len(tfs) == len(self.steps) else np.uint32)

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        if b not in self.opened:
            part = slice(b * BLOCK, (b + 1) * BLOCK)
            docs = np.cumsum(self.steps[part], dtype=np.int64)
            self.opened[b] = docs, impact(self.tfs[part].astype(np.int64), self.m[docs])
        return self.opened[b]

    def bounds(self, docs: np.ndarray) -> np.ndarray:
        """Largest impact that each document can have, from the open part only."""
        at = np.searchsorted(self.last, docs)
        return np.where(at < len(self.tops), self.tops[np.minimum(at, len(self.tops) - 1)], 0).astype(np.int64)

    def impacts(self, docs: np.ndarray) -> np.ndarray:
        """Impacts of ascending documents, 0 where the term is absent."""
        out, at = np.zeros(len(docs), np.int64), np.searchsorted(self.last, docs)
        for b in np.unique(at[at < len(self.tops)]):
            own, value = self.block(b)
            mine = np.flatnonzero(at == b)
            j = np.minimum(np.searchsorted(own, docs[mine]), len(own) - 1)
            out[mine] = np.where(own[j] == docs[mine], value[j], 0)
        return out

    def add(self, score: np.ndarray, low: int, high: int, weight: int) -> None:
        """Scores of the documents from ``low`` up to ``high``."""
        for b in range(np.searchsorted(self.last, low), len(self.tops)):
            docs, value = self.block(b)
            if docs[0] >= high:
                break
            a, z = np.searchsorted(docs, (low, high))
            score[docs[a:z] - low] += weight * value[a:z]


def best(lists: list[tuple[int, _List]], n: int, k: int, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """The k best documents 0 .. n-1 and their scores, by falling score, ties to the smaller; weights must be positive."""
    lists = sorted(lists, key=lambda x: x[0] * x[1].top)
    total = np.cumsum([w * x.top for w, x in lists])
    docs, scores, kth = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for low in range(0, n, span):
        high = min(n, low + span)
        essential = int(np.searchsorted(total, kth, "right"))
        if essential == len(lists):
            break
        score = np.zeros(high - low, np.int64)
        for w, x in lists[essential:]:
            x.add(score, low, high, w)
        at = np.flatnonzero(score)
        score = score[at]
        at += low
        rest = [w * x.bounds(at) for w, x in lists[:essential]]
        left = np.sum(rest, axis=0) if rest else np.zeros(len(at), np.int64)
        for j in range(essential - 1, -1, -1):
            keep = score + left > kth
            at, score, left, rest = at[keep], score[keep], left[keep], [r[keep] for r in rest[: j + 1]]
            if not len(at):
                break
            w, x = lists[j]
            score, left = score + w * x.impacts(at), left - rest[j]
        docs, scores = np.concatenate([docs, at[score > kth]]), np.concatenate([scores, score[score > kth]])
        top = np.lexsort((docs, -scores))[:k]
        docs, scores = docs[top], scores[top]
        if len(docs) == k:
            kth = int(scores[-1])
    return docs, scores


def _cell(k: int):
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        items = list(zip(queries["item_id"].to_pylist(), queries["terms"].to_pylist()))
        index = index.sort_by("shard")
        shards = index["shard"].to_numpy()
        cuts = np.flatnonzero(np.diff(shards, prepend=-1, append=-1)) if len(shards) else []
        for a, z in zip(cuts, cuts[1:]):
            rows = index.slice(a, z - a).to_pylist()
            head = next(r for r in rows if r["term"] is None)
            m, ids = np.frombuffer(head["tfs"], np.int64), np.frombuffer(head["docs"], np.int64)
            held = np.frombuffer(head["last"], bool)
            lists = {r["term"]: _List(r["top"], r["last"], r["tops"], r["docs"], r["tfs"], m) for r in rows if r["term"] is not None}
            for item, wanted in items:
                found = [(t["w"], lists[t["term"]]) for t in wanted if t["term"] in lists and t["w"] > 0]
                for d, s in zip(*best(found, len(m), k)):
                    out.append((item, int(ids[d]) if held[d] else None, int(s)))
        cols = list(zip(*out)) or [(), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("item_id", "doc_id", "score"), cols)})

    return run


def weight(df: Column, n_docs: int) -> Column:
    return F.floor(W_SCALE * F.log(F.lit(2.0 * n_docs + 2) / (2.0 * df + 1))).cast("long")


def item_terms(items: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            rows = [(i, t) for i, x in zip(b.column("item_id").to_pylist(), _utf8(b)) for t in set(terms(x))]
            cols = list(zip(*rows)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary())], names=["item_id", "term"])

    d = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    return d.mapInArrow(run, "item_id long, term binary").distinct()


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents with a score above 0 of every item."""
    spark = docs.sparkSession
    n_docs, n_words = corpus_size(docs)
    index = saved(build_index(docs, n_docs, max(1, n_words)), "ranking-index")
    asked = saved(item_terms(items), "ranking-terms")
    known = asked.select("term").distinct()
    df = index.where("term IS NOT NULL").select("term", "df").join(known, "term").groupBy("term").agg(F.sum("df").alias("df"))
    n_items = asked.agg(F.approx_count_distinct("item_id")).first()[0]
    n_shards = index.where("term IS NULL").count()
    groups, sets = max(1, n_shards), max(1, -(-n_items // SET))
    queries = (asked.join(df, "term").groupBy("item_id")
               .agg(F.collect_list(F.struct("term", weight(F.col("df"), n_docs).alias("w"))).alias("terms"))
               .select("item_id", "terms", F.pmod(F.xxhash64("item_id"), F.lit(sets)).cast("int").alias("s"),
                       F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g")))
    lists = index.join(known, "term", "left_semi").unionByName(index.where("term IS NULL"))
    lists = lists.select("*", F.pmod(F.xxhash64("shard"), F.lit(groups)).cast("int").alias("g"),
                         F.explode(F.sequence(F.lit(0), F.lit(sets - 1))).alias("s"))
    found = lists.groupBy("g", "s").cogroup(queries.groupBy("g", "s")).applyInArrow(_cell(k), "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS t FROM documents WHERE text IS NOT NULL),
e AS (SELECT rid, doc_id, t, len(t) AS n FROM d WHERE len(t) > 0),
s AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_words FROM e),
p AS (SELECT rid, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf
      FROM (SELECT rid, doc_id, n, unnest(t) AS term FROM e) GROUP BY rid, term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS w FROM f, s),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL),
x AS (SELECT q.item_id, p.rid, any_value(p.doc_id) AS doc_id,
             sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (10 + (90 * p.n * s.n_docs) // s.n_words))))::BIGINT AS score
      FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY q.item_id, p.rid),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score
      FROM x WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
"""
