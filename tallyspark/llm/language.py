"""Operator 1, language ID: script ranges narrow the candidates of each word, Viterbi over per-word
scores with a switching penalty labels the spans of mixed-language text.

A word is a run of letters. Its score in a language is the sum of the log-probabilities of its letter
trigrams (with word ends as letters). The scores of a whole batch come from one table lookup in numpy;
Viterbi walks the words of all documents of a batch side by side.

Defined cases: null or letterless text gives ``und``, score 0 and no spans; a word in a script that no
learned language uses says nothing; equal scores go to the language first in name order; repeated rows are
predicted one by one; an empty table gives no rows; with no labelled row every text is ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import map_rows

BUCKETS = 1 << 16
#: First code point of script ranges and a number for each script; 0: any script (fixed values).
SCRIPTS = [
    (0x0000, 1), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0700, 7), (0x0900, 8), (0x0980, 9),
    (0x0A00, 10), (0x0B00, 11), (0x0B80, 12), (0x0C00, 13), (0x0C80, 14), (0x0D00, 15), (0x0D80, 16), (0x0E00, 17),
    (0x0E80, 18), (0x0F00, 19), (0x1000, 20), (0x10A0, 21), (0x1100, 22), (0x1200, 23), (0x1380, 24), (0x1780, 25),
    (0x1800, 26), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x2C80, 27), (0x2E80, 28), (0x3040, 29), (0x3100, 28),
    (0x3130, 22), (0x3200, 28), (0xA000, 0), (0xAC00, 22), (0xD7B0, 0), (0xF900, 28), (0xFB50, 6), (0xFE30, 0),
    (0xFF66, 29), (0xFFA0, 22), (0x10000, 0), (0x20000, 28), (0x30000, 0),
]
N_SCRIPTS = 30
#: Code points scored, and walked by Viterbi, at a time.
SCORE_CHARS, WALK_CHARS = 500_000, 4_000_000


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letter of each code point (0: no letter) and the script of each."""
    low = np.zeros(0x110000, np.uint32)
    for i in range(0x32000):
        c = chr(i)
        if c.isalpha():
            x = c.lower()
            low[i] = ord(x) if len(x) == 1 else i
    starts = np.array([s for s, _ in SCRIPTS])
    ids = np.array([k for _, k in SCRIPTS], np.uint8)
    script = ids[np.searchsorted(starts, np.arange(0x110000), "right") - 1]
    return low, script


def _features(texts: list[str]):
    """Trigram buckets and scripts of the letters of ``texts``, and their words.

    Returns (bucket per letter, first letter of each word, its script, its document, its start, its length)."""
    low, script = _tables()
    raw = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
    c = np.zeros(len(raw) + 2, np.uint32)
    c[1:-1] = low[raw]
    at = np.flatnonzero(c[1:-1])
    h = (c[at] * np.uint32(0x9E3779B1)) ^ (c[at + 1] * np.uint32(0x85EBCA77)) ^ (c[at + 2] * np.uint32(0xC2B2AE3D))
    h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
    first = np.flatnonzero(c[at] == 0)
    start = at[first]
    size = np.diff(np.append(first, len(at)))
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    doc = np.searchsorted(begins, start, "right") - 1
    return h, first, script[raw[start]], doc, start - begins[doc], size


@dataclass
class Model:
    """Log-probability of each trigram bucket by language, and which scripts each language uses."""

    langs: list[str]
    table: np.ndarray
    scripts: np.ndarray
    penalty: float = 10.0


def held_out(doc_id) -> F.Column:
    """Documents that nothing is learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")), F.lit(0)) % 4 == 2


def train(docs: DataFrame, train_docs: int = 4096, alpha: float = 0.05, penalty: float = 10.0) -> Model:
    """Fit on a bounded sample: the ``train_docs`` labelled documents with the smallest hashed id.

    The sample is chosen from ids and labels alone; its texts are counted in tasks, and the driver gets at
    most one count for each bucket and language.
    """
    d = docs.select("doc_id", "lang", "text")
    ids = (d.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
           .select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(train_docs).select("doc_id"))
    sample = d.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).join(F.broadcast(ids.distinct()), "doc_id", "left_semi")

    def count(batches):
        for b in batches:
            langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
            for lang in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs) if x == lang]
                h, first, script, _, _, size = _features(own)
                n = np.concatenate([np.bincount(h, minlength=BUCKETS), np.bincount(script, weights=size, minlength=N_SCRIPTS).astype(np.int64)])
                k = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k, pa.int32()), pa.array(n[k], pa.int64())], names=["lang", "k", "n"])

    counts = sample.select("lang", "text").mapInArrow(count, "lang string, k int, n bigint").groupBy("lang", "k").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counts["lang"].to_pylist()))
    n = np.zeros((BUCKETS + N_SCRIPTS, len(langs)))
    if langs:
        place = {x: i for i, x in enumerate(langs)}
        n[counts["k"].to_numpy(), [place[x] for x in counts["lang"].to_pylist()]] = counts["n"].to_numpy()
    grams, scripts = n[:BUCKETS], n[BUCKETS:]
    used = max(1, int((grams.sum(1) > 0).sum()))
    table = np.log((grams + alpha) / (grams.sum(0) + alpha * used)).astype(np.float32)
    return Model(langs, table, scripts > 0.01 * np.maximum(scripts.sum(0), 1), penalty)


def _word_scores(texts: list[str], m: Model):
    """Scores (words x languages, best 0) of all words, and their document, start and length."""
    parts, lo = [], 0
    while lo < len(texts):
        hi, n = lo, 0
        while hi < len(texts) and (hi == lo or n + len(texts[hi]) <= SCORE_CHARS):
            n += len(texts[hi])
            hi += 1
        h, first, script, doc, start, size = _features(texts[lo:hi])
        if len(first):
            s = np.add.reduceat(m.table[h], first, axis=0)
            able = m.scripts[script]
            some = able.any(1)
            s = np.where(able | ~some[:, None], s, s - 1000)
            s[~some] = 0
            parts.append((np.maximum(s - s.max(1, keepdims=True), -30).astype(np.float32), doc + lo, start, size))
        lo = hi
    if not parts:
        z = np.zeros(0, np.int64)
        return np.zeros((0, len(m.langs)), np.float32), z, z, z
    return tuple(np.concatenate(x) for x in zip(*parts))


def viterbi(score: np.ndarray, first: np.ndarray, count: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of each word; sequence d has the rows first[d] .. first[d] + count[d] of ``score``."""
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    longest = int(count[0]) if len(count) else 0
    active = np.searchsorted(-count, -np.arange(longest), "left")  # sequences longer than t
    label = np.zeros(len(score), np.int16)
    if not longest:
        return label
    came = np.zeros((len(score), score.shape[1]), np.int16)
    v = score[first[: active[0]]].astype(np.float64)
    ends = np.zeros(len(count), np.int16)
    stay = np.arange(score.shape[1], dtype=np.int16)
    for t in range(1, longest):
        n = active[t]
        if n < len(v):
            ends[n:len(v)] = v[n:].argmax(1)
            v = v[:n]
        best = v.argmax(1)
        jump = np.take_along_axis(v, best[:, None], 1) - penalty
        at = first[:n] + t
        came[at] = np.where(v >= jump, stay, best[:, None])
        v = np.maximum(v, jump) + score[at]
    ends[: len(v)] = v.argmax(1)
    for t in range(longest - 1, -1, -1):
        at = first[: active[t]] + t
        label[at] = ends[: active[t]]
        ends[: active[t]] = came[at, ends[: active[t]]]
    return label


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())]))


def label_texts(texts: list[str | None], m: Model) -> tuple[list[str], np.ndarray, pa.Array]:
    """Language, score (share of the letters in its spans) and labelled spans of each text."""
    n = len(texts)
    share = np.zeros((n, max(1, len(m.langs))))
    spans: list[tuple] = []
    lo = 0
    while lo < n and m.langs:
        hi, chars = lo, 0  # so many texts that their words fit in memory
        while hi < n and (hi == lo or chars + len(texts[hi] or "") <= WALK_CHARS):
            chars += len(texts[hi] or "")
            hi += 1
        score, doc, start, size = _word_scores([x or "" for x in texts[lo:hi]], m)
        count = np.bincount(doc, minlength=hi - lo)
        label = viterbi(score, np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64), count, m.penalty)
        np.add.at(share, (doc + lo, label), size)
        if len(doc):
            new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])]))
            last = np.append(new[1:], len(doc)) - 1
            spans.append((doc[new] + lo, start[new], start[last] + size[last], label[new]))
        lo = hi
    total = share.sum(1)
    best = share.argmax(1)
    names = m.langs or ["und"]
    langs = [names[k] if t else "und" for k, t in zip(best, total)]
    value = share[np.arange(n), best] / np.maximum(total, 1)
    if not spans:
        return langs, value, pa.array([[]] * n, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])))
    doc, begin, end, label = (np.concatenate(x) for x in zip(*spans))
    items = pa.StructArray.from_arrays([pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array([names[k] for k in label], pa.string())], names=["start", "end", "lang"])
    offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))]).astype(np.int32)
    return langs, value, pa.ListArray.from_arrays(pa.array(offsets), items)


def identify(docs: DataFrame, model: Model, prefix: str = "") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``spans`` (names after ``prefix``); reads only ``text``."""
    p = prefix
    new = T.StructType([T.StructField(p + "lang_pred", T.StringType()), T.StructField(p + "score", T.DoubleType()), T.StructField(p + "spans", SPANS)])

    def run(b):
        langs, score, spans = label_texts(b.column("text").to_pylist(), model)
        return {p + "lang_pred": pa.array(langs, pa.string()), p + "score": pa.array(score, pa.float64()), p + "spans": spans}

    return map_rows(docs, run, new)


def keep_identified(docs: DataFrame, min_score: float = 0.34) -> DataFrame:
    """Pipeline stage: drop texts without letters and texts of which no language covers ``min_score``."""
    p = "__language_"
    d = identify(docs, train(docs), p)
    return d.where((F.col(p + "lang_pred") != "und") & (F.col(p + "score") >= min_score)).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
