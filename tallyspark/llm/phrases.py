"""Operator 13, phrase collocation mining by dynamic itemset counting.

Documents are dealt into a few shards, which are scanned in turn, round and round. Single words are counted from the
first shard on. After each shard the counts so far are looked at: a longer phrase becomes active as soon as both of its
subphrases (without the last word, without the first) have reached the threshold, and is counted from the next shard
on, until it has seen every shard once. So lengths interleave: while words are still in their first cycle, pairs that
already qualify are being counted, and triples of these. The scan ends when no length has an unfinished cycle.

An active subphrase is known to the tasks by the number of the scan before which it became active, kept in a table of
``CELLS`` bytes at the phrase's hash. Phrases that share a cell become active together, at the earlier of their
scans, and are still counted over one full cycle each, so counts are exact whatever the table's load; phrases that
became active without need are dropped by their count. The table is all that a task gets, and of fixed size.

Words are cut out of whole Arrow batches with array functions. A phrase is known by 96 bits of hash until the counts
are final; the texts of the phrases that reached the threshold are then read in one more scan. Each entry keeps the
``kind`` (16 bits of a hash of its row) of one document that holds the phrase; documents and frequent phrases meet by kind, and
the group that has both names the phrase, once, with its count. Tasks count before they send; counts are kept by length, first scan and hash bucket, so a phrase holding a third of all rows is one entry per
task. A cycle that is complete leaves the phrases that reached the threshold only, and these are not moved again.

Disk: a scan of more than ``SECTION_BYTES`` of text counts the phrases of one section of the hash buckets after the other (up to ``SECTIONS``, each
a pass over the shard), so that what is shuffled at a time is a part of the scan's. What stays from scan to scan is the entries
of the lengths whose cycle is open, and of these each section's old files go as soon as its new ones stand.

Defined cases: null and empty texts hold no words; a null lang is ``und`` (and counts with documents that say so);
rows are documents of their own, also when repeated; phrases never cross pieces or documents; fewer than ``top``
phrases of a lang are all returned; an empty table gives no rows. Columns other than text, lang and id are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import forget, new_path, saved, short_batches, tidy

#: Shards of a cycle; cells of an activation table; places that a task holds before it sends; text bytes of a bucket, and
#: those that are cut into words at a time (more only for a text that is longer).
SHARDS, CELLS, HELD, BUCKET_BYTES, SLICE_BYTES = 2, 1 << 22, 1 << 19, 1 << 23, 1 << 18
#: Bytes of all texts for one section of a scan; sections at most (each reads the shard again); groups of documents for a bucket.
SECTION_BYTES, SECTIONS, SLOTS = 1 << 31, 2, 4
#: Words of the longest phrase, smallest count (fixed values of the query).
LONGEST, LEAST, TOP = 3, 10, 2000
NEVER = 255
SALTS = 64

_WORD, _BLANK, _BREAK = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x09, 0x20]] = _BLANK
_KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_RANDOM = np.random.default_rng(13).integers(1, 1 << 63, (2, 256), np.uint64)
_BASE = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_INVERSE = tuple(pow(b, -1, 1 << 64) for b in _BASE)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of a fresh array, in place."""
    for shift, by in ((32, _A), (29, _B)):
        x ^= x >> np.uint64(shift)
        x *= by
    x ^= x >> np.uint64(32)
    return x


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _first_powers(base: int, n: int) -> np.ndarray:
    """The first n powers, cut from a kept array, longer only for a longer text."""
    return _powers(base, 1 << max(20, (n - 1).bit_length()))[:n]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each run of bytes."""
    return span_hash(data, start, end, 0), span_hash(data, start, end, 1)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, h: int) -> np.ndarray:
    sums = np.append(np.uint64(0), np.cumsum(_RANDOM[h][data] * _first_powers(_BASE[h], len(data)), dtype=np.uint64))
    return _mix((sums[end] - sums[start]) * _first_powers(_INVERSE[h], len(data) + 1)[start] + (end - start).astype(np.uint64) * _A)


class Words:
    """The words of a batch of texts: places in the lower-cased bytes, neighbours in the same piece, hashes of phrases."""

    def __init__(self, texts: pa.Array, langs: list[str | None], kinds: np.ndarray):
        texts = pa.concat_arrays([texts.cast(pa.binary()).fill_null(b"")])
        edge = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edge[0] : edge[-1]] if len(texts) else np.zeros(0, np.uint8)
        edge = edge - edge[0]
        self.low = _LOWER[raw]
        kind = _KIND[raw]
        inside = kind == _WORD
        first = np.zeros(len(raw) + 1, bool)
        first[edge] = True
        before, after = np.append(False, inside[:-1]), np.append(inside[1:], False)
        self.start = np.flatnonzero(inside & (~before | first[:-1]))
        self.end = np.flatnonzero(inside & (~after | first[1:])) + 1
        doc = np.searchsorted(edge, self.start, "right") - 1
        piece = np.cumsum(kind == _BREAK)[self.start] if len(raw) else self.start
        #: next_to[k]: words that k more words of the same piece follow.
        same = (np.diff(doc) == 0) & (np.diff(piece) == 0)
        run = np.append(same, False)
        self.next_to = [np.ones(len(self.start), bool), run]
        for k in range(2, LONGEST):
            run = self.next_to[-1] & np.append(run[1:], False)
            self.next_to.append(run)
        self.names = sorted({"und" if x is None else x for x in langs})
        at = {x: i for i, x in enumerate(self.names)}
        self.lang = np.array([at["und" if x is None else x] for x in langs], np.int64)[doc]
        self.kind = kinds[doc]
        self._seeds = np.array([np.frombuffer(hashlib.blake2b(x.encode(), digest_size=16).digest(), np.uint64) for x in self.names], np.uint64).reshape(-1, 2)
        self._single: dict[int, np.ndarray] = {}

    def _words(self, h: int) -> np.ndarray:
        """Hash h of every word."""
        if h not in self._single:
            self._single[h] = span_hash(self.low, self.start, self.end, h)
        return self._single[h]

    def ids(self, h: int, k: int, at: np.ndarray) -> np.ndarray:
        """Hash h of the lang and the phrase of k+1 words at each place."""
        word, x = self._words(h), self._seeds[self.lang[at], h]
        for j in range(k + 1):
            x = _mix(x * _B + word[at + j])
        return x

    def upper(self, k: int, at: np.ndarray) -> np.ndarray:
        """The second part of the ids, 32 bits of hash 1."""
        return (self.ids(1, k, at) >> np.uint64(32)).astype(np.uint32)

    def phrase(self, i: np.ndarray, k: int) -> pa.Array:
        """The phrases of k words at i, one space between words."""
        lens = np.zeros((len(i), 2 * k - 1), np.int64)
        froms = np.zeros_like(lens)
        low = np.append(self.low, np.uint8(0x20))
        for j in range(k):
            lens[:, 2 * j], froms[:, 2 * j] = self.end[i + j] - self.start[i + j], self.start[i + j]
            if j:
                lens[:, 2 * j - 1], froms[:, 2 * j - 1] = 1, len(low) - 1
        flat = lens.ravel()
        ends = np.cumsum(flat)
        data = low[np.repeat(froms.ravel() - (ends - flat), flat) + np.arange(int(ends[-1]) if len(ends) else 0)]
        offsets = np.append(0, ends[2 * k - 2 :: 2 * k - 1]).astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(i), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary()).cast(pa.string())


def word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """The words of bounded runs of rows."""
    for batch in batches:
        texts, langs = batch.column("text"), batch.column("lang").to_pylist()
        kinds = batch.column("kind").to_numpy().astype(np.uint16)
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = [0, *(np.flatnonzero(np.diff(size // SLICE_BYTES)) + 1).tolist(), len(langs)]
        for a, z in zip(cuts, cuts[1:]):
            if z > a:
                yield Words(texts.slice(a, z - a), langs[a:z], kinds[a:z])


def cell(ids: np.ndarray, cells: int) -> np.ndarray:
    return (ids >> np.uint64(32)) & np.uint64(cells - 1)


def starts(words: Words, k: int, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of phrases of k+1 words, and the scan at which each becomes active."""
    at = np.flatnonzero(words.next_to[k])
    if not k:
        return at, np.zeros(len(at), np.uint8)
    known = np.full(len(words.start), NEVER, np.uint8)
    shorter = np.flatnonzero(words.next_to[k - 1])
    known[shorter] = tables[k - 1][cell(words.ids(0, k - 1, shorter), len(tables[k - 1]))]
    return at, np.maximum(known[at], known[at + 1])


def merged(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids (two parts) with summed counts, and the place of one of each."""
    if not len(a):
        return a, b, n, np.zeros(0, np.int64)
    order = np.argsort(a)
    sa, sb = a[order], b[order]
    new = np.append(True, sa[1:] != sa[:-1])
    if (~new[1:] & (sb[1:] != sb[:-1])).any():
        order = np.lexsort((b, a))
        sa, sb = a[order], b[order]
        new = np.append(True, (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1]))
    at = np.flatnonzero(new)
    return sa[at], sb[at], np.add.reduceat(n[order], at), order[at]


#: ``a`` and ``b`` are the two parts of the ids, phrases that occur once first; ``n`` has the counts of the others.
COUNTS = "len int, since int, bucket int, a binary, b binary, kind binary, n binary"
_TYPES = [pa.int32()] * 3 + [pa.binary()] * 5
ROWS = 16


def _packed(a: np.ndarray, b: np.ndarray, kind: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    order = np.argsort(n > 1, kind="stable")
    return a[order].tobytes(), b[order].tobytes(), kind[order].tobytes(), n[n > 1].tobytes()


def _unpacked(a: list[bytes], b: list[bytes], kind: list[bytes], n: list[bytes]) -> tuple[np.ndarray, ...]:
    counts = [np.ones(len(x) // 8, np.int64) for x in a]
    for c, y in zip(counts, n):
        c[len(c) - len(y) // 8 :] = np.frombuffer(y, np.int64)
    joined = (np.frombuffer(b"".join(x), t) for x, t in ((a, np.uint64), (b, np.uint32), (kind, np.uint16)))
    return *joined, np.concatenate([*counts, np.zeros(0, np.int64)])


def _dealt(k: int, since: int, part: np.ndarray, parts: int, a: np.ndarray, b: np.ndarray, kind: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each part that has entries."""
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    rows = [(k + 1, since, i, *_packed(a[o], b[o], kind[o], n[o])) for i in np.flatnonzero(np.diff(cuts)).tolist() for o in (order[cuts[i] : cuts[i + 1]],)]
    for i in range(0, len(rows), ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + ROWS]), _TYPES)], names=[x.split()[0] for x in COUNTS.split(", ")])


def _bucket(a: np.ndarray, buckets: int) -> np.ndarray:
    return (a % np.uint64(buckets)).astype(np.int64)


def _sent(held: list[list], k: int, since: int, buckets: int) -> Iterator[pa.RecordBatch]:
    a, b, kind = (np.concatenate(x) for x in held)
    a, b, n, one = merged(a, b, np.ones(len(a), np.int64))
    yield from _dealt(k, since, _bucket(a, buckets), buckets, a, b, kind[one], n)


def count_shard(docs: DataFrame, scan: int, shards: int, tables: list[bytes], lengths: list[int], buckets: int, sections: int = 1, section: int = 0) -> DataFrame:
    """Counts of the phrases that are active in this scan, by length, first scan and bucket; of every ``sections``-th bucket."""

    def run(batches):
        known = [np.frombuffer(zlib.decompress(t), np.uint8) for t in tables]
        held: dict[tuple[int, int], list[list]] = {}
        size: dict[tuple[int, int], int] = {}
        for w in word_batches(batches):
            for k in lengths:
                at, first = starts(w, k, known)
                for since in range(max(0, scan - shards + 1), scan + 1):
                    own = at[first == since]
                    a = w.ids(0, k, own)
                    if sections > 1:
                        inside = _bucket(a, buckets) % sections == section
                        a, own = a[inside], own[inside]
                    if not len(own):
                        continue
                    b = w.upper(k, own)
                    for x, y in zip(held.setdefault((k, since), [[], [], []]), (a, b, w.kind[own])):
                        x.append(y)
                    size[k, since] = size.get((k, since), 0) + len(own)
                    if size[k, since] >= HELD:
                        yield from _sent(held.pop((k, since)), k, since, buckets)
                        del size[k, since]
        for key, x in held.items():
            yield from _sent(x, *key, buckets)

    return docs.select("text", "lang", "kind").mapInArrow(run, COUNTS)


STATE = COUNTS + ", reached binary"


def _joined(least: int, cells: int, first_open: int):
    """Counts so far plus new ones; ``reached``: cells of the phrases that reached the threshold just now.

    Cycles that began before scan ``first_open`` are complete: phrases that stayed below the threshold go."""

    def run(old: pa.Table, new: pa.Table) -> pa.Table:
        before, after = (_unpacked(*(t[c].to_pylist() for c in ("a", "b", "kind", "n"))) for t in (old, new))
        a, b, kind, n = (np.concatenate(x) for x in zip(before, after))
        a, b, n, one = merged(a, b, n)
        reached = np.setdiff1d(cell(a[n >= least], cells), cell(before[0][before[3] >= least], cells)).astype(np.uint32)
        kind = kind[one]
        head = (old if len(old) else new).slice(0, 1)
        if head["since"][0].as_py() < first_open:
            a, b, kind, n = (x[n >= least] for x in (a, b, kind, n))
        row = [*(head[c].to_pylist() for c in ("len", "since", "bucket")), *([x] for x in _packed(a, b, kind, n)), [reached.tobytes()]]
        return pa.table([pa.array(v, t) for v, t in zip(row, _TYPES)], names=[x.split()[0] for x in STATE.split(", ")])

    return run


def _reached(counted: list[DataFrame]) -> np.ndarray:
    """Distinct cells; at most CELLS numbers."""

    def run(batches):
        for b in batches:
            for x in b.column("reached").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.uint32).astype(np.int32))], names=["cell"])

    found = counted[0].select("reached")
    for x in counted[1:]:
        found = found.union(x.select("reached"))
    found = found.where(F.length("reached") > 0).mapInArrow(run, "cell int").distinct()
    return found.toArrow()["cell"].to_numpy()


def count_phrases(docs: DataFrame, least: int = LEAST, shards: int = SHARDS, cells: int = CELLS) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, words, f`` of all phrases of up to three words that occur ``least`` times in their lang, and ``lang, n``."""
    spark = docs.sparkSession
    short_batches(spark)
    path = new_path(spark, "phrases-shards")
    kind = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 48).cast("int")
    d = docs.select("text", "lang", kind.alias("kind"), F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(shards)), F.lit(0)).cast("int").alias("shard"))
    with tidy(spark):
        d.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    parts = spark.read.schema("text string, lang string, kind int, shard int").parquet(path)
    parts._saved_path = path
    size = parts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, spark.sparkContext.defaultParallelism, -(-size // BUCKET_BYTES))
    sections = max(1, min(SECTIONS, -(-size // SECTION_BYTES)))
    tables = [np.full(cells, NEVER, np.uint8) for _ in range(LONGEST)]
    schema = spark.createDataFrame([], COUNTS).schema
    state: dict[tuple[int, int, int], DataFrame] = {}  # by length, first scan and section
    active = {0: {0}, **{k: set() for k in range(1, LONGEST)}}  # by length, the scans at which phrases became active
    scan = 0
    while any(scan < s + shards for a in active.values() for s in a):
        now = [(k, s) for k, a in active.items() for s in sorted(a) if s <= scan < s + shards]
        lengths = sorted({k for k, _ in now})
        sent = [zlib.compress(t.tobytes(), 1) for t in tables]
        for section in range(sections):
            new = count_shard(parts.where(F.col("shard") == scan % shards), scan, shards, sent, lengths, buckets, sections, section)
            before = [state.pop((*x, section)) for x in now if (*x, section) in state]
            so_far = spark.createDataFrame([], schema)
            for x in before:
                so_far = so_far.unionByName(x.drop("reached"))
            keys = ("len", "since", "bucket")
            made = so_far.groupBy(*keys).cogroup(new.groupBy(*keys)).applyInArrow(_joined(least, cells, scan - shards + 2), STATE)
            path = new_path(spark, "phrases-counts")
            with tidy(spark):
                made.write.partitionBy("len", "since").parquet(path)
            forget(*before)
            counted = spark.read.schema(made.schema).parquet(path)
            for k, since in now:
                state[k, since, section] = x = counted.where((F.col("len") == k + 1) & (F.col("since") == since)).select(*made.columns)
                x._saved_path = f"{path}/len={k + 1}/since={since}"
        for k in lengths:
            reached = _reached([x for (j, since, _), x in state.items() if j == k and (k, since) in now])
            reached = reached[tables[k][reached] == NEVER]
            if len(reached):
                tables[k][reached] = scan + 1
                if k + 1 < LONGEST:
                    active[k + 1].add(scan + 1)
        scan += 1
    return _named(parts, list(state.values()), buckets * SLOTS)


def matches(ids: tuple[np.ndarray, np.ndarray], words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of phrases of k+1 words that are among ``ids`` (sorted by both parts), and which of them each is; one place for each."""
    a_of, b_of = ids
    at = np.flatnonzero(words.next_to[k])
    if not len(a_of) or not len(at):
        return at[:0], at[:0]
    a = words.ids(0, k, at)
    i = np.searchsorted(a_of, a)
    near = a_of[np.minimum(i, len(a_of) - 1)] == a
    a, i, at = a[near], i[near], at[near]
    b = words.upper(k, at)
    while True:
        here = np.minimum(i, len(a_of) - 1)
        same = (i < len(a_of)) & (a_of[here] == a)
        other = same & (b_of[here] != b)
        if not other.any():  # else another phrase with this first part
            break
        i = i + other
    which, first = np.unique(i[same], return_index=True)
    return at[same][first], which


def _named(parts: DataFrame, state: list[DataFrame], slots: int) -> tuple[DataFrame, DataFrame]:
    """Texts of the phrases in ``state``, in one more scan; words of each lang.

    A slot has all documents of some kinds and all frequent phrases whose document is of these kinds."""
    schema = "lang string, phrase string, words int, f long"  # a row of 0 words has the words of a lang in a slot
    types = [pa.string(), pa.string(), pa.int32(), pa.int64()]

    def frequent(batches):
        held: dict[int, list] = {}
        size: dict[int, int] = {}

        def sent(k):
            size.pop(k)
            a, b, kind, n = (np.concatenate(x) for x in zip(*held.pop(k)))
            yield from _dealt(k - 1, 0, kind.astype(np.int64) % slots, slots, a, b, kind, n)

        for batch in batches:
            for k, *x in zip(*(batch.column(c).to_pylist() for c in ("len", "a", "b", "kind", "n"))):
                held.setdefault(k, []).append(_unpacked(*([v] for v in x)))
                size[k] = size.get(k, 0) + len(held[k][-1][0])
                if size[k] >= HELD:
                    yield from sent(k)
        for k in list(held):
            yield from sent(k)

    def named(docs: pa.Table, counts: pa.Table) -> pa.Table:
        rows, totals, open_ = [], {}, {}
        for k in range(LONGEST):
            own = counts.filter(pc.equal(counts["len"], k + 1))
            a, b, _, n = _unpacked(*(own[c].to_pylist() for c in ("a", "b", "kind", "n")))
            order = np.lexsort((b, a))
            open_[k] = a[order], b[order], n[order], np.ones(len(a), bool)
        for w in word_batches(docs.to_batches()):
            names = np.array(w.names, object)
            for lang, n in zip(w.names, np.bincount(w.lang, minlength=len(names)).tolist()):
                totals[lang] = totals.get(lang, 0) + n
            for k, (a, b, n, left) in open_.items():
                at, which = matches((a, b), w, k)
                at, which = at[left[which]], which[left[which]]
                left[which] = False
                if len(at):
                    rows.append([pa.array(names[w.lang[at]], pa.string()), w.phrase(at, k + 1), pa.array(np.full(len(at), k + 1, np.int32)), pa.array(n[which])])
        if any(left.any() for *_, left in open_.values()):
            raise ValueError("a frequent phrase stands in no document of its kind")
        totals = {x: n for x, n in totals.items() if n}
        rows.append([pa.array(list(totals), pa.string()), pa.nulls(len(totals), pa.string()), pa.array([0] * len(totals), pa.int32()), pa.array(list(totals.values()), pa.int64())])
        return pa.table([pa.chunked_array(x, t) for x, t in zip(zip(*rows), types)], names=[x.split()[0] for x in schema.split(", ")])

    counts = state[0].drop("reached")
    for x in state[1:]:
        counts = counts.unionByName(x.drop("reached"))
    counts = counts.mapInArrow(frequent, COUNTS)
    docs = parts.where("text IS NOT NULL").select("text", "lang", "kind", F.pmod("kind", F.lit(slots)).alias("bucket"))
    found = saved(docs.groupBy("bucket").cogroup(counts.groupBy("bucket")).applyInArrow(named, schema), "phrases-names")
    forget(parts, *state)
    out = found.where("words > 0")
    out._saved_path = found._saved_path
    return out, found.where("words = 0").groupBy("lang").agg(F.sum("f").alias("n"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, shards: int = SHARDS, cells: int = CELLS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each lang."""
    f, totals = count_phrases(docs, least, shards, cells)
    part = F.split("phrase", " ")
    inner = F.array(*[F.array_join(F.slice(part, i, k), " ") for k in range(2, LONGEST) for i in range(1, LONGEST - k + 2)])
    longer = (f.where(F.col("words") == LONGEST).select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("f"))
              .groupBy("lang", "phrase").agg(F.max("f").alias("longer")))
    kept = f.where("words > 1").join(longer, ["lang", "phrase"], "left").where("longer IS NULL OR 100 * longer < 50 * f")
    cuts = F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(
        k.alias("k"), F.array_join(F.slice(part, F.lit(1), k), " ").alias("left"),
        F.array_join(F.slice(part, k + 1, F.col("words") - k), " ").alias("right")))
    cut = kept.select("lang", "phrase", F.col("f").alias("a"), F.explode(cuts).alias("c")).select("lang", "phrase", "a", "c.*")
    sides = f.select("lang", F.col("phrase").alias("part"), F.col("f"))
    # each join is written, so that its shuffle files go before those of the next
    left = saved(cut.join(sides.withColumnsRenamed({"part": "left", "f": "l"}), ["lang", "left"]).drop("left"), "phrases-left")
    cut = left.join(sides.withColumnsRenamed({"part": "right", "f": "r"}), ["lang", "right"])
    cut = cut.withColumn("score", F.expr("(cast(a as decimal(15,0)) * cast(a as decimal(15,0)) * cast(1000000 as decimal(7,0)))"
                                         " div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))"))
    scored = (cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
              .join(totals, "lang").select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score"))
    kept = saved(scored, "phrases-scored")
    forget(left, f)
    order = (F.desc("score"), F.desc("a"), "phrase")
    # first within salts of a lang, so that no task ranks a whole lang
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    few = kept.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top).drop("rank")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM w, (VALUES (1), (2), (3)) AS ks(k) WHERE len(w) >= k)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k AS words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
h AS MATERIALIZED (
  SELECT lang, phrase, a, cut, array_to_string(w[1 : cut], ' ') AS first, array_to_string(w[cut + 1 :], ' ') AS rest
  FROM (SELECT *, unnest(generate_series(1, words - 1)) AS cut FROM c)),
t AS (
  SELECT h.lang, h.phrase, a, cut, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM h JOIN f x ON x.lang = h.lang AND x.phrase = h.first JOIN f y ON y.lang = h.lang AND y.phrase = h.rest),
s AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT lang, phrase, max(a) AS longer FROM (
        SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE words = 3
        UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE words = 3) GROUP BY ALL),
r AS (
  SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank, s.phrase, a, l, r, n.n, score
  FROM s LEFT JOIN o ON o.lang = s.lang AND o.phrase = s.phrase JOIN n ON n.lang = s.lang
  WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT * FROM r WHERE rank <= 2000
"""
