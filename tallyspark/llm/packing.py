"""Operator 4, best-fit packing by patterns and non-negative least squares.

Documents become token pieces in one Arrow pass. The histogram of piece lengths (at most ``capacity``
numbers) is all that reaches the driver: patterns of up to three length classes that fill a sequence are
enumerated, their repeat counts fitted to the histogram by non-negative least squares, rounded, and filled
with real lengths, longest first; lengths left over go, longest first, where they leave the least room.
The plan is a table of runs over (length, rank); each piece finds its place by its rank among the pieces of
its length, counted in salted groups, so that one length may hold any share of all rows.

Defined cases: null or empty text is the one id 1; the tokenizer's special tokens, as written, are their own ids
within a text, as is its default; longer texts than a sequence are cut; null, equal or
repeated ids are packed row by row; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import saved
from tallyspark.llm.phrases import span_hashes

CAPACITY = 4096
END_ID = 1
#: Words whose ids each Python worker keeps, code points looked up at a time, and words of letters tokenized in one
#: string.
CACHE_WORDS, BATCH_CHARS, JOINED = 600_000, 2_000_000, 2000


class _Bank:
    """Ids of runs seen, by the runs' hashes; of too many, those seen in one batch only go first."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.place: dict[int, int] = {}
        self.one = self.other = np.zeros(0, np.uint64)
        self.begin = self.size = self.seen = np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<u4")

    def trim(self, most: int) -> None:
        """Keep at most half of ``most`` runs, those seen in most batches."""
        keep = np.sort(np.argsort(-self.seen, kind="stable")[: most // 2])
        keep = keep[self.seen[keep] > 1]
        size, begin = self.size[keep], self.begin[keep]
        start = np.cumsum(size) - size
        self.ids = self.ids[np.arange(size.sum()) + np.repeat(begin - start, size)]
        self.one, self.other, self.size, self.begin = self.one[keep], self.other[keep], size, start
        self.seen = np.ones(len(keep), np.int64)
        self.place = dict(zip(self.one.tolist(), range(len(keep))))

    def add(self, one: np.ndarray, two: np.ndarray, ids: list[bytes]) -> np.ndarray:
        """Places of the new runs."""
        at = np.arange(len(self.size), len(self.size) + len(ids))
        size = np.array([len(x) // 4 for x in ids], np.int64)
        self.place.update(zip(one.tolist(), at.tolist()))
        self.begin = np.append(self.begin, len(self.ids) + np.cumsum(size) - size)
        self.size, self.one, self.other = np.append(self.size, size), np.append(self.one, one), np.append(self.other, two)
        self.seen = np.append(self.seen, np.zeros(len(at), np.int64))
        self.ids = np.append(self.ids, np.frombuffer(b"".join(ids), "<u4"))
        return at


class _Words:
    """Ids of words as little-endian 32-bit numbers, with a bounded memory of words seen."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.encode_special_tokens = True  # runs are folded, and what is a special token only then is none
        special = {x.content: i for i, x in self.t.get_added_tokens_decoder().items() if x.special}
        self.marks = re.compile("(" + ("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or r"(?!)") + ")")
        self.special = {" " + x: np.array([i], "<u4").tobytes() for x, i in special.items()}  # no run holds a blank
        vocab = self.t.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a piece
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")
        self.new, self.old = {}, {}
        self.bank = _Bank()

    def _encode(self, words: list[str]) -> None:
        for w, e in zip(words, self.t.encode_batch_fast(words, add_special_tokens=False)):
            self.new[w] = np.array(e.ids, "<u4").tobytes()

    def _encode_letters(self, words: list[str]) -> None:
        """Words of letters are one piece each, so one string holds many and the ends of pieces part them again;
        where the pieces are not as many as the words, each is tokenized by itself."""
        groups = [words[i:i + JOINED] for i in range(0, len(words), JOINED)]
        for group, e in zip(groups, self.t.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != len(group):
                self._encode(group)
                continue
            raw, at = ids.tobytes(), 0
            for w, end in zip(group, (4 * cut).tolist()):
                self.new[w] = raw[at:end]
                at = end

    def runs(self, text: str) -> list[str]:
        """The runs of a text, and its special tokens with a blank before them."""
        out = []
        for k, x in enumerate(self.marks.split(text)):
            if k % 2:
                out.append(" " + x)
            else:
                out += (x.lower() if x.isascii() else x).replace("\n", " ").split(" ")
        return out

    def learn(self, words: set[str]) -> None:
        """Make ``new`` hold all of ``words``; a mark behind a letter is always a piece of its own."""
        if len(self.new) > CACHE_WORDS:
            self.new, self.old = {}, self.new
        new, old = self.new, self.old
        new.update(self.special)
        missing = [w for w in words if w not in new]
        for w in missing:
            if w in old:
                new[w] = old[w]
        missing = [w for w in missing if w not in new]
        split = {w: (w[:-1], w[-1]) for w in missing if len(w) > 2 and w[-1] in ".,;:!?" and w[-2].lower().isalpha()}
        plain = ({w for w in missing if w not in split} | {p for pair in split.values() for p in pair}) - new.keys()
        self._encode_letters([w for w in plain if w.isalpha()])
        self._encode([w for w in plain if not w.isalpha()])
        for w, (a, b) in split.items():
            new[w] = new[a] + new[b]


@cache
def _words(path: str) -> _Words:
    return _Words(path)


def packed_ids(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as little-endian 32-bit numbers.

    The tokenizer drops white space and never joins across it, so each run between blanks and line ends is
    tokenized once and looked up afterwards; ASCII runs are looked up in lower case, as the tokenizer folds them.
    Special tokens are cut out before that, as the tokenizer finds them in the text as written.
    """
    words, out, lo = _words(path), [], 0
    while lo < len(texts):
        hi, n = lo, 0
        while hi < len(texts) and (hi == lo or n + len(texts[hi]) <= BATCH_CHARS):
            n += len(texts[hi])
            hi += 1
        part = texts[lo:hi]
        out += _by_runs(part, words) if any(map(words.marks.search, part)) else _by_arrays(part, words)
        lo = hi
    return out


def _by_runs(texts: list[str], words: _Words) -> list[bytes]:
    """Run by run: for texts with special tokens."""
    runs = [words.runs(x) for x in texts]
    words.learn(set().union(*runs))
    get = words.new.__getitem__
    return [b"".join(map(get, r)) for r in runs]


def _by_arrays(texts: list[str], words: _Words) -> list[bytes]:
    """The same for texts without special tokens: equal runs are found by their hashes, and only distinct ones become strings."""
    raw = [(x.lower() if x.isascii() else x).encode() for x in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    inside = (data != 0x20) & (data != 0x0A)
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return [b""] * len(texts)
    one, two = span_hashes(data, start, end)
    code, kinds = pd.factorize(one)
    first = np.empty(len(kinds), np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    bank = words.bank
    if len(bank.place) > CACHE_WORDS:
        bank.trim(CACHE_WORDS)
    at = np.array([bank.place.get(k, -1) for k in kinds.tolist()], np.int64)
    if (two[first[code]] != two).any() or (bank.other[at[at >= 0]] != two[first[at >= 0]]).any():
        return _by_runs(texts, words)
    fresh = np.flatnonzero(at < 0)
    names = [data[a:z].tobytes().decode() for a, z in zip(start[first[fresh]].tolist(), end[first[fresh]].tolist())]
    words.learn(set(names))
    at[fresh] = bank.add(kinds[fresh], two[first[fresh]], [words.new[w] for w in names])
    words.new.clear()
    bank.seen[at] += 1
    each, begin = bank.size[at][code], bank.begin[at][code]
    upto = np.append(0, np.cumsum(each))
    got = bank.ids[np.arange(upto[-1]) + np.repeat(begin - upto[:-1], each)]
    ends = np.cumsum([len(x) + 1 for x in raw])
    cut = upto[np.searchsorted(start, np.append(0, ends))].tolist()
    return [got[a:z].tobytes() for a, z in zip(cut, cut[1:])]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` for every row of ``docs(doc_id, text)``."""
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        for b in batches:
            rows = []
            ids = packed_ids([x or "" for x in b.column("text").to_pylist()], tokenizer)
            for doc, x in zip(b.column("doc_id").to_pylist(), ids):
                x += end
                for k in range(0, len(x), 4 * capacity):
                    part = x[k:k + 4 * capacity]
                    rows.append((doc, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32())] + [pa.array(c, pa.int64()) for c in cols[2:]],
                                                 names=["doc_id", "piece", "start", "length", "ids_crc32"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return d.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def patterns(units: int) -> list[tuple[int, ...]]:
    """Up to three length classes, largest first, that fill ``units``."""
    out = [(units,)] + [(a, units - a) for a in range((units + 1) // 2, units)]
    for a in range((units + 2) // 3, units - 1):
        out += [(a, b, units - a - b) for b in range((units - a + 1) // 2, min(a, units - a - 1) + 1)]
    return out


def nnls(a: np.ndarray, b: np.ndarray, sweeps: int = 60, tolerance: float = 1e-3) -> np.ndarray:
    """min ||a x - b|| over x >= 0 by coordinate descent on the normal equations."""
    gram, x = a.T @ a, np.zeros(a.shape[1])
    grad = -(a.T @ b)
    diag = np.diag(gram)
    for _ in range(sweeps):
        moved = 0.0
        for j in range(len(x)):
            step = max(-x[j], -grad[j] / diag[j])
            if step:
                x[j] += step
                grad += step * gram[:, j]
                moved = max(moved, abs(step))
        if moved < tolerance * max(1.0, b.max(initial=0)):
            break
    return x


class _Plan:
    """Groups of equal sequences: (count, room, chain), where a chain is (length, chain before) or None."""

    def __init__(self, capacity: int):
        self.capacity, self.open, self.rooms, self.closed = capacity, {}, [], []

    def add(self, count: int, room: int, chain) -> None:
        if not room:
            self.closed.append((count, chain))
            return
        if room not in self.open:
            self.open[room] = []
            insort(self.rooms, room)
        self.open[room].append((count, chain))

    def best(self, length: int, count: int) -> int:
        """Put up to ``count`` pieces where they leave the least room; how many went."""
        i = bisect_left(self.rooms, length)
        if i == len(self.rooms):
            each = self.capacity // length
            n, chain, put = count // each, None, each
            if not n:
                n, put = 1, count
            for _ in range(put):
                chain = (length, chain)
            self.add(n, self.capacity - put * length, chain)
            return n * put
        room = self.rooms[i]
        n, chain = self.open[room].pop()
        if not self.open[room]:
            del self.open[room]
            self.rooms.pop(i)
        each = min(room // length, count) if n == 1 else room // length
        if n * each > count:  # part of the group takes what is left, at the same depth
            whole = count // each
            if whole:
                self.add(n - whole, room, chain)
                n = whole
            else:
                self.add(n - 1, room, chain)
                n, each = 1, count
        for _ in range(each):
            chain = (length, chain)
        self.add(n, room - each * length, chain)
        return n * each


def plan_runs(histogram: dict[int, int], capacity: int = CAPACITY, units: int = 64, share: float = 0.9) -> dict[str, np.ndarray]:
    """Where each piece goes: runs (length, first rank, first sequence, offset), sorted by length and rank."""
    width = -(-capacity // units)
    left: dict[int, list[list[int]]] = {}  # by class: [length, count], longest last
    for length in sorted(histogram):
        left.setdefault(-(-length // width), []).append([length, histogram[length]])
    total = np.zeros(units)
    for u, runs in left.items():
        total[u - 1] = sum(n for _, n in runs)
    shapes = [s for s in patterns(units) if all(u in left for u in s)]
    plan = _Plan(capacity)
    if shapes:
        a = np.zeros((units, len(shapes)))
        for j, s in enumerate(shapes):
            for u in s:
                a[u - 1, j] += 1
        weight = np.sqrt(np.arange(1, units + 1) / units)  # long classes must fit, short ones fill room anywhere
        repeats = np.rint(share * nnls(a * weight[:, None], total * weight)).astype(int)
        for j in np.argsort(-repeats, kind="stable"):
            want, shape = int(repeats[j]), shapes[j]
            while want > 0:
                took, room = [], capacity
                for u in shape[:-1]:
                    run = next((x for x in reversed(left[u]) if x[1] > sum(x is y for y in took)), None)
                    if run is None:
                        break
                    took.append(run)
                    room -= run[0]
                if len(took) < len(shape) - 1:
                    break
                # The last piece closes the sequence: the longest that fits, its class or a little above.
                close = next((x for u in range(min(units, shape[-1] + len(shape) - 1), shape[-1] - 1, -1) for x in reversed(left.get(u, ()))
                              if x[0] <= room and x[1] > sum(x is y for y in took)), None)
                if close is None:
                    break
                took.append(close)
                n, chain = want, None
                for run in took:
                    n = min(n, run[1] // sum(run is y for y in took))
                    chain = (run[0], chain)
                for run in took:
                    run[1] -= n
                    if not run[1]:
                        left[-(-run[0] // width)].remove(run)
                plan.add(n, room - close[0], chain)
                want -= n
    for length, count in sorted((x for runs in left.values() for x in runs), reverse=True):
        while count:
            count -= plan.best(length, count)
    rank: dict[int, int] = {}
    sequence, out = 0, []
    for count, chain in plan.closed + [g for gs in plan.open.values() for g in gs]:
        lengths = []
        while chain:
            lengths.append(chain[0])
            chain = chain[1]
        offset = 0
        for length in reversed(lengths):
            r = rank.get(length, 0)
            rank[length] = r + count
            out.append((length, r, sequence, offset))
            offset += length
        sequence += count
    out.sort()
    cols = np.array(out, np.int64).reshape(-1, 4).T
    return {"length": cols[0], "rank": cols[1], "sequence": cols[2], "offset": cols[3]}


def pack(parts: DataFrame, capacity: int = CAPACITY, group_rows: int = 200_000) -> DataFrame:
    """``parts`` (of ``pieces``, already written) with ``sequence_id`` and ``offset``."""
    cols = parts.columns
    histogram = {r[0]: r[1] for r in parts.groupBy("length").count().collect()}  # at most ``capacity`` rows
    runs = plan_runs(histogram, capacity)
    salts = max(1, -(-sum(histogram.values()) // group_rows))
    d = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    size = d.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    size = size.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    d = d.withColumn("own", own).join(size, ["length", "salt"]).select(*cols, (F.col("before") + F.col("own") - 1).alias("rank"))
    key = (runs["length"] << 44) + runs["rank"]

    def place(batches):
        for b in batches:
            length, r = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(key, (length << 44) + r, "right") - 1
            yield pa.RecordBatch.from_arrays([b.column(c) for c in cols] + [pa.array(runs["sequence"][at] + r - runs["rank"][at]), pa.array(runs["offset"][at])],
                                             names=cols + ["sequence_id", "offset"])

    return d.mapInArrow(place, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize and pack all rows of ``docs(doc_id, text)``; also the pipeline's last stage."""
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    return pack(saved(pieces(docs, path, capacity), "pack-pieces"), capacity)


def query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
