"""Operator 12, removal of repeated byte strings by a distributed difference-cover suffix sort.

A byte goes if a string of ``SPAN`` bytes that covers it also starts in a document with a smaller id.

Which places can matter is settled first, by content. Of the ``GRAM``-byte strings in each window of SPAN bytes the one
whose first 8 bytes have the least hash is the window's anchor, so equal windows have equal anchors at the same offset. An
anchor's windows follow each other; its context is all that they can hold. Anchors that only one document holds are done
(short hashes go out, bits come back). Contexts of the others go by anchor to buckets, one entry per chunk of texts: equal
contexts are equal windows, of which all but those of the smallest document go at once (copies, however many, collapse
here; they are kept as runs, so that the last pass over the texts hashes nothing), and anchors that have one context only
are done. What is left are the places where an anchor stands in different contexts; the windows there, in the smallest
document of each context, are the text that is suffix-sorted.

The sort is the difference-cover algorithm with the cover {1, 2} modulo 3. Positions i with i mod 3 in the cover are
sampled. Triples of 8-byte words at sampled positions are sorted over the cluster and named by rank. The recursion sorts
names that are 24 positions apart (also sampled, as 24 is a multiple of 3): ranks of 48 bytes, where it ends, since only
prefixes of SPAN = 50 bytes are compared. The remaining positions are merged by the cover's property: a position and one
of another class reach sampled positions by the same shift, so a byte or two and a rank are a comparable key of exactly
50 bytes. In each of the three merges (classes 0 and 1 by shift 1, 0 and 2 by shift 2, 1 and 2 by shift 0) equal
prefixes stand together, and their smallest document is found; a window goes if either of its two merges has a smaller.
Names, ranks and merges are aggregates of distinct keys per chunk, so a string that stands everywhere is one row a chunk;
a chunk only deals them to ranges, in which they are sorted.

Places are looked up by 64-bit hashes of contexts within an anchor's 64-bit hash.

Defined cases: null and empty texts have no bytes (digest of the empty string); texts shorter than SPAN stay whole;
equal ids are one document (rows with the same id never remove each other's bytes); rows without an id come after all
others and never remove from each other; an empty table gives no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import forget, saved, short_batches
from tallyspark.llm.phrases import _A, _mix

#: Bytes of a compared string, of an anchor; anchors to choose from in a window.
SPAN, GRAM = 50, 36
CHOICE = SPAN - GRAM + 1
#: Text bytes of a chunk (more only for a longer text) and of a bucket; bytes of a triple of words; period of the cover.
CHUNK_BYTES, BUCKET_BYTES = 1 << 19, 1 << 23
TRIPLE, COVER = 24, 3
#: Chunks and keys of each that range bounds are taken from.
SAMPLE_CHUNKS, SAMPLE_KEYS = 64, 256
NO_ID = np.iinfo(np.int64).max
#: Places that are worked on at a time.
BLOCK = 1 << 15
_L, _R = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_AROUND = -(-(CHOICE - 1 + SPAN) // 8) * 8
_NUMBERS = np.arange(BLOCK + CHOICE - 1, dtype=np.uint64)

CHUNKS = "chunk long, ids binary, sizes binary, data binary"


def _fields(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _batch(schema: str, *cols) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    parts = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(cols, parts)], names=[n for n, _ in parts])


def chunks(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Texts put together to chunks of bounded size."""
    short_batches(docs.sparkSession)

    def run(batches):
        chunk, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def cut():
            return _batch(CHUNKS, [chunk], [np.array(ids, np.int64).tobytes()], [np.array([len(t) for t in texts], np.int64).tobytes()], [b"".join(texts)])

        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                ids.append(NO_ID if i is None else i)
                texts.append(t or b"")
                size += len(texts[-1])
                if size >= chunk_bytes or len(ids) >= max(1, chunk_bytes // 64):
                    yield cut()
                    chunk, ids, texts, size = chunk + 1, [], [], 0
        if ids:
            yield cut()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, CHUNKS)


class Chunk:
    """Anchors of a chunk's texts, ascending: their places, documents, windows (all from first to last), hashes and contexts."""

    def __init__(self, ids: bytes, sizes: bytes, data: bytes):
        self.ids, self.sizes, self.data = np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64), np.frombuffer(data, np.uint8)
        self.ends = np.cumsum(self.sizes)
        n = len(self.data)
        #: The texts between zeros, so that what is read around a place lies in the array.
        self._padded = np.zeros(CHOICE - 1 + n + _AROUND, np.uint8)
        self._padded[CHOICE - 1 : CHOICE - 1 + n] = self.data
        starts = np.zeros(n, bool)
        for e, s in zip(self.ends.tolist(), self.sizes.tolist()):
            starts[e - s : max(e - s, e - SPAN + 1)] = True
        places, firsts, before = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], -1
        for at in range(0, n, BLOCK):  # parts that stay in a core's cache
            use = starts[at : at + BLOCK]
            if not use.any():
                continue
            least = _words(self._padded[CHOICE - 1 + at :], len(use) + CHOICE - 1) * _A
            # the least hash wins, then the first place: both in one number
            least &= np.uint64(0xFFFFFFFF00000000)
            least |= _NUMBERS[: len(least)]
            width = 1
            while width < CHOICE:
                step = min(width, CHOICE - width)
                least = np.minimum(least[:-step], least[step:])
                width += step
            window = None if use.all() else np.flatnonzero(use)
            chosen = least if window is None else least[window]
            cut = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1]))
            place = (chosen[cut] & np.uint64(0xFFFFFFFF)).astype(np.int64) + at
            if place[0] == before:
                cut, place = cut[1:], place[1:]
            before = place[-1] if len(place) else before
            places.append(place)
            firsts.append((cut if window is None else window[cut]) + at)
        # a later window never has an earlier anchor
        self.place, self.first = np.concatenate(places), np.concatenate(firsts)
        self.doc = np.repeat(np.arange(len(self.ends)), np.diff(np.searchsorted(self.place, self.ends), prepend=0))
        self.last = np.minimum(np.append(self.first[1:], n)[: len(self.place)] - 1, self.ends[self.doc] - SPAN)
        self.id = self.ids[self.doc]

    @cached_property
    def anchor(self) -> np.ndarray:
        """The hash of each anchor's bytes."""
        words = _rows(self._padded, self.place + CHOICE - 1, -(-GRAM // 8))
        words[-1] &= np.uint64((1 << 8 * (GRAM - 8 * (len(words) - 1))) - 1)
        return _hash(words, np.full(len(self.place), _L))

    @cached_property
    def context(self) -> np.ndarray:
        """The hash of all that the windows through each anchor can hold: the bytes around it, as far as its text goes."""
        words = _rows(self._padded, self.place, _AROUND // 8)
        left = np.maximum(CHOICE - 1 - self.place + (self.ends - self.sizes)[self.doc], 0)
        right = np.maximum(self.place + SPAN - self.ends[self.doc], 0)
        at = np.flatnonzero(left + right)
        j = np.arange(_AROUND)
        inside = (j >= left[at, None]) & (j < CHOICE - 1 + SPAN - right[at, None])
        words[:, at] = (np.ascontiguousarray(words[:, at].T).view(np.uint8) * inside).view(np.uint64).T
        return _hash(words, left.astype(np.uint64) * _L + right.astype(np.uint64) * _R)


def _words(data: np.ndarray, n: int) -> np.ndarray:
    """The 8-byte words at the first n places."""
    return np.ndarray(n, "<u8", data, strides=(1,))


def _rows(data: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """From each place n words, one below the other."""
    every = np.ndarray(len(data) - 8 * n + 1, f"V{8 * n}", data, strides=(1,))
    return np.ascontiguousarray(every[at].view("<u8").reshape(-1, n).T)


def _hash(words: np.ndarray, state: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each column, word by word from a state."""
    for w in words:
        state = _mix(state ^ w)
    return state


def _short(ids: np.ndarray) -> tuple[int, np.ndarray]:
    """A base and what each id has beyond it, in 4 bytes if that fits, else the ids."""
    base = int(ids.min(initial=NO_ID))
    if len(ids) and int(ids.max()) - base < 1 << 32:
        return base, (ids - base).astype(np.uint32)
    return 0, ids.view(np.uint64)


def _long(base: int, offset: bytes, n: int) -> np.ndarray:
    return np.frombuffer(offset, np.uint32 if len(offset) == 4 * n else np.uint64).astype(np.uint64).view(np.int64) + base


#: The chunk's distinct anchors of a bucket, 4 bytes each, ascending; whether all its documents are one, and which.
SEEN = "bucket int, chunk long, anchors binary, ids binary"


def _dealt(anchor: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and short anchor as one number."""
    n = np.uint64(buckets)
    return ((anchor % n) << np.uint64(32)) | ((anchor // n) & np.uint64(0xFFFFFFFF))


def _runs(dealt: np.ndarray) -> list[tuple[int, int, int]]:
    """Bucket, begin and end of its part of ascending numbers."""
    part = (dealt >> np.uint64(32)).astype(np.int64)
    edges = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist() if len(part) else []
    return [(int(part[x]), x, y) for x, y in zip(edges, [*edges[1:], len(part)])]


def see(table: DataFrame, buckets: int) -> DataFrame:
    """Which anchors each chunk holds; ``ids`` has a bit for each that two of its documents hold."""

    def run(batches):
        for b in batches:
            for chunk, *parts in zip(*(b.column(c).to_pylist() for c in _fields(CHUNKS))):
                c = Chunk(*parts)
                dealt = _dealt(c.anchor, buckets)
                order = np.argsort(dealt)
                dealt, id = dealt[order], c.id[order]
                cut = np.flatnonzero(np.append(True, dealt[1:] != dealt[:-1])) if len(dealt) else order
                twice = np.minimum.reduceat(id, cut) != np.maximum.reduceat(id, cut) if len(cut) else np.zeros(0, bool)
                short = dealt[cut].astype(np.uint32)
                rows = [(i, chunk, short[x:y].tobytes(), np.packbits(twice[x:y]).tobytes()) for i, x, y in _runs(dealt[cut])]
                for k in range(0, len(rows), 64):
                    yield _batch(SEEN, *zip(*rows[k : k + 64]))

    return table.mapInArrow(run, SEEN)


def _share(seen: pa.Table) -> pa.Table:
    """For a bucket, by chunk: a bit for each anchor that chunk sent, set if another document holds it too."""
    bucket, chunk, anchors, ids = (seen[c].to_pylist() for c in _fields(SEEN))
    parts = [np.frombuffer(x, np.uint32) for x in anchors]
    every = np.concatenate(parts)
    twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)) for x, p in zip(ids, parts)]).astype(bool)
    order = np.argsort(every)
    new = every[order][1:] != every[order][:-1]
    shared = np.zeros(len(every), bool)
    shared[order] = ~(np.append(True, new) & np.append(new, True))
    shared |= twice
    edges = np.cumsum([0, *map(len, parts)])
    return pa.Table.from_batches([_batch(SEEN, bucket, chunk, [b""] * len(chunk), [np.packbits(shared[x:y]).tobytes() for x, y in zip(edges, edges[1:])])])


def _alike(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that puts equal keys together, where in it each key begins, and the number of each place's key."""
    order = np.argsort(keys)
    new = np.append(True, keys[order][1:] != keys[order][:-1])[: len(keys)]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


ASKED = "bucket int, chunk long, base long, anchor binary, context binary, id binary"


def _ask(buckets: int):
    """By bucket, for the chunk's shared anchors: distinct contexts and the smallest document of each."""

    def run(table: pa.Table, shared: pa.Table) -> pa.Table:
        rows = []
        bits = dict(zip(shared["bucket"].to_pylist(), shared["ids"].to_pylist()))
        for chunk, *parts in zip(*(table[c].to_pylist() for c in _fields(CHUNKS))):
            c = Chunk(*parts)
            dealt = _dealt(c.anchor, buckets)
            order = np.argsort(dealt)
            new = np.append(True, dealt[order][1:] != dealt[order][:-1])[: len(order)]
            use = [np.unpackbits(np.frombuffer(bits[i], np.uint8), count=y - x) for i, x, y in _runs(dealt[order][new])]
            at = order[np.concatenate(use).astype(bool)[np.cumsum(new) - 1]] if use else order
            if not len(at):
                continue
            by, first, _ = _alike(c.context[at])
            at, id = at[by[first]], np.minimum.reduceat(c.id[at[by]], first)
            by = np.argsort((dealt[at] >> np.uint64(32)).astype(np.min_scalar_type(buckets)), kind="stable")
            at, id = at[by], id[by]
            for i, x, y in _runs(dealt[at]):
                base, offset = _short(id[x:y])
                rows.append((i, chunk, base, c.anchor[at[x:y]].tobytes(), c.context[at[x:y]].tobytes(), offset.tobytes()))
        return pa.Table.from_batches([_batch(ASKED, *(zip(*rows) if rows else [[]] * 6))])

    return run


TOLD = "chunk long, context binary, low binary, open binary"


def _tell(asked: pa.Table) -> pa.Table:
    """For a bucket, by chunk: the smallest document of each context that matters, and whether its anchor has others."""
    rows = [asked[c].to_pylist() for c in _fields(ASKED)[1:]]
    anchor = np.concatenate([np.frombuffer(x, np.uint64) for x in rows[2]])
    context = np.concatenate([np.frombuffer(x, np.uint64) for x in rows[3]])
    id = np.concatenate([_long(base, x, len(y) // 8) for base, y, x in zip(rows[1], rows[3], rows[4])])
    row = np.repeat(np.arange(len(rows[0])), [len(x) // 8 for x in rows[2]])
    order = np.lexsort((id, context, anchor))
    a, c, i = anchor[order], context[order], id[order]
    first_a = np.append(True, np.diff(a) != 0)
    first_c = first_a | np.append(True, np.diff(c) != 0)
    at_a, at_c = np.flatnonzero(first_a), np.flatnonzero(first_c)
    in_a, in_c = np.cumsum(first_a) - 1, np.cumsum(first_c) - 1
    low = i[at_c][in_c]
    shared = (np.minimum.reduceat(i, at_a) < np.maximum.reduceat(i, at_a))[in_a]
    open_ = shared & (np.add.reduceat(first_c.astype(np.int64), at_a) > 1)[in_a]
    use = open_ | (low < i)
    row, c, low, open_ = row[order][use], c[use], low[use], open_[use]
    by = np.argsort(row, kind="stable")
    cuts = np.searchsorted(row[by], np.arange(len(rows[0]) + 1))
    out = [(rows[0][k], c[o].tobytes(), low[o].tobytes(), open_[o].tobytes()) for k in range(len(rows[0])) if len(o := by[cuts[k] : cuts[k + 1]])]
    return pa.Table.from_batches([_batch(TOLD, *(zip(*out) if out else [[]] * 4))])


def _known(c: Chunk, told: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor of a chunk: the smallest document of its context (the chunk's own if nothing was told), and the mark."""
    if not len(c.place):
        return c.id, np.zeros(0, bool)
    order, first, number = _alike(c.context)
    lows, opens, known = np.minimum.reduceat(c.id[order], first), np.zeros(len(first), bool), c.context[order[first]]
    if len(told):
        context, low, open_ = (np.concatenate([np.frombuffer(x, t) for x in told[n].to_pylist()]) for n, t in (("context", np.uint64), ("low", np.int64), ("open", bool)))
        at = np.searchsorted(known, context)  # each is one that the chunk asked for
        lows[at], opens[at] = low, open_
    low, open_ = np.empty_like(c.id), np.empty(len(c.id), bool)
    low[order], open_[order] = lows[number], opens[number]
    return low, open_


def _joined(first: np.ndarray, last: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows, those of a document that follow each other as one."""
    new = np.append(True, (first[1:] != last[:-1] + 1) | (doc[1:] != doc[:-1]))[: len(first)]
    return first[new], last[np.append(new[1:], True)[: len(first)]], doc[new]


#: Runs of windows to be sorted: by chunk, where each begins, its number of bytes and document, and all bytes. ``gone``: the
#: first and last of each run of windows whose context stands in a smaller document.
REGIONS = "chunk long, begin binary, size binary, id binary, data binary, names binary, ranks binary, gone binary"


def _regions(table: pa.Table, told: pa.Table) -> pa.Table:
    out = []
    for chunk, *parts in zip(*(table[c].to_pylist() for c in _fields(CHUNKS))):
        c = Chunk(*parts)
        low, open_ = _known(c, told)
        gone, need = low < c.id, open_ & (low == c.id)
        if not (gone | need).any():
            continue
        begin, last, doc = _joined(c.first[need], c.last[need], c.doc[need])
        size = last - begin + SPAN
        data = c.data[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())]
        cut = _pairs(*_joined(c.first[gone], c.last[gone], c.doc[gone])[:2])
        out.append((chunk, begin.tobytes(), size.tobytes(), c.ids[doc].tobytes(), data.tobytes(), b"", b"", cut))
    return pa.Table.from_batches([_batch(REGIONS, *(zip(*out) if out else [[]] * 8))])


def _pairs(first: np.ndarray, last: np.ndarray) -> bytes:
    return np.stack([first, last], 1).astype(np.uint32).tobytes()


def _text(columns: np.ndarray) -> np.ndarray:
    """Rows of bytes as byte strings that sort by their bytes."""
    columns = np.ascontiguousarray(columns)
    return columns.view(f"S{columns.shape[1]}").ravel()


def _bytes_of(numbers: np.ndarray) -> np.ndarray:
    return numbers.astype(">u8").view(np.uint8).reshape(-1, 8)


class Runs:
    """The regions of a chunk, and the keys of each step of the sort."""

    def __init__(self, begin: bytes, size: bytes, id: bytes, data: bytes, names: bytes = b"", ranks: bytes = b""):
        self.data = np.frombuffer(data, np.uint8)
        self.size, self.begin, self.ids = (np.frombuffer(x, np.int64) for x in (size, begin, id))
        self.names, self.ranks = np.frombuffer(names, np.uint64), np.frombuffer(ranks, np.uint64)
        self.within = np.arange(len(self.data)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.left = np.repeat(self.size, self.size) - self.within
        self.kind = self.within - self.within // COVER * COVER

    @cached_property
    def ranked(self) -> np.ndarray:
        return np.flatnonzero((self.kind != 0) & (self.left >= 2 * TRIPLE))

    @cached_property
    def named(self) -> np.ndarray:
        return np.flatnonzero((self.kind != 0) & (self.left >= TRIPLE) & ((self.left >= 2 * TRIPLE) | (self.within >= TRIPLE)))

    def triples(self) -> np.ndarray:
        """Three words at each sampled place."""
        if not len(self.named):
            return np.zeros(0, f"S{TRIPLE}")
        return _text(np.lib.stride_tricks.sliding_window_view(self.data, TRIPLE)[self.named])

    def pairs(self) -> np.ndarray:
        """The recursion: the names of neighbours in the string of names."""
        name = np.zeros(len(self.data), np.uint64)
        name[self.named] = self.names
        return _text(np.hstack([_bytes_of(name[self.ranked]), _bytes_of(name[self.ranked + TRIPLE])]))

    def merges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of all three merges, the place and the document of the window of each."""
        rank = np.zeros(len(self.data), np.uint64)
        rank[self.ranked] = self.ranks
        windows = self.left >= SPAN
        keys, own = [], []
        for other, shift in ((2, 1), (1, 2), (0, 0)):  # of the three classes, the one that takes no part
            at = np.flatnonzero(windows & (self.kind != other))
            # the bytes before and after the 48 that the rank stands for
            free = [*range(shift), *range(shift + 2 * TRIPLE, SPAN)]
            keys.append(np.hstack([np.full((len(at), 1), shift + 1, np.uint8), *(self.data[at + j][:, None] for j in free), _bytes_of(rank[at + shift])]))
            own.append(at)
        at = np.concatenate(own)
        region = np.repeat(np.arange(len(self.size)), self.size)[at]
        return _text(np.vstack(keys)), self.begin[region] + self.within[at], self.ids[region]

    def keys(self, step: str) -> np.ndarray:
        keys = getattr(self, step)()
        return keys[0] if step == "merges" else keys


def _each(table: pa.Table | pa.RecordBatch) -> Iterator[tuple[int, Runs]]:
    for chunk, *parts in zip(*(table.column(c).to_pylist() for c in _fields(REGIONS)[:-1])):
        yield chunk, Runs(*parts)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys as they first stand, and the number of each key among them."""
    coded = pa.Array.from_buffers(pa.binary(keys.itemsize), len(keys), [None, pa.py_buffer(keys.view(np.uint8))]).dictionary_encode()
    every = coded.dictionary
    return np.frombuffer(every.buffers()[1], keys.dtype, len(every)) if len(keys) else keys, coded.indices.to_numpy()


def _ranged(keys: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray]:
    """Distinct keys by range, where in them each range begins and ends, and the place of each key among them."""
    every, number = _distinct(keys)
    bucket = np.searchsorted(cuts, every, "right").astype(np.min_scalar_type(len(cuts)))
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return every[order], np.cumsum([0, *np.bincount(bucket, minlength=len(cuts) + 1)]).tolist(), place[number]


def _lowest(ids: np.ndarray, number: np.ndarray, n: int) -> np.ndarray:
    """The smallest id of each of n numbers."""
    low = np.full(n, NO_ID)
    np.minimum.at(low, number, ids)
    return low


def bounds(regions: DataFrame, step: str, buckets: int) -> np.ndarray:
    """Keys that cut the order into ranges, from a bounded sample; the ranges hold every key."""

    def run(batches):
        for b in batches:
            for _, runs in _each(b):
                keys = _distinct(runs.keys(step))[0]
                some = keys[:: max(1, len(keys) // SAMPLE_KEYS)][: 2 * SAMPLE_KEYS]
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(object), pa.binary())], names=["key"])

    regions = regions.where(F.octet_length("begin") > 0)
    n = regions.count()
    few = regions.sample(min(1.0, SAMPLE_CHUNKS / max(1, n)), 12) if n > SAMPLE_CHUNKS else regions
    keys = np.sort(np.array(few.mapInArrow(run, "key binary").toArrow()["key"].to_pylist(), dtype="S"))
    return np.unique(keys[np.arange(1, buckets) * len(keys) // buckets]) if len(keys) else keys


SENT = "bucket int, chunk long, width int, keys binary, base long, low binary"


def send(regions: DataFrame, step: str, cuts: np.ndarray) -> DataFrame:
    def run(batches):
        for b in batches:
            for chunk, runs in _each(b):
                keys, _, id = runs.merges() if step == "merges" else (runs.keys(step), None, None)
                keys, edges, number = _ranged(keys, cuts)
                low = None if id is None else _lowest(id, number, len(keys))
                rows = []
                for i, (x, y) in enumerate(zip(edges, edges[1:])):
                    if y > x:
                        base, short = _short(low[x:y]) if low is not None else (0, np.zeros(0, np.uint32))
                        rows.append((i, chunk, keys.itemsize, keys[x:y].tobytes(), base, short.tobytes()))
                for k in range(0, len(rows), 64):
                    yield _batch(SENT, *zip(*rows[k : k + 64]))

    return regions.mapInArrow(run, SENT)


#: ``value``: for each key that the chunk sent to the bucket a name, or whether another chunk has a smaller document.
BACK = "chunk long, bucket int, value binary"


def _rank(sent: pa.Table) -> pa.Table:
    """Sort a range of keys; equal keys stand together."""
    bucket, chunk, width, keys, base, low = (sent[c].to_pylist() for c in _fields(SENT))
    edges = np.cumsum([0, *(len(k) // w for k, w in zip(keys, width))])
    every, number = _distinct(np.frombuffer(b"".join(keys), f"S{width[0]}"))
    rank = np.empty(len(every), np.int64)
    rank[np.argsort(every)] = np.arange(len(every))
    rank = rank[number]
    if low[0]:
        own = np.concatenate([_long(b, x, n) for b, x, n in zip(base, low, np.diff(edges).tolist())])
        value = _lowest(own, rank, len(every))[rank] < own
    else:
        value = (np.uint64(bucket[0]) << np.uint64(40)) + rank.astype(np.uint64)
    return pa.Table.from_batches([_batch(BACK, chunk, bucket, [value[x:y].tobytes() for x, y in zip(edges, edges[1:])])])


def _answer(back: pa.Table, kind: type) -> np.ndarray:
    """What came back to a chunk, in the order of its distinct keys."""
    back = back.sort_by("bucket")
    return np.frombuffer(b"".join(back["value"].to_pylist()), kind)


def _with_names(step: str, column: str, cuts: np.ndarray):
    """Regions with the name of each place of ``step``; those of the step before are no longer needed."""

    def run(regions: pa.Table, back: pa.Table) -> pa.Table:
        if not len(regions):
            return regions
        (_, runs), = _each(regions)
        value = _answer(back, np.uint64)[_ranged(runs.keys(step), cuts)[2]].tobytes()
        for name in ("names", "ranks"):
            regions = regions.set_column(_fields(REGIONS).index(name), name, pa.array([value if name == column else b""], pa.binary()))
        return regions

    return run


#: First and last of runs of windows that go; those of ``gone`` and ``sorted`` may overlap.
GONE = "chunk long, gone binary, sorted binary"


def _gone(cuts: np.ndarray):
    """Windows whose string starts in a smaller document."""

    def run(regions: pa.Table, back: pa.Table) -> pa.Table:
        out = []
        for (chunk, runs), gone in zip(_each(regions), regions["gone"].to_pylist()):
            keys, place, id = runs.merges()
            keys, _, number = _ranged(keys, cuts)
            place = np.unique(place[_answer(back, bool)[number] | (_lowest(id, number, len(keys))[number] < id)])
            out.append((chunk, gone, _pairs(*_joined(place, place, place * 0)[:2])))
        return pa.Table.from_batches([_batch(GONE, *(zip(*out) if out else [[]] * 3))])

    return run


def suffix_sort(regions: DataFrame, buckets: int) -> DataFrame:
    """Rows of TOLD with the places of windows that also start in a smaller document."""

    def step(frame: DataFrame, name: str) -> tuple[DataFrame, np.ndarray]:
        cuts = bounds(frame, name, buckets)
        return saved(send(frame, name, cuts).groupBy("bucket").applyInArrow(_rank, BACK), f"suffixes-{name}"), cuts

    for name, column in (("triples", "names"), ("pairs", "ranks")):
        back, cuts = step(regions, name)
        named = saved(regions.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(_with_names(name, column, cuts), REGIONS), "suffixes-regions")
        forget(regions, back)
        regions = named
    back, cuts = step(regions, "merges")
    out = saved(regions.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(_gone(cuts), GONE), "suffixes-places")
    forget(regions, back)
    return out


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"


def _cut(texts: bool):
    def run(table: pa.Table, places: pa.Table) -> pa.Table:
        out = []
        runs = [np.frombuffer(x, np.uint32).reshape(-1, 2) for name in ("gone", "sorted") for x in places[name].to_pylist()]
        for _, ids, sizes, data in zip(*(table[c].to_pylist() for c in _fields(CHUNKS))):
            data, sizes = np.frombuffer(data, np.uint8), np.frombuffer(sizes, np.int64)
            edge = np.zeros(len(data) + 1, np.int32)
            for pairs in runs:  # within one, each place begins or ends one run at most
                edge[pairs[:, 0]] += 1
                edge[pairs[:, 1] + SPAN] -= 1
            covered = np.cumsum(edge[:-1], dtype=np.int32) > 0
            for i, e, n in zip(np.frombuffer(ids, np.int64).tolist(), np.cumsum(sizes).tolist(), sizes.tolist()):
                own, cov = data[e - n : e], covered[e - n : e]
                some = cov.any()
                kept = (own[~cov] if some else own).tobytes()
                spans = int(np.count_nonzero(cov[1:] & ~cov[:-1]) + cov[0]) if some else 0
                out.append((None if i == NO_ID else i, n, n - len(kept), spans, kept if texts else None, hashlib.sha256(kept).hexdigest()))
        return pa.Table.from_batches([_batch(KEPT, *(zip(*out) if out else [[]] * 6))])

    return run


def remove_repeats(docs: DataFrame, texts: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row; ``kept`` has the remaining bytes if ``texts``."""
    spark = docs.sparkSession
    table = saved(chunks(docs, chunk_bytes), "suffixes-chunks")
    size = table.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    buckets = max(8, spark.sparkContext.defaultParallelism, -(-size // BUCKET_BYTES))
    shared = saved(see(table, buckets).groupBy("bucket").applyInArrow(_share, SEEN), "suffixes-anchors")
    asked = table.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(_ask(buckets), ASKED)
    told = saved(asked.groupBy("bucket").applyInArrow(_tell, TOLD), "suffixes-contexts")
    forget(shared)
    regions = saved(table.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_regions, REGIONS), "suffixes-regions")
    forget(told)
    places = suffix_sort(regions, buckets)
    out = table.groupBy("chunk").cogroup(places.groupBy("chunk")).applyInArrow(_cut(texts), KEPT)
    return out if texts else out.drop("kept")


def query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
