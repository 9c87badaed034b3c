"""Operator 3, near-duplicate groups with an LSH forest.

Texts with the same set of word shingles form a class, and only one text of each class goes on. A forest of
sorted signature orders lists the classes: tree t sorts by its own sequence of MinHash values, so texts that
share a long prefix stand side by side, and a place where many texts agree is simply looked at in more depth.

Candidates of a tree are neighbours by longest common prefix, among texts that share at least DEPTH values (a
region). In a large region every text also meets the region's centres, the texts nearest to its bitwise
consensus: copies of one source need not resemble one another, only the source. Packed signatures, which travel
with the places, discard pairs that are far from the threshold at once; of the neighbours and of the centres that
a text meets in large regions of all trees, only the likest goes on. So a text of a hot group has a few candidates,
not a few per tree. They are confirmed on full shingle sets, first the best pair of each component (a few rounds),
then all that still join different components.

After that a region counts as done if its texts are in one component. In the others every pair of texts of
different components is compared by signature, in cells of bounded size; texts with a possible partner get a
longer signature, are compared once more, and what is left is confirmed likewise. So no pair of a region is
left out, and what is compared pair by pair is only what is not yet connected.

Regions of any size are sorted by range, split over tasks and counted before they are shuffled; components
come from star contraction in tables. Nothing but counts reaches the driver.

Defined cases: null text or text without words has the empty set and its own component; rows that repeat an
id are one document; rows without an id are linked with nothing, have no component and are kept; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import forget, saved, tidy

WORDS, PERCENT = 5, 75
#: Values of a signature, trees, least common prefix, and further values that a tree sorts by.
VALUES, TREES, DEPTH, FURTHER = 128, 24, 4, 4
#: Values of a fine signature, and the least estimates of pairs that go on: four standard errors below the threshold.
FINE = 1024
LEAST, LEAST_FINE = 0.58, 0.69
#: Regions above this size get centres; rows in a side of a cell; rounds that confirm best pairs only.
LARGE, SIDE, ROUNDS = 16, 1024, 1
CACHE_WORDS = 300_000
_MULTIPLY = np.random.default_rng(11).integers(1, 2**63, FINE, dtype=np.uint64) | np.uint64(1)
_ADD = np.random.default_rng(12).integers(0, 2**63, FINE, dtype=np.uint64)
_POWERS = np.cumprod(np.full(WORDS, 0x9E3779B97F4A7C15, np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of a 64-bit number over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; ``known`` keeps hashes of words."""
    words = (text or "").encode().lower().split()  # on bytes: lowers A-Z, splits at blanks and TAB to CR
    if not words:
        return np.zeros(0, np.uint64)
    if len(known) > CACHE_WORDS:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(WORDS, len(h))
    total = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        total += _mix(h[j:len(h) - n + 1 + j] + _POWERS[j])
        total *= _POWERS[0]
    return np.unique(_mix(total))


def minhash(h: np.ndarray, values: int = VALUES) -> np.ndarray:
    out = np.full(values, np.iinfo(np.uint32).max, np.uint32)
    step = (1 << 18) // values
    for at in range(0, len(h), step):
        x = (h[at:at + step, None] * _MULTIPLY[:values] + _ADD[:values]) >> np.uint64(32)
        np.minimum(out, x.min(0).astype(np.uint32), out=out)
    return out


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, n, digest, sig`` (set size, hash of the set, signature) for every row of ``docs(doc_id, text)``."""

    def run(batches):
        known: dict[bytes, int] = {}
        for b in batches:
            n, digest, sig = [], [], []
            for text in b.column("text").to_pylist():
                h = shingles(text, known)
                n.append(len(h))
                digest.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                sig.append(minhash(h).tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "n", "digest", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, digest binary, sig binary")


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, VALUES)


def _sketch(sig: np.ndarray) -> np.ndarray:
    """The low four bits of each value, packed."""
    low = (sig & np.uint32(15)).astype(np.uint8)
    return low[:, 0::2] | (low[:, 1::2] << 4)


def _likeness(x: np.ndarray) -> np.ndarray:
    """Estimated similarity from the exclusive or of packed sketches, freed of chance agreement."""
    same = ((x & 15) == 0).sum(-1, dtype=np.int32) + ((x >> 4) == 0).sum(-1, dtype=np.int32)
    return (same / (2 * x.shape[-1]) - 1 / 16) / (15 / 16)


def sketches(classes: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            if b.num_rows:
                s = _sketch(_signatures(b.column("sig")))
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([x.tobytes() for x in s], pa.binary())], names=["id", "sketch"])

    return classes.select("id", "sig").mapInArrow(run, "id long, sketch binary")


def forest(classes: DataFrame) -> DataFrame:
    """``region, id, next_id, near``: places in the trees that share a prefix of DEPTH values with a neighbour.

    Sorting by range puts a tree's order into task order, whatever the size of a region. ``next_id`` is the
    following text of the same region, ``near`` its estimated similarity; the first and last place of a task stay even if they seem alone."""

    def trees(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sig = _signatures(b.column("sig"))
            sketch = [x.tobytes() for x in _sketch(sig)] * TREES
            ids = np.tile(b.column("id").to_numpy(), TREES)
            regions, further = [], []
            for t in range(TREES):
                own = sig[:, (t * DEPTH + np.arange(DEPTH + FURTHER)) % VALUES]
                x = np.full(len(sig), t + 1, np.uint64)
                for j in range(DEPTH):
                    x = _mix(x + own[:, j].astype(np.uint64) * _POWERS[1])
                regions.append(x)
                further += [r.tobytes() for r in own[:, DEPTH:].astype(">u4")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(regions).view(np.int64)), pa.array(further, pa.binary()), pa.array(ids), pa.array(sketch, pa.binary())], names=["region", "further", "id", "sketch"])

    def neighbours(batches):
        held = None  # the last row so far: it may have a neighbour in the next batch
        first = True

        def out(rows, alone_ok):
            region, sketch, ids = rows
            same = region[:-1] == region[1:]
            keep = np.concatenate([[alone_ok], same]) | np.concatenate([same, [False]])
            near = np.append(_likeness(sketch[1:] ^ sketch[:-1]), 0.0)
            nxt = pa.array([int(y) if s else None for s, y in zip(same, ids[1:])] + [None], pa.int64())
            return keep, pa.RecordBatch.from_arrays([pa.array(region), pa.array(ids), nxt, pa.array(near)], names=["region", "id", "next_id", "near"])

        joined = False  # whether the held row already has a neighbour before it
        for b in batches:
            if not b.num_rows:
                continue
            region, ids = b.column("region").to_numpy(), b.column("id").to_numpy()
            sketch = np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint8).reshape(b.num_rows, -1)
            if held is not None:
                region, sketch, ids = np.append(held[0], region), np.vstack([held[1], sketch]), np.append(held[2], ids)
            keep, made = out((region, sketch, ids), first or joined)
            first = False
            joined = bool(len(region) > 1 and region[-1] == region[-2]) or len(region) == 1 and bool(keep[0])
            held = (region[-1:], sketch[-1:], ids[-1:])
            k = np.flatnonzero(keep[:-1])
            if len(k):
                yield made.take(pa.array(k))
        if held is not None:  # the last place of a task stays
            yield out(held, True)[1]

    places = classes.select("id", "sig").mapInArrow(trees, "region long, further binary, id long, sketch binary")
    places = places.repartitionByRange("region", "further", "id").sortWithinPartitions("region", "further", "id")
    return places.mapInArrow(neighbours, "region long, id long, next_id long, near double")


def large_regions(places: DataFrame) -> DataFrame:
    return places.groupBy("region").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE).select("region")


def _likest(pairs: DataFrame) -> DataFrame:
    """``a, b, near``: of ``pairs(id, other, near)`` the likest of each id, ties to the smaller other."""
    best = F.max(F.struct("near", (-F.col("other")).alias("minus"))).alias("m")
    d = pairs.groupBy("id").agg(best).select("id", (-F.col("m.minus")).alias("other"), F.col("m.near").alias("near"))
    return d.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "near")


def neighbour_pairs(places: DataFrame, large: DataFrame) -> DataFrame:
    """``a, b, near``: all likely neighbours of small regions, and each text's likest of the large ones."""
    d = places.where(F.col("next_id").isNotNull() & (F.col("id") != F.col("next_id")) & (F.col("near") >= LEAST)).select("region", "id", F.col("next_id").alias("other"), "near")
    d = d.join(large.withColumn("is_large", F.lit(True)), "region", "left")
    small = d.where("is_large IS NULL").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "near")
    hot = d.where("is_large")
    return small.unionByName(_likest(hot.select("id", "other", "near").unionByName(hot.select(F.col("other").alias("id"), F.col("id").alias("other"), "near"))))


def centre_pairs(places: DataFrame, large: DataFrame, sketch: DataFrame) -> DataFrame:
    """``a, b, near``: each text of large regions with the likest of all their centres.

    The consensus of a region sums one bit of each value over its texts; tasks sum before the shuffle. Three
    shares of the region name the text nearest to it, so no region is gathered."""
    rows = places.select("region", "id").join(large, "region").join(sketch, "id")
    # In region order, so that a task has few regions and its sums are few rows, and a large region has several tasks.
    rows = saved(rows.repartitionByRange("region", "id").sortWithinPartitions("region"), "neardup-large")

    def votes(batches):
        for b in batches:
            if not b.num_rows:
                continue
            region = b.column("region").to_numpy()
            x = np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint8).reshape(len(region), -1)
            bits = np.unpackbits(x, axis=1).astype(np.int64) * 2 - 1
            names, place = np.unique(region, return_inverse=True)
            total = np.zeros((len(names), bits.shape[1]), np.int64)
            np.add.at(total, place, bits)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total.tolist(), pa.list_(pa.int32()))], names=["region", "votes"])

    def merged(batches):
        last, total = None, None
        for b in batches:
            done = []
            for r, v in zip(b.column("region").to_pylist(), b.column("votes").to_pylist()):
                if r != last:
                    if last is not None:
                        done.append((last, np.packbits(total > 0).tobytes()))
                    last, total = r, np.zeros(len(v), np.int64)
                total = total + np.array(v)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.binary()))], names=["region", "consensus"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([np.packbits(total > 0).tobytes()], pa.binary())], names=["region", "consensus"])

    consensus = (rows.mapInArrow(votes, "region long, votes array<int>").repartition("region").sortWithinPartitions("region")
                 .mapInArrow(merged, "region long, consensus binary"))

    def distance(batches):
        for b in batches:
            if b.num_rows:
                x = [np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("sketch", "consensus")]
                near = _likeness(x[0] ^ x[1])
                yield pa.RecordBatch.from_arrays([b.column("region"), b.column("id"), pa.array(near, pa.float64())], names=["region", "id", "near"])

    def meet(batches):
        for b in batches:
            if b.num_rows:
                x = [np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("sketch", "of")]
                near = _likeness(x[0] ^ x[1])
                k = np.flatnonzero(near >= LEAST)
                if len(k):
                    yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(k)), b.column("centre").take(pa.array(k)), pa.array(near[k], pa.float64())], names=["id", "other", "near"])

    near = rows.join(consensus, "region").mapInArrow(distance, "region long, id long, near double")
    best = F.max(F.struct("near", (-F.col("id")).alias("minus")))
    centres = near.groupBy("region", F.pmod(F.xxhash64("id"), F.lit(3)).alias("share")).agg(best.alias("best")).select("region", (-F.col("best.minus")).alias("centre"))
    centres = centres.join(sketch.select(F.col("id").alias("centre"), F.col("sketch").alias("of")), "centre")
    pairs = rows.join(centres, "region").where("id <> centre")
    return _likest(pairs.select("id", "centre", "sketch", "of").mapInArrow(meet, "id long, other long, near double"))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b`` of the ``pairs`` whose full sets of ``sets(id, shingles)`` are as similar as the threshold."""

    def run(batches):
        for b in batches:
            keep = []
            for i, (x, y) in enumerate(zip(b.column("xa").to_pylist(), b.column("xb").to_pylist())):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= PERCENT * (len(x) + len(y) - both):
                    keep.append(i)
            if keep:
                yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])

    d = pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("xa")), "a")
    return d.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("xb")), "b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``id, component`` (smallest id reachable) of every id in ``links(a, b)``, by star contraction.

    Each step hangs a node's larger neighbours, then its smaller ones, below the smallest of them; minima are
    aggregated before the shuffle. It ends when all trees are stars."""
    e, last = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        e2 = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        e = saved(e2, "neardup-stars")
        forget(last)
        last = e
        # Done when each node hangs below one root and no root hangs below another.
        uses = e.select(F.col("a").alias("x"), F.lit(1).alias("n")).unionByName(e.select(F.col("b").alias("x"), F.lit(10**12).alias("n")).distinct())
        with tidy(e.sparkSession):
            done = uses.groupBy("x").agg(F.sum("n").alias("n")).where("n > 1 and n <> 1000000000000").isEmpty()
        if done:
            out = saved(e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()), "neardup-components")
            forget(e)
            return out


def _labelled(pairs: DataFrame, comps: DataFrame | None) -> DataFrame:
    """``pairs`` with the components ``ca, cb`` of their ends, those within one component left out."""
    if comps is None:
        return pairs.withColumn("ca", F.col("a")).withColumn("cb", F.col("b"))
    for end in ("a", "b"):
        own = comps.select(F.col("id").alias(end), F.col("component").alias("c" + end))
        pairs = pairs.join(own, end, "left").withColumn("c" + end, F.coalesce("c" + end, end))
    return pairs.where("ca <> cb")


def connect(pairs: DataFrame, sets: DataFrame, links: DataFrame | None, comps: DataFrame | None, rounds: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Confirm ``pairs(a, b, near)`` as far as they can join components; the links so far and their components.

    For ``rounds`` rounds each component tries its most similar pair; then all pairs are tried that still lie
    between components."""
    last: tuple = ()  # what this call has written and nothing reads any more
    for r in range(rounds + 1):
        pairs = saved(_labelled(pairs.select("a", "b", "near"), comps), "neardup-pairs")
        forget(*last)
        last = (pairs,)
        if pairs.isEmpty():
            break
        tried = pairs
        if r < rounds:
            ends = pairs.select("a", "b", "near", F.col("ca").alias("c")).unionByName(pairs.select("a", "b", "near", F.col("cb").alias("c")))
            best = F.max(F.struct("near", (-F.col("a")).alias("x"), (-F.col("b")).alias("y")))
            tried = saved(ends.groupBy("c").agg(best.alias("m")).select((-F.col("m.x")).alias("a"), (-F.col("m.y")).alias("b")).distinct(), "neardup-tried")
            last = (pairs, tried)
        needed = tried.select(F.col("a").alias("id")).unionByName(tried.select(F.col("b").alias("id"))).distinct()
        new = saved(confirmed(tried, sets.join(needed, "id", "left_semi")), "neardup-links")
        links = new if links is None else saved(links.unionByName(new), "neardup-links")
        comps = components(links)
        pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
    forget(*last)
    return links, comps


def open_pairs(places: DataFrame, comps: DataFrame | None, sketch: DataFrame, least: float, only_ids: bool = False) -> DataFrame:
    """``a, b, near``: all pairs of a region that lie in different components and may be similar enough; with
    ``only_ids`` the ``id`` of each text that is in such a pair.

    A region's largest component stands against the others only; the others against one another, too. Both
    are cut into sides of about SIDE rows, and each cell of two sides is one run of rows in a task."""
    own = places.select("region", "id")
    own = own.withColumn("c", F.col("id")) if comps is None else (
        own.join(comps, "id", "left").select("region", "id", F.coalesce("component", "id").alias("c")))
    counts = own.groupBy("region", "c").agg(F.count(F.lit(1)).alias("n"))
    regions = (counts.groupBy("region").agg(F.sum("n").alias("n"), F.max(F.struct("n", "c")).alias("most"), F.count(F.lit(1)).alias("parts"))
               .where("parts > 1").select("region", F.col("most.c").alias("main"), F.col("most.n").alias("n_main"), (F.col("n") - F.col("most.n")).alias("n_rest")))
    d = own.join(regions, "region").withColumn("in_main", F.col("c") == F.col("main"))
    sides = lambda n: F.ceil(F.col(n) / SIDE).cast("int")
    side = F.pmod(F.xxhash64("id"), F.when(F.col("in_main"), sides("n_main")).otherwise(sides("n_rest"))).cast("int")
    d = d.select("region", "id", "c", "in_main", side.alias("s"), sides("n_main").alias("k_main"), sides("n_rest").alias("k_rest"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    main = d.where("in_main").select("region", "id", "c", F.explode(upto("k_rest")).alias("i"), (-F.col("s") - 1).alias("j"), F.lit(1).alias("role"))
    rest = d.where("not in_main")
    left = rest.select("region", "id", "c", F.col("s").alias("i"), F.explode(F.concat(upto("k_main"), F.sequence(F.col("k_main"), F.col("k_main") + F.col("k_rest") - 1))).alias("x"), "k_main")
    left = left.select("region", "id", "c", "i", F.when(F.col("x") < F.col("k_main"), -F.col("x") - 1).otherwise(F.col("x") - F.col("k_main")).alias("j"), F.lit(0).alias("role")).where("j < 0 or i <= j")
    right = rest.select("region", "id", "c", F.explode(upto("k_rest")).alias("i"), F.col("s").alias("j"), F.lit(1).alias("role")).where("i < j")
    shared = own.groupBy("id").agg(F.array_sort(F.collect_list("region")).alias("regions"))  # one for each tree at most
    cells = main.unionByName(left).unionByName(right).join(sketch.join(shared, "id"), "id")
    cells = cells.repartition("region", "i", "j").sortWithinPartitions("region", "i", "j", "role", "id")

    def run(batches):
        for cell in _runs(batches, ["region", "i", "j"]):
            role, ids, c = (cell[x].to_numpy() for x in ("role", "id", "c"))
            region, regions = cell["region"][0].as_py(), [set(x) for x in cell["regions"].to_pylist()]
            s = np.frombuffer(b"".join(cell["sketch"].to_pylist()), np.uint8).reshape(len(ids), -1)
            n = int((role == 0).sum())
            within = n == len(ids)  # a side with itself
            a, b, near = [], [], []
            for i in range(n):
                k = np.arange(i + 1 if within else n, len(ids))
                k = k[c[k] != c[i]]
                if not len(k):
                    continue
                x = _likeness(s[k] ^ s[i])
                ok = x >= least
                if not only_ids:  # a pair counts in the first region that it shares
                    ok[ok] = [min(regions[i] & regions[m]) == region for m in k[ok]]
                if ok.any():
                    a.append(np.minimum(ids[i], ids[k[ok]]))
                    b.append(np.maximum(ids[i], ids[k[ok]]))
                    near.append(x[ok])
            if a and only_ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(a + b)))], names=["id"])
            elif a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in (a, b, near)], names=["a", "b", "near"])

    return cells.mapInArrow(run, "id long" if only_ids else "a long, b long, near double").distinct()


def _runs(batches, keys: list[str]) -> Iterator[pa.Table]:
    """Tables of consecutive rows that agree in ``keys``."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy() for k in keys]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        edges = [0, *cut.tolist(), b.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            key = tuple(c[lo] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, shingles``: the full sets of the documents in ``ids``."""

    def run(batches):
        known: dict[bytes, int] = {}
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([shingles(x, known).tobytes() for x in b.column("text").to_pylist()], pa.binary())], names=["id", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(saved(ids, "neardup-ids"), "id", "left_semi")
    return saved(texts.mapInArrow(run, "id long, shingles binary").where(F.length("shingles") > 0).dropDuplicates(["id"]), "neardup-sets")


def fine_sketches(sets: DataFrame) -> DataFrame:
    """``id, sketch`` with FINE values, from full sets."""

    def run(batches):
        for b in batches:
            s = [_sketch(minhash(np.frombuffer(x, np.uint64), FINE)[None, :])[0].tobytes() for x in b.column("shingles").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(s, pa.binary())], names=["id", "sketch"])

    return saved(sets.mapInArrow(run, "id long, sketch binary"), "neardup-fine")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``."""
    rows = saved(features(docs), "neardup-features")
    linked = rows.where("n > 0 and doc_id is not null")
    classes = linked.groupBy("digest").agg(F.min("doc_id").alias("id"))
    reps = rows.join(classes.withColumnRenamed("digest", "of"), (F.col("digest") == F.col("of")) & (F.col("doc_id") == F.col("id")))
    reps = saved(reps.select("id", "digest", "sig").dropDuplicates(["id", "digest"]), "neardup-classes")
    sketch = saved(sketches(reps).dropDuplicates(["id"]), "neardup-sketches")
    places = saved(forest(reps), "neardup-places")
    large = saved(large_regions(places), "neardup-regions")
    pairs = saved(neighbour_pairs(places, large).unionByName(centre_pairs(places, large, sketch)).dropDuplicates(["a", "b"]), "neardup-candidates")
    # Rows of one id are one document, whatever their texts.
    twice = linked.join(classes, "digest").where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    many = linked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("doc_id").alias("a"))
    links = saved(twice.join(many, "a", "left_semi").distinct(), "neardup-repeated")
    links, comps = (None, None) if links.isEmpty() else (links, components(links))

    ends = lambda p: p.select(F.col("a").alias("id")).unionByName(p.select(F.col("b").alias("id"))).distinct()
    links, comps = connect(pairs, sets_of(docs, ends(pairs)), links, comps, ROUNDS)
    doubtful = saved(open_pairs(places, comps, sketch, LEAST, only_ids=True), "neardup-doubtful")
    if not doubtful.isEmpty():
        sets = sets_of(docs, doubtful)
        rest = open_pairs(places.join(doubtful, "id", "left_semi"), comps, fine_sketches(sets), LEAST_FINE)
        links, comps = connect(rest.join(pairs.select("a", "b"), ["a", "b"], "left_anti"), sets, links, comps, 0)
    own = classes.select(F.col("digest").alias("of"), F.col("id").alias("rep"))
    if comps is not None:
        own = own.join(comps, own["rep"] == comps["id"], "left").select("of", F.coalesce("component", "rep").alias("rep"))
    out = rows.join(own, rows["digest"] == own["of"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame) -> DataFrame:
    """Pipeline stage: one document of each group stays, and one row of each id that has several; rows without
    an id stay."""
    kept = near_duplicates(docs).where("kept and doc_id is not null").select(F.col("doc_id").alias("__kept_id")).distinct()
    d = docs.where(F.col("doc_id").isNotNull()).join(kept, F.col("doc_id") == F.col("__kept_id"))
    n = F.row_number().over(Window.partitionBy("__kept_id").orderBy(F.col("text").asc_nulls_last()))
    d = d.withColumn("__kept_n", n).where("__kept_n = 1").select(*docs.columns)
    return d.unionByName(docs.where(F.col("doc_id").isNull()))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
