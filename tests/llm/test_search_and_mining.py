"""Operators 11 to 13 against plain brute-force versions, on made rows."""

import hashlib
import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from tallyspark.llm import phrases, ranking, suffixes
from tallyspark.llm.common import shared_dir

DOCS = "doc_id long, text string, lang string, rank int, score double"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def made(n, seed=1, words=60):
    r = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("Al", "be", "ÇA", "du", "ef", "go") for b in range(words // 6)]
    texts = [" ".join(r.choice(vocab[: 6 + i % 50]) for _ in range(r.randint(0, 60))) + r.choice([".", ", ", "\n", ""]) for i in range(n)]
    return [(i, t) for i, t in enumerate(texts)]


# ---- operator 11


def ranked(docs, items, k=10):
    words = [(i, TERM.findall(lower(t))) for i, t in docs]
    words = [(i, w) for i, w in words if w]
    n_docs, n_words = len(words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(TERM.findall(lower(text)))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, w in words:
            tf, m = Counter(w), 10 + (90 * len(w) * n_docs) // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in terms if tf[t])
            if s > 0:
                scores.append((-s, i is None, i))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, n + 1, i, -s) for n, (s, _, i) in enumerate(scores[:k])]
    return sorted(out, key=repr)


def search(spark, docs, items, k=10):
    d = spark.createDataFrame([(i, t, "en", 1, 0.5) for i, t in docs], DOCS).repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    return rows_of(ranking.search(d, q, k))


def test_search_equals_brute_force(spark):
    docs = made(300) + [(7, None), (8, ""), (9, " .,; "), (None, "al1 be2 be2"), (3, "al1 al1"), (3, "al1 al1"), (900, "al1 " * 3000 + "be2")]
    items = [(1, "Al1 be2 unknown"), (2, "al1 AL1 du3 ef4 go5"), (2, "çA1 ÇA1"), (3, ""), (4, None), (None, "al1"), (5, " ".join(f"be{i}" for i in range(10)))]
    want = ranked(docs, items)
    assert want and search(spark, docs, items) == want


def test_search_prunes_and_is_right_for_any_window(monkeypatch):
    """Blocks of lists that cannot lift a candidate stay packed."""
    import numpy as np
    r = np.random.default_rng(3)
    m = np.full(4000, 10 + 90 * 6)  # every document has six terms, as many as there are documents by the mean

    def make(tf):
        rows = list(ranking._shard(0, list(range(4000)), [[b"x"] * t + [b"y"] * (6 - t) for t in tf], 4000, 4000))
        names = rows[0].column("term").to_pylist()
        c = {f: rows[0].column(f)[names.index(b"x")].as_py() for f in ("top", "last", "tops", "docs", "tfs")}
        return ranking._List(c["top"], c["last"], c["tops"], c["docs"], c["tfs"], m)

    rare = np.where(r.random(4000) < 0.01, 5, 0)
    common = np.where(r.random(4000) < 0.5, 1, 0)
    lists = [(9000, make(rare)), (5, make(common))]
    score = 9000 * np.where(rare > 0, ranking.impact(rare, m), 0) + 5 * np.where(common > 0, ranking.impact(common, m), 0)
    want = sorted((-s, i) for i, s in enumerate(score) if s > 0)[:10]
    for span in (1, 64, 512, 5000):
        for _, x in lists:
            x.opened.clear()
        docs, scores = ranking.best(lists, 4000, 10, span)
        assert [(-int(s), int(i)) for i, s in zip(docs, scores)] == want
        if span == 64:
            assert len(lists[1][1].opened) < len(lists[1][1].tops)


def test_search_in_empty_tables(spark):
    assert search(spark, [], [(1, "a")]) == []
    assert search(spark, [(1, "a")], []) == []
    assert search(spark, [(1, None)], [(1, "a")]) == []


# ---- operator 12


def deduped(rows):
    key = lambda i: 2**63 if i is None else i
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - 49):
            first[b[s : s + 50]] = min(first.get(b[s : s + 50], 2**64), key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < key(i):
                gone[s : s + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, len(b), len(b) - len(kept), int(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def remove(spark, rows, parts=3, chunk=1 << 19):
    d = spark.createDataFrame([(i, t, "en", 1, 0.5) for i, t in rows], DOCS).repartition(parts)
    return rows_of(suffixes.remove_repeats(d, chunk_bytes=chunk))


def passages(seed):
    r = random.Random(seed)
    fresh = lambda n: "".join(r.choice("abcdefgh é\0\n") for _ in range(n))
    shared = [fresh(n) for n in (49, 50, 51, 75, 120, 400)]
    rows = []
    for i in range(120):
        text = "".join(r.choice([fresh(r.randint(0, 90)), r.choice(shared), shared[5][r.randint(0, 200) : r.randint(200, 400)]]) for _ in range(r.randint(0, 6)))
        rows.append((r.randint(0, 100), text))
    return rows


@pytest.mark.parametrize("chunk", [1 << 19, 700])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(suffixes, "SAMPLE_CHUNKS", 3)
    rows = passages(4)
    rows += [(None, rows[0][1]), (None, None), (5, None), (6, ""), (1000, "x" * 49), (1001, "x" * 49), (1002, "x" * 3000), (1003, "y" + "x" * 60 + "z"),
             (1004, "ab" * 4000), (1005, "ab" * 30), (-4, "ab" * 26), (2**40, "ab" * 27), rows[3], rows[3], (rows[3][0], "ab" * 40)]
    assert remove(spark, rows, chunk=chunk) == deduped(rows)


def test_copies_of_one_text_keep_the_smallest(spark):
    rows = [(i, "a line that stands in every document of this group, fifty bytes and more") for i in range(200)]
    got = remove(spark, rows, 7)
    assert sum(r[2] > 0 for r in got) == 199 and [r[0] for r in got if not r[2]] == [0]
    assert got == deduped(rows)


def test_repeats_in_empty_tables(spark):
    assert remove(spark, []) == []
    assert remove(spark, [(1, None)]) == deduped([(1, None)])


def test_kept_text_on_request(spark):
    d = spark.createDataFrame([(1, "p" * 60), (2, "new" + "p" * 60)], "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept) for r in suffixes.remove_repeats(d, texts=True).collect()}
    assert got == {1: b"p" * 60, 2: b"new"}


def chunk_of(rows):
    texts = [(t or "").encode() for _, t in rows]
    ids, sizes = (np.array(x, np.int64).tobytes() for x in ([i for i, _ in rows], [len(t) for t in texts]))
    return texts, (ids, sizes, b"".join(texts))


def test_anchors_of_windows_go_by_content(monkeypatch):
    rows = passages(7) + [(1, "x" * 300), (2, "yx" * 90), (3, None), (4, "z" * 49), (5, "y" + "x" * 60)]
    texts, parts = chunk_of(rows)
    c = suffixes.Chunk(*parts)
    begin = np.cumsum([0] + [len(t) for t in texts])
    windows = [begin[d] + s for d, t in enumerate(texts) for s in range(len(t) - 49)]
    own = np.repeat(np.arange(len(c.place)), c.last - c.first + 1)
    assert np.concatenate([np.arange(x, y + 1) for x, y in zip(c.first, c.last)]).tolist() == windows
    at, contexts, anchors = {}, {}, {}
    for w, k in zip(windows, own.tolist()):
        assert w <= c.place[k] <= w + 14 and at.setdefault(parts[2][w : w + 50], c.place[k] - w) == c.place[k] - w
    for p, d, x, y in zip(c.place.tolist(), c.doc.tolist(), c.context.tolist(), c.anchor.tolist()):
        low, high = max(p - 14, begin[d]), min(p + 50, begin[d + 1])
        assert contexts.setdefault(x, (parts[2][low:high], p - low)) == (parts[2][low:high], p - low)
        assert anchors.setdefault(y, parts[2][p : p + 36]) == parts[2][p : p + 36]
    assert len(set(contexts.values())) == len(contexts) and len(set(anchors.values())) == len(anchors)
    monkeypatch.setattr(suffixes, "BLOCK", 61)
    small = suffixes.Chunk(*parts)
    for name in ("place", "first", "last", "doc", "id", "anchor", "context"):
        assert getattr(small, name).tolist() == getattr(c, name).tolist()


def test_the_last_pass_hashes_nothing(monkeypatch):
    """The runs that go are known by then; the texts are not hashed a fourth time."""
    rows = [(1, "p" * 60), (2, "new" + "q" * 60), (None, "r" * 70), (3, None)]
    texts, (ids, sizes, data) = chunk_of([(suffixes.NO_ID if i is None else i, t) for i, t in rows])
    table = pa.table({"chunk": [7], "ids": [ids], "sizes": [sizes], "data": [data]})
    runs = [np.array(x, np.uint32).tobytes() for x in ([[63, 64], [123, 123]], [[64, 66]])]
    places = pa.table({"chunk": [7], "gone": [runs[0]], "sorted": [runs[1]]})
    monkeypatch.setattr(suffixes, "Chunk", None)
    got = [tuple(r.values()) for r in suffixes._cut(True)(table, places).to_pylist()]
    kept = [texts[0], b"new" + b"q" * 7, b"r" * 20, b""]
    removed = [(0, 0), (53, 1), (50, 1), (0, 0)]
    assert got == [(i, len(t), *r, k, hashlib.sha256(k).hexdigest()) for (i, _), t, r, k in zip(rows, texts, removed, kept)]


@pytest.mark.parametrize("n", [0, 1, 255, 256, 300])
def test_keys_are_dealt_to_ranges(n):
    r = np.random.default_rng(n)
    keys = np.sort(r.integers(0, 40, (2000, 2), np.uint8).view("S2").ravel())[r.permutation(2000)]
    cuts = np.unique(keys)[:n]
    got, edges, number = suffixes._ranged(keys, cuts)
    assert (got[number] == keys).all() and sorted(got) == np.unique(keys).tolist() and len(edges) == n + 2
    for k, (x, y) in enumerate(zip(edges, edges[1:])):
        assert all((not k or cuts[k - 1] <= v) and (k == n or v < cuts[k]) for v in got[x:y])
    assert edges[0] == 0 and edges[-1] == len(got)
    none = suffixes._ranged(keys[:0], cuts)
    assert not len(none[0]) and set(none[1]) == {0} and not len(none[2])


def test_long_texts_that_share_passages(spark):
    r = random.Random(9)
    text = "".join(r.choice("abcdefgh é\n") for _ in range(40000))
    rows = [(5, text), (9, text[100:33000] + "!" + text[20000:39000]), (7, "copy " + text[32000:32900] * 3), (2, text[39990:] + text[:60])]
    assert remove(spark, rows) == deduped(rows)


# ---- operator 13


def mined(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in cand.items():
        if len(w) == 2 and any(x[0] == lang and len(x[1]) == 3 and w in (x[1][:2], x[1][1:]) and 100 * b >= 50 * a for x, b in cand.items()):
            continue
        s, _, l, r = min(((1000000 * a * a) // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-s, -a, " ".join(w).encode(), l, r))
    return sorted(((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top])), key=repr)


def mine(spark, rows, least=10, top=2000, shards=2, cells=phrases.CELLS):
    d = spark.createDataFrame([(i % 50 or None, t, lang, 1, 0.5) for i, (lang, t) in enumerate(rows)], DOCS).repartition(3)
    return rows_of(phrases.collocations(d, least, top, shards, cells))


TALK = [(random.Random(i).choice(["en", "fr", None, "und"]), t + " Very very very often. said so" * (i % 3)) for i, t in made(400, 5, 12)]
ODD = [("en", None), ("en", ""), (None, " .,;"), ("en", "a\tb  c\x0bd e"), ("fr", "l a ÉtÉ " * 40), ("en", "word " * 6000)] + [("x", "pair up")] * 12


@pytest.mark.parametrize("shards", [1, 2, 5])
def test_phrases_equal_brute_force(spark, shards):
    rows = TALK + ODD
    want = mined(rows, 10, 2000)
    assert len(want) > 50 and mine(spark, rows, shards=shards) == want


def test_phrases_are_exact_when_cells_are_shared(spark):
    """With four cells every phrase becomes active with others; counts stay whole."""
    rows = TALK[:150] + ODD
    assert mine(spark, rows, least=6, top=20, cells=4) == mined(rows, 6, 20)


def test_phrases_in_empty_tables(spark):
    assert mine(spark, []) == []
    assert mine(spark, [("en", None)]) == []


def test_phrases_are_counted_in_sections(spark, monkeypatch):
    """A scan of much text shuffles one section of the phrases at a time; the sections have no phrase in common and miss none."""
    seen, count = Counter(), phrases.count_shard

    def spied(docs, scan, shards, tables, lengths, buckets, sections, section):
        new = count(docs, scan, shards, tables, lengths, buckets, sections, section)
        seen[scan, sections, frozenset(r.bucket % sections for r in new.select("bucket").distinct().collect())] += 1
        return new

    monkeypatch.setattr(phrases, "SECTION_BYTES", 100)
    monkeypatch.setattr(phrases, "SECTIONS", 3)
    monkeypatch.setattr(phrases, "count_shard", spied)
    rows = TALK[:200] + ODD
    assert mine(spark, rows) == mined(rows, 10, 2000)
    assert {b for s, n, b in seen if s == 0 and n == 3} == {frozenset([0]), frozenset([1]), frozenset([2])}


def test_complete_cycles_keep_frequent_phrases_only(spark, monkeypatch):
    """What stays on disk when a length has seen every shard does not grow with the rare phrases; nothing but the result's files stays at the end."""
    kept, named = Counter(), phrases._named

    def spied(parts, state, *rest):
        for x in state:
            for r in x.collect():
                n = phrases._unpacked(*([bytes(v)] for v in (r.a, r.b, r.kind, r.n)))[3]
                kept.update(few=int((n < 10).sum()), frequent=int((n >= 10).sum()))
        return named(parts, state, *rest)

    monkeypatch.setattr(phrases, "_named", spied)
    shared = Path(shared_dir(spark).replace("file:", ""))
    before = set(shared.rglob("part-*.parquet"))
    rows = TALK[:200] + ODD + [("en", f"rare{i} word{i}") for i in range(300)]
    assert mine(spark, rows) == mined(rows, 10, 2000)
    assert kept["few"] == 0 < kept["frequent"]
    left = {p.relative_to(shared).parts[0].rpartition("-")[0] for p in set(shared.rglob("part-*.parquet")) - before}
    assert left == {"phrases-scored"}
