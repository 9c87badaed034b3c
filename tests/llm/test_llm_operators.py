"""Each operator against brute force, planted cases and odd input (nulls, empties, ties, repeats, clashing names)."""

import hashlib
import math
import random
import re
import struct
from collections import Counter, defaultdict
from io import BytesIO

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.llm import chat, extraction, fingerprint, language, mixing, neardup, packing, search, secrets, warc
from tallyspark.llm.common import saved

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the and with that house water morning which paper should weather".split(), "de": "der die und nicht haus wasser morgen welche zeitung sollte wetter".split(),
         "ru": "это дом вода утро который бумага должен погода и не".split()}


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "s", "en"]) for _ in range(n))


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], DOCS)


def written(spark, df, tmp_path, name):
    df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


# ---------------------------------------------------------------- 1 language


def test_language_held_out_and_odd_texts(spark, tmp_path):
    rng = random.Random(0)
    rows = [(i, text(rng, lang, 60), lang, "s") for i, lang in enumerate(list(WORDS) * 40)]
    rows += [(1000, None, "en", "s"), (1001, "", None, "s"), (1002, "123 !! ...", "en", None), (1003, "漢字", None, "s"), (5, rows[5][1], rows[5][2], "s"), (None, "the water and the house", None, "s")]
    d = docs(spark, rows).withColumn("lang_pred", F.lit("clash"))
    out = language.query(spark, written(spark, d, tmp_path, "documents")).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    want = {i: lang for i, _, lang, _ in rows[:120]}
    assert all(by[i].lang_pred == lang for i, lang in want.items())
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1000].score == 0
    assert by[1003].lang_pred in WORDS and by[None].lang_pred == "en"
    import zlib
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out if r.doc_id is not None)
    assert any(r.held_out for r in out)


def test_language_spans_of_mixed_text(spark):
    rng = random.Random(1)
    m = language.train(docs(spark, [(i, text(rng, lang, 80), lang, "s") for i, lang in enumerate(list(WORDS) * 30)]))
    a, b = text(rng, "en", 30), text(rng, "de", 50)
    langs, score, spans = language.label_texts([a + " " + b + " 12", "", "x " * 100_000], m)
    assert langs[0] == "de" and 0.5 < score[0] < 0.8 and langs[1] == "und"
    assert [x["lang"] for x in spans.to_pylist()[0]] == ["en", "de"]
    assert abs(spans.to_pylist()[0][0]["end"] - len(a)) < 30
    # Viterbi against all labellings of a short text
    s = np.random.default_rng(0).normal(size=(7, 3)).astype(np.float32)
    import itertools
    def value(p):
        return sum(s[i, x] for i, x in enumerate(p)) - 0.7 * sum(x != y for x, y in zip(p, p[1:]))
    best = max(itertools.product(range(3), repeat=7), key=value)
    assert tuple(language.viterbi(s, np.array([0]), np.array([7]), 0.7)) == best


def test_language_untrained_and_empty(spark):
    d = docs(spark, [(1, "some text", None, "s")])
    assert language.identify(d, language.train(d)).first().lang_pred == "und"
    e = docs(spark, [])
    assert language.identify(e, language.train(e)).count() == 0
    kept = language.keep_identified(docs(spark, [(i, "the house and water", "en", None) for i in range(9)] + [(99, None, "en", "s"), (98, "--", None, "s")]))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and kept.count() == 9


# ---------------------------------------------------------------- 2 extraction


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("plain words", "plain words"), ("<p>a &lt;b&gt; &amp;amp; c</p>", "a <b> &amp; c"), ("<script>var x='<p>no</p>'</script>", ""),
    ("<div><p>one\n  <b>t</b>wo</p> tail</div>", "one two\ntail"), ("<p title='a>b'>x y z</p><!-- open", "x y z"), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
    ("<nav><a href=/>Home</a></nav><article><h1>T</h1><p>Body text here.</p><aside>noise noise</aside><p>More.</p></article><footer>f g h</footer>", "T\nBody text here.\nMore."),
    ("<div class='cookie-banner'>We use cookies</div><main><p>Real words stand here.</p><form><label>Mail</label></form></main><div id=comments><p>I like it a lot</p></div>", "Real words stand here."),
    ("<article><p>Unclosed <b>and <i>nested<p>next</article><footer>x y</footer>", "Unclosed and nested\nnext"),
])
def test_extraction_cases(page, want):
    assert extraction.extract(page) == want


@pytest.mark.parametrize("raw", [
    "<script>for(i=0;i<n;i++){}</script>", "<script>a='<!--'</script>", "<SCRIPT>if(a<b)c()</sCript\n>", "<style>/* a<b */ </styled> x<y</style>", "<textarea>p<q</textarea/>",
    "<noscript><img alt='></noscript>", "<script><!--\ndocument.write('<script src=x></script>words of a script');\n//--></script>", "<script><!--></script>",
    "<script>a='<!--<script>'</script>", "<script>a='</scripted>'; b<c</script >",
])
def test_extraction_ends_raw_elements_at_their_own_tag(raw):
    assert extraction.extract(f"<p>First words here.</p>{raw}<p>Second words here.</p>{raw}<p>Last words.</p>") == "First words here.\nSecond words here.\nLast words."
    assert extraction.extract(f"{raw}<article><p>Body text here.</p></article>") == "Body text here."


@pytest.mark.parametrize("menu", [
    "<nav>One Two Three Four Five Six Seven Eight Nine Ten Eleven Twelve</nav>", "<nav><ul>" + "<li><a href=#a>Part of it</a></li>" * 30 + "</ul></nav>",
    "<div class=toc><div class=menu>" + "<p><a href=#a>Part of it</a></p>" * 30 + "</div></div>", "<div class=breadcrumbs>" + "<a href=/>Up</a> &gt; " * 20 + "</div>",
])
@pytest.mark.parametrize("kind", ["main", "article"])
def test_extraction_keeps_what_stands_beside_a_menu_in_the_article(menu, kind):
    body = "<p>The text of this page is a few sentences long and stands behind its menu.</p>"
    want = "Short title\nThe text of this page is a few sentences long and stands behind its menu.\nThe closing line."
    assert extraction.extract(f"<nav>{'<a href=/>Site menu</a> ' * 9}</nav><{kind}><h1>Short title</h1>{menu}{body}{menu}<p>The closing line.</p></{kind}><footer>All rights reserved</footer>") == want


def test_extraction_of_labelled_pages_and_rows(spark, tmp_path):
    for page in extraction.LABELLED:
        parts = re.findall(r"\{\{(.*?)\}\}", page, re.S)
        want = Counter(" ".join(re.sub(r"<[^>]*>", " ", " ".join(parts)).split()).replace(" ,", ",").replace(" .", ".").split())
        got = Counter(extraction.extract(page.replace("{{", "").replace("}}", "")).split())
        assert got == want
    d = spark.createDataFrame([(1, "u", "<p>x</p>", 1), (1, "u", "<p>x</p>", 1), (None, None, None, 2)], "page_id long, url string, html string, text int")
    out = extraction.query(spark, written(spark, d, tmp_path, "pages")).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in out) == [(0, "", 0), (1, "x", 1), (1, "x", 1)]


def test_extraction_finds_the_best_stretch():
    long = "<nav>" + "<a href=/>menu entry</a>" * 3000 + "</nav><article><p>" + "word " * 20000 + "</p></article>"
    assert extraction.extract(long) == ("word " * 20000).strip()


# ---------------------------------------------------------------- 3 near duplicates


def brute_components(rows):
    sets = [(i, {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()) for i, w in ((i, [x.encode().lower() for x in words(t)]) for i, t in rows)]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, (i, s) in enumerate(sets):
        for j, u in sets[:a]:
            if s and u and 100 * len(s & u) >= 75 * len(s | u):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def near_rows(rng):
    rows = [(i, prose(rng, rng.randint(0, 60))) for i in range(40)]
    base = prose(rng, 120).split()
    rows.append((100, " ".join(base)))
    for i in range(101, 161):  # a star: each copy resembles the source and hardly any other copy
        w = list(base)
        for k in rng.sample(range(len(w)), 3):
            w[k] = "edit%d" % rng.randint(0, 10**9)
        rows.append((i, " ".join(w)))
    chain = prose(rng, 60).split()
    for i in range(200, 210):
        chain = chain[2:] + prose(rng, 2).split()
        rows.append((i, " ".join(chain)))
    rows += [(300 + i, " ".join(base).upper()) for i in range(12)]
    common = prose(rng, 25)
    rows += [(400 + i, common + " " + prose(rng, 20 + i)) for i in range(30)]
    return rows + [(500, None), (501, ""), (502, "one two"), (503, "ONE\ttwo"), (504, " \n "), (505, "İ é É")]


def test_near_duplicates_equal_brute_force(spark):
    rows = near_rows(random.Random(5))
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(d).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_repeats_nulls_and_stage(spark):
    a, b = prose(random.Random(2), 50), prose(random.Random(3), 50)
    rows = [(7, a), (7, a), (9, a), (3, b), (9, b), (None, a), (None, None), (20, None)]
    d = docs(spark, [(i, t, "en", "s") for i, t in rows])
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(d).collect()), key=str)
    assert got == sorted([(7, 3, False), (7, 3, False), (9, 3, False), (3, 3, True), (9, 3, False), (None, None, True), (None, None, True), (20, 20, True)], key=str)
    kept = neardup.keep_one(d)
    assert kept.columns == d.columns and sorted(kept.toPandas().doc_id.fillna(-1)) == [-1, -1, 3, 20]
    assert neardup.near_duplicates(docs(spark, [])).count() == 0


def test_open_regions_are_cut_into_cells(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SIDE", 3)
    rng = random.Random(8)
    sig = {i: rng.getrandbits(512).to_bytes(64, "little") for i in range(20)}
    sketch = spark.createDataFrame([(i, bytearray(s)) for i, s in sig.items()], "id long, sketch binary")
    places = spark.createDataFrame([(1, i) for i in range(20)], "region long, id long")
    comps = spark.createDataFrame([(i, 0) for i in range(8)] + [(8, 8), (9, 8)], "id long, component long")
    c = {i: 0 if i < 8 else 8 if i < 10 else i for i in range(20)}
    got = sorted((r.a, r.b) for r in neardup.open_pairs(places, comps, sketch, -9.0).collect())
    assert got == [(a, b) for a in range(20) for b in range(a + 1, 20) if c[a] != c[b]]


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 90), (90, 95)]
    got = dict(map(tuple, neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(31)}, 100: 90, 90: 90, 95: 90}


# ---------------------------------------------------------------- 4 packing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plan_places_every_piece_once(h):
    runs = packing.plan_runs(h, 64, 16)
    rows = list(zip(*(runs[c].tolist() for c in ("length", "rank", "sequence", "offset"))))
    place = defaultdict(list)
    for i, (n, r, s, o) in enumerate(rows):
        end = rows[i + 1][1] if i + 1 < len(rows) and rows[i + 1][0] == n else h[n]
        for k in range(end - r):
            place[s + k].append((o, n))
    assert Counter(n for x in place.values() for _, n in x) == Counter(h)
    for x in place.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 64
    if h:
        decreasing, rooms = sorted((n for n, c in h.items() for _ in range(c)), reverse=True), []
        for n in decreasing:
            fit = [r for r in rooms if r >= n]
            if fit:
                rooms.remove(min(fit))
                rooms.append(min(fit) - n)
            else:
                rooms.append(64 - n)
        assert len(place) <= len(rooms) * 1.1 + 2


def test_nnls_fits():
    rng = np.random.default_rng(0)
    a, x = rng.random((12, 5)), np.array([3.0, 0, 7, 0, 2])
    assert np.allclose(packing.nnls(a, a @ x, 20000, 1e-9), x, atol=0.05)


ODD = "aB.,'!s ?\n\t éLl漢́İΣς\x1c\x85 “😀td-_#<|endoftext|>"


def test_ids_equal_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    rng = random.Random(4)
    xs = ["", "it's I'll. we're!! cd's,", "end.\n\nnew"] + ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    want = [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch_fast(xs, add_special_tokens=False)]
    assert packing.packed_ids(xs, path) == want


def test_ids_of_special_tokens_equal_the_untouched_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    t, rng = Tokenizer.from_file(path), random.Random(5)
    odd = [*ODD, "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|End", "oftext|>", "<|", "|>"]
    xs = ["<|endoftext|>", "a<|endoftext|>b <|EndOfText|>", "it's<|startoftext|><|endoftext|>.\n", "<|endof<|endoftext|>text|>"]
    xs += ["".join(rng.choice(odd) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    want = [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch_fast(xs, add_special_tokens=False)]
    assert packing.packed_ids(xs, path) == want and 49407 in np.frombuffer(want[0], "<u4")


def test_packing_of_documents(spark, tmp_path):
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.choice([0, 1, 5, 300, 900])), "en", "s") for i in range(60)] + [(70, None, None, None), (71, prose(rng, 9000), "en", "s"), (None, "x", "en", "s"), (70, None, None, None)]
    d = docs(spark, rows).withColumn("offset", F.lit("clash"))
    out = packing.query(spark, written(spark, d, tmp_path, "documents")).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, x, *_ in rows:
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4")
        for k in range(0, len(ids), 4096):
            part = ids[k:k + 4096]
            want[(i, k // 4096, k, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    seq = defaultdict(list)
    for r in out:
        seq[r.sequence_id].append((r.offset, r.length))
    for x in seq.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 4096
    assert len(seq) <= math.ceil(sum(r.length for r in out) / 4096) + 1
    assert packing.pack_documents(docs(spark, [])).count() == 0


# ---------------------------------------------------------------- 5 fingerprints


def shingle_set(t):
    w = words((t or "").lower())
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_fingerprints(spark, tmp_path):
    rng = random.Random(9)
    rows = [(3 * i - 40, prose(rng, rng.choice([3, 40, 200])), "en", "s") for i in range(50)]
    rows += [(500, None, None, None), (501, "", "en", "s"), (502, rows[0][1], "en", "s"), (503, rows[0][1], "en", "s"), (10**15, "far away it is here", "en", "s")]
    d = docs(spark, rows).withColumn("fingerprint", F.lit(1)).withColumn("sig", F.lit(2))
    out = {r.doc_id: r for r in fingerprint.query(spark, written(spark, d.repartition(5), tmp_path, "documents")).collect()}
    rows.sort()
    by_text = defaultdict(set)
    for k, (i, t, *_) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        h = len(t) // 2
        edited = t[:len(t) - h] + nxt[:h]
        r = out[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        by_text[t].add(r.fingerprint)
        a, b = shingle_set(t), shingle_set(edited)
        exact = len(a & b) / len(a | b) if a | b else 1.0
        assert abs(r.near_edited - exact) < (0.15 if len(a) > 100 else 0.5), (i, r.near_edited, exact)
    assert all(len(x) == 1 for x in by_text.values()) and len({next(iter(x)) for x in by_text.values()}) == len(by_text)
    assert out[502].near_next == 1.0 and out[500].near_next == 1.0 and out[501].near_next == 0.0 and out[500].fingerprint == ""
    assert len(out[502].fingerprint) == fingerprint.BINS


def test_fingerprint_neighbours(spark):
    keys = sorted(random.Random(3).sample(range(-10**6, 10**6), 900))
    got = dict(map(tuple, fingerprint.successors(spark.createDataFrame([(k,) for k in keys], "k long"), 8).collect()))
    assert got == dict(zip(keys, keys[1:] + [None]))
    d = spark.createDataFrame([(None, "n"), (5, "b"), (5, "a"), (5, "a"), (9, "z")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text, r.next_text) for r in fingerprint.with_next(d, 1).collect()), key=str)
    assert got == sorted([(None, "n", "a"), (5, "a", "a"), (5, "a", "b"), (5, "b", "z"), (9, "z", "n")], key=str)
    one = fingerprint.with_next(spark.createDataFrame([(1, "x")], "doc_id long, text string")).first()
    assert one.next_text == "x"
    assert fingerprint.with_next(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---------------------------------------------------------------- 6 search


def brute_search(rows, every, k):
    v = {}
    for i, e in rows:
        if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            v.setdefault(i, set()).add(tuple(math.floor(256 * x) for x in e))
    flat = [(i, e) for i, es in v.items() for e in es]
    out = []
    for q, e in flat:
        if q % every == 0:
            s = sorted((-sum(a * b for a, b in zip(e, f)), i) for i, f in flat if i != q)[:k]
            out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    return sorted(out)


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in rng.permutation(700)]
    same = [0.5] * 8
    rows += [(1000 + i, same) for i in range(40)] + [(2000, None), (2050, [float("nan")] * 8), (2100, [None] * 8), (2150, [float("inf")] * 8), (None, same), (2200, [1.0, 2.0]), (2250, [0.0] * 8), (2250, [0.0] * 8)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    for block in (16, 128):
        assert sorted(map(tuple, search.search(d, 50, 5, block).collect())) == brute_search(rows, 50, 5)
    few = spark.createDataFrame([(0, [1.0]), (1, [-1.0])], "vec_id long, embedding array<float>")
    assert list(map(tuple, search.search(few, 50, 5).collect())) == [(0, 1, 1, -65536)]
    assert search.search(few.where("vec_id < 0"), 50, 5).count() == 0
    big = [(0, [3e9, 1.0]), (1, [3e9, 2.0]), (2, [1.0, 1.0])]
    got = sorted(map(tuple, search.search(spark.createDataFrame(big, "vec_id long, embedding array<double>"), 50, 5).collect()))
    assert got == [(0, 1, 1, 2**63 - 1), (0, 2, 2, 256 * 256 * 3 * 10**9 + 65536)]


# ---------------------------------------------------------------- 7 archives


def test_archives_round_trip(spark, tmp_path):
    rng = random.Random(1)
    big = prose(rng, 400)
    rows = [(i, f"http://x/{i}", prose(rng, rng.choice([1, 300]))) for i in range(300)]
    rows += [(1000, "u", big), (1001, "u\r\nx%0A", big), (1002, None, big), (1002, None, big), (2000, "u", "short"), (2001, "u", "short"), (3000, "u", None), (3001, "u", ""), (None, "u", big)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    out = warc.query(spark, written(spark, d, tmp_path, "pages")).collect()
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        revisit = h == big and i != 1002
        want[(i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", 1002 if revisit else None)] += 1
    assert Counter(map(tuple, out)) == want
    back = {r.page_id: r for r in warc.read_archives(warc.archive_pages(d)).collect()}
    assert bytes(back[5].payload).decode() == rows[5][2] and back[1001].url == "u\r\nx%0A" and back[1001].payload is None
    assert warc.read_archives(warc.archive_pages(d.where("page_id < 0"))).count() == 0


def one_archive(raw, records):
    c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    return struct.pack("<II", warc.SKIPPABLE, len(raw)) + raw + b"".join(c.compress(r) for r in records)


def test_reader_rejects_damage():
    r = [warc._record(i, "u", b"payload %d" % i * 20, hashlib.sha1(b"payload %d" % i * 20).hexdigest(), None) for i in range(3)]
    raw = b"WARC/1.1 payload WARC-Type: response" * 4
    good = one_archive(raw, r)
    assert [warc.parse(x)["page_id"] for x in warc.frames(BytesIO(good), 7)] == [0, 1, 2]
    packed = zstandard.ZstdCompressor().compress(raw)
    c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    assert list(warc.frames(BytesIO(struct.pack("<II", warc.SKIPPABLE, len(packed)) + packed + c.compress(r[0])))) == [r[0]]
    for bad in (b"", good[:20], b"\0" * 40, good[:-5]):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.frames(BytesIO(bad)))
    for broken in (r[0].replace(b"WARC/1.1", b"WARC/0.9"), r[0][:-1], r[0] + r[1], r[0].replace(b"payload", b"pAyload"), r[0].replace(b"WARC-Date", b"WARC-Type"), b"junk"):
        with pytest.raises(ValueError):
            warc.parse(broken)


# ---------------------------------------------------------------- 8 secrets


def test_base_spans_follow_the_patterns():
    pieces = ["password", "Passwd", "SECRET", "toKen", "api_key", "apikey", "ſecret", '"', "'", " ", "=", ":", "abcdef", "x1", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "f00", "\n", "/+", "é"]
    kinds = {"assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
             "access": (re.compile("AKIA[A-Z0-9]+"), 0, 20), "hex": (re.compile("[0-9a-f]+"), 0, 24)}
    rng = random.Random(2)
    for _ in range(4000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        want = sorted(((m.start(), i, k, m.end()) for i, (k, (p, g, n)) in enumerate(kinds.items()) for m in p.finditer(t) if len(m.group(g)) >= n))
        assert [(s, k, e) for s, e, k, *_ in secrets.base_spans(t)] == [(s, k, e) for s, _, k, e in want]


def secret_docs(spark):
    key = "q7Xk2Lw9ZpR4tV8nB3mD6sJ1"
    rows = [(i, f"copy the example token = EXAMPLE{'0' * 20} please", "en", f"s{i % 5}") for i in range(20)]
    rows += [(50, f"ours is {key} ok and password: hunter2222", "en", "s1"), (51, f"again {key}.", "en", "s1"), (52, None, "en", None), (53, "", None, None)]
    rows += [(60 + i, "shared Ab1Cd2Ef3Gh4Ij5Kl6Mn7Op8 here", "en", f"s{i}") for i in range(4)] + [(53, "", None, None)]
    return docs(spark, rows), key


def test_ownership_decides(spark, tmp_path):
    d, key = secret_docs(spark)
    out = {r.doc_id: r for r in secrets.query(spark, written(spark, d.withColumn("spans", F.lit(0)), tmp_path, "documents")).collect()}
    assert out[0].n_assign == 1 and out[0].n_live == 0 and out[60].spans == ""
    assert out[50].spans == f"key:8:{8 + len(key)},assign:{8 + len(key) + 8}:{8 + len(key) + 28}" and out[50].n_live == 2
    assert out[52].spans == "" and out[52].base_sha256 == hashlib.sha256(b"").hexdigest()
    t = f"assign:17:{17 + 8 + 27}"
    assert out[0].spans == t and out[0].base_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert len(secrets.find_secrets(d).collect()) == d.count()
    assert secrets.find_secrets(docs(spark, [])).count() == 0


def test_redaction_keeps_all_documents(spark):
    d, key = secret_docs(spark)
    out = secrets.redact(d.withColumn("row", F.lit(1)))
    assert out.columns == [*d.columns, "row"] and out.count() == d.count()
    by = {r.doc_id: r for r in out.collect()}
    assert by[50].text == "ours is [secret] ok and password: [secret]" and by[50].n_chars == len(by[50].text)
    assert by[51].text == "again [secret]." and "EXAMPLE" in by[0].text and by[52].text is None and by[60].text.startswith("shared Ab1")


# ---------------------------------------------------------------- 9 chat


HARD = ["\\", "###", "### ", "#", "</turn>", "</", "turn>", "\n", ": ", ":", " ", "a", "é", "\\### Assistant: </turn> ok"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(["user", "assistant", *HARD]), max_size=3).map("".join), st.lists(st.sampled_from(HARD), max_size=8).map("".join)), min_size=1, max_size=25))
def test_chat_round_trip(turns):
    r, back, out = chat.Renderer(chat.turn_template, 4), chat.Reader(), ""
    for role, t in turns:
        piece, start, end, a, b, rewrites = r.add(role, t)
        assert start == len(out) and not rewrites
        out += piece
        assert end == len(out) and chat.unescape(out[a:b]) == t
        back.feed(piece, start, (a, b))
    assert out == chat.turn_template(turns) and back.turns == len(turns) and not back.rest
    assert back.all.hexdigest() == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    assert back.loss.hexdigest() == hashlib.sha256("".join(t for _, t in turns).encode()).hexdigest()


def test_chat_detects_rewritten_history():
    def forgetful(ms):  # keeps the thoughts of the last turn only
        return "<s>" + "".join(f"[{a}]{b if i == len(ms) - 1 else b.split('|')[-1]}[/]" for i, (a, b) in enumerate(ms))
    r = chat.Renderer(forgetful)
    flags = [r.add(a, b)[-1] for a, b in [("user", "hi"), ("assistant", "hmm|yes"), ("user", "and"), ("assistant", "no")]]
    assert flags == [False, False, True, False]


@pytest.mark.parametrize("name", ["numbered", "late_first"])
def test_chat_renders_the_real_prefix(spark, name):
    def numbered(ms):  # the first turn's text goes into the last user turn, and turns are numbered from the first
        last = max((i for i, (role, _) in enumerate(ms) if role == "user"), default=None)
        return "<s>" + "".join(f"[{i}{a} of {len(ms[0][1])}]{ms[0][1] + '/' if i == last else ''}{b}#{i}" for i, (a, b) in enumerate(ms))

    def late_first(ms):  # numbers without an end, a first-turn rule
        return "".join((f"{ms[0][1]}>" if a == "user" else "") + f"{b}{i}" for i, (a, b) in enumerate(ms))

    template = {"numbered": numbered, "late_first": late_first}[name]
    rows = [(c, t, "user" if t % 2 else "assistant", f"first {c}" if not t else f"text {t % 3}" * (t % 4)) for c in range(5) for t in range(40 + c)]
    rows += [(9, 0, "system", ""), (9, 1, "user", "x"), (10, 0, "system", "be kind"), (10, 1, "user", "x")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {(r.conv_id, r.turn_no): r for r in chat.format_conversations(d, template).collect()}
    for c in {x[0] for x in rows}:
        turns, before = [x[2:] for x in rows if x[0] == c], template([])
        for t, (role, own) in enumerate(turns):
            out, r = template(turns[:t + 1]), got[c, t]
            kept = next((i for i, (x, y) in enumerate(zip(out, before)) if x != y), min(len(out), len(before)))
            assert (r.start, r.end, r.rewrites) == (0 if not t else kept, len(out), not out.startswith(before)) and r.piece == out[r.start:]
            if r.text_start is not None:
                assert out[r.text_start:r.text_end] == own
            elif t:
                assert r.rewrites
            before = out


def test_chat_shortens_the_prefix_where_declared():
    def paired(ms):
        return "".join(f"[{ms[i - 1][0] if i else ''}>{a}]{b}" for i, (a, b) in enumerate(ms))
    paired.looks_back = 1
    for template, most in ((chat.turn_template, 16), (paired, 16)):
        seen = []
        def counted(ms):
            seen.append(len(ms))
            return template(ms)
        counted.looks_back = template.looks_back
        turns = [("user" if t % 3 else "assistant", f"text {t}") for t in range(50)]
        r = chat.Renderer(counted)
        got = [r.add(*x) for x in turns]
        out = template(turns)
        assert "".join(x[0] for x in got) == out and max(seen) <= most
        assert [out[x[3]:x[4]] for x in got] == [x[1] for x in turns]


def test_conversations(spark, tmp_path):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice([None, "", "x", "hello ### </turn> \\"])) for c in range(20) for t in range(rng.choice([1, 2, 60]))]
    rows += [(0, 0, "user", "dup"), (0, 0, "user", "dup"), (None, None, None, "lost"), (None, 1, "assistant", "y")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(0))
    out = {r.conv_id: r for r in chat.query(spark, written(spark, d.repartition(4), tmp_path, "conversations")).collect()}
    conv = defaultdict(list)
    for c, t, role, x in rows:
        conv[c].append((-1 if t is None else t, role or "", x or ""))
    conv[-7] = [(0, "user", HARD[-1]), (1, "assistant", HARD[-1])]
    assert set(out) == set(conv)
    for c, turns in conv.items():
        turns.sort()
        loss = "".join(x for _, role, x in turns if role == "assistant")
        full = "".join(f"{role}\n{x}\n" for _, role, x in turns)
        r = out[c]
        assert (r.n_turns, r.loss_chars, r.formatted_chars) == (len(turns), len(loss), len(chat.turn_template([t[1:] for t in turns])))
        assert (r.turns_sha256, r.loss_sha256) == tuple(hashlib.sha256(x.encode()).hexdigest() for x in (full, loss))


# ---------------------------------------------------------------- 10 mixing


def fill(sizes, weights, most=3):
    total, stopped = sum(sizes), set()
    while True:
        free = sum(w for i, w in enumerate(weights) if i not in stopped)
        rate = (total - sum(most * sizes[i] for i in stopped)) / free if free else 0
        new = {i for i, w in enumerate(weights) if i not in stopped and w * rate > most * sizes[i]}
        if not new:
            return [most * s if i in stopped else w * rate for i, (s, w) in enumerate(zip(sizes, weights))]
        stopped |= new


def test_mix_meets_targets_and_repeats(spark, tmp_path):
    rng = random.Random(7)
    names = ["a", "b", "B", "é", "z", "\U0001f600", None]
    rows = [(i, prose(rng, rng.randint(0, 40)), "en", rng.choice(names + ["z"] * 6)) for i in range(1500)]
    rows += [(5000, None, None, None), (5001, "", None, "a"), (7, rows[7][1], "en", rows[7][3]), (None, "x y z", "en", "a")]
    d = docs(spark, rows).withColumn("target", F.lit("clash"))
    path = written(spark, d.repartition(5), tmp_path, "documents")
    out = mixing.query(spark, path).collect()
    assert len(out) == len(rows)
    size = Counter()
    for _, t, _, s in rows:
        size[s] += len(words(t))
    order = sorted((s for s in size if s is not None)) + [None]
    want = dict(zip(order, fill([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])))
    source = {i: s for i, _, _, s in rows}
    taken = Counter()
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == size[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 20 for s in order)
    again = mixing.mix(spark.read.parquet(f"{path}/documents.parquet").repartition(2), bucket_rows=20_000)
    assert sorted((r.doc_id or -1, r.copies) for r in again.collect()) == sorted((r.doc_id or -1, r.copies) for r in out)


def test_mix_tree_and_stage(spark):
    rng = random.Random(3)
    d = docs(spark, [(i, prose(rng, rng.randint(1, 30)), "en", "abc"[i % 3]) for i in range(900)] + [(5, "same words", "en", "a")] * 4)
    out = mixing.mix(d, bucket_rows=10, fan_in=4)
    sums = {r.source: (r.t, r.w) for r in out.groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("copies") * F.col("size")).alias("w")).collect()}
    assert all(abs(t - w) <= 15 for t, w in sums.values())
    one = Counter(r.doc_id for r in mixing.take_mix(d).collect())
    two = Counter()
    for r in mixing.mix(d).collect():
        two[r.doc_id] += r.copies
    assert one == +two and mixing.take_mix(d).columns == d.columns
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.take_mix(docs(spark, [(1, None, None, None)])).count() == 0


def test_trades_keep_words_and_expectation():
    rng, total = random.Random(0), Counter()
    rows = [(i, s, 0.3) for i, s in enumerate([50, 40, 30, 20, 10, 5, 5])]
    for _ in range(4000):
        settled, left = mixing._trade(rows, rng)
        got = sum(rows[k][1] * v for k, v in settled.items()) + (left[1] * left[2] if left else 0)
        assert abs(got - 0.3 * 160) < 1e-9
        total.update({k: v for k, v in settled.items()})
        if left:
            total[left[0]] += left[2]
    assert all(abs(total[k] / 4000 - 0.3) < 0.03 for k in range(7))


def test_saved_frames_do_not_use_local_checkpoints(spark):
    assert saved(spark.range(3).toDF("x"), "t").count() == 3
