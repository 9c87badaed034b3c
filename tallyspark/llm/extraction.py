"""Operator 2, HTML extraction by a maximum-scoring subsequence.

A page is read once into text runs and tags. A word scores by the log-odds of its surroundings (the region
it stands in, its block, whether it is a link) and a tag scores below zero by its name; both kinds of weight
come from labelled pages. One linear scan finds the contiguous stretch with the largest sum, which is then
grown over neighbouring blocks as long as no unwanted word is met; runs inside it whose surroundings score
below zero (an advert between two paragraphs) are left out. A noise element costs a bounded amount, so that
a long sidebar in the middle does not cut an article in two; one that stands within a named article costs
little with all its tags, so that a menu under the title does not cut off the title. Where a page names its article, text in no
named region counts as outside of it.

Defined cases: null, empty or text-free html gives the empty text; unclosed tags, comments and scripts run to
the end of the page; character references are decoded once; white space within a block is one space; equal
pages give equal texts; repeated rows are extracted one by one; an empty table gives no rows.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import map_rows

# Names of HTML and usual class names, as published (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math textarea select canvas audio video".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul""".split())
REGION_TAGS = {"head": "head", "title": "head", "nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "sidebar", "form": "form",
               "button": "form", "label": "form", "fieldset": "form", "dialog": "notice", "article": "article", "main": "main"}
REGION_NAMES = [
    ("comment", r"comments?|respond|replies|reply|disqus|discussion"), ("advert", r"ads?|adverts?|advertisement|sponsor(ed)?|promo(tion)?|adsense|banner"),
    ("notice", r"cookies?|consent|notice|gdpr|alert|popup|modal|overlay|subscribe|newsletter|paywall"),
    ("sidebar", r"sidebar|widget|related|recommended|share|social|toc|tags|trending|aside"),
    ("menu", r"nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|skip"), ("footer", r"footer|copyright|legal|colophon"), ("header", r"header|masthead|topbar|logo"),
    ("form", r"form|search|login|signup"), ("article", r"article|content|post|story|entry|main|body|text"),
]
_NAMES = re.compile("|".join(f"(?P<{k}>(?<![a-z0-9])(?:{v})(?![a-z0-9]))" for k, v in REGION_NAMES))
GOOD = ("article", "main")
#: Blocks in which a link is part of a sentence.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 td th blockquote dd pre figcaption".split())
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*)>|<[/!?][^>]*(?:>|\Z)|<[a-zA-Z][^<>]*(?:>|\Z)""", re.S)
#: Ends of elements whose content is no markup; within a script also what may hide an end.
_RAW_END = {x: re.compile(rf"(?ai)</{x}(?=[ \t\r\n\f/>])[^>]*(?:>|\Z)") for x in RAW}
_SCRIPT_PART = re.compile(r"(?ai)<!--|-->|<(/?)script(?=[ \t\r\n\f/>])")
_CLASS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: What one noise element takes from the sum at most, within an article and around it, and bounds of the weights of words and tags.
NOISE, EDGE, WORD_BOUNDS, TAG_BOUNDS = -2.0, -30.0, (-3.0, 3.0), (-1.0, -0.02)
#: Regions that mostly stand around an article; they take up to EDGE there, and up to NOISE within one, as others do.
AROUND = ("head", "header", "menu", "footer", "comment")

#: Labelled pages, written for this purpose: what stands between {{ and }} is the main text.
LABELLED = [
    """<html><head><title>A day at sea</title></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/a>About us</a></li></ul></nav>
<div class="ad">Buy three lamps and pay for two of them today.</div><p>Morning edition, price two coins, no refunds for wet paper.</p><article>{{<h1>A day at sea</h1><p>We left the harbour before dawn and the wind was kind to us all morning.</p>
<p>By noon the coast was a <b>thin</b> line, and <a href=/x>the lighthouse</a> could hardly be seen.</p>}}</article><footer>&copy; The paper. All rights reserved. Write to us.</footer></body></html>""",
    """<html><body><header class="masthead"><a href=/>The Daily Page</a><p>Your paper since long ago</p></header><div id="content"><h1>{{Bread without haste</h1><p>Flour, water and
salt are all it takes, and time does the rest of the work.</p>}}<div class="advert">Sponsored: knives for every kitchen, sharp and cheap</div><ul>{{<li>Mix the flour with the water.</li>
<li>Wait for twelve hours, then fold.</li></ul><blockquote>Good bread is mostly waiting.</blockquote>}}</div><aside><h3>Related</h3><a href=/1>Ten soups</a> <a href=/2>All about rye</a>
<p>Most read this week by our friends</p></aside><section class="comments"><h2>Comments</h2><div><p>I tried it and it came out well, thank you so much for this.</p></div><div><p>Mine was
flat, what did I do wrong with the dough?</p></div></section><footer><p>Imprint and contact</p></footer></body></html>""",
    """<html><body><div class="cookie-notice"><p>We use cookies to make this page better. Do you agree with that?</p><button>Accept</button></div><ul class=menu><li><a>Start</a></li>
<li><a>Shop</a></li><li><a>Contact</a></li></ul><main>{{<h2>Opening hours</h2><table><tr><td>Monday</td><td>nine to five</td></tr><tr><td>Friday</td><td>nine to one</td></tr></table>
<p>On holidays the house stays closed, except for groups that have written to us before.</p>}}<form action=/s><label>Your mail</label><input><button>Sign up for the letter</button></form></main>
<div class="sidebar"><p>Weather: mild with some rain in the evening.</p></div><div class=footer>Terms, privacy, help</div></body></html>""",
    """<html><body><div id=nav><a>One</a> | <a>Two</a> | <a>Three</a></div><div>{{<p>There is no sign on this page of where the text begins, yet its sentences are long and have few links.</p><p>The
second paragraph goes on in the same way until the matter has been told in full.</p>}}</div><div class="share"><a>Send</a><a>Print</a></div><div id="disqus"><p>First! And a very nice page.</p>
</div><div class="copyright"><p>Nothing here may be copied.</p></div></body></html>""",
    """<html><body><ul><li><a href=/>Front page</a></li><li><a href=/l>Letters to us</a></li><li><a href=/c>Crosswords and games</a></li><li><a href=/t>Travel</a></li></ul><div>{{<h2>Snow on
the pass</h2><p>The road was closed at six and will stay so until the ploughs have been through.</p><p>Drivers are asked to take the tunnel, see <a href=/m>the map</a>.</p>}}</div><div><a href=/1>More
news</a> <a href=/2>The week in pictures</a> <a href=/3>Write a letter</a></div></body></html>""",
]


def _region(name: str, attrs: str, outer: str) -> str:
    """The kind of region that this element's content stands in."""
    own = REGION_TAGS.get(name, "")
    if attrs and own in ("", "header", *GOOD) and name not in ("html", "body"):  # a class says more than a plain element
        for token in " ".join(m.group(1) or m.group(2) or m.group(3) or "" for m in _CLASS.finditer(attrs)).lower().replace("_", "-").split():
            found = _NAMES.search(token)
            if found and (own in ("", "header") or found.lastgroup == "comment" and token.startswith("comment")):
                own = found.lastgroup
                break
    if own == "header" and outer in GOOD:
        return outer  # the head of an article, not of the page
    if outer not in GOOD and outer != "plain" and own in (*GOOD, ""):
        return outer  # inside noise, everything is noise
    return own or outer


def _script_end(page: str, at: int) -> int | None:
    """Where the end tag of a script whose content begins at ``at`` stands. A script named within a ``<!--`` hides
    its own end tag, as in HTML; None if the page ends before that is undone."""
    escaped = hides = False
    while m := _SCRIPT_PART.search(page, at):
        at = m.end()
        if m.group() == "<!--":
            escaped, at = True, at - 2  # <!--> is a whole one
        elif m.group() == "-->":
            escaped = hides = False
        elif not m.group(1):
            hides = escaped
        elif hides:
            hides = False
        else:
            return m.start()
    return None


def parse(page: str) -> list[tuple]:
    """Text runs ("", text, features, element) and tags (name, is block, element). The element is the one that
    the region comes from; below zero, it is noise that stands within an article, with all it holds."""
    out, stack, at = [], [("", "plain", 0)], 0
    n, hidden = 0, True

    def text(s: str) -> None:
        if s:
            names = [x[0] for x in stack]
            block = next((x for x in reversed(names) if x in BLOCK), "none")
            out.append(("", s, (("region", stack[-1][1]), ("block", block), ("link", f"{stack[-1][1]} {'text' if block in PROSE else 'list'}" if "a" in names else "none")), stack[-1][2]))

    while m := _TAG.search(page, at):
        name = (m.group(2) or "").lower()
        text(page[at:m.start()])
        at = m.end()
        if not name:
            continue
        if m.group(1):
            place = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            if place:
                del stack[place:]
        else:
            if name in RAW and not m.group(3).endswith("/"):
                end = _script_end(page, at) if name == "script" and hidden else at
                if end is None:  # no later script has a hidden end either
                    hidden, end = False, at
                end = _RAW_END[name].search(page, end)
                at = end.end() if end else len(page)
                continue
            if name in BLOCK and stack[-1][0] == "p" or name == stack[-1][0] and name in ("li", "td", "th", "tr", "dd", "dt", "option"):
                stack.pop()
            if name not in VOID and not m.group(3).endswith("/"):
                _, outer, element = stack[-1]
                region = _region(name, m.group(3), outer)
                n += 1
                if region != outer and element >= 0:
                    element = -n if outer in GOOD and region not in GOOD else n
                stack.append((name, region, element))
        out.append((name, name in BLOCK, stack[-1][2]))
    text(page[at:])
    if any(not x[0] and x[2][0][1] in GOOD and x[1].strip() for x in out):  # the page names its article
        out = [x if x[0] or x[2][0][1] != "plain" else (*x[:2], (("region", "outside"), *x[2][1:]), x[3]) for x in out]
    return out


@cache
def learned() -> tuple[dict, dict]:
    """Weights of word features and of tags: log-odds of standing in the main text of the labelled pages."""
    words = [Counter(), Counter()]
    tags = [Counter(), Counter()]
    total = [0, 0]
    for page in LABELLED:
        inside = 0
        for item in parse(page):
            if item[0]:
                tags[inside][item[0]] += 1
                continue
            for part in re.split(r"(\{\{|\}\})", item[1]):
                if part in ("{{", "}}"):
                    inside = int(part == "{{")
                    continue
                k = len(part.split())
                total[inside] += k
                for f in item[2]:
                    words[inside][f] += k
    prior = math.log(total[1] / total[0])
    word = {f: math.log((words[1][f] + 0.5) / (words[0][f] + 0.5)) - prior for f in words[0] | words[1]}
    every = sum(tags[0].values()) / sum(tags[1].values())
    lo, hi = TAG_BOUNDS
    tag = {t: max(lo, min(hi, 0.25 * math.log((tags[1][t] + 1) * every / (tags[0][t] + 1)) - 0.25)) for t in tags[0] | tags[1]}
    return word, tag


#: How much each group of features counts; the region decides where it is known.
_SHARE = {"region": 1.0, "block": 0.3, "link": 2.0}
#: What a word is worth before its surroundings are known.
_START = 0.8


@cache
def _word_weight(features: tuple) -> float:
    word = learned()[0]
    w = _START + sum(_SHARE[f[0]] * word.get(f, 0.0) for f in features)
    return max(WORD_BOUNDS[0], min(WORD_BOUNDS[1], w))


def extract(page: str | None) -> str:
    """Main text of a page, its blocks joined by line ends."""
    items = parse(page or "")
    tag = learned()[1]
    score, low = [], {}
    for x in items:
        element, k = x[-1], 0 if x[0] else len(x[1].split())
        s = tag.get(x[0], -0.1) if x[0] else k * _word_weight(x[2]) if k else 0.0
        if s < 0 and (element < 0 or not x[0]):  # of one noise element no more than NOISE
            left = low.get(element, EDGE if element >= 0 and x[2][0][1] in AROUND else NOISE)
            s = max(s, left)
            low[element] = left - s
        score.append(s)
    best, lo, hi, run, start = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(score):
        if run <= 0:
            run, start = 0.0, i
        run += s
        if run > best:
            best, lo, hi = run, start, i + 1
    if best <= 0:
        return ""
    unwanted = [not x[0] and _word_weight(x[2]) <= 0 and bool(x[1].strip()) for x in items]
    i = lo - 1
    while i >= 0 and not unwanted[i]:
        lo, i = i, i - 1
    while hi < len(items) and not unwanted[hi]:
        hi += 1
    blocks, parts = [], []
    for x, bad in zip(items[lo:hi], unwanted[lo:hi]):
        if not x[0]:
            if not bad:
                parts.append(_html.unescape(x[1]))
        elif x[1]:
            blocks.append("".join(parts))
            parts = []
        elif x[0] == "br":
            parts.append(" ")
    blocks.append("".join(parts))
    return "\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` for every row of ``pages(page_id, url, html)``."""

    def run(b):
        return {"text": pa.array([extract(x) for x in b.column("html").to_pylist()], pa.string())}

    return map_rows(pages.select("page_id", "url", "html"), run, T.StructType([T.StructField("text", T.StringType())]), ["page_id", "url"])


def query(spark, sf_dir: str) -> DataFrame:
    out = extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
