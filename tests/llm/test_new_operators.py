"""Hard negatives, main text and spelling variants, against brute force and on odd input."""

import random
import re
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import ODD_TEXTS
from trawler.llm import hard_negatives as hn
from trawler.llm import main_text as mt
from trawler.llm import spelling

# --- hard negatives ---------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 20), st.integers(1, 30), st.integers(1, 9), st.sampled_from([1, 7, 300, 1 << 24]), st.integers(0, 1 << 30))
def test_lookup_scores_are_inner_products(anchors, rows, width, size, seed):
    draw = np.random.default_rng(seed)
    a, b = draw.integers(-size, size + 1, (anchors, width)), draw.integers(-size, size + 1, (rows, width))
    assert (hn.scores(hn.subset_sums(a), hn.bit_planes(b)) == b @ a.T).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(-3, 3), st.booleans()), min_size=1, max_size=9), min_size=1, max_size=5))
def test_best_over_slices(slices):
    best, everything, next_id = hn.Best(1, 4), [], 0
    for rows in slices:
        ids = np.arange(next_id, next_id + len(rows))
        next_id += len(rows)
        best.add(0, np.array([[s for s, _ in rows]]), np.array([[f for _, f in rows]]), ids)
        everything += [(-s, int(i)) for (s, f), i in zip(rows, ids, strict=True) if f]
    want = sorted(everything)[:4]
    assert [(-int(s), int(i)) for s, i, t in zip(best.score[0], best.id[0], best.there[0], strict=True) if t] == want


def brute_negatives(rows):
    ready = {}
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        made = ((label + 1) % 10 if vec_id % 7 == 0 else label, [int(np.floor(256 * float(np.float32(x)))) for x in vector])
        ready[vec_id] = min(ready.get(vec_id, made), made)
    out = []
    for a, (label, v) in ready.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i, other) for i, (other, w) in ready.items())
        for p, i, _ in [s for s in scored if s[2] == label and s[1] != a][:5]:
            fits = [s for s in scored if s[2] != label and 30 * -p <= 100 * -s[0] <= 90 * -p][:10]
            out += [(a, i, k + 1, j, -p, -s) for k, (s, j, _) in enumerate(fits)]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<float>, label int"


def test_hard_negatives_odd(spark):
    draw = random.Random(5)
    rows = [(k, [round(draw.uniform(-1, 1), 2) for _ in range(5)], draw.randrange(3)) for k in range(240)]
    rows += [(100 * k, [0.5, 0.5, 0.5, 0.5, 0.5], 1) for k in range(3, 6)] + [(300, [0.25] * 5, 0)]
    rows += [(900 + k, [0.5] * 5, k % 3) for k in range(20)]
    rows += [(None, [0.1] * 5, 1), (701, None, 1), (702, [0.1, None], 1), (703, [float("nan")], 1), (704, [float("inf")], 2)]
    rows += [(705, [0.1], None), (706, [], 1), (800, [], 1), (707, [0.9] * 11, 2), (1000, [0.3] * 9, 2), (708, [70000.0] * 5, 1)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS query", "2 AS score", "'x' AS rank", "3 AS anchor_id", "4 AS v", "5 AS n")
    got = [tuple(r) for r in hn.hard_negatives(frame).collect()]
    assert sorted(got) == brute_negatives(rows) and got
    assert hn.hard_negatives(frame.limit(0)).count() == 0
    assert hn.hard_negatives(frame.filter("vec_id = 100")).count() == 0


def test_hard_negatives_in_batches(spark, monkeypatch):
    draw = random.Random(6)
    rows = [(k, [draw.uniform(-1, 1) for _ in range(4)], 0 if k % 3 else 1) for k in range(0, 900, 4)]
    monkeypatch.setattr(hn, "BATCH", 4)
    assert sorted(tuple(r) for r in hn.hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect()) == brute_negatives(rows)


# --- main text --------------------------------------------------------------------

PROSE = "A sentence of some length that stands here for the text of the page and is long enough to surge. "
PAGES = {
    "article": (f"<nav><a>x</a></nav><article><h1>T</h1><p>a &amp;lt; b<p>one  <b>tw</b>o<br>three</article><footer>{PROSE}</footer>", "T a &lt; b one two three"),
    "advert inside": (f"<article><p>first<div class='ad-slot'><p>{PROSE}</div><p>last</article><p>{PROSE}", "first last"),
    "comments": (f"<div id=main><p>{PROSE}<p>b</div><section class=comments><p>{PROSE}</section>", PROSE.strip() + " b"),
    "notice": (f"<div class=cookieNotice>{PROSE}</div><div><p>{PROSE}</p>end</div>", PROSE.strip() + " end"),
    "links": (f"<ul><li><a>{PROSE}</a><li><a>{PROSE}</a></ul><div></div><div>{PROSE}</div>", PROSE.strip()),
    "sidebar": (f"<header><p>{PROSE}</header><main><header>H</header>text</main><aside>{PROSE}</aside>", "H text"),
    "hints would leave nothing": ("<div class=widget><p>all there is</p></div>", "all there is"),
    "form": (f"<article>a<form><p>{PROSE}</form>b<button>c</button></article>", "a b"),
    "script": ("<article>a<script>x='</p><p>'</script>b<style>p{}</style><!-- c --></article>", "ab"),
    "unclosed script": ("<article>a<script>never <p>ends", "a"),
    "short": ("<p>few words</p>", "few words"),
    "stray": ("a < b <<> c</p></div> d", "a < b <<> c d"),
    "unclosed advert": ("<article>a<div class=ad>b</article>", "a"),
    "hidden": ("<article>a<p style='display: none'>b</p><p hidden>c</p>d</article>", "a d"),
    "body class": (f"<body class='has-sidebar'><p>{PROSE}</p></body>", PROSE.strip()),
    "cells": ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a b c"),
    "entities": ("<article>&copy; &#233;&nbsp;&#x41; &bogus;</article>", "© é A &bogus;"),
    "empty": ("", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    html, want = PAGES[name]
    assert mt.main_text(html) == want


class _Blocks(HTMLParser):
    """Text of the article's blocks by the standard library's parser; adverts are left out."""

    def __init__(self):
        super().__init__()
        self.blocks, self.inside, self.skip = [""], False, 0

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        self.skip += tag in ("script", "aside")
        if tag in ("p", "h1", "article"):
            self.blocks.append("")
        if tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        self.skip -= tag in ("script", "aside")

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.blocks[-1] += data


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<br>", "x", " y  z ", "é", "<aside>no</aside>", "\n"]), max_size=20))
def test_article_against_parser(parts):
    html = "<nav>menu</nav><article><h1>t</h1>" + "".join(parts) + "</article><footer>f</footer>"
    blocks = _Blocks()
    blocks.feed(html)
    want = " ".join(" ".join(b.split()) for b in blocks.blocks if b.split())
    assert mt.main_text(html).replace(" ", "") == want.replace(" ", "")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=30))
def test_stretches(weight):
    sums = [sum(weight[i : i + mt.WINDOW]) for i in range(len(weight))]
    want, run = [], []
    for i, s in enumerate([*sums, 0]):
        if s:
            run.append(i)
        elif run:
            want.append((run[0], run[-1] + 1, max(sums[i] for i in run)))
            run = []
    assert mt.stretches(weight) == want


def test_extract_odd(spark):
    rows = [(1, "u", "<article>a</article>", 0), (None, None, None, 0), (2, "v", "", 0), (2, "v", "", 0)]
    rows += [(3, "w", "<p>" + "x" * 300_000 + "<p><div class=ad>no</div>", 0), (4, "w", "<a " * 50_000 + '"', 0), (5, "w", "<div>" * 20_000 + "deep", 0)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int").selectExpr("*", "'t' AS text")
    got = sorted((r["page_id"] or 0, r["url"], len(r["text"]), r["n_chars"]) for r in mt.extract(frame).collect())
    texts = [mt.main_text(h) for _, _, h, _ in rows]
    assert got == sorted((i or 0, u, len(t), len(t)) for (i, u, _, _), t in zip(rows, texts, strict=True))
    assert len(texts[4]) == 300_000 and texts[6] == "deep"
    assert mt.extract(frame.limit(0)).count() == 0


# --- spelling variants ------------------------------------------------------------


def brute_variants(rows, min_length=5, min_count=3):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}

    def near(a, b):
        a, b = sorted((a, b), key=len)
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    told, forms = [], {}
    for w, n in words.items():
        around = sorted((-words[v], v) for v in words if v != w and near(w, v))
        if around and -around[0][0] >= 2 * n:
            forms[w] = around[0][1]
        told.append((w, n, len(around)))
    out = []
    for w, n, n_near in told:
        root = w
        while root in forms:
            root = forms[root]
        out.append((w, forms.get(w), root, n, n_near, words[forms[w]] if w in forms else None))
    return sorted(out, key=str)


def variants(frame, **how):
    return sorted((tuple(r) for r in spelling.spelling_variants(frame, **how).collect()), key=str)


def test_spelling_variants_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spelling, "LEVELS", 8)  # longer words go the other way
    draw = random.Random(11)
    words = ["".join(draw.choice("abé") for _ in range(draw.randint(4, 7))) for _ in range(150)]
    words += ["Straße", "STRASSE", "naïve", "naive", "aaaaa", "aaaaaa", "aaaaaaa", "x" * 8, "x" * 9, "x" * 10, "xxxxyxxxx"]
    rows = [(k, " ".join(draw.choice(words) for _ in range(40)) + "-Words, " * draw.randrange(3)) for k in range(60)]
    rows += [(100 + k, "xxxxxxxx xxxxxxxxx xxxxxxxxxx xxxxyxxxx " + "qwert qwerta qwerta qwerta " + "qwertab " * 9) for k in range(3)]
    got = variants(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute_variants(rows)
    assert any(r[2] != (r[1] or r[0]) for r in got)


def test_spelling_variants_odd(spark, odd_docs, no_docs):
    rows = [(k, t) for k, t in enumerate(ODD_TEXTS)] + [(None, "same text here"), (5, "same text here"), (5, "same text here")]
    assert variants(odd_docs, min_length=1, min_count=1) == brute_variants(rows, 1, 1)
    assert variants(odd_docs) == brute_variants(rows)
    assert variants(no_docs) == []
