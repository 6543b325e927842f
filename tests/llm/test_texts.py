"""Operators on texts, against brute force and on odd input."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import ODD_TEXTS
from trawler.llm import exact_dedup as ed
from trawler.llm import quality_rules as qr
from trawler.llm import sentencepiece as sp
from trawler.llm import simhash as sh
from trawler.llm import textbytes as tb
from trawler.llm import token_counts as tc
from trawler.session import ship_package

TEXTS = st.lists(st.text(alphabet="aAbß \n\t日|#"), max_size=6)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words(texts):
    for _, _, data, offsets in tb.texts(pa.array(texts, pa.string()), 8):
        starts, ends, first = tb.words(data, offsets)
        raw = data.tobytes()
        for k in range(len(offsets) - 1):
            own = [raw[a:b].decode() for a, b in zip(starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]], strict=True)]
            assert own == split(raw[offsets[k] : offsets[k + 1]].decode())


def brute_counts(text):
    w = split(text)
    runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + j for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if split(x)]
    return [len(w), sum(map(len, w)), sum(c in qr.SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered)]


@settings(max_examples=80, deadline=None)
@given(TEXTS)
def test_quality_counts(texts):
    data, offsets = tb.flat(pa.array(texts, pa.string()))
    got = np.array(qr.measure_slice(data, offsets)).reshape(5, -1).T.tolist()
    assert got == [brute_counts(t) for t in texts]


def test_quality_rules_odd(odd_docs, no_docs):
    rows = qr.quality_rules(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    for k, text in enumerate(ODD_TEXTS):
        assert [by_id[k][c] for c in qr.COUNTS] == brute_counts(text or "")
    assert by_id[9]["base_failed"] and not by_id[9]["kept"]
    assert qr.quality_rules(no_docs).count() == 0


def test_host_verdict(spark):
    good, bad = "a b c d e f g h i j k l", "a b"
    rows = [(k, good if k % 10 else bad, "clean") for k in range(200)] + [(500 + k, bad if k % 10 else good, "foul") for k in range(200)]
    rows = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {(r["host"], r["base_failed"], r["kept"]) for r in qr.quality_rules(rows).collect()}
    assert got == {("clean", False, True), ("clean", True, False), ("foul", False, False), ("foul", True, False)}


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 64))
def test_fingerprints_combine(data, chunk):
    array = np.frombuffer(data, np.uint8)
    for i, prime in enumerate(ed.PRIMES):
        whole = 0
        for byte in data:
            whole = (whole * ed.RADIX[i] + byte + 1) % prime
        assert ed.row_hashes(array, np.array([0, len(data)]), ed.PRIMES, chunk)[i][0] == whole


@pytest.mark.parametrize("primes", [ed.PRIMES, (1, 1)])
def test_exact_dedup(odd_docs, primes):
    """Also with primes that make all fingerprints of a length collide."""
    told = [(r["doc_id"], r["text"] or "") for r in odd_docs.select("doc_id", "text").collect()]
    groups = {}
    for doc_id, text in told:
        groups.setdefault(text, []).append(doc_id)
    rows = ed.exact_dedup(odd_docs, primes).collect()
    assert len(rows) == len(told)
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    for r in rows:
        ids = groups[sha[r["text_sha256"]]]
        assert r["group_size"] == len(ids) and r["keep_id"] == max(x for x in ids if x is not None)
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert sum(r["kept"] for r in rows) == len(groups)


def test_exact_dedup_empty(no_docs):
    assert ed.exact_dedup(no_docs).count() == 0


def brute_print(text, words=3):
    w = split(lower(text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + words]), 42) for i in range(max(1, len(w) - words + 1))] if w else []
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def grouped(nodes, linked):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_simhash_odd(odd_docs, no_docs):
    rows = sh.simhash_near_dedup(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        if r["doc_id"] is not None:
            assert r["fingerprint"] == f"{brute_print(ODD_TEXTS[r['doc_id']]):016x}"
    empty = {r["component_id"] for r in rows if r["doc_id"] in (0, 1, 2)}
    assert empty == {0}
    assert sh.simhash_near_dedup(no_docs).count() == 0


def test_links_are_all_close_pairs(spark):
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for p in list(prints)[:20]:
        for _ in range(6):
            prints.add(p ^ sum(1 << rng.randrange(64) for _ in range(rng.choice([1, 2, 3]))) & (1 << 64) - 1)
    signed = sorted(sh._signed(p & (1 << 64) - 1) for p in prints)
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = {(r["a"], r["b"]) for r in sh.links(df).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert got == want and len(want) > 20


def test_components_of_a_long_path(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 200), (200, 150)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["label"] for r in sh.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == grouped({x for e in edges for x in e}, edges)


def test_similar_groups(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(5000)}" for _ in range(120)] for _ in range(12)]
    texts = [" ".join(w) for w in base]
    for w in base[:8]:
        for _ in range(4):
            copy = list(w)
            copy[rng.randrange(120)] = "changed"
            texts.append(" ".join(copy))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    close = [(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    rows = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    got = {r["node"]: r["label"] for r in sh.similar_groups(rows).collect()}
    want = grouped(range(len(texts)), close)
    assert {n: got.get(n, n) for n in want} == want


def shingle_set(text, words=5):
    w = split(lower(text))
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def test_similar_groups_of_a_star(spark):
    """Copies that are similar to their base and not to each other."""
    rng = random.Random(17)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts = [" ".join(base)]
    for _ in range(1000):
        copy = list(base)
        for at in rng.sample(range(5, 295), 5):
            copy[at] = f"c{rng.randrange(10**9)}"
        texts.append(" ".join(copy))
    rng.shuffle(texts)
    sets = [shingle_set(t) for t in texts]
    assert sum(len(sets[0] & s) < 0.8 * len(sets[0] | s) for s in sets) > 500
    centre = shingle_set(" ".join(base))
    assert all(len(centre & s) >= 0.8 * len(centre | s) for s in sets)
    rows = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    assert {(r["node"], r["label"]) for r in sh.similar_groups(rows).collect()} == {(n, 0) for n in range(len(texts))}


@pytest.mark.parametrize("seed", range(2))
def test_similar_groups_are_exact(spark, seed):
    """Chains near the threshold, texts of few words, and lines that many texts share."""
    rng = random.Random(seed)
    lines = [" ".join(f"l{rng.randrange(10**6)}" for _ in range(12)) for _ in range(2)]
    texts = ["", None, "one", "One", "a b c d e", "a b c d e f", "a b c d f"]
    for _ in range(30):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([6, 20, 60, 200]))]
        for _ in range(rng.choice([1, 3, 8])):
            texts.append(" ".join([*words, rng.choice([*lines, ""])]))
            words = list(words)
            for _ in range(max(1, len(words) // 50)):
                words[rng.randrange(len(words))] = f"c{rng.randrange(10**9)}"
    sets = [shingle_set(t or "") for t in texts]
    close = [(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    rows = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    got = {r["node"]: r["label"] for r in sh.similar_groups(rows).collect()}
    want = grouped(range(len(texts)), close)
    assert {n: got.get(n, n) for n in want} == want
    assert set(got) == {n for pair in close for n in pair}


def test_similar_groups_of_repeats(spark):
    """Texts that differ in how often a phrase repeats have nearly equal sets of shingles."""
    rng = random.Random(9)
    rows = []
    for k in range(12):
        w = [f"w{rng.randrange(10**9)}" for _ in range(1000)]
        phrase = [f"p{rng.randrange(10**9)}" for _ in range(10)]
        rows += [(2 * k, " ".join(w[:500] + phrase + w[500:])), (2 * k + 1, " ".join(w[:500] + phrase * 24 + w[500:]))]
    got = {r["node"]: r["label"] for r in sh.similar_groups(spark.createDataFrame(rows, "node long, text string")).collect()}
    assert got == {n: n - n % 2 for n, _ in rows}


@pytest.fixture(scope="module")
def model():
    return sp.Model.read(sp.MODEL)


def best_score(model, marked):
    best = [0.0] + [-1e18] * len(marked)
    for end in range(1, len(marked) + 1):
        for start in range(max(0, end - model.longest), end):
            gain = model.score.get(marked[start:end], model.unknown_score if end - start == 1 else None)
            if gain is not None:
                best[end] = max(best[end], best[start] + gain)
    return best[-1]


def path_score(model, ids):
    total, held = 0.0, b""
    for i in ids:
        piece = model.pieces[i]
        if piece in model.score:
            total += model.score[piece]
        else:
            held += model.bytes_of[i]
            try:
                held.decode()
            except UnicodeDecodeError:
                continue
            total, held = total + model.unknown_score, b""
    return total


@settings(max_examples=80, deadline=None)
@given(text=st.text(alphabet="the anio  \nß日🎉qz", max_size=60))
def test_viterbi_is_best_and_round_trips(model, text):
    ids = sp.Encoder(model).encode(text).tolist()
    assert model.decode(ids) == text
    if text:
        marked = sp.MARK + text.replace(" ", sp.MARK)
        assert abs(path_score(model, ids) - best_score(model, marked)) < 1e-6


def test_window_stays_short(model):
    search, widest = sp.StreamingViterbi(model), 0
    out = []
    for c in "▁" + "internationalization" * 300:
        out += search.feed(c)
        widest = max(widest, len(search.text))
    out += search.finish()
    assert widest < 4 * model.longest
    assert np.array(out, np.int32).tobytes() == sp.Encoder(model)._segment("▁" + "internationalization" * 300)


def test_encode_decode_odd(odd_docs, no_docs):
    encoded = sp.encode(odd_docs)
    rows = encoded.collect()
    assert len(rows) == odd_docs.count() and all(r["round_trip"] for r in rows)
    texts = {r["doc_id"]: r["text"] for r in sp.decode(encoded).collect()}
    assert all(texts[k] == (t or "") for k, t in enumerate(ODD_TEXTS))
    assert sp.encode(no_docs).count() == 0


def greedy(pieces, word):
    symbols, at, n = (*word, tc.END), 0, 0
    while at < len(symbols):
        end = next((e for e in range(len(symbols), at, -1) if symbols[at:e] in pieces), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=5), max_size=12), st.sets(st.text("abc", max_size=3), max_size=4), st.text("abcd", max_size=14))
def test_automaton_is_greedy(plain, ended, word):
    pieces = {tuple(p.encode()) for p in plain} | {(*p.encode(), tc.END) for p in ended}
    assert tc.Automaton(pieces).count(word.encode()) == greedy(pieces, word.encode())


def test_token_counts_odd(odd_docs, no_docs):
    pieces = set(tc.read_vocabulary(tc.VOCABULARY))
    rows = {r["doc_id"]: r for r in tc.token_counts(odd_docs).collect()}
    for k, text in enumerate(ODD_TEXTS[:8]):
        words = [w.encode() for w in split(lower(text or ""))]
        assert rows[k]["n_words"] == len(words)
        assert rows[k]["n_tokens"] == sum(greedy(pieces, w) for w in words)
    assert tc.token_counts(no_docs).count() == 0


def test_workers_get_small_batches(spark):
    """A batch of texts is cut by its bytes: executors hold several copies of one, outside the heap."""
    ship_package(spark)
    rows = spark.range(64, numPartitions=1).select(F.repeat(F.lit("word "), 13000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    got = [r["n"] for r in rows.mapInArrow(sizes, "n long").collect()]
    assert sum(got) > 64 * 65000 and max(got) < 2 << 20
