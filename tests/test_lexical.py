"""BM25 results against SQLite FTS5, an independent implementation."""

import random
import sqlite3
import uuid

import pytest
from pyspark.sql import functions as F

from trawler.config import Settings
from trawler.functions.lexquery import parse, parse_any, word_tokens
from trawler.functions import stem
from trawler.functions.stem import porter
from trawler.operators.lexical import TermIndex, bm25_matches, search
from trawler.operators import postings as postings_module
from trawler.operators.postings import corpus_stats
from trawler.sources.index import write_search_tables
from trawler.sources.tables import TableIndex
from tests.test_store import LEXICAL

EXTRA = {
    "crepe.md": "# Crêpe Stand\n\nThe crêpe's naïve price: won't anchor dry_dock; dry.dock and sailing sails.\n",
    "repeats.md": "# Repeats\n\nnight ferry night ferry. ferry night. The the the.\n",
    "mixed.md": "# Mixed\n\nxyz港口日志uvw 只是测试 anchoring anchored anchors 부두 ボート\n",
    "front.md": "---\ntag: survey\n---\n\n# 港口日志\n\ntide_gauge\n",
}
QUERIES = [
    "tide_gauge", '"night ferry"', '"night ferry', "night-ferry", "3.14.15", "engine -regatta", "港口日志", "winter",
    "anchor", "engine -3.14.15", "crêpe", "won't", "dry.dock!", 'dry"dock"', "sailing", "the ferry",
    'night -"night ferry"', "anchor anchor", "survey", "saili", "anchored price", "ボート",
]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    docs = {**LEXICAL, **EXTRA}
    rows = [(i + 1, "docs", rel, body, True) for i, (rel, body) in enumerate(sorted(docs.items()))]
    files = spark.createDataFrame(rows, "rowid long, collection string, rel_path string, body string, active boolean")
    root = str(tmp_path_factory.mktemp("index"))
    paths = {t: f"{root}/{t}-{uuid.uuid4().hex}" for t in ("tokens", "documents", "postings")}
    write_search_tables(files, paths, Settings())
    documents = spark.read.parquet(paths["documents"])
    index = TermIndex(spark.read.parquet(paths["postings"]), *corpus_stats(documents))

    db = sqlite3.connect(":memory:")
    db.execute("create virtual table fts using fts5(filepath, title, body, tokenize='porter unicode61')")

    def spaced(s):
        return "".join(f" {c} " if word_tokens(c) == [c] and ord(c) >= 0x1100 else c for c in s)

    for r in documents.join(files.select("rowid", "body"), "rowid").collect():
        db.execute(
            "insert into fts(rowid, filepath, title, body) values (?, ?, ?, ?)",
            (r.rowid, spaced(f"docs/{r.rel_path}"), spaced(r.title), spaced(r.body)),
        )
    return index, documents, db


@pytest.mark.parametrize("query", QUERIES)
def test_matches_fts5(built, query):
    index, documents, db = built
    want = db.execute(
        "select rowid, bm25(fts, 1.5, 4.0, 1.0) as s from fts where fts match ? order by s, rowid", (str(parse(query)),)
    ).fetchall()
    got = [(r.rowid, r.bm25) for r in bm25_matches(index, parse(query)).orderBy("bm25", "rowid").collect()]
    assert [r for r, _ in got] == [r for r, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], rel=1e-12)


def test_any_query_matches_fts5(built):
    index, _, db = built
    for query in ("the anchor of ferry", "the of", "night-ferry regatta"):
        want = db.execute(
            "select rowid, bm25(fts, 1.5, 4.0, 1.0) as s from fts where fts match ? order by s, rowid",
            (str(parse_any(query)),),
        ).fetchall()
        got = [(r.rowid, r.bm25) for r in bm25_matches(index, parse_any(query)).orderBy("bm25", "rowid").collect()]
        assert [r for r, _ in got] == [r for r, _ in want]
        assert [s for _, s in got] == pytest.approx([s for _, s in want], rel=1e-12)


def test_min_score_and_ranks(built):
    index, documents, _ = built
    hits = search(index, documents, "anchor", min_score=0.4).orderBy("bm25_rank").collect()
    assert [h.bm25_rank for h in hits] == list(range(1, len(hits) + 1))
    assert all(h.score >= 0.4 for h in hits)


@pytest.mark.parametrize(
    "query, want",
    [
        ("engine -3.14.15", '"engine"* NOT ("3"* AND "14"* AND "15"*)'),
        ("crêpe", '"crêpe"*'),
        ("won't", '"won\'t"*'),
        ("dry.dock!", '"drydock"*'),
        ("anchor-", '"anchor"*'),
        ('dry"dock"', '"dry"* AND "dock"'),
        ("-only", ""),
        ("night-ferry", '"night ferry"'),
        ("港口", '"港 口"'),
        ('-"a b" c', '"c"* NOT "a b"'),
        ("___", '"___"*'),
    ],
)
def test_query_reading(query, want):
    assert str(parse(query)) == want


def test_clause_without_tokens_matches_nothing(built):
    index, _, _ = built
    assert bm25_matches(index, parse("___ anchor")).isEmpty()
    assert not bm25_matches(index, parse("anchor -___")).isEmpty()


def test_any_query_reading():
    assert str(parse_any("The Anchor of x!")) == '"anchor"* OR "x"*'
    assert str(parse_any("the of")) == '"the"* OR "of"*'


def test_porter():
    words = "caresses ponies relational running agreed hopping sky happy electricity adoption ies eed at".split()
    stems = "caress poni relat run agre hop sky happi electr adopt ie e at".split()
    assert [porter(w) for w in words] == stems


def test_stems_against_fts5(spark):
    """Column steps, Python and the full-text tokenizer give the same stems."""
    draw = random.Random(3)
    rules = [r[0] for r in (*stem.STEP_2, *stem.STEP_3)] + list(stem.STEP_4) + ["s", "ed", "ing", "sses", "ies", "eed", "y", "e", "ll"]
    words = set(rules) | {"yyying", "cyyyed", "sse", "straßes", "naïvely", "日本ing", "123s", "x" * 64 + "s", "as"}
    for _ in range(1500):
        words.add("".join(draw.choice("abeioutslyzwxnr") for _ in range(draw.randint(0, 5))) + draw.choice(rules) + draw.choice(rules + [""] * 30))
    words = sorted(words)
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table fts using fts5(t, tokenize='porter unicode61 remove_diacritics 0')")
    db.execute("create virtual table vocab using fts5vocab(fts, 'instance')")
    db.executemany("insert into fts(rowid, t) values (?, ?)", enumerate(words))
    want = {words[doc]: term for term, doc in db.execute("select term, doc from vocab")}
    got = {r.term: r.stem for r in stem.stems(spark.createDataFrame([(w,) for w in words], "term string")).collect()}
    assert got == want == {w: porter(w) for w in words}


def test_hot_term_is_spread_over_files(spark, tmp_path):
    """A term holding most occurrences is cut into several ranges."""
    from trawler.operators.postings import build_postings, write_postings

    rows = spark.range(4000).select(F.col("id").alias("rowid"), F.lit("hot " * 20 + "cold").alias("body"))
    postings = build_postings(rows, {"body": F.col("body")}, "none")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_postings(postings, str(tmp_path / "p"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = spark.read.parquet(str(tmp_path / "p")).filter("term = 'hot'").select(F.input_file_name().alias("f"))
    assert files.distinct().count() > 1
    assert files.count() == 80000


def test_postings_are_cut_by_their_number(spark, tmp_path, monkeypatch):
    """More occurrences than the session's partitions should sort make more ranges, not longer ones."""
    monkeypatch.setattr(postings_module, "ROWS_PER_RANGE", 50)
    files = spark.createDataFrame([(i, "c", f"f{i}.md", f"w{i} the end") for i in range(400)], "rowid long, collection string, rel_path string, body string")
    paths = {p: str(tmp_path / p) for p in ("tokens", "documents", "postings")}
    write_search_tables(files, paths, Settings())
    stored = spark.read.parquet(paths["postings"])
    sizes = [r["count"] for r in stored.groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 400 * 7 and max(sizes) <= 200


def test_document_tables_need_no_postings(spark, tmp_path):
    """Searches that only look up documents do not build the postings."""
    rows = [(i, f"the word{i} end", "en", "src0", 12) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "t/documents.parquet"))
    ix = TableIndex(spark, str(tmp_path / "t"), Settings(stemmer="none"), str(tmp_path / "ix"))
    assert ix.documents.count() == 20 and not (tmp_path / "ix/postings").exists()
    assert ix.entries.rows == 20 and not (tmp_path / "ix/postings").exists()
    assert ix.terms.rows == 20 and ix.terms.postings.filter("term = 'the'").count() == 20


def test_stemmed_index_shares_plain_tables(spark, tmp_path):
    """Only postings are written again for another stemmer."""
    rows = [(i, f"the words{i} running", "en", "src0", 12) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "t/documents.parquet"))
    plain = TableIndex(spark, str(tmp_path / "t"), Settings(stemmer="none"), str(tmp_path / "plain"))
    stemmed = TableIndex(spark, str(tmp_path / "t"), Settings(stemmer="porter"), str(tmp_path / "stemmed"), plain)
    assert stemmed.terms.postings.filter("term = 'run'").count() == 20
    assert stemmed.chunk_terms.postings.filter("term = 'run'").count() == 20
    assert (stemmed.entries.rows, stemmed.documents.count(), stemmed.chunks.count()) == (20, 20, 20)
    assert {p.name for p in (tmp_path / "stemmed").iterdir()} == {"postings", "chunk_postings", "entries"}
    assert not (tmp_path / "plain/postings").exists() and plain.documents.count() == 20
