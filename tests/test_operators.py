import json

import pytest
from pyspark.sql import functions as F

from trawler.functions import models as m
from trawler.functions import terms
from trawler.functions import text as tx
from trawler.functions.globs import glob_regex, included
from trawler.operators import catalog, fusion, sessions
from trawler.sources.files import json_lines, pipe_table


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "globs, yes, no",
    [
        (["**/*"], ["a", "x/y.bin"], []),
        (["**/*.md"], ["a.md", "x/B.MD"], ["a.mdx", "md"]),
        (["tmp/*"], ["tmp/a"], ["tmp/a/b", "x/tmp/a"]),
        (["tmp/**"], ["tmp/a.md"], ["tmp/a/b.md"]),
        (["**/README*"], ["README.md", "x/y/README"], ["x/README/z"]),
        (["docs/?[ab].md", " "], ["docs/xa.md"], ["docs/xc.md", "docs/a.md"]),
    ],
)
def test_globs(spark, globs, yes, no):
    rows = spark.createDataFrame([(p,) for p in yes + no], "p string")
    assert {r.p for r in rows.filter(included(F.col("p"), globs, [])).collect()} == set(yes)
    assert glob_regex([" "]) is None


def test_default_files(spark):
    rows = spark.createDataFrame([("a.md",), ("b.TXT",), ("c.log",), ("d.markdown",), ("e.go",)], "p string")
    kept = rows.filter(included(F.col("p"), [], ["c*"])).collect()
    assert [r.p for r in kept] == ["a.md", "b.TXT", "d.markdown"]


def test_text_functions(spark):
    assert one(spark, "x\n  # Head  \n# Two", lambda c: tx.title(c, F.lit("a/b.c.md"))) == "Head"
    assert one(spark, "#tag\n#\n", lambda c: tx.title(c, F.lit("a/b.c.md"))) == "b.c"
    assert one(spark, " a \n\t b  ", tx.snippet) == "a b"
    long = "word " * 100
    assert one(spark, long, tx.snippet) == ("word " * 36)[:180] + "..."
    assert one(spark, "x " * 90 + "y", tx.snippet) == ("x " * 90) + "..."
    assert one(spark, "x" * 180 + "   ", tx.snippet) == "x" * 180
    assert one(spark, "abc用户，def 管理", tx.display_snippet) == "abc 用户 ，def 管理"
    assert one(spark, "Héllo, World! 2", tx.slug) == "h-llo-world-2"
    assert one(spark, "用户abcd", tx.estimate_tokens) == 4
    assert one(spark, " a|b\r\nc ", tx.pipe_cell) == "a\\|b c"
    assert one(spark, "用户x", tx.space_cjk) == " 用  户 x"


def test_terms(spark):
    assert terms.question_terms('What is "API" v2? 用') == ["what", "api", "用"]
    assert terms.intent_terms("what about 【API】 a x1") == ["api", "x1"]
    score = lambda c: terms.overlap_score(c, "missing question", "what about 【API】")
    assert one(spark, "what about api route", score) == 1
    answers = {"Yes, 0.2": 1.0, "I know": 0.0, "score 0.75": 0.75, "7": 1.0, "-3": 0.0, "": 0.0}
    for text, want in answers.items():
        assert one(spark, text, terms.rerank_score) == want
    assert terms.parse_expansions("lex: a\nVEC : b: c\nother: x\nhyde:\nplain") == [("lex", "a"), ("vec", "b: c")]
    for shape in (
        {"embedding": [1, 2]}, {"embeddings": [[1, 2]]}, {"data": [{"embedding": [1, 2]}]}, [{"embedding": [1, 2]}], [[1, 2]], [1, 2],
    ):
        assert terms.parse_embedding("log line\n" + json.dumps(shape) + "\n") == [1.0, 2.0]
    with pytest.raises(ValueError):
        terms.parse_embedding("nothing")


def test_models(spark):
    assert m.query_input("ollama/qwen3-embedding", " q ").endswith("\nQuery: q")
    assert m.query_input("x", "q") == "task: search result | query: q"
    first = m.fingerprint("x", 50, 0.15)
    assert len(first) == 6 and first != m.fingerprint("y", 50, 0.15) != m.fingerprint("x", 60, 0.15)
    docs = spark.createDataFrame([("", "body"), ("T", " body ")], "t string, b string")
    inputs = [r.i for r in docs.select(m.document_input("x", F.col("t"), F.col("b")).alias("i")).collect()]
    assert inputs == ["title: none | text: body", "title: T | text: body"]
    embedder = m.HashingEmbedder(8)
    long = "alpha beta " * 1000
    pooled = m.embed_long(embedder, ["short", long])
    assert len(pooled) == 2 and len(pooled[1]) == 8
    with pytest.raises(ValueError):
        m.embed_long(embedder, [" "])
    rows = m.embed_rows(spark.createDataFrame([(1, "alpha"), (2, "beta")], "k int, t string"), "t", embedder)
    assert {r.k: len(r.embedding) for r in rows.collect()} == {1: 8, 2: 8}
    e = m.Expansion
    assert m.primary_question([e("hyde", "h"), e("vec", "v"), e("lex", "l")]) == "l"
    assert m.primary_question([e("hyde", "h"), e("vec", "v")]) == "v"
    for bad in (e("lex", 'a "b'), e("vec", "a\nb"), e("hyde", "x -y", 3)):
        with pytest.raises(ValueError):
            m.check_expansions([bad])


def test_strong_signal(spark):
    from trawler.plans.query import strong_signal

    frame = lambda *s: spark.createDataFrame(list(enumerate(s, 1)), "bm25_rank int, score double")
    assert strong_signal(frame(0.9, 0.5)) and strong_signal(frame(0.86))
    assert not strong_signal(frame(0.9, 0.8)) and not strong_signal(frame(0.5)) and not strong_signal(frame())


def test_context(spark):
    docs = spark.createDataFrame([("c", "api/x.md"), ("c", "apis.md"), ("c", "z.md"), ("d", "api/x.md")], "collection string, rel_path string")
    contexts = spark.createDataFrame([("c", "/", "root"), ("c", "/api", "api"), ("c", "api/", "deep"), ("c", "z", "")], "collection string, prefix string, text string")
    got = {(r.collection, r.rel_path): r.context for r in fusion.with_context(docs, contexts, "all").collect()}
    assert got == {("c", "api/x.md"): "deep", ("c", "apis.md"): "api", ("c", "z.md"): "all", ("d", "api/x.md"): "all"}


def test_list_index_skips_empty_lists(spark):
    hits = lambda ids: spark.createDataFrame([(i, 0.5, n) for n, i in enumerate(ids, 1)], "id string, score double, bm25_rank int")
    item = lambda q, ids, keep=False: fusion.RankedList("fts", "lex", q, 1.0, hits(ids), keep)
    fused = fusion.fuse_lists([item("a", []), item("b", ["x", "y"]), item("c", ["y"])], first_weight=2.0)
    rows = {r.id: r for r in fused.collect()}
    assert [c.list_index for c in rows["y"].contributions] == [0, 1]
    assert [c.weight for c in rows["y"].contributions] == [2.0, 1.0]
    assert rows["y"].base_score == 2.0 / 62 + 1.0 / 61 and rows["x"].top_rank == 1
    kept = fusion.fuse_lists([item("a", [], True), item("b", ["x"], True)])
    assert kept.first().contributions[0].list_index == 1


def test_file_changes(spark):
    scanned = spark.createDataFrame([("c", "a", "1"), ("c", "b", "2"), ("c", "n", "9"), ("c", "r", "5")], "collection string, rel_path string, hash string")
    stored = spark.createDataFrame(
        [("c", "a", "1", True), ("c", "b", "1", True), ("c", "gone", "3", True), ("c", "old", "3", False), ("c", "r", "5", False)],
        "collection string, rel_path string, hash string, active boolean",
    )
    status = {r.rel_path: r.status for r in catalog.file_changes(scanned, stored).collect()}
    assert status == {"a": "unchanged", "b": "changed", "n": "new", "gone": "removed", "r": "restored"}
    assert {r.status for r in catalog.file_changes(scanned, stored, rebuild=True).collect()} == {"changed", "new", "removed"}


def test_number_rows_with_a_hot_key(spark):
    rows = spark.range(6000).select(
        F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("key"), F.col("id").alias("at"),
        F.floor(F.col("id") / 100).alias("bucket"),
    )
    for bucket in ("bucket", None):
        got = sessions.number_rows(rows, "key", bucket, ["at"])
        hot = [r.ordinal for r in got.filter("key = 0").orderBy("at").collect()]
        assert hot == list(range(1, len(hot) + 1)) and got.count() == 6000


def test_ranges_split_a_hot_key(spark):
    rows = spark.range(8000).select(F.lit("hot").alias("key"), F.col("id").alias("at"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = sessions.in_ranges(rows, "key", ["at"]).groupBy(sessions.RANGE).agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count("*").alias("n"))
        parts = parts.orderBy(sessions.RANGE).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(parts) > 2 and max(p.n for p in parts) < 4000
    assert all(a.hi < b.lo for a, b in zip(parts, parts[1:]))


def test_sessions(spark):
    schema = "id string, agent_id string, title string, status string, backend_thread_id string, last_run_id string, updated_at string"
    old = spark.createDataFrame([("s1", "codex", "T", "idle", "thr", "r0", "1")], schema)
    new = spark.createDataFrame([("s1", "x", "other", "", "", "", "9"), ("s2", "", " ", "", "", "", "2")], schema)
    both = sessions.add_sessions(old, new)
    rows = {r.id: r for r in both.collect()}
    assert rows["s1"].title == "T" and rows["s2"].title == "新对话"
    assert (rows["s2"].agent_id, rows["s2"].status) == ("codex", "idle")
    change = spark.createDataFrame([("s1", "", "r1", "running", "5")], "id string, backend_thread_id string, last_run_id string, status string, updated_at string")
    done = {r.id: r for r in sessions.update_sessions(both, change).collect()}["s1"]
    assert (done.backend_thread_id, done.last_run_id, done.status, done.updated_at) == ("thr", "r1", "running", "5")
    assert [r.id for r in sessions.list_sessions(both, limit=1).collect()] == ["s2"]
    many = spark.range(300).select(F.col("id").cast("string").alias("id"), F.lit("a").alias("agent_id"), F.col("id").alias("updated_at"))
    assert sessions.list_sessions(many, limit=250).count() == 250 and sessions.list_sessions(many, limit=0).count() == 50
    assert one(spark, "x" * 90, sessions.session_title) == "x" * 80 and one(spark, "  ", sessions.session_title) == "新对话"
    assert one(spark, '[{"text":"a"},{"text":""},{"text":"b"}]', sessions.content_text) == "a\nb"
    assert one(spark, '"plain"', sessions.content_text) == "plain" and one(spark, "{}", sessions.content_text) == ""
    assert one(spark, "{bad", sessions.json_map) is None and one(spark, '{"a": 1}', sessions.json_map) == {"a": "1"}
    runs = spark.createDataFrame([("r1", "s", "running", 1), ("r2", "s", "running", 2), ("r3", "s", "done", 3)], "id string, session_id string, status string, updated_at int")
    assert sessions.running_run(runs, "s").first().id == "r2"


def test_sinks(spark):
    rows = spark.createDataFrame([(1, "a|b")], "k int, t string")
    assert pipe_table(rows).first().value == "|1|a\\|b|" and json.loads(json_lines(rows).first().value) == {"k": 1, "t": "a|b"}
