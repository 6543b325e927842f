import numpy as np
import pytest
from pyspark.sql import functions as F

from trawler.operators import vector as v
from trawler.functions.vectors import cosine, l2_normalize


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    rows = [(f"c{i:04}", f"d{i // 3:03}", [float(x) for x in rng.normal(size=8)]) for i in range(600)]
    rows += [("c9998", "d900", [0.0] * 8), ("c9999", "d901", [1.0, 2.0])]
    return spark.createDataFrame(rows, "chunk_id string, doc_id string, embedding array<float>").repartition(5)


def brute(table, query, metric):
    out = []
    for r in table.collect():
        e = np.array(r.embedding, dtype=np.float64)
        if len(e) != len(query):
            continue
        scale = np.linalg.norm(e) * np.linalg.norm(query)
        cos = float(e @ query / scale) if scale else 0.0
        out.append((np.linalg.norm(e - query) if metric == "l2" else -cos, r.chunk_id, cos))
    return sorted(out)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_nearest_equals_brute_force(table, metric):
    rng = np.random.default_rng(9)
    queries = [rng.normal(size=8) for _ in range(3)]
    got = v.nearest_chunks(table, [list(q) for q in queries], 25, metric).collect()
    for i, q in enumerate(queries):
        want = [c for _, c, _ in brute(table, q, metric)[:25]]
        mine = sorted((r.distance, r.chunk_id) for r in got if r.variant == i)
        assert [c for _, c in mine] == want
    single = v.nearest_chunks(table, [list(queries[0])], 25, metric)
    assert [r.chunk_id for r in single.orderBy("distance", "chunk_id").collect()] == [
        c for _, c, _ in brute(table, queries[0], metric)[:25]
    ]


def test_ties_do_not_depend_on_batches(spark):
    rows = spark.range(5000).select(
        F.format_string("c%05d", "id").alias("chunk_id"), F.lit("d").alias("doc_id"),
        F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("embedding"),
    )
    got = v.nearest_chunks(rows.repartition(7), [[1.0, 0.0]], 4, "cosine").collect()
    assert sorted(r.chunk_id for r in got) == ["c00000", "c00001", "c00002", "c00003"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(f"d{i:03}", "docs" if i % 2 else "other", f"{i}.md", "t", i != 5) for i in range(8)]
    return spark.createDataFrame(rows, "id string, collection string, rel_path string, title string, active boolean")


def vectors(spark, items):
    return spark.createDataFrame(items, "chunk_id string, doc_id string, embedding array<float>")


def test_variants_keep_the_best_score(spark, docs):
    table = vectors(spark, [("a", "d001", [1.0, 0.0]), ("b", "d003", [0.0, 1.0]), ("c", "d007", [0.6, 0.8]),
                            ("d", "d005", [1.0, 0.0]), ("e", "d001", [0.5, 0.5])])
    hits = v.vector_search(table, docs, [[1.0, 0.0], [0.6, 0.8]], "docs", 3).orderBy("vector_rank").collect()
    assert [(h.id, h.chunk_id) for h in hits] == [("d001", "a"), ("d007", "c"), ("d003", "b")]
    assert hits[0].score == pytest.approx(1.0) and hits[2].score == pytest.approx(0.8)


def test_collection_filter_comes_before_the_document_cut(spark, docs):
    table = vectors(spark, [("a", "d001", [0.8, 0.6]), ("b", "d002", [1.0, 0.0])])
    hits = v.vector_search(table, docs, [[1.0, 0.0]], "docs", 1).collect()
    assert [h.id for h in hits] == ["d001"]


def test_score_floor(spark, docs):
    table = vectors(spark, [("a", "d001", [-1.0, 0.0])])
    assert v.vector_search(table, docs, [[1.0, 0.0]], "", 5, 0.3).isEmpty()
    assert v.vector_search(table, docs, [[1.0, 0.0]], "", 5, -2.0).count() == 1


def test_functions(spark):
    row = spark.sql("select array(3f, 4f) a, array(0f, 0f) z, array(1f) s").select(
        l2_normalize(F.col("a")).alias("u"), l2_normalize(F.col("z")).alias("zu"),
        cosine(F.col("a"), F.col("z")).alias("c0"), cosine(F.col("a"), F.col("s")).alias("c1"),
        cosine(F.col("a"), F.col("a")).alias("c2"),
    ).first()
    assert row.u == [0.6, 0.8] and row.zu == [0.0, 0.0] and (row.c0, row.c1, row.c2) == (0.0, 0.0, 1.0)


def test_mean_pool_with_a_hot_key(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 != 0, "hot").otherwise(F.col("id").cast("string")).alias("key"),
        F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"),
    )
    pooled = {r.key: r.embedding for r in v.mean_pool(rows, "key").collect()}
    hot = [i for i in range(3000) if i % 3]
    assert pooled["hot"] == [sum(hot) / len(hot), 1.0] and pooled["3"] == [3.0, 1.0]
