"""Exact nearest-neighbour search over a table of chunk vectors.

Vector tables have ``chunk_id, doc_id, embedding`` and may have
``embed_fingerprint`` and ``shard``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawler.config import NO_MIN_SCORE, VECTOR_OVERFETCH
from trawler.operators.lookup import bounded, fetch, top_per_group
from trawler.session import settle

Vector = Sequence[float]


def _score_batches(queries: np.ndarray, k: int, metric: str):
    """Arrow batches in, the batch's k nearest rows per query out.

    Rows tied with the k-th are kept, so the cut never depends on batching.
    """
    lengths = np.sqrt((queries * queries).sum(axis=1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.schema.get_field_index("embedding")
            rows = batch.column(at).flatten().to_numpy(zero_copy_only=False)
            rows = rows.reshape(batch.num_rows, -1).astype(np.float64)
            others = [i for i in range(batch.num_columns) if i != at]
            row_lengths = np.sqrt((rows * rows).sum(axis=1))
            for variant, query in enumerate(queries):
                scale = row_lengths * lengths[variant]
                cos = np.divide(
                    (rows * query).sum(axis=1), scale, out=np.zeros(len(rows)), where=scale > 0
                )
                far = np.sqrt(((rows - query) ** 2).sum(axis=1)) if metric == "l2" else -cos
                keep = np.arange(len(rows))
                if len(rows) > k:
                    keep = np.flatnonzero(far <= np.partition(far, k - 1)[k - 1])
                taken = batch.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays(
                    [taken.column(i) for i in others]
                    + [
                        pa.array(np.full(len(keep), variant, dtype=np.int32)),
                        pa.array(far[keep]),
                        pa.array(cos[keep]),
                    ],
                    [batch.schema.names[i] for i in others] + ["variant", "distance", "score"],
                )

    return score


def nearest_chunks(
    vectors: DataFrame,
    queries: Sequence[Vector],
    limit: int,
    metric: str = "l2",
    fingerprint: str = "",
) -> DataFrame:
    """The ``limit`` nearest chunks of every query vector, in one scan.

    ``metric='l2'`` picks by distance and then reports cosine; ``'cosine'``
    picks by cosine. The two agree on vectors of equal length.
    """
    limit = limit if limit > 0 else 20
    scored = scored_chunks(vectors, queries, limit, metric, fingerprint)
    order = [F.col("distance"), F.col("chunk_id")]
    if len(queries) == 1:
        return scored.orderBy(*order).limit(limit)
    return top_per_group(scored, "variant", order, limit)


def scored_chunks(
    vectors: DataFrame, queries: Sequence[Vector], per_batch: int, metric: str = "l2", fingerprint: str = ""
) -> DataFrame:
    """Chunks with distance and score per query vector: the ``per_batch`` nearest of every Arrow batch."""
    width = len(queries[0])
    if any(len(q) != width for q in queries):
        raise ValueError("query vectors differ in width")
    if fingerprint:
        vectors = vectors.filter(F.col("embed_fingerprint") == fingerprint)
    keep = [c for c in ("chunk_id", "doc_id", "shard") if c in vectors.columns]
    rows = vectors.filter(F.size("embedding") == width).select(*keep, "embedding")
    schema = T.StructType(
        [rows.schema[c] for c in keep]
        + [
            T.StructField("variant", T.IntegerType()),
            T.StructField("distance", T.DoubleType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    return rows.mapInArrow(_score_batches(np.array(queries, dtype=np.float64), per_batch, metric), schema)


def nearest_in_documents(
    vectors: DataFrame, query: Vector, doc_ids: DataFrame, limit: int, metric: str = "cosine"
) -> DataFrame:
    """Nearest chunks among the documents in ``doc_ids``."""
    picked = vectors.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    return nearest_chunks(picked, [query], limit, metric)


def best_chunk_per_document(chunks: DataFrame, by: list[str]) -> DataFrame:
    """Highest score of each group; equal scores go to the smaller chunk id."""
    best = F.struct((-F.col("score")).alias("s"), F.col("chunk_id").alias("c"))
    return chunks.groupBy(*by).agg(F.min(best).alias("best")).select(
        *by, F.col("best.c").alias("chunk_id"), (-F.col("best.s")).alias("score")
    )


def variant_search(
    vectors: DataFrame,
    documents: DataFrame,
    queries: Sequence[Vector],
    collection: str = "",
    limit: int = 10,
    metric: str = "l2",
    fingerprint: str = "",
    near: DataFrame | None = None,
) -> DataFrame:
    """Documents by their best chunk over all query variants.

    Per variant: nearest chunks of the whole index, then the collection and
    active filters, the best chunk per document, and the ``limit`` best
    documents. Over variants a document keeps its highest score, and of equal
    ones that of the earlier variant.
    """
    limit = limit if limit > 0 else 10
    over = limit * VECTOR_OVERFETCH
    if near is None:
        near = nearest_chunks(vectors, queries, over, metric, fingerprint)
    live = documents.filter(F.col("active"))
    if collection:
        live = live.filter(F.col("collection") == collection)
    columns = ["id", "collection", "rel_path", "title"]
    columns += [c for c in ("shard", "rowid") if c in documents.columns]
    found = fetch(
        live.select(*columns), near.withColumnRenamed("doc_id", "id"), "id", over * len(queries)
    )
    by = ["variant", "id"]
    extra = [c for c in columns if c != "id"]
    best = F.struct((-F.col("score")).alias("s"), "chunk_id", *extra)
    per_doc = found.groupBy(*by).agg(F.min(best).alias("best")).select(*by, "best.*")
    order = [F.col("s"), F.col("id"), F.col("chunk_id")]
    per_doc = top_per_group(per_doc, "variant", order, limit)
    merged = per_doc.groupBy("id").agg(
        F.min(F.struct("s", "variant", "chunk_id", *extra)).alias("best")
    )
    rows = merged.select("id", "best.*").withColumn("score", -F.col("s")).drop("s")
    # At most limit rows per variant remain.
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "id"))
    return rows.withColumn("vector_rank", rank)


def vector_results(hits: DataFrame, min_score: float, limit: int) -> DataFrame:
    """Cut by score and limit, and renumber."""
    kept = hits.filter(F.col("score") >= min_score).orderBy("vector_rank").limit(limit)
    return kept.withColumn("vector_rank", F.row_number().over(Window.orderBy("vector_rank")))


def with_snippets(hits: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """Add the snippet of each hit's chunk, empty if the chunk is gone."""
    hits = settle(hits)
    keys = [c for c in ("chunk_id", "shard") if c in hits.columns and c in chunks.columns]
    texts = chunks.select(*keys, "snippet").join(bounded(hits.select(*keys), limit), keys, "left_semi")
    return hits.join(bounded(texts, limit), keys, "left").withColumn(
        "snippet", F.coalesce("snippet", F.lit(""))
    )


def vector_search(
    vectors: DataFrame,
    documents: DataFrame,
    queries: Sequence[Vector],
    collection: str = "",
    limit: int = 20,
    min_score: float = NO_MIN_SCORE,
    metric: str = "l2",
    fingerprint: str = "",
    near: DataFrame | None = None,
) -> DataFrame:
    """Best documents for one or more query vectors."""
    hits = variant_search(vectors, documents, queries, collection, limit, metric, fingerprint, near)
    return vector_results(hits, min_score, limit)


def vector_matches(
    vectors: DataFrame,
    documents: DataFrame,
    queries: Sequence[Vector],
    collections: Sequence[str] = (),
    min_score: float = NO_MIN_SCORE,
    metric: str = "l2",
    fingerprint: str = "",
) -> DataFrame:
    """Every active document of the collections by its best chunk over all queries, unranked.

    Scores are those of ``vector_search``; no chunk is left out before its document is known.
    """
    live = documents.filter(F.col("active"))
    if collections:
        live = live.filter(F.col("collection").isin(list(collections)))
    columns = ["id", "collection", "rel_path", "title"]
    columns += [c for c in ("shard", "rowid") if c in documents.columns]
    picked = vectors.join(live.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    scored = scored_chunks(picked, queries, sys.maxsize, metric, fingerprint).withColumnRenamed("doc_id", "id")
    best = best_chunk_per_document(scored, ["id", "variant"])
    first = F.min(F.struct((-F.col("score")).alias("s"), "variant", "chunk_id")).alias("best")
    best = best.groupBy("id").agg(first).select("id", "best.variant", "best.chunk_id", (-F.col("best.s")).alias("score"))
    return best.filter(F.col("score") >= min_score).join(live.select(*columns), "id")


def _sums_of(key: str):
    """Per Arrow batch and key: how many vectors, and their element-wise sum."""

    def run(batches):
        for batch in batches:
            keys, vectors = batch.column(0), batch.column(1)
            codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
            sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            width = int(sizes.max(initial=0))
            groups = int(codes.max(initial=-1)) + 1
            row = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            cell = codes[row] * width + place
            sums = np.bincount(cell, values, groups * width).reshape(groups, width) if width else np.zeros((groups, 0))
            first = np.zeros(groups, dtype=np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            counts = pa.array(np.bincount(codes, minlength=groups))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(groups + 1) * width, pa.int32()), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(first)), counts, lists], names=[key, "n", "total"])

    return run


def pool_parts(segments: DataFrame, key: str) -> DataFrame:
    """(key, n, total): vectors counted and summed; each key once.

    Batches are summed where they are read, so a key that holds most segments sends one
    row per batch. Parts of different tables can be merged again.
    """
    kind = dict(segments.dtypes)[key]
    parts = segments.filter(F.col("embedding").isNotNull()).select(key, "embedding")
    return merge_parts(parts.mapInArrow(_sums_of(key), f"{key} {kind}, n long, total array<double>"), key)


def merge_parts(parts: DataFrame, key: str) -> DataFrame:
    """Element-wise sums of (key, n, total) parts per key, two by two as they meet."""

    def add(x: Column, y: Column) -> Column:
        return F.zip_with(x, y, lambda a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))

    # A key has one part per batch at most, sums of what were thousands of rows.
    gathered = parts.groupBy(key).agg(F.sum("n").alias("n"), F.collect_list("total").alias("all"))
    start = F.array().cast("array<double>")
    return gathered.select(key, "n", F.aggregate("all", start, add).alias("total"))


def mean_pool(segments: DataFrame, key: str) -> DataFrame:
    """Element-wise mean of the vectors of each key."""
    return pooled(pool_parts(segments, key), key)


def pooled(parts: DataFrame, key: str) -> DataFrame:
    """The means of merged parts (or of a stored document-vector table)."""
    return parts.select(key, F.transform("total", lambda x: x / F.col("n")).alias("embedding"))


def upsert_document_vectors(stored: DataFrame, vectors: DataFrame, key: str = "doc_id") -> DataFrame:
    """The table (key, n, total) with the documents of ``vectors`` replaced or added."""
    fresh = pool_parts(vectors, key)
    return stored.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def delete_document_vectors(stored: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    return stored.join(gone.select(key).distinct(), key, "left_anti")


def has_vectors(vectors: DataFrame, documents: DataFrame, collection: str = "", fingerprint: str = "") -> bool:
    """Whether any active document of the collection has a current vector."""
    if fingerprint:
        vectors = vectors.filter(F.col("embed_fingerprint") == fingerprint)
    live = documents.filter(F.col("active"))
    if collection:
        live = live.filter(F.col("collection") == collection)
    if vectors.isEmpty():
        return False
    joined = vectors.select(F.col("doc_id").alias("id")).join(live.select("id"), "id", "left_semi")
    return not joined.isEmpty()


def vector_counts(vectors: DataFrame, documents: DataFrame, fingerprint: str = "") -> dict[str, int]:
    """Current vectors of active documents, per collection."""
    if fingerprint:
        vectors = vectors.filter(F.col("embed_fingerprint") == fingerprint)
    per_doc = vectors.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n"))
    live = documents.filter(F.col("active")).select("id", "collection")
    rows = per_doc.join(live, "id").groupBy("collection").agg(F.sum("n").alias("n")).collect()
    return {r.collection: r.n for r in rows}
