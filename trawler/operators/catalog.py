"""Statistics, snapshot differences and embedding state of collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def collection_stats(collections: DataFrame, documents: DataFrame) -> DataFrame:
    """Per collection: documents, active documents, last change.

    Documents are counted before the join, so a collection that holds a third
    of them sends one row per task over the network.
    """
    counts = documents.groupBy(F.col("collection").alias("name")).agg(
        F.count("id").alias("doc_count"),
        F.count_if("active").alias("active_count"),
        F.max("updated_at").alias("last_modified"),
    )
    zero = F.lit(0).cast("long")
    return collections.join(counts, "name", "left").select(
        *collections.columns,
        F.coalesce("doc_count", zero).alias("doc_count"),
        F.coalesce("active_count", zero).alias("active_count"),
        "last_modified",
    )


def embedding_state(documents: DataFrame, chunks: DataFrame, vectors: DataFrame, fingerprint: str = "") -> DataFrame:
    """Active documents with their chunk count and current vector count."""
    if fingerprint:
        vectors = vectors.filter(F.col("embed_fingerprint") == fingerprint)
    per_doc = (
        chunks.groupBy("doc_id")
        .agg(F.count("*").alias("chunks"))
        .join(vectors.groupBy("doc_id").agg(F.count("*").alias("vectors")), "doc_id", "full_outer")
        .withColumnRenamed("doc_id", "id")
    )
    zero = F.lit(0).cast("long")
    return (
        documents.filter("active")
        .join(per_doc, "id", "left")
        .withColumn("chunks", F.coalesce("chunks", zero))
        .withColumn("vectors", F.coalesce("vectors", zero))
    )


def needs_embedding() -> Column:
    return (F.col("chunks") > 0) & (F.col("vectors") < F.col("chunks"))


def index_status(documents: DataFrame, chunks: DataFrame, vectors: DataFrame, fingerprint: str = "") -> DataFrame:
    """One row: active documents, all vectors, documents to embed."""
    state = embedding_state(documents, chunks, vectors, fingerprint)
    total = vectors.agg(F.count("*").alias("n")).scalar()
    return state.agg(
        F.count("*").alias("total_documents"), F.count_if(needs_embedding()).alias("needs_embedding")
    ).select("total_documents", total.alias("vector_count"), "needs_embedding")


def file_changes(scanned: DataFrame, stored: DataFrame, rebuild: bool = False) -> DataFrame:
    """Compare scanned files with stored documents on (collection, rel_path).

    ``status``: ``new``, ``changed``, ``restored`` (inactive but back with the
    same content), ``unchanged``, ``removed``; inactive documents that are
    still missing are left out.
    """
    keys = ["collection", "rel_path"]
    old = stored.select(*keys, F.col("hash").alias("old_hash"), "active", F.lit(True).alias("_old"))
    new = scanned.select(*keys, "hash", F.lit(True).alias("_new"))
    status = (
        F.when(F.col("_new").isNull(), F.when(F.col("active"), "removed"))
        .when(F.col("_old").isNull(), "new")
        .when((F.col("hash") != F.col("old_hash")) | F.lit(rebuild), "changed")
        .when(~F.col("active"), "restored")
        .otherwise("unchanged")
    )
    both = new.join(old, keys, "full_outer").withColumn("status", status)
    return both.filter(F.col("status").isNotNull()).select(*keys, "hash", "old_hash", "status")


def newest_vectors(vectors: DataFrame, order: str) -> DataFrame:
    """Upsert semantics: the newest vector of each chunk id."""
    others = [c for c in vectors.columns if c != "chunk_id"]
    return (
        vectors.groupBy("chunk_id")
        .agg(F.max_by(F.struct(*others), order).alias("v"))
        .select("chunk_id", "v.*")
        .select(*vectors.columns)
    )
