"""Write the search tables of a set of documents.

Input rows have ``rowid, collection, rel_path, body`` and may carry further
document columns. Tables, each a Parquet folder:

``texts``      rowid, body
``documents``  narrow metadata with title, hash, snippet and doc_len
``postings``   token occurrences of file path, title and body
``chunks``     passages with offsets and snippet
``entries``    token occurrences for the any-term document search
``chunk_postings``  token occurrences of chunk heading and content
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawler.config import CHUNK_WEIGHTS, ENTRY_WEIGHTS, FIELD_WEIGHTS, Settings
from trawler.functions.text import content_hash, display_snippet, document_id, title, tokens
from trawler.operators.chunking import chunk_documents, indexed_chunks
from trawler.operators.lexical import shard_of
from trawler.operators.postings import (
    POSTING_COLUMNS,
    build_postings,
    corpus_stats,
    explode_postings,
    stem_terms,
    write_postings,
)
from trawler.session import spread

INPUT_COLUMNS = ["rowid", "collection", "rel_path", "body"]
# Chunk rows are numbered inside their document; write_chunks fails on a longer one.
CHUNKS_PER_ROWID = 1 << 20


def document_rows(files: DataFrame, settings: Settings) -> DataFrame:
    """Input rows with every derived document column."""
    return (
        files.withColumn("id", document_id(F.col("collection"), F.col("rel_path")))
        .withColumn("title", title(F.col("body"), F.col("rel_path")))
        .withColumn("hash", content_hash(F.col("body")))
        .withColumn("snippet", display_snippet(F.col("body")))
        .withColumn("shard", shard_of("rowid", settings.docs_per_shard))
    )


def write_texts(files: DataFrame, path: str, settings: Settings) -> None:
    """Keep the input rows; what follows reads them instead of the source."""
    rows = files.withColumn("shard", shard_of("rowid", settings.docs_per_shard))
    rows.write.partitionBy("shard").mode("overwrite").parquet(path)


def _length():
    return sum((F.size(f"{name}_tokens") for name in FIELD_WEIGHTS), F.lit(0))


def write_search_tables(files: DataFrame, paths: dict[str, str], settings: Settings) -> None:
    """Write ``tokens``, ``documents`` and ``postings``."""
    write_documents(files, paths, settings)
    write_document_postings(files.sparkSession, paths, settings)


def write_documents(files: DataFrame, paths: dict[str, str], settings: Settings) -> None:
    """Write ``tokens`` and ``documents``.

    Text is tokenized once, into a staging table that the metadata, both
    postings tables and their range sampling read.
    """
    rows = document_rows(spread(files, "rowid"), settings)
    extra = [c for c in files.columns if c not in INPUT_COLUMNS]
    meta = ["rowid", "id", "collection", "rel_path", "title", "hash", "snippet", "shard", *extra]
    fields = {
        "filepath": F.concat_ws("/", "collection", "rel_path"),
        "title": F.col("title"),
        "body": F.col("body"),
    }
    arrays = [tokens(col).alias(f"{name}_tokens") for name, col in fields.items()]
    rows.select(*meta, *arrays).write.mode("overwrite").parquet(paths["tokens"])

    staged = files.sparkSession.read.parquet(paths["tokens"]).withColumn("doc_len", _length())
    # Lengths live in narrow tables, so corpus numbers never need a posting scan.
    entry_len = F.size("body_tokens") + sum(
        (F.size(tokens(F.col(c))) for c in ("id", "collection", "rel_path")), F.lit(0)
    )
    narrow = staged.select(*meta, "doc_len", entry_len.alias("entry_len"))
    narrow.repartitionByRange("rowid").write.partitionBy("shard").mode("overwrite").parquet(paths["documents"])


def write_document_postings(spark, paths: dict[str, str], settings: Settings) -> None:
    """Postings of path, title and body from staging; terms are stemmed here."""
    staged = spark.read.parquet(paths["tokens"]).withColumn("doc_len", _length())
    token_rows = staged.select("rowid", "doc_len", *[F.col(f"{n}_tokens").alias(n) for n in FIELD_WEIGHTS])
    postings = explode_postings(token_rows, list(FIELD_WEIGHTS), ["rowid"])
    _, count = corpus_stats(spark.read.parquet(paths["documents"]))
    write_postings(stem_terms(postings, settings.stemmer).select(*POSTING_COLUMNS), paths["postings"], count)


def write_entry_postings(spark, paths: dict[str, str], settings: Settings) -> None:
    """Postings of the any-term search; body tokens come from staging."""
    staged = spark.read.parquet(paths["tokens"])
    arrays = {
        "id": tokens(F.col("id")),
        "content": F.col("body_tokens"),
        "tags": tokens(F.col("collection")),
        "article_path": tokens(F.col("rel_path")),
    }
    rows = staged.select("rowid", *[col.alias(name) for name, col in arrays.items()])
    rows = rows.withColumn("doc_len", sum((F.size(name) for name in arrays), F.lit(0)))
    postings = stem_terms(explode_postings(rows, list(ENTRY_WEIGHTS), ["rowid"]), settings.stemmer)
    _, count = corpus_stats(rows)
    write_postings(postings.select(*POSTING_COLUMNS), paths["entries"], count)


def write_chunks(files: DataFrame, path: str, settings: Settings) -> None:
    rows = (
        spread(files, "rowid").withColumn("doc_id", document_id(F.col("collection"), F.col("rel_path")))
        .withColumn("shard", shard_of("rowid", settings.docs_per_shard))
    )
    cut = chunk_documents(
        rows, ["rowid", "doc_id", "shard"], "body", settings.chunk_tokens, settings.chunk_overlap
    )
    too_many = F.raise_error(F.lit(f"a document has {CHUNKS_PER_ROWID} chunks or more; use larger ones"))
    checked = F.when(F.col("chunk_index") < CHUNKS_PER_ROWID, F.col("chunk_index")).otherwise(too_many.cast("int"))
    length = F.size(tokens(F.col("heading"))) + F.size(tokens(F.col("content")))
    stored = (
        indexed_chunks(cut, "doc_id")
        .withColumn("chunk_rowid", F.col("rowid") * CHUNKS_PER_ROWID + checked)
        .withColumn("chunk_len", length)
    )
    stored.write.partitionBy("shard").mode("overwrite").parquet(path)


def write_chunk_postings(chunks: DataFrame, path: str, settings: Settings) -> None:
    rows = chunks.select(F.col("chunk_rowid").alias("rowid"), "heading", "content")
    fields = {"heading": F.col("heading"), "content": F.col("content")}
    _, count = corpus_stats(chunks.select(F.col("chunk_len").alias("doc_len")))
    write_postings(build_postings(rows, fields, settings.stemmer), path, count)
