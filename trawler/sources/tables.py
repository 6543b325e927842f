"""The corpus view of the benchmark tables, and its index.

``documents`` become files ``<source>/<doc_id>.md`` of one collection per
language. The index is written once per application to the shared folder,
and every query reads its tables from there.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawler.config import CHUNK_WEIGHTS, ENTRY_WEIGHTS, Settings
from trawler.functions.text import document_id
from trawler.operators.lexical import TermIndex, shard_of
from trawler.operators.postings import corpus_stats
from trawler.operators.vector import pool_parts, vector_counts
from trawler.plans.query import Corpus
from trawler.session import shared_folder, ship_package
from trawler.sources.index import (
    write_chunk_postings,
    write_chunks,
    write_document_postings,
    write_documents,
    write_entry_postings,
)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


_schemas: dict[str, T.StructType] = {}


def read(spark: SparkSession, path: str) -> DataFrame:
    """Read Parquet; the schema of a path is taken from its files only once."""
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as files: rowid, collection, rel_path, body, active."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("rowid"),
        F.col("lang").alias("collection"),
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("rel_path"),
        F.col("text").alias("body"),
        F.lit(True).alias("active"),
    )


def corpus_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as chunk vectors: two per document, in id order, and again
    from the first document on where there are more.

    ``doc_id`` is the id of the document the pair belongs to; the lookup reads
    three narrow columns of ``documents``.
    """
    documents = table(spark, sf_dir, "documents")
    docs = documents.select(
        F.col("doc_id").alias("doc_rowid"),
        document_id(
            F.col("lang"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
        ).alias("doc_id"),
    )
    vectors = table(spark, sf_dir, "embeddings").select(
        F.format_string("v%08d", "vec_id").alias("chunk_id"),
        (F.floor(F.col("vec_id") / 2) % max(1, documents.count())).alias("doc_rowid"),
        "vec_id",
        "label",
        "embedding",
    )
    shard = shard_of("doc_rowid", Settings().docs_per_shard)
    return vectors.join(docs, "doc_rowid").withColumn("shard", shard)


@dataclass
class TableIndex:
    """Index tables of one table folder; parts are built when first used.

    Only postings depend on the stemmer. An index with a ``plain`` one beside it takes all
    other tables from there, so that these are written once.
    """

    spark: SparkSession
    sf_dir: str
    settings: Settings
    root: str
    plain: TableIndex | None = None
    _built: dict = field(default_factory=dict)

    def _path(self, part: str) -> str:
        return f"{self.root}/{part}"

    @property
    def _shared(self) -> TableIndex:
        return self.plain or self

    def _once(self, part: str, build):
        if part not in self._built:
            self._built[part] = build()
        return self._built[part]

    def _documents(self):
        def build():
            paths = {p: self._path(p) for p in ("tokens", "documents")}
            write_documents(corpus_files(self.spark, self.sf_dir), paths, self.settings)
            return corpus_stats(read(self.spark, paths["documents"]))

        return self._once("documents", build) if self.plain is None else self.plain._documents()

    @property
    def documents(self) -> DataFrame:
        self._documents()
        return read(self.spark, self._shared._path("documents"))

    @property
    def terms(self) -> TermIndex:
        rows, total = self._documents()

        def build():
            paths = {p: self._shared._path(p) for p in ("tokens", "documents")} | {"postings": self._path("postings")}
            write_document_postings(self.spark, paths, self.settings)
            return True

        self._once("postings", build)
        return TermIndex(read(self.spark, self._path("postings")), rows, total, self.settings.stemmer)

    @property
    def entries(self) -> TermIndex:
        self._documents()

        def build():
            paths = {"tokens": self._shared._path("tokens"), "entries": self._path("entries")}
            write_entry_postings(self.spark, paths, self.settings)
            # One posting per token, so the row count is the token count.
            return self.documents.count(), self._count("entries")

        rows, total = self._once("entries", build)
        return TermIndex(
            read(self.spark, self._path("entries")), rows, total, self.settings.stemmer, ENTRY_WEIGHTS
        )

    def _count(self, part: str) -> int:
        return read(self.spark, self._path(part)).count()

    @property
    def chunks(self) -> DataFrame:
        if self.plain is not None:
            return self.plain.chunks

        def build():
            write_chunks(corpus_files(self.spark, self.sf_dir), self._path("chunks"), self.settings)
            return True

        self._once("chunks", build)
        return read(self.spark, self._path("chunks"))

    @property
    def chunk_terms(self) -> TermIndex:
        def build():
            write_chunk_postings(self.chunks, self._path("chunk_postings"), self.settings)
            return self.chunks.count(), self._count("chunk_postings")

        rows, total = self._once("chunk_postings", build)
        return TermIndex(
            read(self.spark, self._path("chunk_postings")),
            rows,
            total,
            self.settings.stemmer,
            CHUNK_WEIGHTS,
        )

    @property
    def vectors(self) -> DataFrame:
        """Chunk vectors with their document ids, so that a search scans one
        table and joins only its top rows."""
        if self.plain is not None:
            return self.plain.vectors

        def build():
            corpus_vectors(self.spark, self.sf_dir).write.mode("overwrite").parquet(self._path("vectors"))
            return True

        self._once("vectors", build)
        return read(self.spark, self._path("vectors"))

    @property
    def document_vectors(self) -> DataFrame:
        """The summed vectors of every document, written once."""
        if self.plain is not None:
            return self.plain.document_vectors

        def build():
            pool_parts(self.vectors, "doc_id").write.mode("overwrite").parquet(self._path("document_vectors"))
            return True

        self._once("document_vectors", build)
        return read(self.spark, self._path("document_vectors"))

    def corpus(self, **models) -> Corpus:
        vectors = self.vectors
        counts = self._shared._once("vector_counts", lambda: vector_counts(vectors, self.documents))
        return Corpus(
            documents=self.documents,
            chunks=self.chunks,
            terms=self.terms,
            vectors=vectors,
            vector_counts=counts,
            docs_per_shard=self.settings.docs_per_shard,
            **models,
        )


_indexes: dict[tuple, TableIndex] = {}


def table_index(spark: SparkSession, sf_dir: str, stemmer: str = "none") -> TableIndex:
    """The index of a table folder, shared by all queries of an application."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), stemmer)
    if key not in _indexes:
        ship_package(spark)
        root = f"{shared_folder(spark)}/index-{uuid.uuid4().hex[:12]}"
        plain = table_index(spark, sf_dir) if stemmer != "none" else None
        _indexes[key] = TableIndex(spark, sf_dir.rstrip("/"), Settings(stemmer=stemmer), root, plain)
    return _indexes[key]
