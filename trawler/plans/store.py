"""A corpus of collections kept as append-only Parquet tables.

Layout under ``root``: ``<table>/rev=<n>`` for each table of
``trawler.sources.index`` plus ``vectors`` and ``retired``, and ``manifest``,
one JSON line per commit. A refresh appends one revision with the new and
changed documents and retires the rows they replace, so its cost follows the
change, not the corpus. Readers see the revisions the newest manifest line
lists; a revision that never committed stays invisible.
"""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawler.config import CHUNK_WEIGHTS, ENTRY_WEIGHTS, NO_MIN_SCORE, SEARCH_LIMIT, Settings, VECTOR_SEARCH_MIN_SCORE
from trawler.functions.lexquery import parse_any
from trawler.functions.models import (
    Embedder,
    Expander,
    Reranker,
    document_input,
    embed_rows,
    expand,
    fingerprint,
    query_input,
    vector_texts,
)
from trawler.functions.text import content_hash
from trawler.operators import catalog
from trawler.operators.lexical import TermIndex, all_matches, bm25_matches, ranked, search, search_many
from trawler.operators.lookup import fetch
from trawler.operators.vector import vector_counts, vector_matches, vector_search, with_snippets
from trawler.plans.query import Corpus, QueryOptions, hybrid_query, query_collections
from trawler.session import settle, ship_package
from trawler.sources.files import extracted, scan_files
from trawler.sources.index import (
    write_chunk_postings,
    write_chunks,
    write_entry_postings,
    write_search_tables,
    write_texts,
)

MANIFEST_SCHEMA = "rev long, state string"
DOCUMENT_SCHEMA = (
    "rowid long, id string, collection string, rel_path string, title string, hash string, snippet string, "
    "abs_path string, mtime timestamp, size_bytes long, embedding_model string, active boolean, "
    "created_at timestamp, updated_at timestamp, doc_len int, entry_len int, shard int"
)
POSTING_SCHEMA = "term string, rowid long, field string, pos int, doc_len int"
SCHEMAS = {
    "texts": "rowid long, body string, shard int",
    "documents": DOCUMENT_SCHEMA,
    "postings": POSTING_SCHEMA,
    "entries": POSTING_SCHEMA,
    "chunk_postings": POSTING_SCHEMA,
    "chunks": (
        "rowid long, doc_id string, chunk_index int, heading string, content string, start_offset long, "
        "end_offset long, chunk_id string, snippet string, chunk_rowid long, chunk_len int, shard int"
    ),
    "vectors": (
        "chunk_id string, doc_id string, rowid long, embedding array<float>, dimensions int, model string, "
        "embed_fingerprint string, shard int"
    ),
    "retired": "kind string, rowid long, old_rev int",
}
# Tables looked up by row, partitioned so that a lookup reads few shards.
SHARDED = ("texts", "documents", "chunks")
INDEX_TABLES = ("texts", "documents", "postings", "entries", "chunks", "chunk_postings")


@dataclass
class Collection:
    name: str
    path: str
    pattern: str = ""
    include: list[str] = field(default_factory=list)
    ignore: list[str] = field(default_factory=list)
    update: str = ""
    include_by_default: bool | None = None
    context: dict[str, str] = field(default_factory=dict)


@dataclass
class State:
    """What a manifest line says."""

    rev: int = 0
    revisions: list[int] = field(default_factory=list)
    retired: int = 0
    next_rowid: int = 1
    stats: dict[str, list[int]] = field(default_factory=dict)
    vectors: dict[str, int] = field(default_factory=dict)
    vector_fingerprint: str = ""
    collections: dict[str, dict] = field(default_factory=dict)
    global_context: str = ""


class CorpusStore:
    """Catalog, ingest and search over one root folder. One writer at a time."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        settings: Settings = Settings(),
        embedder: Embedder | None = None,
        expander: Expander | None = None,
        reranker: Reranker | None = None,
    ):
        ship_package(spark)
        self.spark = spark
        self.root = root.rstrip("/")
        self.settings = settings
        self.embedder, self.expander, self.reranker = embedder, expander, reranker
        self.state = self._load()

    # -- manifest -------------------------------------------------------------

    def _load(self) -> State:
        manifest = f"{self.root}/manifest"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(manifest)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return State()
        last = self.spark.read.schema(MANIFEST_SCHEMA).json(manifest).agg(F.max_by("state", "rev").alias("s")).first()
        return State(**json.loads(last.s)) if last.s else State()

    def _commit(self, state: State) -> None:
        state.rev += 1
        line = json.dumps(asdict(state), ensure_ascii=False)
        row = self.spark.createDataFrame([(state.rev, line)], MANIFEST_SCHEMA)
        row.coalesce(1).write.mode("append").json(f"{self.root}/manifest")
        self.state = state

    def _draft(self) -> State:
        return State(**json.loads(json.dumps(asdict(self.state))))

    @property
    def fingerprint(self) -> str:
        if self.embedder is None:
            return ""
        return fingerprint(self.embedder.name, self.settings.chunk_tokens, self.settings.chunk_overlap)

    # -- tables ---------------------------------------------------------------

    def _raw(self, name: str, revisions: list[int] | None = None) -> DataFrame:
        """Rows of the committed revisions of a table, with ``rev``."""
        wanted = self.state.revisions if revisions is None else revisions
        schema = T._parse_datatype_string(SCHEMAS[name]).add("rev", T.IntegerType())
        paths = [p for p in (f"{self.root}/{name}/rev={r}" for r in wanted) if self._exists(p)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return (
            self.spark.read.schema(schema)
            .option("basePath", f"{self.root}/{name}")
            .parquet(*paths)
        )

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _live(self, name: str) -> DataFrame:
        """Rows nothing has replaced. The replaced (rowid, revision) pairs are
        a small side; the join is skipped while there are none."""
        rows = self._raw(name)
        if not self.state.retired:
            return rows
        kind = "vec" if name == "vectors" else "doc"
        dead = self._raw("retired").filter(F.col("kind") == kind)
        if name == "chunk_postings":
            rows = rows.withColumn("_owner", F.shiftright("rowid", 20))
            on = [F.col("_owner") == F.col("_dead"), F.col("rev") == F.col("old_rev")]
        else:
            on = [F.col("rowid") == F.col("_dead"), F.col("rev") == F.col("old_rev")]
        dead = dead.select(F.col("rowid").alias("_dead"), "old_rev").distinct()
        return rows.join(dead, on[0] & on[1], "left_anti").drop("_owner")

    @property
    def documents(self) -> DataFrame:
        return self._live("documents")

    @property
    def chunks(self) -> DataFrame:
        return self._live("chunks")

    @property
    def vectors(self) -> DataFrame:
        return self._live("vectors")

    def _terms(self, table: str, weights: dict | None = None) -> TermIndex:
        rows, tokens = self.state.stats.get(table, [0, 0])
        postings = self._live(table).drop("rev")
        extra = {"weights": weights} if weights else {}
        return TermIndex(postings, rows, tokens, self.settings.stemmer, **extra)

    def corpus(self) -> Corpus:
        known = self.state.vector_fingerprint == self.fingerprint
        return Corpus(
            documents=self.documents,
            chunks=self.chunks,
            terms=self._terms("postings"),
            vectors=self.vectors,
            contexts=self.context_rows(),
            global_context=self.state.global_context,
            embedder=self.embedder,
            expander=self.expander,
            reranker=self.reranker,
            fingerprint=self.fingerprint,
            metric=self.settings.metric,
            uri_scheme=self.settings.uri_scheme,
            docs_per_shard=self.settings.docs_per_shard,
            vector_counts=dict(self.state.vectors) if known else None,
        )

    # -- catalog --------------------------------------------------------------

    def _collection(self, name: str) -> Collection:
        if name not in self.state.collections:
            raise KeyError(f"collection not found: {name}")
        return Collection(**self.state.collections[name])

    def add_collection(self, collection: Collection) -> None:
        """Register or replace scan rules; an empty context keeps the old one."""
        if not collection.name.strip() or not collection.path.strip():
            raise ValueError("a collection needs a name and a path")
        item = replace(collection)
        item.path = item.path if "://" in item.path else os.path.abspath(item.path)
        item.pattern = item.pattern.strip()
        if not item.pattern and not item.include:
            item.pattern = self.settings.default_pattern
        item.include = item.include or [item.pattern]
        if item.include_by_default is None:
            item.include_by_default = True
        state = self._draft()
        old = state.collections.get(item.name)
        if old and not item.context:
            item.context = old["context"]
        state.collections[item.name] = asdict(item)
        self._commit(state)

    def list_collections(self) -> DataFrame:
        """Collections with document counts and last change, by name."""
        schema = (
            "name string, path string, pattern string, include array<string>, ignore array<string>, "
            "update string, include_by_default boolean, context map<string,string>"
        )
        rows = self.spark.createDataFrame(list(self.state.collections.values()), schema)
        return catalog.collection_stats(rows, self.documents).orderBy("name")

    def update_settings(self, name: str, update: str | None = None, include_by_default: bool | None = None) -> bool:
        state = self._draft()
        if name not in state.collections:
            return False
        if update is not None:
            state.collections[name]["update"] = update
        if include_by_default is not None:
            state.collections[name]["include_by_default"] = include_by_default
        self._commit(state)
        return True

    def default_collections(self) -> list[str]:
        return sorted(n for n, c in self.state.collections.items() if c["include_by_default"])

    def remove_collection(self, name: str) -> bool:
        if name not in self.state.collections:
            return False
        state = self._draft()
        del state.collections[name]
        gone = self.documents.filter(F.col("collection") == name)
        self._retire(state, gone.select("rowid", "rev"), with_vectors=True)
        self._finish(state)
        return True

    def rename_collection(self, old: str, new: str) -> bool:
        """Give a collection a new name; ids, chunk ids and indexed paths follow."""
        old, new = old.strip(), new.strip()
        if not new:
            raise ValueError("new collection name is required")
        if old not in self.state.collections:
            return False
        if new in self.state.collections:
            raise ValueError(f"collection already exists: {new}")
        state = self._draft()
        state.collections[new] = {**state.collections.pop(old), "name": new}
        mine = self.documents.filter(F.col("collection") == old)
        texts = self._live("texts").select("rowid", F.col("rev").alias("_rev"), "body")
        kept = ["abs_path", "mtime", "size_bytes", "embedding_model", "active", "created_at"]
        moved = mine.filter("active").join(
            texts, (mine.rowid == texts.rowid) & (mine.rev == texts._rev)
        ).select(mine.rowid, F.lit(new).alias("collection"), "rel_path", "body", *kept, self._now().alias("updated_at"))
        rev = self._next_rev(state)
        idle = mine.filter("not active").withColumn("collection", F.lit(new))
        self._write_revision(moved, rev, idle)
        vectors = self.vectors.join(mine.select("rowid", F.col("id").alias("_old")), "rowid", "left_semi")
        names = self._raw("documents", [rev]).select("rowid", F.col("id").alias("_new"))
        suffix = F.substring_index("chunk_id", ":", -1)
        vectors = (
            vectors.join(names, "rowid")
            .withColumn("chunk_id", F.concat("_new", F.lit(":"), suffix))
            .withColumn("doc_id", F.col("_new"))
        )
        self._append("vectors", vectors, rev)
        self._retire(state, mine.select("rowid", "rev"), with_vectors=True, rev=rev)
        state.revisions.append(rev)
        self._finish(state)
        return True

    def set_global_context(self, text: str) -> None:
        state = self._draft()
        state.global_context = text if text.strip() else ""
        self._commit(state)

    def add_context(self, name: str, prefix: str, text: str) -> bool:
        state = self._draft()
        if name not in state.collections:
            return False
        state.collections[name]["context"][prefix] = text
        self._commit(state)
        return True

    def remove_context(self, name: str, prefix: str) -> bool:
        state = self._draft()
        if prefix not in state.collections.get(name, {}).get("context", {}):
            return False
        del state.collections[name]["context"][prefix]
        self._commit(state)
        return True

    def list_contexts(self) -> list[tuple[str, str, str]]:
        """(collection, path, text): the global one first, then by name and path."""
        rows = [("*", "/", self.state.global_context)] if self.state.global_context else []
        for name in sorted(self.state.collections):
            context = self.state.collections[name]["context"]
            rows += [(name, path, context[path]) for path in sorted(context)]
        return rows

    def context_rows(self) -> DataFrame:
        rows = [r for r in self.list_contexts() if r[0] != "*"]
        return self.spark.createDataFrame(rows, "collection string, prefix string, text string")

    # -- ingest ---------------------------------------------------------------

    @staticmethod
    def _now():
        return F.lit(datetime.now(timezone.utc).replace(tzinfo=None)).cast("timestamp")

    def _next_rev(self, state: State) -> int:
        """A revision number that no attempt has used, committed or not.

        What a failed attempt left behind is in no manifest line and is never read.
        """
        rev = max(state.revisions, default=0) + 1
        while any(self._exists(f"{self.root}/{t}/rev={rev}") for t in (*SCHEMAS, "tokens")):
            rev += 1
        return rev

    def _append(self, name: str, rows: DataFrame, rev: int) -> None:
        columns = T._parse_datatype_string(SCHEMAS[name]).names
        writer = rows.select(*columns).write.mode("overwrite")
        if name in SHARDED:
            writer = writer.partitionBy("shard")
        writer.parquet(f"{self.root}/{name}/rev={rev}")

    def _write_revision(self, files: DataFrame, rev: int, inactive: DataFrame) -> None:
        """Index ``files`` as a revision; ``inactive`` document rows join it."""
        path = lambda t: f"{self.root}/{t}/rev={rev}"
        paths = {t: path(t) for t in (*INDEX_TABLES, "tokens")}
        write_texts(files, paths["texts"], self.settings)
        files = self.spark.read.schema(files.schema).parquet(paths["texts"]).drop("shard")
        if files.isEmpty():
            self._append("documents", inactive, rev)
            return
        write_search_tables(files, paths, self.settings)
        write_entry_postings(self.spark, paths, self.settings)
        write_chunks(files, paths["chunks"], self.settings)
        fresh = self._raw("chunks", [rev])
        write_chunk_postings(fresh, paths["chunk_postings"], self.settings)
        columns = T._parse_datatype_string(SCHEMAS["documents"]).names
        inactive.select(*columns).write.partitionBy("shard").mode("append").parquet(paths["documents"])

    def _retire(self, state: State, rows: DataFrame, with_vectors: bool, rev: int | None = None) -> None:
        """Mark (rowid, rev) pairs as replaced, and their vectors with them."""
        dead = rows.select(F.lit("doc").alias("kind"), "rowid", F.col("rev").alias("old_rev"))
        if with_vectors:
            vectors = self.vectors.join(rows.select("rowid"), "rowid", "left_semi")
            dead = dead.unionByName(
                vectors.select(F.lit("vec").alias("kind"), "rowid", F.col("rev").alias("old_rev")).distinct()
            )
        new_rev = rev if rev is not None else self._next_rev(state)
        self._append("retired", dead, new_rev)
        if new_rev not in state.revisions and rev is None:
            state.revisions.append(new_rev)
        state.retired += self._raw("retired", [new_rev]).count()

    def _finish(self, state: State) -> None:
        """Refresh the corpus numbers from narrow columns, then commit."""
        before, self.state = self.state, state
        try:
            live = self.documents.filter("active").agg(
                F.count("*").alias("n"), F.sum("doc_len").alias("t"), F.sum("entry_len").alias("e")
            ).first()
            parts = self.chunks.agg(F.count("*").alias("n"), F.sum("chunk_len").alias("t")).first()
            state.stats["postings"] = [live.n, live.t or 0]
            state.stats["entries"] = [live.n, live.e or 0]
            state.stats["chunk_postings"] = [parts.n, parts.t or 0]
            state.vectors = vector_counts(self.vectors, self.documents, self.fingerprint)
            state.vector_fingerprint = self.fingerprint
        except Exception:
            self.state = before
            raise
        self._commit(state)

    def _number_files(self, fresh: DataFrame, first: int) -> tuple[DataFrame, int]:
        """Give new files consecutive row ids in path order, without a global
        window: ids count up inside range partitions, and the partitions'
        sizes (one small row each) give the offsets."""
        ordered = fresh.repartitionByRange("rel_path").sortWithinPartitions("rel_path")
        placed = settle(ordered.withColumn("_at", F.monotonically_increasing_id()))
        part = F.shiftright("_at", 33)
        sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
        numbered = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
        inside = F.col("_at") - F.shiftleft("_part", 33)
        return (
            numbered.withColumn("rowid", F.lit(first) + F.col("_offset") + inside).drop("_at", "_part", "_offset"),
            placed.count(),
        )

    def update_collection(
        self,
        name: str,
        files: DataFrame | None = None,
        rebuild: bool = False,
        before_scan: Callable[[Collection], None] | None = None,
        remove_missing: bool = True,
    ) -> dict[str, int]:
        """Scan a collection and index what changed.

        ``files`` (``rel_path, body``) replaces the file scan. ``before_scan``
        is called first, the place to fetch or generate the files. Without
        ``remove_missing`` absent files stay, for feeds that only bring news.
        """
        collection = self._collection(name)
        if before_scan:
            before_scan(collection)
        if files is None:
            files = scan_files(self.spark, collection.path, collection.include, collection.ignore)
        for column, kind in (("abs_path", "string"), ("mtime", "timestamp"), ("size_bytes", "long")):
            if column not in files.columns:
                files = files.withColumn(column, F.lit(None).cast(kind))
        files = extracted(files).withColumn("collection", F.lit(name))

        current = self.documents.filter(F.col("collection") == name)
        hashed = files.select("collection", "rel_path", content_hash(F.col("body")).alias("hash"))
        changes = settle(catalog.file_changes(hashed, current, rebuild))
        counts = {r.status: r["count"] for r in changes.groupBy("status").count().collect()}
        if not remove_missing:
            changes = changes.filter(F.col("status") != "removed")
            counts.pop("removed", None)
        result = {
            "scanned": sum(n for s, n in counts.items() if s != "removed"),
            "indexed": sum(counts.get(s, 0) for s in ("new", "changed", "restored")),
            "skipped": counts.get("unchanged", 0),
            "removed": counts.get("removed", 0),
        }
        if not result["indexed"] and not result["removed"]:
            return result

        state = self._draft()
        rev = self._next_rev(state)
        new, added = self._number_files(changes.filter("status = 'new'").select("rel_path"), state.next_rowid)
        state.next_rowid += added
        touched = changes.filter(F.col("status").isin("changed", "restored", "removed")).select("rel_path", "status")
        old = settle(current.join(touched, "rel_path"))
        now = self._now()
        ids = new.withColumn("created_at", now).unionByName(
            old.filter("status <> 'removed'").select("rel_path", "rowid", "created_at")
        )
        rows = (
            files.join(ids, "rel_path")
            .withColumn("active", F.lit(True))
            .withColumn("updated_at", now)
            .withColumn("embedding_model", F.lit(self.fingerprint))
        )
        gone = old.filter("status = 'removed'").withColumn("active", F.lit(False)).withColumn("updated_at", now)
        self._write_revision(rows, rev, gone)
        self._retire(state, old.select("rowid", "rev"), with_vectors=True, rev=rev)
        state.revisions.append(rev)
        self._finish(state)
        return result

    def embed_collection(self, name: str = "", force: bool = False) -> dict[str, int]:
        """Embed the chunks of documents whose vectors are missing or stale."""
        if self.embedder is None:
            raise ValueError("embedding provider is not configured")
        if name:
            self._collection(name)
        docs = self.documents
        if name:
            docs = docs.filter(F.col("collection") == name)
        counted = catalog.embedding_state(docs, self.chunks, self.vectors, self.fingerprint)
        stale = F.lit(True) if force else F.col("vectors") != F.col("chunks")
        pending = settle(
            counted.select("rowid", "id", "title", "chunks", "vectors").withColumn("pending", stale & (F.col("chunks") > 0))
        )
        scanned = pending.count()
        todo = pending.filter("pending").select("rowid", "title")
        result = {"scanned": scanned, "skipped": scanned - todo.count(), "embedded": 0}
        if todo.isEmpty():
            return result
        text = document_input(self.embedder.name, F.col("title"), F.col("content"))
        inputs = self.chunks.join(todo, "rowid").select("chunk_id", "doc_id", "rowid", "shard", text.alias("input"))
        state = self._draft()
        rev = self._next_rev(state)
        made = (
            embed_rows(inputs, "input", self.embedder)
            .withColumn("dimensions", F.size("embedding"))
            .withColumn("model", F.lit(self.embedder.name.strip()))
            .withColumn("embed_fingerprint", F.lit(self.fingerprint))
        )
        self._append("vectors", made, rev)
        result["embedded"] = self._raw("vectors", [rev]).count()
        old = self.vectors.join(todo.select("rowid"), "rowid", "left_semi")
        dead = old.select(F.lit("vec").alias("kind"), "rowid", F.col("rev").alias("old_rev")).distinct()
        self._append("retired", dead, rev)
        state.retired += self._raw("retired", [rev]).count()
        state.revisions.append(rev)
        self._finish(state)
        return result

    def compact(self) -> None:
        """Rewrite the live rows as one revision and forget the older ones."""
        state = self._draft()
        rev = self._next_rev(state)
        for table in (*INDEX_TABLES, "vectors"):
            rows = self._live(table)
            if table in ("postings", "entries", "chunk_postings"):
                rows = rows.repartitionByRange("term", "rowid").sortWithinPartitions("term", "rowid")
            self._append(table, rows, rev)
        state.revisions, state.retired = [rev], 0
        self._finish(state)

    # -- search ---------------------------------------------------------------

    def search(self, query: str, collection: str = "", limit: int = SEARCH_LIMIT, min_score: float = 0.0) -> DataFrame:
        c = self.corpus()
        return search(c.terms, c.documents, query, collection, limit, min_score, c.docs_per_shard)

    def search_many(self, queries: list[str], collection: str = "", limit: int = SEARCH_LIMIT, min_score: float = 0.0):
        c = self.corpus()
        return search_many(c.terms, c.documents, queries, collection, limit, min_score, c.docs_per_shard)

    def _by_vectors(self, texts, collection, limit, min_score) -> DataFrame | None:
        """The ``limit`` best documents; all of them, unranked, if it is None."""
        if self.embedder is None:
            raise ValueError("embedding provider is not configured")
        c = self.corpus()
        counts = c.vector_counts if c.vector_counts is not None else vector_counts(c.vectors, c.documents, c.fingerprint)
        if not (counts.get(collection, 0) if collection else sum(counts.values())):
            return None
        queries = self.embedder.embed_batch([query_input(self.embedder.name, t) for t in texts])
        if limit is None:
            hits = vector_matches(
                c.vectors, c.documents, queries, [collection] if collection else [], min_score, c.metric, c.fingerprint
            )
            return with_snippets(hits, c.chunks, sys.maxsize)
        hits = vector_search(
            c.vectors, c.documents, queries, collection, limit, min_score, c.metric, c.fingerprint
        )
        return with_snippets(hits, c.chunks, limit)

    def search_vector(self, query: str, collection: str = "", limit: int = 20, min_score: float = 0.0):
        """Raw vector search; None when nothing is embedded yet."""
        return self._by_vectors([query], collection, limit if limit > 0 else 20, min_score or -2.0)

    def search_semantic(self, query: str, collection="", limit=10, min_score=0.0, intent=""):
        """Vector search with expansions; a zero floor means 0.3."""
        if self.embedder is None:
            raise ValueError("embedding provider is not configured")
        floor = min_score or VECTOR_SEARCH_MIN_SCORE
        return self._by_vectors(
            vector_texts(self.expander, query, intent), collection, limit if limit > 0 else 10, floor
        )

    def expand_query(self, query: str, intent: str = ""):
        return expand(self.expander, query, intent)

    def query(self, question: str, options: QueryOptions = QueryOptions()) -> DataFrame | None:
        return hybrid_query(self.corpus(), question, options)

    def query_many(self, question: str, collections: list[str] = (), options: QueryOptions = QueryOptions()):
        """The question asked of each collection (the default ones if none)."""
        names = list(collections) or self.default_collections()
        return query_collections(self.corpus(), question, names, options)

    def search_targets(
        self, queries: list[str], collections: list[str] = (), limit: int = 0, min_score: float = 0.0,
        everything: bool = False, mode: str = "lexical",
    ) -> DataFrame | None:
        """One search for several target collections.

        ``mode``: ``lexical``, ``semantic`` or ``vector``. One target is
        searched directly; several are searched globally and then filtered.
        ``everything`` gives all matching documents, unranked, with the score of
        their best query or chunk.
        """
        names = list(dict.fromkeys(c for c in collections if c)) or self.default_collections()
        limit = limit if limit > 0 else 20
        one = names[0] if len(names) == 1 else ""
        wide = max(50, limit * 2) if mode == "lexical" and len(names) > 1 else limit
        if mode == "lexical" and everything:
            hits, rank = all_matches(self.corpus().terms, self.documents, queries, min_score), "score"
        elif mode == "lexical":
            hits, rank = self.search_many(queries, one, wide, min_score), "score"
        elif everything:
            text, semantic = " ".join(queries), mode == "semantic"
            texts = vector_texts(self.expander, text, "") if semantic else [text]
            floor = min_score or (VECTOR_SEARCH_MIN_SCORE if semantic else NO_MIN_SCORE)
            hits, rank = self._by_vectors(texts, one, None, floor), "score"
        elif mode == "semantic":
            hits, rank = self.search_semantic(" ".join(queries), one, wide, min_score), "score"
        else:
            hits, rank = self.search_vector(" ".join(queries), one, wide, min_score), "score"
        if hits is None:
            return None
        if names:
            hits = hits.filter(F.col("collection").isin(names))
        return hits if everything else hits.orderBy(F.desc(rank), "rowid").limit(limit)

    def search_entries(self, query: str, tags: list[str] = (), limit: int = 10) -> DataFrame:
        """Documents with any of the words; every tag must be part of the tags."""
        limit = limit if limit > 0 else 10
        matches = bm25_matches(self._terms("entries", ENTRY_WEIGHTS), parse_any(query))
        docs = self.documents.filter("active")
        if tags:
            for tag in tags:
                docs = docs.filter(F.col("collection").ilike(f"%{tag}%"))
            matches = matches.join(docs.select("rowid"), "rowid", "left_semi")
        return fetch(docs, ranked(matches, limit), "rowid", limit)

    def search_chunks(self, query: str, limit: int = 20) -> DataFrame:
        limit = limit if limit > 0 else 20
        matches = bm25_matches(self._terms("chunk_postings", CHUNK_WEIGHTS), parse_any(query))
        top = ranked(matches, limit).withColumnRenamed("rowid", "chunk_rowid")
        return fetch(self.chunks, top, "chunk_rowid", limit)

    def status(self) -> DataFrame:
        return catalog.index_status(self.documents, self.chunks, self.vectors, self.fingerprint)
