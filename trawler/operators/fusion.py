"""Reciprocal-rank fusion of retrieval lists, best passages, rerank blend."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawler.config import EXPANSION_WEIGHT, RRF_K
from trawler.functions.terms import overlap_score
from trawler.functions.text import document_uri, short_hash, snippet
from trawler.operators.lookup import bounded, fetch

TRACE = (
    "struct<list_index:int,source:string,query_type:string,query:string,rank:int,"
    "weight:double,backend_score:double,rrf_contribution:double>"
)


@dataclass(frozen=True)
class RankedList:
    """One backend's answer: rows with ``id``, ``score`` and a rank column."""

    source: str
    query_type: str
    query: str
    weight: float
    hits: DataFrame
    keep_empty: bool = True


def top_rank_bonus(rank: Column) -> Column:
    return F.when(rank == 1, 0.05).when(rank <= 3, 0.02).otherwise(0.0)


def blend_weight(rank: Column) -> Column:
    return F.when(rank <= 3, 0.75).when(rank <= 10, 0.60).otherwise(0.40)


def _tagged(at: int, item: RankedList) -> DataFrame:
    """Uniform rows of one list; a document body never rides along."""
    hits, columns = item.hits, item.hits.columns
    rank = "bm25_rank" if item.source == "fts" else "vector_rank"

    def column(name: str, kind: str) -> Column:
        value = F.col(name) if name in columns else F.lit(None)
        return value.cast(kind).alias(name)

    return hits.select(
        "id",
        F.lit(at).alias("raw_index"),
        F.lit(item.source).alias("source"),
        F.lit(item.query_type).alias("query_type"),
        F.lit(item.query).alias("query"),
        F.col(rank).cast("int").alias("rank"),
        F.lit(float(item.weight)).alias("weight"),
        F.col("score").alias("backend_score"),
        column("snippet", "string"),
        column("chunk_id", "string"),
        column("bm25_rank", "int"),
        column("vector_rank", "int"),
        *[column(c, "int") for c in ("shard",) if c in columns],
    )


def fuse_lists(lists: list[RankedList], first_weight: float | None = None) -> DataFrame:
    """Weighted fusion with the full contribution trace, best first.

    ``first_weight`` replaces the weight of the first list that has rows.
    Every list holds at most a few dozen rows, so the windows here are small.
    """
    rows = reduce(DataFrame.unionByName, [_tagged(i, item) for i, item in enumerate(lists)])
    if not all(item.keep_empty for item in lists):
        # Lists that may be dropped when empty do not use up an index.
        present = F.collect_set("raw_index").over(Window.partitionBy())
        kept = F.array(*[F.lit(i) for i, item in enumerate(lists) if item.keep_empty]).cast("array<int>")
        before = F.filter(F.array_union(present, kept), lambda i: i < F.col("raw_index"))
        rows = rows.withColumn("list_index", F.size(before))
    else:
        rows = rows.withColumn("list_index", F.col("raw_index"))
    if first_weight is not None:
        rows = rows.withColumn(
            "weight", F.when(F.col("list_index") == 0, first_weight).otherwise(EXPANSION_WEIGHT)
        )
    rows = rows.withColumn("rrf_contribution", F.col("weight") / (F.lit(RRF_K) + F.col("rank")))
    trace = F.struct(
        "list_index", "source", "query_type", "query", "rank", "weight", "backend_score", "rrf_contribution"
    )
    payload = F.struct("snippet", "chunk_id", "bm25_rank", "vector_rank", *[c for c in ("shard",) if c in rows.columns])
    per_doc = rows.groupBy("id").agg(
        F.min("rank").alias("top_rank"),
        F.array_sort(F.collect_list(trace)).cast(f"array<{TRACE}>").alias("contributions"),
        F.min_by(payload, "list_index").alias("first"),
    )
    # Added up in list order, so equal inputs give bit-equal sums.
    base = F.aggregate("contributions", F.lit(0.0), lambda s, c: s + c["rrf_contribution"])
    scores = lambda test: F.transform(F.filter("contributions", test), lambda c: c["backend_score"])
    return per_doc.select(
        "id",
        "first.*",
        "top_rank",
        "contributions",
        base.alias("base_score"),
        scores(lambda c: c["source"] == "fts").alias("fts_scores"),
        scores(lambda c: c["source"] != "fts").alias("vector_scores"),
    ).withColumn("total_score", F.col("base_score") + top_rank_bonus(F.col("top_rank")))


def rank_candidates(fused: DataFrame, candidate_limit: int, tie: str = "file") -> DataFrame:
    """Number by total score; the position score of rank n is 1/n."""
    order = [F.desc("total_score"), F.col(tie)]
    return (
        fused.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
        .filter(F.col("rank") <= candidate_limit)
        .withColumn("position_score", 1.0 / F.col("rank"))
    )


def with_context(docs: DataFrame, contexts: DataFrame, global_context: str = "") -> DataFrame:
    """Add ``context``: the text of the longest path prefix of the collection.

    ``contexts`` (collection, prefix, text) is catalog data: one small row per
    configured prefix, folded to one row per collection.
    """
    clean = F.concat(F.lit("/"), F.regexp_replace("prefix", "^/", ""))
    entry = F.struct(F.length(clean).alias("n"), clean.alias("prefix"), F.col("text"))
    per_collection = contexts.groupBy("collection").agg(
        F.sort_array(F.collect_list(entry), asc=False).alias("_prefixes")
    )
    path = F.concat(F.lit("/"), F.regexp_replace("rel_path", "^/", ""))
    longest = F.try_element_at(F.filter("_prefixes", lambda e: F.startswith(path, e["prefix"])), F.lit(1))
    text = F.nullif(longest.getField("text"), F.lit(""))
    return (
        docs.join(per_collection, "collection", "left")
        .withColumn("context", F.coalesce(text, F.lit(global_context)))
        .drop("_prefixes")
    )


def best_chunks(chunks: DataFrame, question: str, intent: str = "", by: str = "doc_id") -> DataFrame:
    """Per document the chunk with most query terms, the first one on ties.

    ``chunks`` may carry ``hit_chunk``; that chunk's snippet is kept as well.
    The aggregation combines before the shuffle, so one document may own any
    share of the chunks.
    """
    scored = chunks.withColumn("overlap", overlap_score(F.col("content"), question, intent))
    row = F.struct((-F.col("overlap")).alias("o"), F.col("chunk_index").alias("i"))
    pos = F.coalesce("start_offset", F.col("chunk_index").cast("long"))
    pick = F.struct("chunk_id", "content", pos.alias("pos"))
    aggs = [F.min_by(pick, row).alias("b"), F.max("overlap").alias("overlap")]
    extra = []
    if "hit_chunk" in chunks.columns:
        aggs.append(F.max(F.when(F.col("chunk_id") == F.col("hit_chunk"), F.col("snippet"))).alias("hit_snippet"))
        extra = ["hit_snippet"]
    return scored.groupBy(by).agg(*aggs).select(
        by,
        F.col("b.chunk_id").alias("chunk_id"),
        F.col("b.content").alias("best_chunk"),
        F.col("b.pos").alias("best_chunk_pos"),
        "overlap",
        *extra,
    )


def enrich(
    candidates: DataFrame,
    documents: DataFrame,
    chunks: DataFrame,
    contexts: DataFrame,
    question: str,
    intent: str,
    global_context: str,
    scheme: str,
    rows: int,
) -> DataFrame:
    """Add path, title, ids, context and best chunk to at most ``rows`` rows.

    ``candidates`` is a settled frame: it is joined with both large tables.
    """
    columns = ["id", "collection", "rel_path", "title", "hash"]
    columns += [c for c in ("shard",) if c in documents.columns]
    docs = fetch(documents.filter(F.col("active")).select(*columns), candidates, "id", rows)
    docs = with_context(docs, contexts, global_context)
    keys = [c for c in ("doc_id", "shard") if c in chunks.columns and c in ["doc_id", *candidates.columns]]
    wanted = candidates.withColumnRenamed("id", "doc_id").withColumnRenamed("chunk_id", "hit_chunk")
    mine = chunks.join(bounded(wanted.select(*keys, "hit_chunk"), rows), keys)
    best = best_chunks(mine, question, intent).drop("overlap").withColumnRenamed("doc_id", "id")
    shown = F.coalesce(F.nullif("snippet", F.lit("")), F.nullif("hit_snippet", F.lit("")))
    return (
        docs.drop("chunk_id")
        .join(bounded(best, rows), "id", "left")
        .withColumn("file", document_uri(scheme, F.col("collection"), F.col("rel_path")))
        .withColumn("doc_id", short_hash(F.col("hash")))
        .withColumn("best_chunk", F.coalesce("best_chunk", F.lit("")))
        .withColumn("snippet", F.coalesce(shown, snippet(F.col("best_chunk"))))
        .withColumnRenamed("rel_path", "path")
        .drop("hit_snippet", "hash")
    )


def blend_rerank(candidates: DataFrame, scores: DataFrame, rows: int) -> DataFrame:
    """Blend position with an outside score: by id, else by file, else 0."""
    by_id = by_file = None
    if "id" in scores.columns:
        by_id = scores.groupBy("id").agg(F.max("score").alias("_by_id"))
        wanted = candidates.select("id")
        by_id = by_id.join(bounded(wanted, rows), "id", "left_semi")
        candidates = candidates.join(by_id, "id", "left")
    if "file" in scores.columns:
        by_file = scores.groupBy("file").agg(F.max("score").alias("_by_file"))
        candidates = candidates.join(by_file, "file", "left")
    found = [c for c, df in (("_by_id", by_id), ("_by_file", by_file)) if df is not None]
    weight = blend_weight(F.col("rank"))
    return (
        candidates.withColumn("rerank_score", F.coalesce(*found, F.lit(0.0)).cast("double"))
        .withColumn("blend_weight", weight)
        .withColumn("score", weight * F.col("position_score") + (1 - weight) * F.col("rerank_score"))
        .drop(*found)
    )


def rank_fusion(lists: list[DataFrame], keys: list[str], limit: int, rank: str = "rank") -> DataFrame:
    """Plain reciprocal-rank fusion: ``keys``, ``rrf`` and ``rank`` of the ``limit`` best rows.

    Sums that differ by rounding alone count as ties, broken by the keys.
    """
    rows = reduce(DataFrame.unionByName, [df.select(*keys, F.col(rank).alias("rank")) for df in lists])
    fused = rows.groupBy(*keys).agg(F.sum(1.0 / (F.lit(float(RRF_K)) + F.col("rank"))).alias("rrf"))
    order = [F.desc(F.round("rrf", 12)), *keys]
    # At most ``limit`` rows are left for the window.
    return fused.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def document_order(hits: DataFrame, doc: str, rank: str = "rank") -> DataFrame:
    """Distinct documents of ranked passages, by their best one: ``doc``, ``best_rank``, ``position``."""
    docs = hits.groupBy(doc).agg(F.min(rank).alias("best_rank"))
    return docs.withColumn("position", F.row_number().over(Window.orderBy("best_rank")))


def first_or_else(hits: DataFrame, fallback: DataFrame) -> DataFrame:
    """``hits``, or ``fallback`` if there are none; decided inside the plan."""
    some = hits.select(F.lit(1).alias("_any")).limit(1)
    other = fallback.withColumn("_any", F.lit(1)).join(F.broadcast(some), "_any", "left_anti").drop("_any")
    return hits.unionByName(other, allowMissingColumns=True)
