"""The hybrid query: retrieval lists, fusion, best passages, rerank."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawler.config import (
    BACKEND_LIMIT,
    CANDIDATE_LIMIT,
    EXPANSION_WEIGHT,
    NO_MIN_SCORE,
    ORIGINAL_WEIGHT,
    QUERY_LIMIT,
    VECTOR_OVERFETCH,
)
from trawler.functions.models import (
    Embedder,
    Expander,
    Expansion,
    Reranker,
    check_expansions,
    primary_question,
    query_input,
)
from trawler.functions.terms import rerank_question
from trawler.operators.fusion import RankedList, blend_rerank, enrich, fuse_lists, rank_candidates, top_rank_bonus
from trawler.operators.lexical import TermIndex, candidate_cut, search, top_candidates
from trawler.operators.vector import has_vectors, nearest_chunks, vector_search
from trawler.session import settle

RESULT_COLUMNS = [
    "id", "collection", "path", "title", "snippet", "chunk_id", "score", "bm25_rank", "vector_rank",
    "file", "context", "doc_id", "best_chunk", "best_chunk_pos",
]


@dataclass(frozen=True)
class Corpus:
    """The tables a query reads, and the models it may call."""

    documents: DataFrame
    chunks: DataFrame
    terms: TermIndex
    vectors: DataFrame | None = None
    contexts: DataFrame | None = None
    global_context: str = ""
    embedder: Embedder | None = None
    expander: Expander | None = None
    reranker: Reranker | None = None
    fingerprint: str = ""
    metric: str = "l2"
    uri_scheme: str = "doc"
    docs_per_shard: int = 0
    # Current vectors per collection, when known from the last commit.
    vector_counts: dict[str, int] | None = None
    # Global candidates shared by the collections of one call.
    shared: dict | None = None

    @property
    def spark(self) -> SparkSession:
        return self.documents.sparkSession

    def context_rows(self) -> DataFrame:
        if self.contexts is not None:
            return self.contexts
        return self.spark.createDataFrame([], "collection string, prefix string, text string")


@dataclass(frozen=True)
class QueryOptions:
    collection: str = ""
    limit: int = QUERY_LIMIT
    min_score: float = 0.0
    candidate_limit: int = CANDIDATE_LIMIT
    skip_rerank: bool = False
    intent: str = ""
    explain: bool = False
    queries: list[Expansion] = field(default_factory=list)
    search_queries: list[str] = field(default_factory=list)


def _once(corpus: Corpus, key: tuple, make) -> DataFrame | None:
    """A settled global result, made once when several collections share it."""
    if corpus.shared is None:
        return None
    if key not in corpus.shared:
        corpus.shared[key] = settle(make())
    return corpus.shared[key]


def _lexical(corpus: Corpus, options: QueryOptions, text: str) -> DataFrame:
    cut = candidate_cut(options.collection, BACKEND_LIMIT)
    candidates = _once(corpus, ("fts", text, cut), lambda: top_candidates(corpus.terms, text, cut))
    return search(
        corpus.terms, corpus.documents, text, options.collection, BACKEND_LIMIT,
        docs_per_shard=corpus.docs_per_shard, candidates=candidates,
    )


def _any_vectors(corpus: Corpus, collection: str) -> bool:
    if corpus.vector_counts is None:
        return has_vectors(corpus.vectors, corpus.documents, collection, corpus.fingerprint)
    counts = corpus.vector_counts
    return (counts.get(collection, 0) if collection else sum(counts.values())) > 0


def _vector_lists(corpus: Corpus, options: QueryOptions, wanted: list[tuple], keep_empty=True) -> list[RankedList]:
    """One list per (type, text, weight); all texts are embedded in one call."""
    if corpus.embedder is None or corpus.vectors is None or not wanted:
        return []
    if not _any_vectors(corpus, options.collection):
        return []
    texts = [query_input(corpus.embedder.name, text) for _, text, _ in wanted]
    lists = []
    for at, ((kind, text, weight), vector) in enumerate(zip(wanted, corpus.embedder.embed_batch(texts))):
        near = _once(
            corpus, ("vec", at, text),
            lambda v=vector: nearest_chunks(
                corpus.vectors, [v], BACKEND_LIMIT * VECTOR_OVERFETCH, corpus.metric, corpus.fingerprint
            ),
        )
        hits = vector_search(
            corpus.vectors, corpus.documents, [vector], options.collection, BACKEND_LIMIT,
            NO_MIN_SCORE, corpus.metric, corpus.fingerprint, near,
        )
        lists.append(RankedList("vec", kind, text, weight, hits, keep_empty))
    return lists


def strong_signal(hits: DataFrame) -> bool:
    """Whether the two best scores already decide; the one driver-side look."""
    top = [r.score for r in hits.orderBy("bm25_rank").select("score").take(2)] + [0.0, 0.0]
    return top[0] >= 0.85 and top[0] - top[1] >= 0.15


def retrieval_lists(corpus: Corpus, question: str, options: QueryOptions):
    """(lists, primary question, weight of the first non-empty list or None)."""
    extra = [q.strip() for q in options.search_queries if q.strip()]
    if options.queries and extra:
        raise ValueError("query options cannot set both queries and search_queries")

    if options.queries:
        check_expansions(options.queries)
        typed = [e for e in options.queries if e.text.strip()]
        lists = [
            RankedList("fts", "lex", e.text.strip(), EXPANSION_WEIGHT, _lexical(corpus, options, e.text.strip()), False)
            for e in typed
            if e.kind == "lex"
        ]
        wanted = [(e.kind, e.text.strip(), EXPANSION_WEIGHT) for e in typed if e.kind in ("vec", "hyde")]
        lists += _vector_lists(corpus, options, wanted, keep_empty=False)
        return lists, primary_question(options.queries), ORIGINAL_WEIGHT

    if extra:
        primary = question.strip() or extra[0]
        original = [("original", primary, ORIGINAL_WEIGHT)]
        lists = [RankedList("fts", *original[0], _lexical(corpus, options, primary), False)]
        lists += _vector_lists(corpus, options, original)
        lists += [
            RankedList("fts", "search", q, EXPANSION_WEIGHT, _lexical(corpus, options, q), False) for q in extra
        ]
        return lists, primary, None

    hits = _lexical(corpus, options, question)
    if corpus.expander and not options.intent:
        hits = settle(hits)
    lists = [RankedList("fts", "original", question, ORIGINAL_WEIGHT, hits)]
    wanted = [("original", question, ORIGINAL_WEIGHT)]
    if corpus.expander and (options.intent or not strong_signal(hits)):
        for e in corpus.expander.expand(question, options.intent):
            text = e.text.strip()
            if text and e.kind == "lex":
                lists.append(RankedList("fts", "lex", text, EXPANSION_WEIGHT, _lexical(corpus, options, text)))
            elif text and e.kind in ("vec", "hyde"):
                wanted.append((e.kind, text, EXPANSION_WEIGHT))
    return lists + _vector_lists(corpus, options, wanted), question, None


def hybrid_query(corpus: Corpus, question: str, options: QueryOptions = QueryOptions()) -> DataFrame | None:
    """The best documents for a question; None when nothing could be searched.

    After the backends' own top-k, at most a few hundred rows are left, so the
    rest of the plan joins small frames with pruned reads of the large tables.
    """
    limit = options.limit if options.limit > 0 else QUERY_LIMIT
    cut = options.candidate_limit if options.candidate_limit > 0 else CANDIDATE_LIMIT
    lists, primary, first_weight = retrieval_lists(corpus, question, options)
    if not lists:
        return None
    fused = settle(fuse_lists(lists, first_weight))
    # Ties are broken by file, so the path is looked up before the cut.
    rows = BACKEND_LIMIT * len(lists)
    enriched = enrich(
        fused, corpus.documents, corpus.chunks, corpus.context_rows(), primary, options.intent,
        corpus.global_context, corpus.uri_scheme, rows,
    )
    candidates = rank_candidates(enriched, cut)
    if options.skip_rerank or corpus.reranker is None:
        ranked = (
            candidates.withColumn("score", F.col("position_score"))
            .withColumn("rerank_score", F.lit(None).cast("double"))
            .withColumn("blend_weight", F.lit(1.0))
        )
        order = [F.col("rank")]
    else:
        candidates = settle(candidates)
        texts = candidates.select("id", "file", F.col("best_chunk").alias("text"))
        scores = corpus.reranker.scores(rerank_question(primary, options.intent), texts)
        ranked = blend_rerank(candidates, scores, cut)
        order = [F.desc("score"), F.col("file")]
    if options.min_score:
        ranked = ranked.filter(F.col("score") >= options.min_score)
    ranked = ranked.orderBy(*order).limit(limit)
    # Rank 0: the document did not come from that backend first.
    for name in ("bm25_rank", "vector_rank"):
        ranked = ranked.withColumn(name, F.coalesce(name, F.lit(0)))
    columns = list(RESULT_COLUMNS)
    if options.explain:
        ranked = ranked.withColumn("explain", explain_column())
        columns.append("explain")
    return ranked.select(*columns)


def explain_column():
    rrf = F.struct(
        "rank",
        "top_rank",
        "position_score",
        F.col("blend_weight").alias("weight"),
        "base_score",
        top_rank_bonus(F.col("top_rank")).alias("top_rank_bonus"),
        "total_score",
        "contributions",
    )
    return F.struct(
        "fts_scores",
        "vector_scores",
        rrf.alias("rrf"),
        "rerank_score",
        F.col("score").alias("blended_score"),
    )


def merge_collections(results: list[DataFrame], limit: int) -> DataFrame:
    """Answers of several collections by score, then collection, then path."""
    merged = reduce(DataFrame.unionByName, results)
    return merged.orderBy(F.desc("score"), "collection", "path").limit(limit)


def query_collections(
    corpus: Corpus, question: str, collections: list[str], options: QueryOptions = QueryOptions()
) -> DataFrame | None:
    """One hybrid query per collection, merged.

    Candidates are global before the collection filter, so the index and the
    vectors are searched once for all collections.
    """
    collections = list(dict.fromkeys(c for c in collections if c))
    limit = options.limit if options.limit > 0 else QUERY_LIMIT
    per_collection = max(20, limit * 2) if len(collections) > 1 else limit
    corpus = replace(corpus, shared={} if len(collections) > 1 else None)
    answers = [
        hybrid_query(corpus, question, replace(options, collection=c, limit=per_collection))
        for c in collections
    ]
    answers = [a for a in answers if a is not None]
    return merge_collections(answers, limit) if answers else None
