"""BM25 over the postings table."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawler.config import (
    BM25_B,
    BM25_K1,
    COLLECTION_CANDIDATE_FACTOR,
    FIELD_WEIGHTS,
    IDF_FLOOR,
    RRF_K,
    SEARCH_LIMIT,
)
from trawler.functions.lexquery import LexQuery, parse
from trawler.operators.lookup import fetch


@dataclass(frozen=True)
class TermIndex:
    """Postings with the corpus numbers BM25 needs.

    ``rows`` and ``tokens`` count the whole index, all collections together.
    """

    postings: DataFrame
    rows: int
    tokens: int
    stemmer: str = "porter"
    weights: dict = field(default_factory=lambda: FIELD_WEIGHTS)


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _is_token(token: str, prefix: bool) -> Column:
    return F.col("term").startswith(token) if prefix else F.col("term") == token


def _field_weight(weights: dict) -> Column:
    pairs = [x for name, w in weights.items() for x in (F.lit(name), F.lit(float(w)))]
    return F.element_at(F.create_map(*pairs), F.col("field"))


def _word_hits(index: TermIndex, clauses: dict[int, tuple], names: list[str]) -> DataFrame:
    """Weighted occurrences of the one-token clauses."""
    tests = {i: _is_token(tokens[0], prefix) for i, (tokens, prefix) in clauses.items()}
    weight = _field_weight(index.weights)
    return index.postings.filter(_any(list(tests.values()))).select(
        "rowid",
        "doc_len",
        *[
            (F.when(tests[i], weight) if i in tests else F.lit(None).cast("double")).alias(name)
            for i, name in enumerate(names)
        ],
    )


def _phrase_hits(index: TermIndex, at: int, tokens: tuple, prefix: bool, names: list[str]) -> DataFrame:
    """Weighted starts of one phrase: positions where every token is in place."""
    last = len(tokens) - 1
    tests = [_is_token(t, prefix and i == last) for i, t in enumerate(tokens)]
    starts = F.array_compact(F.array(*[F.when(t, F.col("pos") - i) for i, t in enumerate(tests)]))
    return (
        index.postings.filter(_any(tests))
        .select("rowid", "doc_len", "field", F.explode(starts).alias("start"))
        .groupBy("rowid", "field", "start")
        .agg(F.count("*").alias("n"), F.max("doc_len").alias("doc_len"))
        .filter(F.col("n") == len(tokens))
        .select(
            "rowid",
            "doc_len",
            *[
                (_field_weight(index.weights) if i == at else F.lit(None).cast("double")).alias(name)
                for i, name in enumerate(names)
            ],
        )
    )


def _idf(rows: int, name: str) -> Column:
    idf = F.log((F.lit(rows) - F.col(name) + 0.5) / (F.col(name) + 0.5))
    return F.when(idf > 0, idf).otherwise(F.lit(IDF_FLOOR)).alias(name)


def bm25_matches(index: TermIndex, query: LexQuery) -> DataFrame:
    """(rowid, bm25) of every matching row; lower is better.

    Occurrences are summed per row before the shuffle, and one shuffle on
    ``rowid`` answers all clauses. Row counts per clause come from a scalar
    subquery over the same grouping, whose exchange is reused.
    """
    session = index.postings.sparkSession
    required = [(c.tokens(index.stemmer), c.prefix) for c in query.required]
    groups = [[(c.tokens(index.stemmer), c.prefix) for c in g] for g in query.excluded]
    if query.any_clause:
        required = [c for c in required if c[0]]
    groups = [g for g in groups if all(tokens for tokens, _ in g)]
    if not required or not all(tokens for tokens, _ in required):
        return session.createDataFrame([], "rowid long, bm25 double")

    clauses = required + [c for g in groups for c in g]
    names = [f"f{i}" for i in range(len(clauses))]
    words = {i: c for i, c in enumerate(clauses) if len(c[0]) == 1}
    parts = [_word_hits(index, words, names)] if words else []
    parts += [
        _phrase_hits(index, i, tokens, prefix, names)
        for i, (tokens, prefix) in enumerate(clauses)
        if len(tokens) > 1
    ]
    hits = reduce(DataFrame.unionByName, parts)
    grouped = hits.groupBy("rowid").agg(
        F.max("doc_len").alias("doc_len"),
        *[F.coalesce(F.sum(name), F.lit(0.0)).alias(name) for name in names],
    )

    used = names[: len(required)]
    # Reads every grouped column, so that both uses share one exchange.
    found = grouped.agg(
        *[F.count_if((F.col(name) > 0) & (F.col("doc_len") > 0)).alias(name) for name in names]
    )
    idf = found.select(F.struct(*[_idf(index.rows, name) for name in names])).scalar()
    mean_len = index.tokens / index.rows if index.rows else 1.0
    norm = BM25_K1 * (1 - BM25_B + BM25_B * F.col("doc_len") / F.lit(mean_len))

    def part(name: str) -> Column:
        return idf.getField(name) * F.col(name) * (BM25_K1 + 1) / (F.col(name) + norm)

    present = [F.col(name) > 0 for name in used]
    keep = _any(present) if query.any_clause else _all(present)
    start = len(required)
    for group in groups:
        keep &= ~_all([F.col(name) > 0 for name in names[start : start + len(group)]])
        start += len(group)
    score = reduce(lambda a, b: a + b, [part(name) for name in used])
    return grouped.filter(keep).select("rowid", (-score).alias("bm25"))


def shard_of(rowid: str, docs_per_shard: int) -> Column:
    """The partition a row lives in; a function of its id, so never stored twice."""
    return F.floor(F.col(rowid) / docs_per_shard).cast("int")


def positive_score(bm25: Column) -> Column:
    return F.abs(bm25) / (F.abs(bm25) + 1)


def top_candidates(index: TermIndex, query: str, cut: int) -> DataFrame:
    """The best ``cut`` rows of the whole index, every collection together."""
    return bm25_matches(index, parse(query)).orderBy("bm25", "rowid").limit(cut)


def candidate_cut(collection: str, limit: int) -> int:
    return limit * COLLECTION_CANDIDATE_FACTOR if collection else limit


def search(
    index: TermIndex,
    documents: DataFrame,
    query: str,
    collection: str = "",
    limit: int = SEARCH_LIMIT,
    min_score: float = 0.0,
    docs_per_shard: int = 0,
    candidates: DataFrame | None = None,
) -> DataFrame:
    """Best documents for a search string, with score and ``bm25_rank``.

    The candidate cut is global and comes before the collection filter, so a
    small collection can come back empty; that is the documented behaviour.
    Candidates already at hand can be passed in.
    """
    limit = limit if limit > 0 else SEARCH_LIMIT
    cut = candidate_cut(collection, limit)
    if candidates is None:
        candidates = top_candidates(index, query, cut)
    rows = documents.filter(F.col("active"))
    if collection:
        rows = rows.filter(F.col("collection") == collection)
    if docs_per_shard:
        candidates = candidates.withColumn("shard", shard_of("rowid", docs_per_shard))
    hits = (
        fetch(rows, candidates, "rowid", cut)
        .orderBy("bm25", "rowid")
        .limit(limit)
        .withColumn("score", positive_score(F.col("bm25")))
    )
    if min_score > 0:
        hits = hits.filter(F.col("score") >= min_score)
    # At most ``limit`` rows are left, so one ordered partition is enough.
    return hits.withColumn("bm25_rank", F.row_number().over(Window.orderBy("bm25", "rowid")))


def fuse_equal(
    lists: list[DataFrame], limit: int, min_score: float = 0.0, key: str = "id", order: str = "bm25_rank"
) -> DataFrame:
    """Equal-weight reciprocal-rank fusion, scaled so the best row scores 1.

    Ties keep first-seen order; columns come from the first list with the row.
    """
    tagged = [df.withColumn("list_index", F.lit(i)) for i, df in enumerate(lists)]
    rows = reduce(DataFrame.unionByName, tagged)
    seen = F.struct("list_index", order)
    payload = F.struct(*[c for c in lists[0].columns if c not in (key, "score")])
    fused = rows.groupBy(key).agg(
        F.sum(1.0 / (F.lit(RRF_K) + F.col(order))).alias("fused"),
        F.min(seen).alias("first_seen"),
        F.min_by(payload, seen).alias("row"),
    )
    # Each list was cut to ``limit`` rows, so this window sees few rows.
    score = F.col("fused") / F.max("fused").over(Window.partitionBy())
    out = fused.withColumn("score", score)
    if min_score > 0:
        out = out.filter(F.col("score") >= min_score)
    return out.orderBy(F.desc("score"), "first_seen").limit(limit).select(key, "score", "first_seen", "row.*")


def search_many(
    index: TermIndex,
    documents: DataFrame,
    queries: list[str],
    collection: str = "",
    limit: int = SEARCH_LIMIT,
    min_score: float = 0.0,
    docs_per_shard: int = 0,
) -> DataFrame | None:
    """Several search strings fused by rank; one string keeps its raw score."""
    queries = [q.strip() for q in queries if q.strip()]
    limit = limit if limit > 0 else SEARCH_LIMIT
    if not queries:
        return None
    lists = [search(index, documents, q, collection, limit, min_score, docs_per_shard) for q in queries]
    return lists[0] if len(lists) == 1 else fuse_equal(lists, limit, min_score)


def all_matches(index: TermIndex, documents: DataFrame, queries: list[str], min_score: float = 0.0) -> DataFrame | None:
    """Every active document that any of the queries matches, with its best score; unranked."""
    queries = [q.strip() for q in queries if q.strip()]
    if not queries:
        return None
    found = reduce(DataFrame.unionByName, [bm25_matches(index, parse(q)) for q in queries])
    best = found.groupBy("rowid").agg(F.max(positive_score(F.col("bm25"))).alias("score"))
    return documents.filter("active").join(best.filter(F.col("score") >= min_score), "rowid")


def ranked(matches: DataFrame, limit: int) -> DataFrame:
    """Cut to the best rows and number them; ``bm25_score`` is positive."""
    top = matches.orderBy("bm25", "rowid").limit(limit)
    return top.select(
        "rowid",
        (-F.col("bm25")).alias("bm25_score"),
        F.row_number().over(Window.orderBy("bm25", "rowid")).alias("rank"),
    )
