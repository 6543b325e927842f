"""The registered queries over the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawler.config import VECTOR_SEARCH_MIN_SCORE
from trawler.functions import text as tx
from trawler.functions.globs import included
from trawler.functions.lexquery import parse_any
from trawler.functions.models import Expansion, TableReranker
from trawler.functions.terms import rerank_score
from trawler.functions.vectors import cosine, l2_normalize, norm
from trawler.functions.wiki import matches_any, table_rows
from trawler.operators import catalog, fusion, lexical, sessions, vector, wiki
from trawler.operators.chunking import chunk_documents
from trawler.plans.query import QueryOptions, hybrid_query, query_collections
from trawler.session import settle, ship_package, spread
from trawler.streaming.events import normalize
from trawler.sources.tables import corpus_files, table, table_index

COLLECTIONS = ["de", "en", "es", "fr"]
HIT = ["rowid", "collection", "rel_path"]


def _score(name: str = "score"):
    return F.round(name, 9).alias(name)


def _hits(df: DataFrame) -> DataFrame:
    return df.select(*HIT, _score(), "bm25_rank")


def _search(spark, sf_dir, query, collection="", limit=20, min_score=0.0):
    ix = table_index(spark, sf_dir)
    return _hits(
        lexical.search(
            ix.terms, ix.documents, query, collection, limit, min_score, ix.settings.docs_per_shard
        )
    )


def lex_prefix_bm25(spark, sf_dir):
    return _search(spark, sf_dir, "enheit")


def lex_and_not(spark, sf_dir):
    return _search(spark, sf_dir, "tion the -queque -of.en")


def lex_phrase(spark, sf_dir):
    return _search(spark, sf_dir, '"of the"')


def lex_fielded_weights(spark, sf_dir):
    return _search(spark, sf_dir, "src3 the", limit=50)


def lex_candidate_cut(spark, sf_dir):
    return _search(spark, sf_dir, "tion", "fr", limit=5)


def lex_min_score(spark, sf_dir):
    return _search(spark, sf_dir, "ciónas", min_score=0.82, limit=100)


def lex_hyphen_dotted(spark, sf_dir):
    return _search(spark, sf_dir, "to-the en.src1", limit=30)


def search_many_rrf(spark, sf_dir):
    ix = table_index(spark, sf_dir)
    fused = lexical.search_many(
        ix.terms, ix.documents, ["tion", "of the", "ndtion"], limit=20,
        docs_per_shard=ix.settings.docs_per_shard,
    )
    return fused.select("rowid", "collection", "rel_path", _score(), "bm25_rank")


def search_fanout(spark, sf_dir):
    """Two target collections: a wide global search, then filter and cut."""
    ix = table_index(spark, sf_dir)
    hits = lexical.search(ix.terms, ix.documents, "tion", "", max(50, 2 * 10), 0.0, ix.settings.docs_per_shard)
    kept = hits.filter(F.col("collection").isin("de", "en")).orderBy("bm25_rank").limit(10)
    return _hits(kept)


def _folder_search(spark, sf_dir, queries):
    """Fused search over all collections, cut to 50, then one folder kept; without hits, a substring search there."""
    ix = table_index(spark, sf_dir)
    fused = lexical.search_many(ix.terms, ix.documents, queries, limit=50, docs_per_shard=ix.settings.docs_per_shard)
    hits = fused.filter(F.col("rel_path").startswith("src1/")).select("rowid", "rel_path", _score())
    inside = corpus_files(spark, sf_dir).filter(F.col("rel_path").startswith("src1/"))
    found = inside.filter(matches_any(queries, F.col("body"))).select("rowid", "rel_path")
    return fusion.first_or_else(hits, found).withColumn("score", F.coalesce("score", F.lit(-1.0)))


def page_folder_search(spark, sf_dir):
    return _folder_search(spark, sf_dir, ["tion", "src1"])


def page_folder_fallback(spark, sf_dir):
    """No word begins like this, but texts hold it."""
    return _folder_search(spark, sf_dir, ["ngth", "itung"])


def lex_all_matches(spark, sf_dir):
    """All documents that either search matches, unranked."""
    ix = table_index(spark, sf_dir)
    found = lexical.all_matches(ix.terms, ix.documents, ["enheit", '"of the"'], 0.1)
    return found.select("rowid", "collection", _score())


def legacy_or_search(spark, sf_dir):
    ix = table_index(spark, sf_dir)
    matches = lexical.bm25_matches(ix.entries, parse_any("the queque of enlich-es"))
    tagged = ix.documents.filter(F.col("collection").ilike("%e%")).select(*HIT)
    kept = matches.join(tagged.select("rowid"), "rowid", "left_semi")
    top = lexical.ranked(kept, 10)
    return fusion.fetch(tagged, top, "rowid", 10).select(*HIT, _score("bm25_score"), "rank")


def _chunk_hits(ix, query, limit):
    top = lexical.ranked(lexical.bm25_matches(ix.chunk_terms, parse_any(query)), limit)
    top = top.withColumnRenamed("rowid", "chunk_rowid")
    chunks = ix.chunks.select("chunk_rowid", "chunk_id", "doc_id", F.col("rowid"), "chunk_index")
    return fusion.fetch(chunks, top, "chunk_rowid", limit)


def chunk_search(spark, sf_dir):
    ix = table_index(spark, sf_dir)
    return _chunk_hits(ix, "enheit queque", 20).select("rowid", "chunk_index", _score("bm25_score"), "rank")


def chunk_multi_rrf(spark, sf_dir):
    ix = table_index(spark, sf_dir)
    lists = [
        _chunk_hits(ix, q, 20).withColumnRenamed("bm25_score", "score") for q in ("tion", "ndtion", "of")
    ]
    top = fusion.rank_fusion(lists, ["chunk_rowid", "rowid", "chunk_index"], 20)
    return top.select("rowid", "chunk_index", F.round("rrf", 9).alias("rrf"), "rank")


def chunk_doc_ids(spark, sf_dir):
    """Documents of the chunk hits, in order of their best chunk."""
    return fusion.document_order(_chunk_hits(table_index(spark, sf_dir), "tion the", 50), "rowid")


def _stemmed(spark, sf_dir, query, limit=20):
    ix = table_index(spark, sf_dir, "porter")
    return _hits(lexical.search(ix.terms, ix.documents, query, limit=limit, docs_per_shard=ix.settings.docs_per_shard))


def porter_search(spark, sf_dir):
    """Two searches of the stemmed index."""
    return _stemmed(spark, sf_dir, "tions estional").unionByName(_stemmed(spark, sf_dir, "ering", 30))


def porter_phrase(spark, sf_dir):
    return _stemmed(spark, sf_dir, '"the ered" -queques')


def porter_chunk_search(spark, sf_dir):
    ix = table_index(spark, sf_dir, "porter")
    return _chunk_hits(ix, "ering estions", 20).select("rowid", "chunk_index", _score("bm25_score"), "rank")


# --- vectors ---------------------------------------------------------------


def _query_vectors(spark, sf_dir, *ids) -> list[list[float]]:
    """Query vectors: one stored vector plus half of the next one, each."""
    wanted = sorted({i for at in ids for i in (at, at + 1)})
    rows = table(spark, sf_dir, "embeddings").filter(F.col("vec_id").isin(*wanted)).collect()
    by_id = {r.vec_id: r.embedding for r in rows}
    return [[x + 0.5 * y for x, y in zip(by_id[i], by_id[i + 1])] for i in ids]


class _StoredEmbedder:
    """Answers each text with a stored vector, in order."""

    name = "stored"

    def __init__(self, vectors):
        self._vectors = vectors

    def embed_batch(self, texts):
        return self._vectors[: len(texts)]


def _plain_vectors(spark, sf_dir):
    ship_package(spark)
    return table(spark, sf_dir, "embeddings").select(
        F.format_string("v%08d", "vec_id").alias("chunk_id"),
        F.col("vec_id").cast("string").alias("doc_id"),
        "embedding",
    )


def _near(df: DataFrame) -> DataFrame:
    return df.select("chunk_id", _score())


def knn_cosine(spark, sf_dir):
    (q,) = _query_vectors(spark, sf_dir, 0)
    return _near(vector.nearest_chunks(_plain_vectors(spark, sf_dir), [q], 20, "cosine"))


def knn_l2_rescored(spark, sf_dir):
    (q,) = _query_vectors(spark, sf_dir, 1)
    return _near(vector.nearest_chunks(_plain_vectors(spark, sf_dir), [q], 60, "l2"))


def knn_filtered_docs(spark, sf_dir):
    """Nearest chunks among the documents a lexical search found."""
    ix = table_index(spark, sf_dir)
    (q,) = _query_vectors(spark, sf_dir, 2)
    hits = lexical.search(ix.terms, ix.documents, "the", "", 250, 0.0, ix.settings.docs_per_shard)
    ids = hits.select(F.col("id").alias("doc_id"))
    return _near(vector.nearest_in_documents(ix.vectors, q, ids, 20))


def knn_best_per_doc(spark, sf_dir):
    (q,) = _query_vectors(spark, sf_dir, 3)
    near = vector.nearest_chunks(table_index(spark, sf_dir).vectors, [q], 60, "cosine")
    return vector.best_chunk_per_document(near, ["doc_id"]).select("doc_id", "chunk_id", _score())


def _vector_hits(spark, sf_dir, ids, collection, limit, min_score):
    ix = table_index(spark, sf_dir)
    hits = vector.vector_search(
        table_index(spark, sf_dir).vectors, ix.documents, _query_vectors(spark, sf_dir, *ids), collection,
        limit, min_score,
    )
    return hits.select("rowid", "collection", "chunk_id", _score(), "vector_rank")


def knn_variants_max(spark, sf_dir):
    return _vector_hits(spark, sf_dir, (0, 1, 2), "", 10, -2.0)


def search_vector_collection(spark, sf_dir):
    return _vector_hits(spark, sf_dir, (4,), "en", 20, -2.0)


def vector_min_score(spark, sf_dir):
    return _vector_hits(spark, sf_dir, (5, 6), "", 10, VECTOR_SEARCH_MIN_SCORE)


def vector_mean_pool(spark, sf_dir):
    pooled = vector.mean_pool(table(spark, sf_dir, "embeddings"), "label")
    return pooled.select("label", F.posexplode("embedding").alias("at", "x")).select(
        "label", "at", _score("x")
    )


def vector_l2_normalize(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    tripled = F.transform("embedding", lambda x: x.cast("double") * 3)
    unit = rows.select("vec_id", l2_normalize(tripled).alias("unit"))
    return unit.select("vec_id", F.round(norm(F.col("unit")), 6).alias("length"),
                       F.round(F.col("unit")[0], 6).alias("first"))


def doc_vector_knn(spark, sf_dir):
    """One vector per document (the mean of its chunks), nearest to a query."""
    (q,) = _query_vectors(spark, sf_dir, 7)
    pooled = vector.pooled(table_index(spark, sf_dir).document_vectors, "doc_id")
    like = F.array(*[F.lit(float(x)) for x in q])
    scored = pooled.select("doc_id", cosine(F.col("embedding"), like).alias("score"))
    return scored.orderBy(F.desc("score"), "doc_id").limit(10).select("doc_id", _score())


def doc_vector_upsert(spark, sf_dir):
    """Document vectors after every third document was embedded anew and every seventh deleted."""
    ix = table_index(spark, sf_dir)
    again = ix.vectors.filter(F.col("doc_rowid") % 3 == 0).select(
        "doc_id", "doc_rowid", F.transform(F.slice("embedding", 1, 32), lambda x: x * 2).alias("embedding")
    )
    stored = vector.upsert_document_vectors(ix.document_vectors, again)
    stored = vector.delete_document_vectors(stored, ix.vectors.filter(F.col("doc_rowid") % 7 == 0))
    mean = vector.pooled(stored, "doc_id")
    return mean.select("doc_id", F.size("embedding").alias("width"), F.round(F.col("embedding")[0], 9).alias("head"))


def vector_upsert(spark, sf_dir):
    """The newest vector of every chunk, some of another width than before."""
    old = table_index(spark, sf_dir).vectors.select("chunk_id", "vec_id", "embedding", F.lit(1).alias("rev"))
    new = old.filter(F.col("vec_id") % 3 == 0).withColumn("embedding", F.slice("embedding", 1, 16)).withColumn("rev", F.lit(2))
    newest = catalog.newest_vectors(old.unionByName(new), "rev")
    return newest.select("chunk_id", "rev", F.size("embedding").alias("width"))


# --- hybrid ----------------------------------------------------------------


def _corpus(spark, sf_dir, ids, reranker=None, stemmer="none"):
    return table_index(spark, sf_dir, stemmer).corpus(
        embedder=_StoredEmbedder(_query_vectors(spark, sf_dir, *ids)),
        reranker=reranker,
        contexts=settle(_contexts(spark, sf_dir)),
        global_context="all documents",
    )


def _hybrid(spark, sf_dir, question, ids, reranker=None, **options):
    corpus = _corpus(spark, sf_dir, ids, reranker)
    return hybrid_query(corpus, question, QueryOptions(**options))


def hybrid_rrf(spark, sf_dir):
    hits = _hybrid(spark, sf_dir, "enheit the", (0,), limit=20)
    return hits.select("id", "collection", "path", _score(), "bm25_rank", "vector_rank", "context",
                       "doc_id", "chunk_id", "best_chunk_pos")


def hybrid_rrf_explain(spark, sf_dir):
    hits = _hybrid(spark, sf_dir, "tion", (8,), limit=40, explain=True)
    rrf = "explain.rrf"
    return hits.select(
        "id",
        F.col(f"{rrf}.rank").alias("rank"),
        F.col(f"{rrf}.top_rank").alias("top_rank"),
        F.round(f"{rrf}.base_score", 9).alias("base_score"),
        F.round(f"{rrf}.total_score", 9).alias("total_score"),
        F.round(f"{rrf}.top_rank_bonus", 9).alias("bonus"),
        F.size(f"{rrf}.contributions").alias("lists"),
        F.round(F.coalesce(F.try_element_at("explain.fts_scores", F.lit(1)), F.lit(-9.0)), 6).alias("fts_score"),
        F.round(F.coalesce(F.try_element_at("explain.vector_scores", F.lit(1)), F.lit(-9.0)), 6).alias("vec_score"),
    )


def porter_hybrid(spark, sf_dir):
    """The hybrid query over the stemmed index."""
    corpus = _corpus(spark, sf_dir, (12,), stemmer="porter")
    hits = hybrid_query(corpus, "ering estions", QueryOptions(limit=40, explain=True))
    rrf = "explain.rrf"
    return hits.select(
        "id",
        F.col(f"{rrf}.rank").alias("rank"),
        F.round(f"{rrf}.base_score", 9).alias("base_score"),
        F.round(f"{rrf}.total_score", 9).alias("total_score"),
        F.size(f"{rrf}.contributions").alias("lists"),
    )


def hybrid_structured_weights(spark, sf_dir):
    typed = [
        Expansion("vec", "meaning of it"),
        Expansion("lex", "zzzabsent"),
        Expansion("lex", "ndtion"),
        Expansion("hyde", "an answer"),
    ]
    hits = _hybrid(spark, sf_dir, "", (1, 2), queries=typed, limit=30, explain=True)
    first = F.col("explain.rrf.contributions")[0]
    return hits.select(
        "id", _score(), F.round("explain.rrf.total_score", 9).alias("total_score"),
        first["list_index"].alias("list_index"), first["weight"].alias("weight"),
    )


def hybrid_search_queries(spark, sf_dir):
    hits = _hybrid(
        spark, sf_dir, "ndtion", (3,), search_queries=["of the", "queque"], limit=30, explain=True
    )
    return hits.select("id", _score(), F.round("explain.rrf.total_score", 9).alias("total_score"),
                       F.col("explain.rrf.contributions")[0]["list_index"].alias("list_index"))


def rerank_blend(spark, sf_dir):
    """Blend with the quality labels as outside scores."""
    files = corpus_files(spark, sf_dir)
    ids = files.select(F.col("rowid").alias("doc_id"), tx.document_id(F.col("collection"), F.col("rel_path")).alias("id"))
    scores = table(spark, sf_dir, "labels").join(ids, "doc_id").select("id", F.col("quality").cast("double").alias("score"))
    hits = _hybrid(spark, sf_dir, "tion", (9,), reranker=TableReranker(scores), limit=20, explain=True)
    return hits.select("id", _score(), F.col("explain.rrf.weight").alias("weight"),
                       F.col("explain.rerank_score").alias("rerank_score"))


def query_merge_collections(spark, sf_dir):
    corpus = _corpus(spark, sf_dir, (10,))
    merged = query_collections(corpus, "tion", COLLECTIONS, QueryOptions(limit=15))
    return merged.select("collection", "path", _score())


def rrf_two_lists(spark, sf_dir):
    """Plain fusion of one lexical and one vector list."""
    ix = table_index(spark, sf_dir)
    lex = lexical.search(ix.terms, ix.documents, "ndtion", "", 20, 0.0, ix.settings.docs_per_shard)
    vec = vector.vector_search(
        table_index(spark, sf_dir).vectors, ix.documents, _query_vectors(spark, sf_dir, 11), "", 20
    )
    lists = [lex.withColumnRenamed("bm25_rank", "rank"), vec.withColumnRenamed("vector_rank", "rank")]
    return fusion.rank_fusion(lists, ["id"], 20).select("id", F.round("rrf", 9).alias("rrf"))


def best_query_chunk(spark, sf_dir):
    """The best passage of every document for one question and intent."""
    ix = table_index(spark, sf_dir)
    best = fusion.best_chunks(ix.chunks, "tion of the enheit", "find the queque of ndtion")
    return best.select("doc_id", "chunk_id", "best_chunk_pos", "overlap")


# --- documents -------------------------------------------------------------


def doc_title_snippet(spark, sf_dir):
    files = spread(corpus_files(spark, sf_dir), "rowid")
    return files.select(
        "rowid", tx.title(F.col("body"), F.col("rel_path")).alias("title"), tx.snippet(F.col("body")).alias("snippet")
    )


def doc_ids_hashes(spark, sf_dir):
    full = tx.content_hash(F.col("body"))
    return corpus_files(spark, sf_dir).select(
        "rowid",
        tx.document_id(F.col("collection"), F.col("rel_path")).alias("id"),
        full.alias("hash"),
        tx.short_hash(full).alias("short"),
        tx.document_uri("doc", F.col("collection"), F.col("rel_path")).alias("uri"),
    )


def _contexts(spark, sf_dir) -> DataFrame:
    """Context rows from the corpus: one per source, one per language."""
    files = table(spark, sf_dir, "documents").select("lang", "source")
    per_source = files.distinct().select(
        F.col("lang").alias("collection"),
        F.concat(F.lit("/"), "source").alias("prefix"),
        F.concat(F.lit("source "), "source", F.lit(" in "), "lang").alias("text"),
    )
    odd = per_source.filter(~F.col("prefix").isin("/src3", "/src7", "/src9"))
    per_lang = files.select("lang").distinct().filter(F.col("lang") != "es").select(
        F.col("lang").alias("collection"), F.lit("/").alias("prefix"), F.concat(F.lit("language "), "lang").alias("text")
    )
    return odd.unionByName(per_lang)


def context_longest_prefix(spark, sf_dir):
    docs = corpus_files(spark, sf_dir).select("rowid", "collection", "rel_path")
    return fusion.with_context(docs, _contexts(spark, sf_dir), "all documents").select("rowid", "context")


def chunk_markdown(spark, sf_dir):
    ship_package(spark)
    chunks = chunk_documents(spread(corpus_files(spark, sf_dir), "rowid"), ["rowid"])
    return chunks.select(
        "rowid", "chunk_index", "start_offset", "end_offset", "heading", F.md5(F.col("content").cast("binary")).alias("content_md5")
    )


def token_estimate(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"), "doc_id")
    return docs.select("doc_id", tx.estimate_tokens(F.col("text")).alias("estimate"))


def glob_filter(spark, sf_dir):
    files = corpus_files(spark, sf_dir)
    wanted = included(F.col("rel_path"), ["src1/*.md", "**/*[05].md", "src2?/*"], ["src15/*", "**/1*0.md"])
    return files.filter(wanted).select("rowid", "rel_path")


def slugify(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("name"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return pages.unionByName(parts).select("id", tx.slug(F.col("name")).alias("slug"))


def haystack_search(spark, sf_dir):
    files = spread(corpus_files(spark, sf_dir), "rowid").withColumn("title", tx.title(F.col("body"), F.col("rel_path")))
    parsed = files.select(
        "rel_path", "title", F.col("title").alias("slug"), F.lit("").alias("summary"), F.col("body").alias("text")
    )
    return wiki.search_pages(parsed, ["queque", " ENHEIT "])


def rerank_parse(spark, sf_dir):
    """Read every benchmark text and document start as a reranker's answer."""
    texts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("score: "), F.when(F.col("p_size") > 40, "-").otherwise(""), F.lit("0."), F.col("p_size").cast("string")).alias("text")
    )
    return texts.unionByName(parts).select("id", "text", rerank_score(F.col("text")).alias("score"))


# --- catalog ---------------------------------------------------------------


def _stored(spark, sf_dir) -> DataFrame:
    """Documents with catalog columns taken from the labels: toxic documents
    are inactive, and the last change is the day number of the quality."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("rowid"), "quality", "toxic")
    files = corpus_files(spark, sf_dir).drop("active").join(labels, "rowid", "left")
    return files.select(
        "rowid",
        tx.document_id(F.col("collection"), F.col("rel_path")).alias("id"),
        "collection",
        "rel_path",
        "body",
        "quality",
        (F.coalesce("toxic", F.lit(0)) == 0).alias("active"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("rowid") % 365).cast("int")).cast("string").alias("updated_at"),
    )


def collection_stats(spark, sf_dir):
    langs = table(spark, sf_dir, "documents").select(F.col("lang").alias("name")).distinct()
    empty = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"))
    return catalog.collection_stats(langs.unionByName(empty), _stored(spark, sf_dir).drop("body"))


def index_status(spark, sf_dir):
    ix = table_index(spark, sf_dir)
    docs = _stored(spark, sf_dir).select("id", "active")
    return catalog.index_status(docs, ix.chunks.select("doc_id"), table_index(spark, sf_dir).vectors.select("doc_id"))


def embed_pending(spark, sf_dir):
    ix = table_index(spark, sf_dir)
    docs = _stored(spark, sf_dir).select("id", "collection", "rel_path", "active")
    state = catalog.embedding_state(docs, ix.chunks.select("doc_id"), table_index(spark, sf_dir).vectors.select("doc_id"))
    return state.filter(catalog.needs_embedding()).select("collection", "rel_path", "chunks", "vectors")


def incremental_diff(spark, sf_dir):
    """Scan result against a stored state: labelled documents are known, those
    of low quality with other content, and every page file has gone."""
    scanned = corpus_files(spark, sf_dir).withColumn("hash", tx.content_hash(F.col("body")))
    stored = _stored(spark, sf_dir).filter(F.col("quality").isNotNull())
    known = stored.select(
        "collection", "rel_path", "active",
        tx.content_hash(F.when(F.col("quality") == 1, F.col("body")).otherwise(F.concat("body", F.lit("!")))).alias("hash"),
    )
    gone = table(spark, sf_dir, "pages").select(
        F.lit("web").alias("collection"), F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("rel_path"), F.lit(True).alias("active"),
        tx.content_hash(F.col("html")).alias("hash"),
    )
    changes = catalog.file_changes(scanned, known.unionByName(gone))
    return changes.select("collection", "rel_path", "status")


def index_counts(spark, sf_dir):
    """Entries, chunks, vectors and the widest vector, as one row."""
    ix = table_index(spark, sf_dir)
    count = lambda df: df.agg(F.count("*")).scalar()
    return table(spark, sf_dir, "embeddings").agg(
        F.count("*").alias("vectors"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dimensions")
    ).select(
        count(ix.documents).alias("entries"), count(ix.chunks).alias("chunks"), "vectors", "dimensions"
    )


# --- pages -----------------------------------------------------------------


def _wiki_pages(spark, sf_dir) -> DataFrame:
    """A topic page per document: without good quality it lacks the core section,
    unless known as not toxic the explanation, and German ones have no title."""
    labels = table(spark, sf_dir, "labels")
    docs = spread(table(spark, sf_dir, "documents"), "doc_id").join(labels, "doc_id", "left")
    clean = F.regexp_replace("text", "[<>]", " ")

    def section(name, when):
        marked = F.concat(F.lit(f"<!-- kb:section id={name} -->\n"), clean, F.lit("\n<!-- /kb:section -->\n"))
        return F.when(when, marked).otherwise(F.lit(""))

    title = F.when(F.col("lang") != "de", F.concat(F.lit("title: Doc "), F.col("doc_id").cast("string"), F.lit("\n"))).otherwise(F.lit(""))
    head = F.concat(F.lit("---\n"), title, F.lit("kind: topic\nevidence:\n  - title: nested\nsummary: '"), "source", F.lit("'\n---\n"))
    return docs.select(
        "doc_id",
        F.concat(F.lit("wiki/topics/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("rel_path"),
        F.concat(head, section("card", F.lit(True)), section("core", F.col("quality") == 1), section("explain", F.col("toxic") == 0)).alias("text"),
    )


def wiki_page_parse(spark, sf_dir):
    parsed = wiki.parse_pages(_wiki_pages(spark, sf_dir))
    return parsed.select(
        "doc_id", "title", "slug", "kind", "summary",
        F.array_join(F.array_sort(F.map_keys("sections")), ",").alias("section_names"),
        F.char_length(F.col("sections")["card"]).alias("card_chars"),
    )


def wiki_document_check(spark, sf_dir):
    return wiki.check_documents(_wiki_pages(spark, sf_dir))


def _table_files(spark, sf_dir) -> DataFrame:
    """One index file per nation whose table lists its customers."""
    row = F.concat(F.lit("| "), "c_mktsegment", F.lit(" | about "), "c_name", F.lit(" | "), "c_name", F.lit(" |"))
    customers = table(spark, sf_dir, "customer").select("c_nationkey", F.struct("c_custkey", row.alias("line")).alias("r"))
    lines = customers.groupBy("c_nationkey").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: r["line"]), "\n")
    nations = table(spark, sf_dir, "nation")
    return nations.join(lines, nations.n_nationkey == lines.c_nationkey).select(
        "n_nationkey",
        F.concat(F.lit("wiki/"), F.lower("n_name"), F.lit(".md")).alias("rel_path"),
        F.concat(F.lit("# "), "n_name", F.lit("\n\n| type | description | slug |\n| --- | :-: | --- |\n"), body, F.lit("\n\n| other | table |\n| x | y |\n")).alias("text"),
    )


def wiki_table_search(spark, sf_dir):
    return wiki.search_table(_table_files(spark, sf_dir), "index", ["building", "00001"])


def wiki_table_terms(spark, sf_dir):
    files = _table_files(spark, sf_dir)
    return files.select("n_nationkey", F.size(table_rows(F.col("text"))).alias("row_count"))


# --- sessions --------------------------------------------------------------


def _sessions(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.col("user_id").cast("string").alias("id")).agg(
        F.max("ts").alias("updated_at"), F.min("ts").alias("created_at"), F.count("*").alias("events"),
        F.min_by("event_type", F.struct("ts", "event_id")).alias("agent_id"),
    )


def session_list(spark, sf_dir):
    return sessions.list_sessions(_sessions(spark, sf_dir), "", 500).select("id", "updated_at", "events")


def session_list_agent(spark, sf_dir):
    return sessions.list_sessions(_sessions(spark, sf_dir), "click", 20).select("id", "updated_at", "agent_id")


def session_update(spark, sf_dir):
    """Update sessions from purchases: every purchase day is a run id."""
    base = _sessions(spark, sf_dir).select(
        "id", "updated_at", F.lit("idle").alias("status"), F.lit("").alias("last_run_id"),
        F.concat(F.lit("thr_"), "id").alias("backend_thread_id"),
    )
    bought = table(spark, sf_dir, "events").filter(F.col("event_type") == "purchase")
    last = bought.groupBy(F.col("user_id").cast("string").alias("id")).agg(
        F.max("ts").alias("updated_at"),
        F.max_by(F.when(F.col("value") > 20, F.col("event_id").cast("string")).otherwise(F.lit("")), F.struct("ts", "event_id")).alias("last_run_id"),
    ).withColumn("status", F.when(F.col("last_run_id") == "", "").otherwise("running")).withColumn("backend_thread_id", F.lit(""))
    return sessions.update_sessions(base, last)


def session_edit(spark, sf_dir):
    """Rename the sessions that bought something, then delete every seventh."""
    base = _sessions(spark, sf_dir).select("id", F.concat(F.lit("user "), "id").alias("title"), "updated_at")
    bought = table(spark, sf_dir, "events").filter(F.col("event_type") == "purchase")
    titles = bought.groupBy(F.col("user_id").cast("string").alias("id")).agg(F.max("ts").alias("updated_at"), F.count("*").alias("n"))
    named = titles.select("id", "updated_at", F.concat(F.lit("  "), F.repeat(F.concat("id", F.lit(" buys ")), F.col("n").cast("int"))).alias("title"))
    gone = base.filter(F.col("id").cast("long") % 7 == 0)
    return sessions.delete_sessions(sessions.rename_sessions(base, named), gone)


def message_ordinals(spark, sf_dir):
    """Position of every event in its user's log, in ranges of any user's rows."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    numbered = sessions.number_rows(events, "user_id", None, ["ts", "event_id"])
    return numbered.select("event_id", "user_id", "ordinal")


def message_upsert(spark, sf_dir):
    """Insert-or-replace per (conversation, role): the last turn stays."""
    rows = table(spark, sf_dir, "conversations").select(
        F.concat_ws("/", F.col("conv_id").cast("string"), "role").alias("id"), "turn", "text"
    )
    return sessions.last_write_wins(rows, "id", ["turn", "text"])


def latest_user_message(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))
    last = sessions.latest_user_message(rows, "conv_id", "turn")
    return last.select("conv_id", F.col("at").alias("turn"), sessions.auto_title(F.col("text")).alias("title"))


RUN_EVENTS = {"signup": "RUN_STARTED", "purchase": "RUN_FINISHED", "error": "RUN_ERROR"}


def run_status_fold(spark, sf_dir):
    kinds = F.create_map(*[F.lit(x) for pair in RUN_EVENTS.items() for x in pair])
    events = table(spark, sf_dir, "events").select(
        "user_id", "ts", "event_id", F.try_element_at(kinds, F.col("event_type")).alias("type")
    )
    return sessions.run_status(events, "user_id", F.struct("ts", "event_id"))


def _run_messages(spark, sf_dir) -> DataFrame:
    """The event log as agent messages of one run per user."""
    kind = (
        F.when(F.col("event_type").isin("view", "click"), "text")
        .when(F.col("event_type") == "purchase", "tool_use")
        .when(F.col("event_type") == "signup", "tool_result")
        .otherwise("error")
    )
    number = F.col("event_id").cast("string")
    return table(spark, sf_dir, "events").select(
        "user_id", "ts", "event_id", kind.alias("kind"),
        F.concat(F.lit("["), number, F.lit("]")).alias("content"),
        F.concat(F.lit("call"), number).alias("call_id"),
        F.lit("exec_command").alias("tool"),
        F.when(F.col("value") > 10, F.col("props")).otherwise(F.lit("")).alias("input"),
        F.when(F.col("value") > 10, F.col("props")).otherwise(F.lit("")).alias("output"),
    )


def event_text_runs(spark, sf_dir):
    events = sessions.fold_events(_run_messages(spark, sf_dir), "user_id", None, ["ts", "event_id"])
    return events.select(
        "user_id", F.coalesce("event_id", F.lit(-1)).alias("event_id"), "seq", "type",
        F.coalesce("message_no", F.lit(-1)).alias("message_no"),
        F.coalesce("call_id", F.lit("")).alias("call_id"), F.coalesce("body", F.lit("")).alias("body"),
    )


def event_saved_messages(spark, sf_dir):
    saved = sessions.saved_messages(_run_messages(spark, sf_dir), "user_id", None, ["ts", "event_id"])
    return saved.withColumn("tool_call_id", F.coalesce("tool_call_id", F.lit("")))


def _notifications(spark, sf_dir) -> DataFrame:
    """The event log as raw agent notifications, one run per user and day."""
    kind, number = F.col("event_type"), F.col("event_id").cast("string")
    mark = F.concat(F.lit("["), number, F.lit("]"))
    turn = F.element_at(F.array(*map(F.lit, ("completed", "failed", "interrupted", "failed"))), (F.col("event_id") % 4 + 1).cast("int"))
    reason = F.when(F.col("event_id") % 8 < 4, mark)

    def note(method: str, params) -> F.Column:
        return F.to_json(F.struct(F.lit(method).alias("method"), F.struct(params).alias("params")))

    command = F.struct(F.lit("commandExecution").alias("type"), number.alias("id"), mark.alias("command"), F.col("props").alias("aggregatedOutput"))
    raw = (
        F.when((kind == "view") & (F.col("event_id") % 3 == 0), F.to_json(F.struct(F.lit("agent_message").alias("type"), mark.alias("message"))))
        .when(kind == "view", note("item/agentMessage/delta", F.struct(mark.alias("delta")).alias("item")))
        .when(kind == "click", F.when(F.col("event_id") % 2 == 0, note("item/started", command.alias("item"))).otherwise(note("item/completed", command.alias("item"))))
        .when(kind == "signup", note("turn/started", F.struct(number.alias("id")).alias("turn")))
        .when((kind == "purchase") & (F.col("value") > 50), note("turn/completed", F.struct(turn.alias("status"), F.struct(reason.alias("message")).alias("error")).alias("turn")))
        .when(kind == "purchase", note("thread/status/changed", F.struct(F.lit("idle").alias("type")).alias("status")))
        .when(F.col("value") > 10, note("error", F.struct(mark.alias("message")).alias("error")))
        .otherwise(note("account/updated", F.lit(1).alias("n")))
    )
    run = F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string"))
    return table(spark, sf_dir, "events").select(run.alias("run_id"), "ts", "event_id", raw.alias("raw"))


def event_notifications(spark, sf_dir):
    """Raw notifications to client events: mapping, turn state and fold."""
    order = ["ts", "event_id"]
    messages = sessions.end_turns(normalize(_notifications(spark, sf_dir)), "run_id", order)
    events = sessions.fold_events(messages, "run_id", None, order)
    return events.select(
        "run_id", F.coalesce("event_id", F.lit(-1)).alias("event_id"), "seq", "type",
        F.coalesce("message_no", F.lit(-1)).alias("message_no"),
        F.coalesce("call_id", F.lit("")).alias("call_id"), F.coalesce("body", F.lit("")).alias("body"),
    )


def json_props(spark, sf_dir):
    props = sessions.json_map(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", F.try_element_at(props, F.lit("k")).cast("int").alias("k"))


QUERIES = {
    f.__name__: f
    for f in (
        lex_prefix_bm25, lex_and_not, lex_phrase, lex_fielded_weights, lex_candidate_cut, lex_min_score,
        lex_hyphen_dotted, search_many_rrf, search_fanout, page_folder_search, page_folder_fallback, lex_all_matches, legacy_or_search, chunk_search,
        chunk_multi_rrf, chunk_doc_ids, porter_search, porter_phrase, porter_chunk_search, porter_hybrid, knn_cosine, knn_l2_rescored, knn_filtered_docs,
        knn_best_per_doc, knn_variants_max, search_vector_collection, vector_min_score, vector_mean_pool,
        vector_l2_normalize, doc_vector_knn, doc_vector_upsert, vector_upsert, hybrid_rrf, hybrid_rrf_explain, hybrid_structured_weights,
        hybrid_search_queries, rerank_blend, query_merge_collections, rrf_two_lists, best_query_chunk,
        doc_title_snippet, doc_ids_hashes, context_longest_prefix, chunk_markdown, token_estimate,
        glob_filter, slugify, haystack_search, rerank_parse, collection_stats, index_status, embed_pending,
        incremental_diff, index_counts, wiki_page_parse, wiki_document_check, wiki_table_search,
        wiki_table_terms, session_list, session_list_agent, session_update, session_edit, message_ordinals,
        message_upsert, latest_user_message, run_status_fold, event_text_runs, event_saved_messages, event_notifications,
        json_props,
    )
}
