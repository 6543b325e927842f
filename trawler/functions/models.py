"""Pluggable models: embedder, query expander, reranker.

The defaults need no network and always give the same answer.
"""

from __future__ import annotations

import hashlib
import random
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawler.config import EMBED_SEGMENT_CHARS
from trawler.functions.terms import EXPANSION_KINDS, has_negation, question_terms
from trawler.functions.text import trim_space


@dataclass(frozen=True)
class Expansion:
    """One typed sub-query: ``lex`` for words, ``vec`` and ``hyde`` for vectors."""

    kind: str
    text: str
    line: int = 0


class Embedder(Protocol):
    name: str

    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]: ...


class Expander(Protocol):
    def expand(self, query: str, intent: str = "") -> list[Expansion]: ...


class Reranker(Protocol):
    def scores(self, question: str, documents: DataFrame) -> DataFrame:
        """``id, file, text`` rows in; ``id, file, score`` rows out."""


class TransientError(Exception):
    """A call that may succeed later: rate limited or unavailable."""

    def __init__(self, message: str = "", retry_after: float = 0.0):
        super().__init__(message)
        self.retry_after = retry_after


class HashingEmbedder:
    """Signed feature hashing of words into a unit vector."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions
        self.name = f"hashing/{dimensions}"

    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimensions))
        for row, text in zip(out, texts):
            for word in text.lower().split():
                h = xxhash.xxh64_intdigest(word)
                row[h % self.dimensions] += 1.0 if h >> 63 else -1.0
        lengths = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, lengths, out=out, where=lengths > 0).astype(np.float32).tolist()


class RetryingEmbedder:
    """Repeat a remote embedder's call on ``TransientError``, with growing,
    jittered waits; each executor task holds its own copy."""

    def __init__(self, inner: Embedder, retries: int = 3, first_wait: float = 1.0, sleep=time.sleep):
        self.inner, self.retries, self.first_wait, self.sleep = inner, retries, first_wait, sleep
        self.name = inner.name

    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]:
        for attempt in range(self.retries + 1):
            try:
                return self.inner.embed_batch(texts)
            except TransientError as problem:
                if attempt == self.retries:
                    raise
                wait = self.first_wait * 2**attempt * random.uniform(0.75, 1.25)
                self.sleep(problem.retry_after or wait)
        raise AssertionError("unreachable")


class OverlapReranker:
    """Share of the question's terms a text contains."""

    def scores(self, question: str, documents: DataFrame) -> DataFrame:
        terms = question_terms(question)
        low = F.lower("text")
        hits = [F.contains(low, F.lit(t)).cast("double") for t in terms]
        score = reduce(lambda a, b: a + b, hits, F.lit(0.0)) / max(len(terms), 1)
        return documents.select("id", "file", score.alias("score"))


class TableReranker:
    """Scores that are already in a table with ``id`` or ``file``, and ``score``."""

    def __init__(self, scores: DataFrame):
        self._scores = scores

    def scores(self, question: str, documents: DataFrame) -> DataFrame:
        return self._scores


def is_instruct_model(name: str) -> bool:
    low = name.strip().lower()
    return "qwen" in low and "embed" in low


def query_input(model: str, query: str) -> str:
    query = query.strip()
    if is_instruct_model(model):
        return f"Instruct: Retrieve relevant documents for the given query\nQuery: {query}"
    return f"task: search result | query: {query}"


def document_input(model: str, title: Column, text: Column) -> Column:
    title, text = trim_space(title), trim_space(text)
    if is_instruct_model(model):
        return F.when(title != "", F.concat(title, F.lit("\n"), text)).otherwise(text)
    named = F.when(title != "", title).otherwise(F.lit("none"))
    return F.concat(F.lit("title: "), named, F.lit(" | text: "), text)


def _probe_document(model: str, title: str, text: str) -> str:
    return f"{title}\n{text}" if is_instruct_model(model) else f"title: {title} | text: {text}"


def fingerprint(
    model: str,
    chunk_tokens: int,
    chunk_overlap: float,
    probes: tuple[str, str, str] = ("__query_probe__", "__title_probe__", "__document_probe__"),
) -> str:
    """Six hex digits naming everything that shapes a vector.

    Pass the probe strings of an existing index to get its fingerprints.
    """
    query, title, text = probes
    lines = [
        f"model:{model.strip()}",
        f"query:{query_input(model, query)}",
        f"doc:{_probe_document(model, title, text)}",
        f"chunk_tokens:{chunk_tokens}",
        f"chunk_overlap_tokens:{int(chunk_tokens * chunk_overlap)}",
    ]
    return hashlib.sha256("\n".join(lines).encode("utf-8")).hexdigest()[:6]


def embed_long(embedder: Embedder, texts: Sequence[str]) -> list[list[float]]:
    """Embed texts of any length: pieces of 5000 characters, then their mean."""
    pieces, owner = [], []
    for i, text in enumerate(texts):
        for a in range(0, len(text), EMBED_SEGMENT_CHARS):
            piece = text[a : a + EMBED_SEGMENT_CHARS]
            if piece.strip():
                pieces.append(piece)
                owner.append(i)
    if len(set(owner)) != len(texts):
        raise ValueError("cannot embed blank text")
    vectors = np.array(embedder.embed_batch(pieces), dtype=np.float32)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    counts = np.diff(first, append=len(owner)).astype(np.float32)
    return (np.add.reduceat(vectors, first, axis=0) / counts[:, None]).tolist()


def embed_rows(rows: DataFrame, text: str, embedder: Embedder) -> DataFrame:
    """Replace the ``text`` column by ``embedding``, one batch call per Arrow batch."""
    keep = [c for c in rows.columns if c != text]
    schema = T.StructType(
        [rows.schema[c] for c in keep] + [T.StructField("embedding", T.ArrayType(T.FloatType()))]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = embed_long(embedder, batch[text].tolist()) if len(batch) else []
            yield batch[keep].assign(embedding=pd.Series(vectors, index=batch.index, dtype=object))

    return rows.mapInPandas(run, schema)


def check_expansions(expansions: Sequence[Expansion]) -> None:
    """Reject sub-queries that no backend can run."""
    for e in expansions:
        where = f"Line {e.line}" if e.line else "Structured search"
        text = e.text.strip()
        if e.kind not in EXPANSION_KINDS:
            continue
        if "\n" in text or "\r" in text:
            raise ValueError(f"{where} ({e.kind}): queries must be single-line")
        if e.kind == "lex" and text.count('"') % 2:
            raise ValueError(f"{where} ({e.kind}): lex query has an unmatched double quote")
        if e.kind != "lex" and has_negation(text):
            raise ValueError(f"{where} ({e.kind}): Negation (-term) is not supported in vec/hyde queries")


def primary_question(expansions: Sequence[Expansion]) -> str:
    """The first lex text, else the first vec text, else any text."""
    for kinds in (("lex",), ("vec",), EXPANSION_KINDS):
        for e in expansions:
            if e.text.strip() and (e.kind in kinds):
                return e.text.strip()
    return ""


def expand(expander: Expander | None, query: str, intent: str = "") -> list[Expansion]:
    """Expansions that differ from the query itself."""
    found = expander.expand(query, intent) if expander else []
    return [e for e in found if e.text.strip() != query]


def vector_texts(expander: Expander | None, query: str, intent: str = "") -> list[str]:
    """The query and its distinct semantic expansions, in order."""
    texts = [query.strip()]
    for e in expander.expand(query, intent) if expander else []:
        if e.kind in ("vec", "hyde") and e.text.strip():
            texts.append(e.text.strip())
    return list(dict.fromkeys(texts))
