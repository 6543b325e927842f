"""Exact dedup by composable polynomial fingerprints.

A text is cut into chunks of bytes. Each chunk is hashed on its own modulo two
primes, and the hash of a text is the sum of its chunk hashes, each shifted by
the number of bytes that follow it: ``h(a + b) = h(a) * r^len(b) + h(b)``. The
sum does not care about order, but all chunks of a text are hashed and added up in
the task that holds the text. Texts whose fingerprint and length agree are then
compared chunk by chunk: per (fingerprint, chunk) the smallest and the largest
chunk must be the same bytes. Both combine before the shuffle, so a group that
holds a third of all rows sends one chunk per task and never meets in one place.
Should the comparison fail, the group is split by the SHA-256 of its texts.

Null and empty text are equal. Rows that repeat (id and text) count in the size
of their group and exactly one of them stays. A null id is the smallest; a group
without any id keeps one of its rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawler.llm import textbytes as tb
from trawler.llm.frames import settled, small

PRIMES = (2147483647, 2147483629)
RADIX = (1103515245, 1664525)
CHUNK_BYTES = 1 << 16

_SCHEMA = "doc_id long, bytes long, h1 long, h2 long, text_sha256 string"
_CHUNKS = "bytes long, h1 long, h2 long, chunk_no long, chunk binary"
_KEY = ["bytes", "h1", "h2"]


def powers(radix: int, prime: int, n: int) -> np.ndarray:
    """radix^0 .. radix^(n-1) modulo prime, by doubling."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    have = 1
    while have < n:
        step = min(have, n - have)
        out[have : have + step] = out[:step] * np.uint64(pow(radix, have, prime)) % np.uint64(prime)
        have += step
    return out[:n]


_tables: dict[tuple, np.ndarray] = {}


def _table(radix: int, prime: int, chunk: int) -> np.ndarray:
    if (radix, prime, chunk) not in _tables:
        _tables[radix, prime, chunk] = powers(radix, prime, chunk)
    return _tables[radix, prime, chunk]


def chunk_hashes(data: np.ndarray, bounds: np.ndarray, radix: int, prime: int, chunk: int = CHUNK_BYTES) -> np.ndarray:
    """Hash of each range ``bounds[k]:bounds[k+1]``, none longer than ``chunk``."""
    lengths = np.diff(bounds)
    place = np.repeat(bounds[1:], lengths) - 1 - np.arange(len(data))
    # A term has at most 9 + 31 bits; sums over a slice stay below 2^64, and
    # differences of wrapped sums would still be right.
    terms = (data.astype(np.uint64) + np.uint64(1)) * _table(radix, prime, chunk)[place]
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(terms, out=total[1:])
    return (total[bounds[1:]] - total[bounds[:-1]]) % np.uint64(prime)


def combine(left: int, right: int, right_bytes: int, radix: int, prime: int) -> int:
    """Hash of two texts put together, from their hashes."""
    return (left * pow(radix, right_bytes, prime) + right) % prime


def _chunk_bounds(offsets: np.ndarray, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """Cuts of all rows into chunks, and the first chunk of each row."""
    counts = -(-np.diff(offsets) // chunk)
    first = np.concatenate([[0], np.cumsum(counts)])
    within = np.arange(first[-1]) - np.repeat(first[:-1], counts)
    return np.append(np.repeat(offsets[:-1], counts) + within * chunk, offsets[-1]), first


def row_hashes(data: np.ndarray, offsets: np.ndarray, primes=PRIMES, chunk: int = CHUNK_BYTES) -> list[np.ndarray]:
    """The hash of every row under each prime, its chunks combined."""
    bounds, first = _chunk_bounds(offsets, chunk)
    counts = np.diff(first)
    out = []
    for radix, prime in zip(RADIX, primes, strict=True):
        hashes = chunk_hashes(data, bounds, radix, prime, chunk)
        rows = np.zeros(len(offsets) - 1, dtype=np.int64)
        rows[counts == 1] = hashes[first[:-1][counts == 1]]
        for k in np.flatnonzero(counts > 1):
            value = 0
            for c in range(first[k], first[k + 1]):
                value = combine(value, int(hashes[c]), int(bounds[c + 1] - bounds[c]), radix, prime)
            rows[k] = value
        out.append(rows)
    return out


def fingerprints(docs: DataFrame, primes=PRIMES) -> DataFrame:
    """doc_id, bytes, h1, h2, text_sha256 of every row."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in tb.texts(batch.column("text")):
                raw = data.tobytes()
                ends = zip(offsets[:-1], offsets[1:], strict=True)
                sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in ends]
                values = [np.diff(offsets), *row_hashes(data, offsets, primes), sha]
                ids = batch.column("doc_id").slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, values)], names=["doc_id", *_KEY, "text_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _SCHEMA)


def unequal_fingerprints(docs: DataFrame, shared: DataFrame, primes=PRIMES) -> DataFrame:
    """Of the fingerprints in ``shared``, those whose texts differ somewhere.

    Reads the texts once more and compares them chunk by chunk.
    """

    def run(batches):
        for batch in batches:
            for _, _, data, offsets in tb.texts(batch.column("text")):
                h1, h2 = row_hashes(data, offsets, primes)
                bounds, first = _chunk_bounds(offsets, CHUNK_BYTES)
                raw = data.tobytes()
                row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
                chunks = [raw[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                values = [np.diff(offsets)[row], h1[row], h2[row], np.arange(len(row)) - first[:-1][row]]
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, values), pa.array(chunks, pa.binary())], names=[*_KEY, "chunk_no", "chunk"]
                )

    chunks = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, _CHUNKS)
    compared = (
        chunks.join(shared, _KEY, "left_semi")
        .groupBy(*_KEY, "chunk_no")
        .agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
    )
    return compared.filter("low <> high").select(*_KEY).distinct()


def exact_dedup(docs: DataFrame, primes=PRIMES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id (largest id of
    the equal texts), group_size, kept, text_sha256."""
    rows = settled(fingerprints(docs, primes))
    shared = rows.groupBy(*_KEY).agg(F.count("*").alias("n")).filter("n > 1").select(*_KEY)
    unequal = settled(unequal_fingerprints(docs, small(settled(shared)), primes))
    if unequal.isEmpty():
        rows = rows.withColumn("part", F.lit(""))
    else:
        rows = rows.join(unequal.withColumn("unequal", F.lit(True)), _KEY, "left")
        rows = rows.withColumn("part", F.when(F.col("unequal"), F.col("text_sha256")).otherwise(F.lit("")))
    key = [*_KEY, "part"]
    sizes = settled(rows.groupBy(*key).agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id")))
    # Repeated rows fall together before the join and are dealt out again after it.
    own = rows.groupBy(*key, "doc_id").agg(F.count("*").alias("times"), F.first("text_sha256").alias("text_sha256"))
    joined = own.join(small(sizes), key)
    dealt = joined.select("*", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("nth"))
    return dealt.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        "text_sha256",
    )
