"""Host-level quality rules.

Every text is measured by rules on its own. The failures are added up by host,
the failure rate of each host is shrunk with a beta prior whose two parameters
are fitted to all hosts by moments (empirical Bayes), and the host verdict is
joined back: a document falls if it fails the rules itself, or if the lower
bound of its host's posterior rate lies above ``max_host_rate``.

The host is a column (``source`` in ``documents``); null and empty are one host.
Null text has no words and therefore fails. Each row is measured on its own, so
repeated rows give repeated results; a text is held whole in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawler.llm import textbytes as tb
from trawler.llm.frames import fold, settled, small

WINDOW = 5
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS.encode())] = True


def repeated_words(word_hash: np.ndarray, first: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Words of each row that lie in a window which its row holds twice or more."""
    n = len(word_hash)
    rows = len(first) - 1
    if n < window:
        return np.zeros(rows, dtype=np.int64)
    row = np.repeat(np.arange(rows), np.diff(first))
    at = n - window + 1
    combined = tb.mix(row[:at].astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    for k in range(window):
        combined = tb.mix(combined * np.uint64(0x9E3779B97F4A7C15) + word_hash[k : k + at])
    whole = np.flatnonzero(row[:at] == row[window - 1 :])
    _, back, times = np.unique(combined[whole], return_inverse=True, return_counts=True)
    hit = whole[times[back] > 1]
    cover = np.zeros(n + 1, dtype=np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + window, -1)
    return tb.sum_rows(np.cumsum(cover[:-1]) > 0, first)


def duplicate_lines(data, offsets, starts, hashes) -> np.ndarray:
    """Lines with a word that equal an earlier line of the same row."""
    breaks = np.flatnonzero(data == 0x0A)
    begin = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    end = np.sort(np.concatenate([breaks, offsets[1:]]))
    row = np.searchsorted(offsets, begin, "right") - 1
    # A break that ends its text, and an empty text, begin a line at the next row's offset.
    told = np.searchsorted(starts, end, "left") > np.searchsorted(starts, begin, "left")
    begin, end, row = begin[told], end[told], row[told]
    keyed = tb.mix(hashes.of(begin, end) + tb.mix(row.astype(np.uint64) + np.uint64(1)))
    distinct = row[np.unique(keyed, return_index=True)[1]]
    rows = len(offsets) - 1
    return np.bincount(row, minlength=rows) - np.bincount(distinct, minlength=rows)


def measure_slice(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The five counts of every row, in the order of ``COUNTS``."""
    starts, ends, first = tb.words(data, offsets)
    hashes = tb.SpanHash(data)
    leading = (data & 0xC0) != 0x80
    leading &= ~tb._SPACE[data]
    return [
        np.diff(first),
        tb.sum_rows(leading, offsets),
        tb.sum_rows(_SYMBOL[data], offsets),
        duplicate_lines(data, offsets, starts, hashes),
        repeated_words(hashes.of(starts, ends), first),
    ]


def _measured(batches):
    for batch in batches:
        text, rest = batch.column("text"), batch.column("doc_id")
        for lo, hi, data, offsets in tb.texts(text):
            counts = [pa.array(x.astype(np.int64)) for x in measure_slice(data, offsets)]
            yield pa.RecordBatch.from_arrays(
                [rest.slice(lo, hi - lo), batch.column("host").slice(lo, hi - lo), *counts],
                names=["doc_id", "host", *COUNTS],
            )


def base_failed():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def measure(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the counts of every row, and whether it fails the rules."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), fold(host).alias("host"), F.col("text").cast("string").alias("text")
    )
    columns = ", ".join(f"{c} long" for c in COUNTS)
    measured = rows.mapInArrow(_measured, f"doc_id long, host string, {columns}")
    return measured.withColumn("base_failed", base_failed())


def host_rates(measured: DataFrame, z: float = 1.96) -> DataFrame:
    """host, rows, failed, posterior rate and its lower bound.

    The prior Beta(a, b) matches mean and variance of the hosts' rates, the
    variance freed of what chance alone would give. With a single host, or no
    more spread than chance, the prior is as heavy as 1,000 documents.
    """
    hosts = settled(measured.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("k")))
    total = hosts.agg(
        F.sum("k").alias("k"),
        F.sum("n").alias("n"),
        F.count("*").alias("hosts"),
        F.sum((F.col("k") / F.col("n")) * F.col("k")).alias("kk"),
        F.sum(F.col("n") * F.col("n")).alias("nn"),
    ).first()
    if not total["n"]:
        mean, weight = 0.5, 1.0
    else:
        mean, n, m = total["k"] / total["n"], total["n"], total["hosts"]
        chance = mean * (1 - mean)
        # Weighted variance between hosts, less its expectation under one common rate.
        between = (total["kk"] - n * mean * mean) - (m - 1) * chance
        spread = between / (n - total["nn"] / n) if m > 1 and n > total["nn"] / n else 0.0
        weight = min(max(chance / spread - 1, 1.0), 1000.0) if spread > 0 else 1000.0
    a, b = mean * weight, (1 - mean) * weight
    alpha, beta = F.col("k") + F.lit(a), F.col("n") - F.col("k") + F.lit(b)
    rate = alpha / (alpha + beta)
    deviation = F.sqrt(rate * (1 - rate) / (alpha + beta + 1))
    return hosts.select(
        "host", "n", "k", rate.alias("host_rate"), F.greatest(F.lit(0.0), rate - z * deviation).alias("host_bound")
    )


def quality_rules(docs: DataFrame, host: str = "source", max_host_rate: float = 0.5) -> DataFrame:
    """Counts and verdicts per row: doc_id, the five counts, base_failed, kept,
    host, host_rate and host_bound."""
    measured = settled(measure(docs, host))
    rates = host_rates(measured).drop("n", "k")
    judged = measured.join(small(settled(rates)), "host")
    return judged.select(
        "doc_id",
        *COUNTS,
        "base_failed",
        (~F.col("base_failed") & (F.col("host_bound") <= max_host_rate)).alias("kept"),
        "host",
        F.round("host_rate", 9).alias("host_rate"),
        F.round("host_bound", 9).alias("host_bound"),
    )
