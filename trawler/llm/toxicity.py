"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all other text is unlabelled, toxic or
not. With the class prior pi, the risk of a classifier g is estimated as
``pi R+(g) + max(0, R-_u(g) - pi R-_p(g))``: the positives' share in the unlabelled
risk is taken off, and where that turns negative the step goes the other way, so
that the model cannot fit by driving it below zero. The classifier is linear over
the densities of words and word beginnings and is trained in numpy on a bounded sample
(``SAMPLE_POSITIVE``, ``SAMPLE_UNLABELLED`` documents, the smallest by a hash of
id and text). Its features are those whose mean density differs significantly
between the two samples. Everything else reads all rows: the class prior, and
the scores.

Labels come only from rows whose crc32(doc_id) mod ``FOLDS`` is not 0; label, lang,
source and id are no inputs of a score. Null text is empty and has the score of
no words. Conflicting or repeated labels of a document: toxic if any says so.
Without any positive every score is the prior, 0 if there are no labels either.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawler.llm import textbytes as tb
from trawler.llm.frames import settled

FOLDS = 5
SAMPLE_POSITIVE = 20_000
SAMPLE_UNLABELLED = 40_000
MAX_FEATURES = 4096
PREFIXES = (4, 6, 8)
SCALE = 50
MOST = 2.0
MIN_Z = 5.0
STEPS = 600
RATE = 0.05
DECAY = 1e-4
BETA = 0.0
SEED = 42


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def row_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature hashes of all rows with repeats, the row of each, and the words per row.

    Features are the words, runs of letters, digits and non-ASCII bytes with A-Z
    lower-cased, and the first bytes of longer words (``PREFIXES``).
    """
    starts, ends, first = tb.words(np.where(_KEEP[data], data, np.uint8(0x20)), offsets)
    spans = tb.SpanHash(tb.lower_ascii(data))
    row = np.searchsorted(offsets, starts, "right") - 1
    hashes, rows = [spans.of(starts, ends)], [row]
    for k in PREFIXES:
        longer = ends - starts > k
        begin = starts[longer]
        hashes.append(spans.of(begin, begin + k) ^ np.uint64(k))
        rows.append(row[longer])
    return np.concatenate(hashes), np.concatenate(rows), np.diff(first)


def densities(keys: np.ndarray, row: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every key once per row, ordered by row, with its share of the row's words
    in units of 1 / ``SCALE``, at most ``MOST``."""
    order = np.lexsort((keys, row))
    keys, row = keys[order], row[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(row)))
    return keys[at], row[at], np.minimum(SCALE * times / np.maximum(words[row[at]], 1), MOST)


_KEEP = np.zeros(256, dtype=bool)
_KEEP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _moments(batches):
    """Sums of the values and of their squares, by class and feature."""
    for batch in batches:
        classes = batch.column("toxic").to_numpy(zero_copy_only=False)
        for lo, hi, data, offsets in tb.texts(batch.column("text")):
            hashes, row, values = densities(*row_features(data, offsets))
            for toxic in (0, 1):
                mine = classes[lo:hi][row] == toxic
                found, at = np.unique(hashes[mine], return_inverse=True)
                sums = [np.bincount(at, values[mine] ** k, len(found)).astype(np.float64) for k in (1, 2)]
                columns = [found.view(np.int64), np.full(len(found), toxic, np.int32), *sums]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["feature", "toxic", "s", "q"])


def choose_features(sample: DataFrame, n_p: int, n_u: int) -> np.ndarray:
    """Sorted hashes of the features whose means differ significantly, the first ``MAX_FEATURES``."""
    told = sample.mapInArrow(_moments, "feature long, toxic int, s double, q double")
    parts = {"p": (F.col("toxic") == 1, n_p), "u": (F.col("toxic") == 0, n_u)}
    sums = [F.sum(F.when(mine, F.col(c))).alias(f"{c}_{k}") for k, (mine, _) in parts.items() for c in ("s", "q")]
    summed = told.groupBy("feature").agg(*sums).na.fill(0.0)
    spread = F.lit(0.0)
    for k, (_, n) in parts.items():
        mean = F.col(f"s_{k}") / n
        # One more row with the feature at its most, on either side, tames rare ones.
        spread = spread + (F.greatest(F.col(f"q_{k}") / n - mean * mean, F.lit(0.0)) + MOST / n) / n
    z = F.abs(F.col("s_p") / n_p - F.col("s_u") / n_u) / F.sqrt(spread)
    best = summed.select("feature", z.alias("z")).filter(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "feature")
    return np.sort(np.array([r["feature"] for r in best.limit(MAX_FEATURES).collect()], dtype=np.int64).view(np.uint64))


def slice_values(data, offsets, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the chosen features: which, in which row, and the value there."""
    hashes, row, words = row_features(data, offsets)
    at = np.minimum(np.searchsorted(features, hashes), len(features) - 1)
    hit = features[at] == hashes
    return densities(at[hit], row[hit], words)


class Sparse:
    """Values of the chosen features in sampled rows, and the products that training needs."""

    def __init__(self, rows: pd.DataFrame, width: int):
        sizes = [len(x) for x in rows["columns"]]
        self.columns = np.concatenate([np.asarray(x, np.int64) for x in rows["columns"]])
        self.values = np.concatenate([np.asarray(x, np.float64) for x in rows["values"]])
        self.rows = np.repeat(np.arange(len(sizes)), sizes)
        self.height, self.width = len(sizes), width

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * weights[self.columns], self.height)

    def back(self, gradient: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, self.values * gradient[self.rows], self.width)


def chosen_values(sample: DataFrame, features: np.ndarray) -> pd.DataFrame:
    """toxic, columns and values of every row of the sample: a few numbers a row."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in tb.texts(batch.column("text")):
                columns, row, values = slice_values(data, offsets, features)
                first = pa.array(np.searchsorted(row, np.arange(hi - lo + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(first, pa.array(x)) for x in (columns.astype(np.int32), values)]
                toxic = batch.column("toxic").slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([toxic, *lists], names=["toxic", "columns", "values"])

    return sample.mapInArrow(run, "toxic int, columns array<int>, values array<double>").toPandas()


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def train(positive: Sparse, unlabelled: Sparse, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk of the logistic loss (Adam)."""
    n = positive.width
    theta, first, second = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    theta[n] = np.log(prior / (1 - prior))
    n_p, n_u = positive.height, unlabelled.height
    for step in range(1, STEPS + 1):
        g_p, g_u = positive.dot(theta[:n]) + theta[n], unlabelled.dot(theta[:n]) + theta[n]
        # Logistic loss: as positive log(1 + e^-g), as negative log(1 + e^g).
        negative = np.logaddexp(0, g_u).mean() - prior * np.logaddexp(0, g_p).mean()
        d_u, d_p = _sigmoid(g_u) / n_u, prior * _sigmoid(g_p) / n_p
        if negative >= -BETA:
            slope_u, slope_p = d_u, -d_p + prior * (_sigmoid(g_p) - 1) / n_p
        else:
            slope_u, slope_p = -d_u, d_p
        gradient = np.append(positive.back(slope_p) + unlabelled.back(slope_u), slope_p.sum() + slope_u.sum())
        gradient[:n] += DECAY * theta[:n]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        theta -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:n], float(theta[n])


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Features (sorted hashes), their weights and the bias."""
    told = (
        labels.filter(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    )
    counts = told.agg(F.count("*").alias("n"), F.sum((F.col("toxic") == 1).cast("long")).alias("toxic")).first()
    if not counts["n"]:
        return np.zeros(0, np.uint64), np.zeros(0), -np.inf
    prior = min(max(counts["toxic"] / counts["n"], 1e-4), 0.5)
    learnt = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(~held_out())
    positive = told.filter("toxic = 1").select("doc_id")

    # Only ids and hashes are joined and sorted; texts are then read for the chosen ones, at most the two bounds.
    keyed = learnt.withColumn("order", F.xxhash64("doc_id", "text"))
    narrow = keyed.select("doc_id", "order")

    def drawn(how: str, toxic: int, most: int) -> DataFrame:
        rows = narrow.join(positive, "doc_id", how).orderBy("order", "doc_id").limit(most)
        return rows.withColumn("toxic", F.lit(toxic))

    chosen = drawn("left_semi", 1, SAMPLE_POSITIVE).unionByName(drawn("left_anti", 0, SAMPLE_UNLABELLED))
    chosen = settled(chosen.distinct().coalesce(1))
    # Rows that repeat id and text come back together; one of them is learnt from, so the bounds hold.
    sample = keyed.join(F.broadcast(chosen), ["doc_id", "order"]).dropDuplicates(["doc_id", "order"])
    sample = settled(sample.select("toxic", "text"))
    heights = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    none = np.zeros(0, np.uint64), np.zeros(0), float(np.log(prior / (1 - prior)))
    if len(heights) < 2:
        return none
    features = choose_features(sample, heights[1], heights[0])
    if not len(features):
        return none
    rows = chosen_values(sample, features)
    at_p, at_u = (Sparse(rows[rows["toxic"] == k], len(features)) for k in (1, 0))
    return features, *train(at_p, at_u, prior)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches):
        features, weights, bias = model.value
        for batch in batches:
            for lo, hi, data, offsets in tb.texts(batch.column("text")):
                value = np.zeros(hi - lo)
                if len(features):
                    found, row, density = slice_values(data, offsets, features)
                    value = np.bincount(row, weights[found] * density, hi - lo)
                score = _sigmoid(value + bias)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(score)], names=["doc_id", "score"]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
