"""Hard-negative mining by Four-Russians scoring.

Vectors are quantised to integers (``floor(256 * x)``); a row's score for an anchor
is the exact integer inner product. Anchors come in blocks. For each group of eight
dimensions a table holds, per anchor, the sums of all 256 subsets of its eight
components. A slice of candidates is packed into bit planes: the eight bits that a
plane of a group holds are one byte, and that byte is the place of the subset's sum. So
a plane costs one lookup per group, planes are shifted and added (the top one, of the
sign, negative), and the score is whole: nothing is approximated or verified again.

The queries are the anchors (``ANCHOR_STEP``); all rows are candidates. Anchors reach the
tasks as broadcasts of at most ``BATCH`` anchors, streamed from a written table, one pass
over the candidates each. A task keeps, per anchor and positive, the best rows so far
and sends those alone, so the shuffle grows with tasks and anchors, not with pairs, and
a label that holds a third of all rows is no heavier than others.

Two passes: first each anchor's positives (the best other rows of its label), then,
once their scores are known, the best rows of other labels inside each positive's
window ``LOW * positive <= 100 * negative <= HIGH * positive``.

A row whose id, label, vector or any component is null, or with a component that is not
finite, takes no part. An empty vector scores 0; of vectors of unequal width the shorter
counts as filled up with zeros. Quantised values and sums are 64-bit (beyond, values
saturate and sums wrap). Of rows that share a vec_id the one with the smallest label,
then vector, takes part. An anchor without positives, or a window without rows, gives
no rows; so does an empty table. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawler.llm.frames import settled, small

ANCHOR_STEP = 100
RELABEL_STEP, LABELS = 7, 10
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
SCALE = 256

#: Anchors sent to the tasks at once, anchors whose tables are held at once, and candidates packed at once.
BATCH, BLOCK, SLICE = 16_384, 64, 4_096
GROUP = 8

_FLOOR = np.iinfo(np.int64).min


def prepared(rows: DataFrame) -> DataFrame:
    """vec_id, label and quantised vector of the rows that take part, one per vec_id."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    whole = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    label = F.col("label").cast("int")
    moved = F.when(F.col("vec_id") % RELABEL_STEP == 0, (label + 1) % LABELS).otherwise(label)
    told = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").filter(whole)
    told = told.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        moved.cast("int").alias("label"),
        F.transform(x, lambda c: F.floor(c * F.lit(float(SCALE)))).alias("v"),
    )
    twice = settled(told.groupBy("vec_id").agg(F.count("*").alias("n")).filter("n > 1").select("vec_id"))
    if twice.isEmpty():
        return told
    twice = small(twice)
    first = told.join(twice, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row"))
    return told.join(twice, "vec_id", "left_anti").unionByName(first.select("vec_id", "row.label", "row.v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of a list column as rows of ``width`` numbers, cut or filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == sizes[0]).all() and sizes[0] == width:
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row[place < width], place[place < width]] = values[place < width]
    return out


def _padded(vectors: np.ndarray) -> np.ndarray:
    short = -vectors.shape[1] % GROUP
    return np.pad(vectors, ((0, 0), (0, short))) if short else vectors


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """[group, byte, anchor]: sums of the anchor's components that the byte's bits choose."""
    parts = _padded(anchors).reshape(len(anchors), -1, GROUP).transpose(1, 2, 0)
    sums = np.zeros((parts.shape[0], 1 << GROUP, len(anchors)), dtype=np.int64)
    for bit in range(GROUP):
        sums[:, 1 << bit : 2 << bit] = sums[:, : 1 << bit] + parts[:, bit : bit + 1]
    narrow = np.abs(sums).max(initial=0) < 1 << 31
    return sums.astype(np.int32) if narrow else sums


def bit_planes(vectors: np.ndarray) -> np.ndarray:
    """[plane, group, row]: two's-complement bits of eight dimensions as one byte, lowest plane first."""
    vectors = _padded(vectors)
    top = np.maximum(vectors, ~vectors).max(initial=0)
    n = int(top).bit_length() + 1
    parts = vectors.reshape(len(vectors), -1, GROUP)
    planes = [np.packbits(((parts >> k) & 1).astype(np.uint8), axis=2, bitorder="little")[:, :, 0].T for k in range(n)]
    return np.ascontiguousarray(np.stack(planes))


def scores(sums: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """[row, anchor] inner products by lookups, shifts and additions."""
    total = np.zeros((planes.shape[2], sums.shape[2]), dtype=np.int64)
    with np.errstate(over="ignore"):
        for k in range(len(planes) - 1, -1, -1):
            total <<= 1
            for g in range(sums.shape[0]):
                looked = np.take(sums[g], planes[k, g], axis=0)
                if k == len(planes) - 1:
                    total -= looked
                else:
                    total += looked
    return total


class Best:
    """The best ``k`` (score, id) of every query, over any number of slices."""

    def __init__(self, queries: int, k: int):
        self.score = np.full((queries, k), _FLOOR, dtype=np.int64)
        self.id = np.zeros((queries, k), dtype=np.int64)
        self.there = np.zeros((queries, k), dtype=bool)
        self.k = k

    def add(self, lo: int, scores: np.ndarray, fits: np.ndarray, ids: np.ndarray) -> None:
        """Rows ``scores[query, row]`` that ``fits``, for the queries from ``lo`` on. ``ids`` ascend."""
        hi, k = lo + len(scores), min(self.k, scores.shape[1])
        held = np.where(fits, scores, _FLOOR)
        # All rows that reach the k-th score stay; ties are settled by id below.
        cut = np.partition(held, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        q, row = np.nonzero((held >= np.maximum(cut, self.score[lo:hi, -1])[:, None]) & fits)
        if not len(q):
            return
        keep = self.there[lo:hi].ravel()
        old = np.repeat(np.arange(hi - lo), self.k)[keep]
        q = np.concatenate([old, q])
        score = np.concatenate([self.score[lo:hi].ravel()[keep], held[q[len(old) :], row]])
        found = np.concatenate([self.id[lo:hi].ravel()[keep], ids[row]])
        # ~score turns the order round without overflow.
        order = np.lexsort((found, ~score, q))
        q, score, found = q[order], score[order], found[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        q, score, found, rank = (x[rank < self.k] for x in (q, score, found, rank))
        for mine, new, empty in ((self.score, score, _FLOOR), (self.id, found, 0), (self.there, True, False)):
            mine[lo:hi] = empty
            mine[lo + q, rank] = new


def _slices(batches, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids ascending, labels, planes) of candidates."""
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE):
            part = batch.slice(lo, SLICE)
            ids = part.column("vec_id").to_numpy(zero_copy_only=False)
            order = np.argsort(ids, kind="stable")
            labels = part.column("label").to_numpy(zero_copy_only=False)
            yield ids[order], labels[order], bit_planes(matrix(part.column("v"), width)[order])


def _best_positives(shared):
    def run(batches):
        anchors, labels, vectors = shared.value
        blocks = [(lo, subset_sums(vectors[lo : lo + BLOCK])) for lo in range(0, len(anchors), BLOCK)]
        best = Best(len(anchors), POSITIVES)
        for ids, own, planes in _slices(batches, vectors.shape[1]):
            for lo, sums in blocks:
                hi = lo + sums.shape[2]
                fits = (labels[lo:hi, None] == own) & (anchors[lo:hi, None] != ids)
                best.add(lo, scores(sums, planes).T, fits, ids)
        yield _told(best, anchors)

    return run


def _best_negatives(shared):
    def run(batches):
        anchors, labels, vectors, owner, low, high = shared.value
        blocks = [(lo, subset_sums(vectors[lo : lo + BLOCK])) for lo in range(0, len(anchors), BLOCK)]
        first = np.searchsorted(owner, np.arange(len(anchors) + 1))
        best = Best(len(owner), NEGATIVES)
        for ids, own, planes in _slices(batches, vectors.shape[1]):
            for lo, sums in blocks:
                hi = lo + sums.shape[2]
                found = scores(sums, planes).T
                a, b = first[lo], first[hi]
                at = owner[a:b] - lo
                found, other = found[at], labels[owner[a:b], None] != own
                best.add(a, found, other & (found >= low[a:b, None]) & (found <= high[a:b, None]), ids)
        yield _told(best, np.arange(len(owner)))

    return run


def _told(best: Best, names: np.ndarray) -> pa.RecordBatch:
    query, place = np.nonzero(best.there)
    values = [names[query], best.id[query, place], best.score[query, place]]
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in values], names=["query", "vec_id", "score"])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _batches(anchors: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids ascending, labels, vectors) of at most ``BATCH`` anchors each."""
    held = []
    for row in anchors.toLocalIterator():
        held.append(row)
        if len(held) == BATCH:
            yield _packed(held)
            held = []
    if held:
        yield _packed(held)


def _packed(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = sorted(rows, key=lambda r: r["vec_id"])
    width = max(1, *(len(r["v"]) for r in rows)) if rows else 1
    vectors = np.zeros((len(rows), width), dtype=np.int64)
    for k, r in enumerate(rows):
        vectors[k, : len(r["v"])] = r["v"]
    return np.array([r["vec_id"] for r in rows]), np.array([r["label"] for r in rows]), vectors


def _windows(ids: np.ndarray, positives: list) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Positives in the order of their anchors, with the place of the anchor and the window of scores.

    Whole-number bounds: negatives from ceil(LOW * p / 100) to floor(HIGH * p / 100).
    """
    place = {v: k for k, v in enumerate(ids.tolist())}
    positives = sorted(positives, key=lambda r: (place[r["query"]], r["rank"]))
    owner = np.array([place[r["query"]] for r in positives], dtype=np.int64)
    low = np.array([-(-LOW * r["score"] // 100) for r in positives], dtype=np.int64)
    high = np.array([HIGH * r["score"] // 100 for r in positives], dtype=np.int64)
    return positives, owner, low, high


def hard_negatives(rows: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score."""
    spark = rows.sparkSession
    ready = prepared(rows)
    anchors = settled(ready.filter(F.col("vec_id") % ANCHOR_STEP == 0))
    outcome, told = [], "query long, vec_id long, score long"
    for ids, labels, vectors in _batches(anchors):
        first = spark.sparkContext.broadcast((ids, labels, vectors))
        # At most BATCH * POSITIVES rows.
        found = _ranked(ready.mapInArrow(_best_positives(first), told), POSITIVES).collect()
        if not found:
            continue
        positives, owner, low, high = _windows(ids, found)
        second = spark.sparkContext.broadcast((ids, labels, vectors, owner, low, high))
        chosen = _ranked(ready.mapInArrow(_best_negatives(second), told), NEGATIVES)
        pairs = spark.createDataFrame(
            [(k, r["query"], r["vec_id"], r["score"]) for k, r in enumerate(positives)],
            "query long, anchor_id long, positive_id long, positive_score long",
        )
        chosen = chosen.join(F.broadcast(pairs), "query").select(
            "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score"),
        )
        outcome.append(settled(chosen))
    if not outcome:
        return spark.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        )
    union = outcome[0]
    for more in outcome[1:]:
        union = union.unionByName(more)
    return union
