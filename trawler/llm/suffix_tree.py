"""Language-model scoring with a probabilistic suffix tree.

Symbols are bytes: the words of a text (A-Z lower-cased), a space after each, and
an end symbol, so that a text's probability is that of its word sequence and no
word is out of vocabulary. The tree grows from the counts of all training text:

* a context of up to ``DEPTH`` symbols is looked at if it occurs ``MIN_COUNT`` times,
  whatever the corpus, so more text gives more contexts;
* it is retained if the divergence of its next-symbol distribution from that of the
  context one symbol shorter is ``MIN_DIVERGENCE`` or more, together with its suffixes;
* next-symbol distributions are smoothed towards the shorter context's, with
  ``PSEUDO`` counts per distinct next symbol, down to a uniform one.

A symbol is scored by the longest suffix of what precedes it that is a state. Counts,
divergence, the closure over suffixes and smoothing are joins and sums of tables, one
per length of context, keyed by context and symbol.

States that end in the same two symbols back off among themselves until shorter than
two. So the tree is a table partitioned by these: groups are packed into shards of about
``SHARD`` entries (a larger group is one alone), each with the states of fewer symbols (65,792
at most). Scoring a symbol needs one shard. A task reads ``GROUP_BYTES`` of text at a
time, takes its distinct grams, and goes through the shards they need one by one, so it
holds one shard whatever the size of the tree. Shards pass through the driver one by
one on their way to the executors' disks.

Beside the model's score, ``score`` gives a unigram base score over words with exact
counts. Words of at least ``FREQUENT`` of all tokens (so 1 / ``FREQUENT`` words at most)
are broadcast with their counts; all others are looked up by a shuffle join.

Texts whose crc32(doc_id) mod ``FOLDS`` is ``FOLD`` are held out of all counts; a null
id counts as empty text. Null and empty texts have one token, their end. Repeated
rows count each and get equal scores. No rows give no rows; without training text every
symbol has the probability of the uniform distribution. A text is held whole in one task. Other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawler.llm import textbytes as tb
from trawler.llm.frames import settled

DEPTH = 6
MIN_COUNT = 8
MIN_DIVERGENCE = 0.02
PSEUDO = 5.0
SHARD = 1_500_000
FREQUENT = 2.0**-22
FOLDS, FOLD = 7, 2

END = 0xFF
SLICE = 512 << 10
#: Text whose grams go through the shards together.
GROUP_BYTES = 8 << 20
#: Distinct counts a task holds before it sends them on.
HELD = 1_500_000

_GRAM, _WORD, _TEXT = 0, 1, 2
_BYTE, _LAST = np.uint64(8), np.uint64(0xFF)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == FOLD


def symbols(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all rows one after the other, and each row's first."""
    row_bytes = tb.sum_rows(ends - starts + 1, first) + 1
    begin = np.concatenate([[0], np.cumsum(row_bytes)])
    out = np.full(begin[-1], 0x20, dtype=np.uint8)
    out[begin[1:] - 1] = END
    lengths = ends - starts
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    # Where each word goes: all words and spaces before it, and an end per earlier row.
    to = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1] + row
    within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(to, lengths) + within] = data[np.repeat(starts, lengths) + within]
    return out, begin


def grams(stream: np.ndarray, begin: np.ndarray, depth: int) -> np.ndarray:
    """Per symbol the ``depth`` symbols before it and itself, packed; ends stand before a text."""
    padded = np.concatenate([np.full(depth, END, np.uint8), stream])
    n = len(stream)
    key = np.zeros(n, dtype=np.uint64)
    for k in range(depth + 1):
        key = (key << np.uint64(8)) | padded[k : k + n].astype(np.uint64)
    # The first symbols of a row must not see the row before it.
    place = np.arange(n) - np.repeat(begin[:-1], np.diff(begin))
    for k in range(depth):
        at = np.flatnonzero(place == k)
        seen = np.uint64((1 << (8 * (k + 1))) - 1)
        ends = np.uint64(((1 << (8 * (depth + 1))) - 1) & ~int(seen))
        key[at] = (key[at] & seen) | ends
    return key


class _Counter:
    """Counts of 64-bit keys, merged as they come."""

    def __init__(self, kind: int):
        self.kind, self.parts, self.size = kind, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None):
        found, n = np.unique(keys, return_counts=True)
        self.parts.append((found, n))
        self.size += len(found)
        if self.size > HELD:
            self._merge()
            if self.size > HELD // 2:
                yield self.flush()

    def _merge(self) -> None:
        keys = np.concatenate([k for k, _ in self.parts])
        counts = np.concatenate([n for _, n in self.parts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
        self.parts = [(keys[at], np.add.reduceat(counts, at))]
        self.size = len(at)

    def flush(self) -> pa.RecordBatch:
        if self.parts:
            self._merge()
        keys, counts = self.parts[0] if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.parts, self.size = [], 0
        kinds = np.full(len(keys), self.kind, np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(kinds), pa.array(keys.view(np.int64)), pa.array(counts)], names=["kind", "key", "n"]
        )


def read_slice(data: np.ndarray, offsets: np.ndarray):
    """Word hashes, each row's first word, the symbols and each row's first symbol."""
    data = tb.lower_ascii(data)
    starts, ends, first = tb.words(data, offsets)
    return tb.SpanHash(data).of(starts, ends), first, *symbols(data, starts, ends, first)


def counts(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """kind, key, n: counts of grams, words and texts in ``docs`` (text)."""

    def run(batches):
        words, runs, texts = _Counter(_WORD), _Counter(_GRAM), 0
        for batch in batches:
            for lo, hi, data, offsets in tb.texts(batch.column("text"), SLICE):
                hashes, _, stream, begin = read_slice(data, offsets)
                yield from words.add(hashes)
                yield from runs.add(grams(stream, begin, depth))
                texts += hi - lo
        yield words.flush()
        yield runs.flush()
        if texts:
            yield pa.RecordBatch.from_arrays(
                [pa.array([_TEXT], pa.int32()), pa.array([0], pa.int64()), pa.array([texts], pa.int64())],
                names=["kind", "key", "n"],
            )

    told = docs.select("text").mapInArrow(run, "kind int, key long, n long")
    return told.groupBy("kind", "key").agg(F.sum("n").alias("n"))


class Tree:
    """States and smoothed distributions, or a shard of them, by length of context.

    ``entries[k]`` has sorted keys (context of k symbols, then the next one) with log10
    probabilities ``values[k]``, ``states[k]`` sorted contexts with ``backoff[k]``.
    """

    def __init__(self, level: np.ndarray, state: np.ndarray, key: np.ndarray, value: np.ndarray, depth: int):
        self.states, self.entries, self.values, self.backoff = [], [], [], []
        for k in range(depth + 1):
            for is_state, keys, values in ((True, self.states, self.backoff), (False, self.entries, self.values)):
                own = np.flatnonzero((level == k) & (state == is_state))
                own = own[np.argsort(key[own], kind="stable")]
                keys.append(key[own])
                values.append(value[own])

    def score(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's last symbol after the others: from the
        longest state down until one told the symbol."""
        context, symbol = keys >> _BYTE, keys & _LAST
        value = np.zeros(len(keys))
        left = np.arange(len(keys))
        for k in range(len(self.states) - 1, -1, -1):
            if not len(left):
                break
            code = _suffix(context[left], k)
            state = _find(self.states[k], code)
            is_state = state >= 0
            entry = np.full(len(left), -1)
            entry[is_state] = _find(self.entries[k], code[is_state] << _BYTE | symbol[left[is_state]])
            told = entry >= 0
            value[left[told]] += self.values[k][entry[told]]
            further = is_state & ~told
            value[left[further]] += self.backoff[k][state[further]]
            left = left[~told]
        value[left] -= math.log10(256)
        return value


def _suffix(context: np.ndarray, k: int) -> np.ndarray:
    """The last ``k`` symbols of packed contexts."""
    return context & np.uint64((1 << (8 * k)) - 1)


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of ``keys`` in a sorted table, -1 where absent."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def _collected(df: DataFrame, key: str, count: str) -> tuple[np.ndarray, np.ndarray]:
    """A small table as arrays, ordered by its key as an unsigned number."""
    told = df.select(key, count).toArrow()
    keys = told.column(0).to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], told.column(1).to_numpy()[order]


def _mask(symbols: int) -> Column:
    return F.lit((1 << (8 * symbols)) - 1).cast("long")


def _levels(counted: DataFrame, depth: int) -> list[DataFrame]:
    """(context, above, key, n) by length of context: counts of grams, and the gram one symbol shorter."""
    out = []
    key = F.col("key")
    level = settled(counted.filter(F.col("kind") == _GRAM).select("key", "n"))
    for k in range(depth, -1, -1):
        out.append(level.select(F.shiftrightunsigned("key", 8).alias("context"), key.bitwiseAND(_mask(k)).alias("above"), "key", "n"))
        if k:
            level = settled(level.groupBy(key.bitwiseAND(_mask(k)).alias("key")).agg(F.sum("n").alias("n")))
    return out[::-1]


def tree_tables(
    counted: DataFrame, depth: int = DEPTH, min_count: int = MIN_COUNT, min_divergence: float = MIN_DIVERGENCE, pseudo: float = PSEUDO
) -> DataFrame:
    """(level, state, key, value): the tree's log10 probabilities of entries, and of backing off from states."""
    shares, kept = [], []
    for k, level in enumerate(_levels(counted, depth)):
        sizes = level.groupBy("context").agg(F.sum("n").alias("m"), F.count("*").alias("d")).filter(F.col("m") >= (min_count if k else 1))
        told = level.join(sizes, "context")
        if k:
            # What follows a context follows its suffix at least as often, so it is told there.
            above = shares[-1].select(F.col("key").alias("above"), (F.col("n") / F.col("m")).alias("above_share"))
            told = told.join(above, "above")
        shares.append(settled(told))
        if k:
            share = F.col("n") / F.col("m")
            divergence = shares[-1].groupBy("context").agg(F.sum(share * F.ln(share / F.col("above_share"))).alias("x"))
            kept.append(settled(divergence.filter(F.col("x") >= min_divergence).select("context")))
    for k in range(depth - 1, 0, -1):
        suffixes = kept[k].select(F.col("context").bitwiseAND(_mask(k)).alias("context"))
        kept[k - 1] = settled(kept[k - 1].unionByName(suffixes).distinct())
    parts, below = [], None
    for k, told in enumerate(shares):
        if k:
            told = told.join(kept[k - 1], "context", "left_semi").join(below, "above")
        else:
            told = told.withColumn("p", F.lit(1.0 / 256))
        weight = F.col("d") * F.lit(pseudo) + 1
        value = (F.col("n") + weight * F.col("p")) / (F.col("m") + weight)
        told = settled(told.select("context", "key", value.alias("p"), (weight / (F.col("m") + weight)).alias("back")))
        below = told.select(F.col("key").alias("above"), "p")
        entries = told.select(F.lit(k).alias("level"), F.lit(False).alias("state"), "key", F.log10("p").cast("float").alias("value"))
        states = told.groupBy("context").agg(F.first("back").alias("back"))
        states = states.select(F.lit(k).alias("level"), F.lit(True).alias("state"), F.col("context").alias("key"), F.log10("back").cast("float").alias("value"))
        parts += [entries, states]
    tree = parts[0]
    for part in parts[1:]:
        tree = tree.unionByName(part)
    return settled(tree)


def _tree(rows: DataFrame, depth: int) -> Tree:
    told = rows.select("level", "state", "key", "value").toArrow()
    level, state, key, value = (told.column(c).to_numpy() for c in ("level", "state", "key", "value"))
    return Tree(level, state, key.view(np.uint64), value, depth)


def shards(tree: DataFrame, depth: int = DEPTH, shard: int = SHARD) -> tuple[np.ndarray, list]:
    """The shard of every pair of last context symbols, and the shards, broadcast."""
    context = F.when(F.col("state"), F.col("key")).otherwise(F.shiftrightunsigned("key", 8))
    tail = context.bitwiseAND(_mask(2)).cast("int")
    deep = tree.filter("level >= 2").withColumn("tail", tail)
    # At most 65,536 groups.
    sizes = deep.groupBy("tail").agg(F.count("*").alias("n")).orderBy("tail").collect()
    of, number, held = np.zeros(1 << 16, dtype=np.int32), 0, 0
    for row in sizes:
        if held and held + row["n"] > shard:
            number, held = number + 1, 0
        of[row["tail"]], held = number, held + row["n"]
    if number:
        spark = tree.sparkSession
        told = spark.createDataFrame([(r["tail"], int(of[r["tail"]])) for r in sizes], "tail int, shard int")
        deep = settled(deep.join(F.broadcast(told), "tail").drop("tail").repartition(number + 1, "shard"), by=["shard"])
    shallow = settled(tree.filter("level < 2"))
    context = tree.sparkSession.sparkContext
    out = []
    for k in range(number + 1):
        own = deep.filter(F.col("shard") == k).drop("shard") if number else deep.drop("tail")
        out.append(context.broadcast(_tree(own.unionByName(shallow), depth)))
    return of, out


def _opened(shared) -> Tree:
    """A shard, held by nothing but the caller."""
    value = shared.value
    shared.__dict__.pop("_value", None)
    return value


def _scored(groups: list[np.ndarray], of: np.ndarray, parts: list) -> list[np.ndarray]:
    """log10 probabilities of sorted distinct grams, one array per slice; one shard is open at a time."""
    places = [of[((keys >> _BYTE) & np.uint64(0xFFFF)).astype(np.int64)] for keys in groups]
    values = [np.zeros(len(keys)) for keys in groups]
    for k in sorted({int(x) for place in places for x in np.unique(place)}):
        tree = _opened(parts[k])
        for keys, place, value in zip(groups, places, values, strict=True):
            own = np.flatnonzero(place == k)
            value[own] = tree.score(keys[own])
        del tree
    return values


def score(docs: DataFrame, depth: int = DEPTH, min_count: int = MIN_COUNT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens,
    n_known, train_tokens, base_score and score (both log10 probabilities)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = settled(counts(rows.filter(~held_out()), depth))
    vocabulary = counted.filter(F.col("kind") == _WORD).select(F.col("key").alias("word"), F.col("n").alias("c"))
    totals = vocabulary.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    texts = (counted.filter(F.col("kind") == _TEXT).agg(F.sum("n")).first()[0]) or 0
    train_tokens, distinct = (totals["n"] or 0) + texts, totals["v"] + (texts > 0)
    whole = math.log10(train_tokens + distinct + 1)

    frequent = vocabulary.filter(F.col("c") >= max(train_tokens * FREQUENT, 1))
    words, c = _collected(frequent, "word", "c")
    shared = spark.sparkContext.broadcast((words, np.log10(c + 1.0)))
    of, parts = shards(tree_tables(counted, depth, min_count), depth)
    end_score, end_known = math.log10(texts + 1) - whole, int(texts > 0)

    def row_part(batch, lo, hi, data, offsets, common, common_log):
        """Columns of a slice but for the model's score, and its grams."""
        hashes, first, stream, begin = read_slice(data, offsets)
        keys, back = np.unique(grams(stream, begin, depth), return_inverse=True)
        at = _find(common, hashes)
        hit = at >= 0
        value = np.zeros(len(hashes))
        value[hit] = common_log[at[hit]] - whole
        row = np.repeat(np.arange(hi - lo), np.diff(first))[~hit]
        rare = hashes[~hit]
        order = np.lexsort((rare, row))
        rare, row = rare[order], row[order]
        new = np.flatnonzero(np.concatenate([[True], (rare[1:] != rare[:-1]) | (row[1:] != row[:-1])])[: len(rare)])
        times = np.diff(np.append(new, len(rare)))
        rare_first = pa.array(np.searchsorted(row[new], np.arange(hi - lo + 1)), pa.int32())
        ends = zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
        raw = memoryview(data)
        content = np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in ends], dtype=np.uint64)
        columns = [
            batch.column("doc_id").slice(lo, hi - lo),
            pa.array(content.view(np.int64)),
            pa.array(np.diff(first) + 1),
            pa.array(tb.sum_rows(hit, first) + end_known),
            pa.array(tb.sum_rows(value, first) + end_score),
            pa.ListArray.from_arrays(rare_first, pa.array(rare[new].view(np.int64))),
            pa.ListArray.from_arrays(rare_first, pa.array(times.astype(np.int32))),
        ]
        return columns, keys, back.astype(np.int32), begin

    def scored_group(group):
        values = _scored([keys for _, keys, _, _ in group], of, parts)
        for (columns, _, back, begin), value in zip(group, values, strict=True):
            columns.insert(5, pa.array(tb.sum_rows(value[back], begin)))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches):
        common, common_log = shared.value
        group, held = [], 0
        for batch in batches:
            for lo, hi, data, offsets in tb.texts(batch.column("text"), SLICE):
                group.append(row_part(batch, lo, hi, data, offsets, common, common_log))
                held += len(data)
                if held >= GROUP_BYTES:
                    yield from scored_group(group)
                    group, held = [], 0
        yield from scored_group(group)

    schema = (
        "doc_id long, content long, n_tokens long, n_known long, base double, score double, "
        "rare array<long>, times array<int>"
    )
    names = [c.split()[0] for c in schema.split(", ")]
    scored = settled(rows.mapInArrow(run, schema))
    key = ["doc_id", "content"]
    pairs = scored.select(*key, F.explode(F.arrays_zip("rare", "times")).alias("r"))
    pairs = pairs.select(*key, F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    looked_up = pairs.join(vocabulary, "word", "left")
    told = F.log10(F.coalesce("c", F.lit(0)) + 1) - whole
    rare = looked_up.select(
        *key,
        F.lit(0).cast("long").alias("rows"),
        F.lit(None).cast("long").alias("n_tokens"),
        F.when(F.col("c") > 0, F.col("times")).otherwise(0).cast("long").alias("n_known"),
        (F.col("times") * told).alias("base"),
        F.lit(None).cast("double").alias("score"),
    )
    own = scored.select(*key, F.lit(1).cast("long").alias("rows"), "n_tokens", "n_known", "base", "score")
    # Rows with equal id and text add up to a multiple of one row's sums.
    summed = own.unionByName(rare).groupBy(*key).agg(
        F.sum("rows").alias("rows"),
        F.max("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"),
        F.sum("base").alias("base"),
        F.max("score").alias("score"),
    )
    return summed.select("*", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).select(
        "doc_id",
        held_out().alias("held_out"),
        "n_tokens",
        (F.col("n_known") / F.col("rows")).cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("rows")).alias("base_score"),
        "score",
    )
