"""Token counts by a linear longest-match automaton.

Words (A-Z lower-cased) are cut greedily into the longest pieces of a vocabulary,
the end of the word being a symbol of its own. Only the number of pieces is
wanted, so none is built: the vocabulary is a trie whose states carry a failure
link and the number of tokens popped on the way along it. A word is read once,
byte by byte; whenever a state cannot go on, its popped count is added and its
link followed. Links never lead to work twice, so a word costs its length.

The automaton is built once on the driver from a vocabulary of checked size and
broadcast. Within a slice of texts equal words are counted once. A word with a
byte that no piece covers counts as one unknown token, whole.

Null and empty texts have no words and no tokens. Each row is counted on its own,
so repeated rows give repeated results; a text is held whole in one task.
"""

from __future__ import annotations

import json
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawler.llm import textbytes as tb

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
MAX_PIECES = 1_000_000
#: Counts of words remembered between slices by one worker.
REMEMBERED = 200_000

END = 256
_NONE = -1


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, and their bytes.

    Printable Latin-1 characters stand for themselves; the other bytes take the
    code points from 256 on, in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in plain}
    spare = 0
    for b in range(256):
        if b not in plain:
            table[chr(256 + spare)] = b
            spare += 1
    return table


def read_vocabulary(path: str, word_end: str = "</w>") -> list[tuple[int, ...]]:
    """Pieces of a tokenizer file as symbols: bytes, and END for a word's end."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    if len(vocabulary) > MAX_PIECES:
        raise ValueError(f"{len(vocabulary)} pieces; at most {MAX_PIECES} are broadcast")
    table = byte_symbols()
    pieces = []
    for piece in vocabulary:
        ended = piece.endswith(word_end) and piece != word_end
        stem = piece[: -len(word_end)] if ended else piece
        if all(c in table for c in stem):
            pieces.append((*[table[c] for c in stem], *([END] if ended else [])))
    return pieces


class Automaton:
    """Trie of symbol sequences with failure links and popped-token counts."""

    def __init__(self, pieces):
        children: list[dict[int, int]] = [{}]
        final = [False]
        for piece in pieces:
            state = 0
            for symbol in piece:
                step = children[state].get(symbol)
                if step is None:
                    step = children[state][symbol] = len(children)
                    children.append({})
                    final.append(False)
                state = step
            final[state] = final[state] or state != 0
        self.children = children
        self.fail = [_NONE] * len(children)
        self.popped = [0] * len(children)
        queue = deque([0])
        while queue:
            state = queue.popleft()
            for symbol, child in children[state].items():
                queue.append(child)
                if final[child]:
                    self.fail[child], self.popped[child] = 0, 1
                    continue
                # What the parent would pop, then what lets its link read this symbol.
                count, back = self.popped[state], self.fail[state]
                while back != _NONE and symbol not in children[back]:
                    count += self.popped[back]
                    back = self.fail[back]
                if back != _NONE:
                    self.fail[child], self.popped[child] = children[back][symbol], count

    def count(self, word: bytes) -> int:
        """Pieces of a word; an unknown word is one."""
        children, fail, popped = self.children, self.fail, self.popped
        state = total = 0
        for symbol in (*word, END):
            step = children[state].get(symbol)
            while step is None:
                total += popped[state]
                state = fail[state]
                if state == _NONE:
                    return 1
                step = children[state].get(symbol)
            state = step
        while state:
            total += popped[state]
            state = fail[state]
            if state == _NONE:
                return 1
        return total


def slice_counts(automaton: Automaton, data, offsets, known: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Words and tokens of every row of a slice. ``known``: counts by word hash."""
    data = tb.lower_ascii(data)
    starts, ends, first = tb.words(data, offsets)
    hashes, at, back = np.unique(tb.SpanHash(data).of(starts, ends), return_index=True, return_inverse=True)
    raw = data.tobytes()
    counts = np.empty(len(hashes), dtype=np.int64)
    for i, (h, a, b) in enumerate(zip(hashes.tolist(), starts[at].tolist(), ends[at].tolist(), strict=True)):
        n = known.get(h)
        if n is None:
            n = automaton.count(raw[a:b])
            if len(known) >= REMEMBERED:
                known.clear()
            known[h] = n
        counts[i] = n
    return np.diff(first), tb.sum_rows(counts[back], first)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_words and n_tokens of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(read_vocabulary(vocabulary)))

    def run(batches):
        automaton, known = shared.value, {}
        for batch in batches:
            for lo, hi, data, offsets in tb.texts(batch.column("text")):
                counts = slice_counts(automaton, data, offsets, known)
                ids = batch.column("doc_id").slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, counts)], names=["doc_id", "n_words", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long")
