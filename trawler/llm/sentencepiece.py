"""SentencePiece encoding and decoding by streaming Viterbi.

A text is segmented into pieces of a vocabulary so that the sum of the piece
scores is the largest. The search keeps a window: a piece has at most ``L``
characters, so only the last ``L`` boundaries can be continued and no more of
the lattice is held. Whenever the backpointers of all boundaries in the window
lead through one common boundary, every piece before it is certain and its id is
committed. No piece spans the mark that begins a word unless it begins with it,
so paths usually converge at each word; a text without spaces costs no more
memory than one with.

Models are read from their file, never trained. A unigram model's scores are
log probabilities and are used as they are. A BPE model's scores are only merge
ranks; they stand for ``-log(rank + 2)`` here, as Zipf's law would have it. Runs of
the mark, which a BPE model excludes from merging, get the lowest of these.
A character without a piece becomes its UTF-8 byte pieces, at a penalty below
every score. Of equal paths the one whose last piece is longer wins.

The text is taken as it stands (identity normalisation): a mark is put before it,
each space becomes a mark, and nothing is removed, so decoding gives back every
text that has no mark character of its own (U+2581 comes back as a space). Null
and empty texts have no pieces. Each row is encoded on its own, so repeated rows
give repeated results; a text is held whole in one task. Parts between marks that
were seen before come from a table of bounded size.
"""

from __future__ import annotations

import math
import re
import struct
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawler.llm import textbytes as tb

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MAX_PIECES = 1_000_000
#: Segmented parts remembered by one worker, and the longest part worth it.
REMEMBERED = 500_000
REMEMBERED_CHARS = 32
UNKNOWN_PENALTY = 10.0

MARK = "▁"
_NORMAL, _BYTE, _USER = 1, 6, 4
_BPE = 2
_NEVER = -math.inf


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        shift += 7
        if byte < 0x80:
            return value, at


def fields(data: bytes):
    """(field number, value) of a serialised protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Model:
    """Pieces, scores and byte ids of a model file."""

    def __init__(self, data: bytes):
        entries, kind = [], 1
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                score = struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0]
                entries.append((piece[1].decode(), score, piece.get(3, _NORMAL)))
            elif number == 2:
                kind = dict(fields(value)).get(3, 1)
        if len(entries) > MAX_PIECES:
            raise ValueError(f"{len(entries)} pieces; at most {MAX_PIECES} are broadcast")
        usable = [(p, s, i) for i, (p, s, t) in enumerate(entries) if t in (_NORMAL, _USER) and p]
        if kind == _BPE:
            ranks = [-s for _, s, _ in usable if s > -len(entries)]
            last = max(ranks, default=0.0) + 1
            usable = [(p, -math.log((-s if s > -len(entries) else last) + 2), i) for p, s, i in usable]
        self.score = {p: s for p, s, _ in usable}
        self.id = {p: i for p, _, i in usable}
        self.pieces = [p for p, _, _ in entries]
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(entries) if t == _BYTE}
        self.bytes_of = [p.encode() for p in self.pieces]
        for byte, i in self.byte_id.items():
            self.bytes_of[i] = bytes([byte])
        self.unknown_id = next((i for i, (_, _, t) in enumerate(entries) if t == 2), 0)
        self.longest = max(map(len, self.score), default=1)
        self.unknown_score = min(self.score.values(), default=0.0) - UNKNOWN_PENALTY
        # A trie over characters: each leads to the score of the piece so far, if it is one, and on.
        self.trie: dict = {}
        for piece, score in self.score.items():
            node = self.trie
            for c in piece[:-1]:
                node = node.setdefault(c, [None, {}])[1]
            node.setdefault(piece[-1], [None, {}])[0] = score

    @classmethod
    def read(cls, path: str) -> Model:
        with open(path, "rb") as f:
            return cls(f.read())

    def ids(self, piece: str) -> list[int]:
        found = self.id.get(piece)
        if found is not None:
            return [found]
        if len(self.byte_id) == 256:
            return [self.byte_id[b] for b in piece.encode()]
        return [self.unknown_id]

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")[1:]


class StreamingViterbi:
    """Segments a stream of characters; ids come out once they are certain.

    ``best`` and ``back`` hold, for each boundary from the last committed one on,
    the score of its best path and where that path's last piece starts. Starts
    before ``start`` have been continued to all their ends.
    """

    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.text, self.best, self.back, self.start = "", [0.0], [0], 0

    def feed(self, text: str) -> list[int]:
        """Take characters; returns the ids that have become certain."""
        self.text += text
        out = []
        longest = self.model.longest
        # A start is continued once the longest piece from it is in view.
        while len(self.text) - self.start >= longest:
            self._advance(min(self.start + longest, len(self.text) - longest + 1))
            out += self._commit()
        return out

    def finish(self) -> list[int]:
        """End of the text: returns the ids that are left."""
        self._advance(len(self.text))
        out = self._path(len(self.text))
        self.reset()
        return out

    def _advance(self, stop: int) -> None:
        """Let the pieces from every start before ``stop`` reach their ends."""
        text, best, back = self.text, self.best, self.back
        trie, unknown, longest = self.model.trie, self.model.unknown_score, self.model.longest
        room = min(stop + longest, len(text)) + 1 - len(best)
        best += [_NEVER] * room
        back += [-1] * room
        for start in range(self.start, stop):
            here = best[start]
            node, end = trie, start
            for c in text[start : start + longest]:
                hit = node.get(c)
                if hit is None:
                    break
                end += 1
                gain, node = hit
                # Starts come in order, so a tie keeps the longer last piece.
                if gain is not None and here + gain > best[end]:
                    best[end], back[end] = here + gain, start
            first = trie.get(text[start])
            if (first is None or first[0] is None) and here + unknown > best[start + 1]:
                best[start + 1], back[start + 1] = here + unknown, start
        self.start = stop

    def _commit(self) -> list[int]:
        """Commit up to the boundary where the paths of all live boundaries meet."""
        back = self.back
        live = {end for end in range(self.start, len(back)) if back[end] >= 0}
        while len(live) > 1:
            last = max(live)
            live.discard(last)
            live.add(back[last])
        (meet,) = live
        if meet == 0:
            return []
        out = self._path(meet)
        shift = self.best[meet]
        self.text = self.text[meet:]
        self.best = [b - shift for b in self.best[meet:]]
        self.back = [b - meet if b >= 0 else b for b in back[meet:]]
        self.back[0] = 0
        self.start -= meet
        return out

    def _path(self, end: int) -> list[int]:
        text, back, known, ids = self.text, self.back, self.model.id.get, []
        while end > 0:
            start = back[end]
            piece = text[start:end]
            found = known(piece)
            if found is None:
                ids += reversed(self.model.ids(piece))
            else:
                ids.append(found)
            end = start
        ids.reverse()
        return ids


class Encoder:
    """Encodes texts with one model; remembers short parts.

    A part is a word with the marks before it, or a line break: no piece spans the
    place before a mark that follows another character, nor a break, so all paths
    converge there. A model with such pieces is searched whole.
    """

    def __init__(self, model: Model):
        self.search = StreamingViterbi(model)
        self.known: dict[str, bytes] = {}
        longer = [p for p in model.score if len(p) > 1]
        self.separable = not any(MARK in p.lstrip(MARK) for p in longer)
        breaks = "" if any("\n" in p for p in longer) else "\n"
        self.parts = re.compile(f"{MARK}*[^{MARK}{breaks}]+|{MARK}+" + ("|\n" if breaks else "")).findall

    def _segment(self, part: str) -> bytes:
        # Characters arrive in blocks, as from a reader: the window stays short.
        out = []
        for k in range(0, len(part), 4096):
            out += self.search.feed(part[k : k + 4096])
        return array("i", out + self.search.finish()).tobytes()

    def _new(self, part: str) -> bytes:
        ids = self._segment(part)
        if len(part) <= REMEMBERED_CHARS:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[part] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text."""
        if not text:
            return np.zeros(0, np.int32)
        marked = MARK + text.replace(" ", MARK)
        if not self.separable:
            return np.frombuffer(self._segment(marked), np.int32)
        known, new = self.known.get, self._new
        return np.frombuffer(b"".join([known(p) or new(p) for p in self.parts(marked)]), np.int32)


_encoders: dict[str, Encoder] = {}


def _encoder(key: str, model: Model) -> Encoder:
    """One encoder per model and Python worker, so that tasks share what it remembers."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(model)
    return _encoders[key]


def _shared(df: DataFrame, model: str):
    """The model on all executors; read once on the driver, of checked size."""
    return df.sparkSession.sparkContext.broadcast(Model.read(model))


def encode(docs: DataFrame, model: str = MODEL, carry=()) -> DataFrame:
    """doc_id, ids, n_pieces, n_chars (code points) and round_trip of every row.

    ``round_trip`` says whether the ids decode to the text again. ``carry`` names
    further text columns to keep.
    """
    shared = _shared(docs, model)

    def run(batches):
        encoder = _encoder(model, shared.value)
        for batch in batches:
            for lo, hi, data, offsets in tb.texts(batch.column("text")):
                raw = data.tobytes()
                texts = [raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                ids = [encoder.encode(t) for t in texts]
                first = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
                flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo),
                        pa.ListArray.from_arrays(pa.array(first, pa.int32()), flat),
                        pa.array(np.diff(first)),
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.array([shared.value.decode(x.tolist()) == t for x, t in zip(ids, texts, strict=True)], pa.bool_()),
                        *[batch.column(c).slice(lo, hi - lo) for c in carry],
                    ],
                    names=["doc_id", "ids", "n_pieces", "n_chars", "round_trip", *carry],
                )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        *[F.col(c).cast("string").alias(c) for c in carry],
    )
    kept = "".join(f", {c} string" for c in carry)
    return rows.mapInArrow(run, f"doc_id long, ids array<int>, n_pieces long, n_chars long, round_trip boolean{kept}")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of every row of ``encoded`` (doc_id, ids)."""
    shared = _shared(encoded, model)

    def run(batches):
        for batch in batches:
            texts = [shared.value.decode(x or ()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
