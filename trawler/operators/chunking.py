"""Cut Markdown documents into overlapping chunks at good break points."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawler.config import BREAK_WINDOW_TOKENS, BYTES_PER_TOKEN, CHUNK_OVERLAP, CHUNK_TOKENS
from trawler.functions.text import chunk_id, snippet

# How good a line end is for cutting, by what follows it.
# A heading scores 100 at level one and 10 less per level.
NEWLINE, LIST_ITEM, BLANK_LINE, RULE, FENCE = 1, 5, 20, 60, 80
FAR_PENALTY = 0.7
# Chunks of this many bytes leave a task at a time, whatever its batches hold.
HELD_BYTES = 1 << 20

# One match per run of line ends; a run of several is a blank line and its
# later line ends are no break points.
_BREAK = re.compile(
    rb"\n(?:(?P<blank>\n+)"
    rb"|(?=(?P<heading>#{1,6})(?!#))"
    rb"|(?=(?P<fence>```))"
    rb"|(?=(?P<rule>[ \t\r\f\v]*(?:---|\*\*\*|___)[ \t\r\f\v]*\n))"
    rb"|(?=(?P<item>[-*] |[0-9]+\. )))?"
)
_FENCE = re.compile(rb"\n(?=```)")
_HEADING_LINE = re.compile(r"^[^\S\n]*(#[^\n]*)", re.MULTILINE)

CHUNK_SCHEMA = T.StructType(
    [
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("heading", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("start_offset", T.LongType()),
        T.StructField("end_offset", T.LongType()),
    ]
)


def _break_points(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions and scores of the break points outside code fences."""
    at, score = [], []
    for m in _BREAK.finditer(data):
        at.append(m.start())
        if m["heading"]:
            score.append(110 - 10 * len(m["heading"]))
        else:
            kinds = {"blank": BLANK_LINE, "fence": FENCE, "rule": RULE, "item": LIST_ITEM}
            score.append(kinds.get(m.lastgroup, NEWLINE))
    at, score = np.array(at, dtype=np.int64), np.array(score, dtype=np.float64)

    edges = [m.start() for m in _FENCE.finditer(data)]
    outside = np.ones(len(at), dtype=bool)
    for start, end in zip(edges[::2], [e + 4 for e in edges[1::2]] + [len(data)]):
        outside &= (at <= start) | (at >= end)
    return at[outside], score[outside]


def _char_start(data: bytes, pos: int) -> int:
    """The position itself, or the start of the character it falls into."""
    pos = min(max(pos, 0), len(data))
    while 0 < pos < len(data) and data[pos] & 0xC0 == 0x80:
        pos -= 1
    return pos


def first_heading(text: str) -> str:
    found = _HEADING_LINE.search(text)
    return found[1].rstrip().lstrip("#").lstrip(" ") if found else ""


def chunk_spans(data: bytes, max_tokens: int, overlap: float) -> list[tuple[int, int]]:
    """Byte ranges of the chunks of one document."""
    size = max_tokens * BYTES_PER_TOKEN
    if max_tokens <= 0 or len(data) <= size:
        return [(0, len(data))]
    back = int(max_tokens * overlap) * BYTES_PER_TOKEN
    window = BREAK_WINDOW_TOKENS * BYTES_PER_TOKEN
    at, score = _break_points(data)

    spans, start = [], 0
    while start < len(data):
        end = target = _char_start(data, start + size)
        if target < len(data):
            # The whole window is scored, also before the chunk's start: if the
            # best point lies there, it is not replaced by a later, worse one.
            lo, hi = np.searchsorted(at, [target - window, target + 1])
            if lo < hi:
                far = (target - at[lo:hi]) / window
                best = int(at[lo + np.argmax(score[lo:hi] * (1 - FAR_PENALTY * far * far))])
                end = best if best > start else target
        if data[start:end].strip():
            spans.append((start, end))
        if end >= len(data):
            break
        following = _char_start(data, end - back)
        start = following if following > start else end
    return spans or [(0, len(data))]


def _cut_batches(keep: list[str], max_tokens: int, overlap: float):
    """Arrow batches of ``keep`` and ``_body`` in, batches of chunks out."""
    names = [*keep, *CHUNK_SCHEMA.names]
    types = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def packed(batch: pa.RecordBatch, rows: list, parts: list) -> pa.RecordBatch:
        kept = batch.select(keep).take(pa.array(rows, pa.int64())).columns
        made = zip(*parts, strict=True) if parts else [()] * len(types)
        return pa.RecordBatch.from_arrays([*kept, *map(pa.array, made, types)], names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts, held = [], [], 0
            for i, text in enumerate(batch.column("_body")):
                data = (text.as_py() or "").encode("utf-8")
                for n, (a, b) in enumerate(chunk_spans(data, max_tokens, overlap)):
                    content = data[a:b].decode("utf-8")
                    rows.append(i)
                    parts.append((n, first_heading(content), content, a, b))
                    held += b - a
                    if held >= HELD_BYTES:
                        yield packed(batch, rows, parts)
                        rows, parts, held = [], [], 0
            yield packed(batch, rows, parts)

    return cut


def chunk_documents(
    docs: DataFrame,
    keep: list[str],
    body: str = "body",
    max_tokens: int = CHUNK_TOKENS,
    overlap: float = CHUNK_OVERLAP,
) -> DataFrame:
    """One row per chunk: the ``keep`` columns and ``CHUNK_SCHEMA``.

    The cut depends on where the previous one fell, so a document is walked in
    order inside one task; documents are independent and nothing is shuffled. Texts are
    read one by one, so a task holds one Arrow batch and ``HELD_BYTES`` of chunks.
    """
    source = docs.select(*keep, F.col(body).alias("_body"))
    schema = T.StructType([source.schema[c] for c in keep] + CHUNK_SCHEMA.fields)
    return source.mapInArrow(_cut_batches(keep, max_tokens, overlap), schema)


def indexed_chunks(chunks: DataFrame, doc_id: str = "id") -> DataFrame:
    """Chunks as stored: blank ones dropped, with id and snippet."""
    return (
        chunks.filter(F.col("content").rlike(r"\S"))
        .withColumn("chunk_id", chunk_id(F.col(doc_id), F.col("chunk_index")))
        .withColumn("snippet", snippet(F.col("content")))
    )
