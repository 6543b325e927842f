import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from trawler.operators.chunking import HELD_BYTES, _cut_batches, chunk_documents, chunk_spans, first_heading, indexed_chunks


def pieces(text, tokens, overlap=0.0):
    data = text.encode()
    return [data[a:b].decode() for a, b in chunk_spans(data, tokens, overlap)]


def test_short_text_is_one_chunk():
    assert chunk_spans(b"abc", 4, 0.15) == [(0, 3)]
    assert chunk_spans(b"a" * 100, 0, 0.15) == [(0, 100)]
    assert chunk_spans(b"", 4, 0.15) == [(0, 0)]


def test_overlap_starts_inside_the_previous_chunk():
    text = "alpha alpha alpha\n\nboundary context before marker\n\nbeta beta beta\n"
    spans = chunk_spans(text.encode(), 4, 0.5)
    assert len(spans) > 2 and all(b[0] < a[1] for a, b in zip(spans, spans[1:]) if a[1] - a[0] > 8)


def test_fences_are_not_cut_at_inner_breaks():
    text = "# Title\n\nintro\n\n```\n" + "x" * 30 + "\n" + "y" * 30 + "\n```\n\nclosing paragraph\n"
    data = text.encode()
    inner = data.index(b"\n" + b"y" * 30)
    assert inner not in {a for a, _ in chunk_spans(data, 6, 0)} and len(chunk_spans(data, 6, 0)) >= 3


def test_heading_beats_nearer_newline():
    text = "a" * 2000 + "\n# Head\n" + "b" * 1500 + "\n" + "c" * 3000
    assert pieces(text, 900)[0] == "a" * 2000 + "\n# Head\n" + "b" * 1500
    text = "a" * 3300 + "\n# Head\n" + "b" * 200 + "\n" + "c" * 3000
    assert pieces(text, 900)[0] == "a" * 3300


def test_blank_line_hides_a_following_heading():
    text = "a" * 3300 + "\n\n# Head\n" + "b" * 100 + "\n## Sub\n" + "c" * 3000
    assert pieces(text, 900)[0].endswith("b" * 100)


def test_headings():
    assert first_heading("text\n  ### Deep one  \n# Next") == "Deep one"
    assert first_heading("#tag line") == "tag line" and first_heading("none") == ""


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab用é \n#`-1.", max_size=400), st.integers(1, 20), st.sampled_from([0.0, 0.15, 0.5]))
def test_chunks_cover_the_text(text, tokens, overlap):
    data = text.encode()
    spans = chunk_spans(data, tokens, overlap)
    kept = set()
    for a, b in spans:
        data[a:b].decode()
        assert b - a <= max(tokens * 4, len(data) if len(spans) == 1 else 0)
        kept.update(range(a, b))
    assert all(data[i : i + 1].isspace() for i in set(range(len(data))) - kept)


def test_documents(spark):
    docs = spark.createDataFrame([("d:1", "# T\n\nbody"), ("d:2", " \n")], "id string, body string")
    rows = indexed_chunks(chunk_documents(docs, ["id"])).collect()
    assert [(r.chunk_id, r.heading, r.start_offset, r.end_offset, r.snippet) for r in rows] == [
        ("d:1:c0", "T", 0, 9, "# T body")
    ]


def test_batches_hold_little(spark):
    """A batch of many texts leaves in small parts, and a null key takes no digits from the others."""
    texts = ["word " * 20000 + str(i) for i in range(100)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(102)), pa.array(texts, pa.string())], names=["rowid", "_body"])
    parts = list(_cut_batches(["rowid"], 900, 0.15)(iter([batch])))
    assert max(p.nbytes for p in parts) < 2 * HELD_BYTES
    assert {k for p in parts for k in p.column("rowid").to_pylist()} == set(range(102))
    rows = spark.createDataFrame([(None, "a"), (2**60 + 1, None)], "rowid long, body string").coalesce(1)
    assert {r["rowid"] for r in chunk_documents(rows, ["rowid"]).collect()} == {None, 2**60 + 1}
