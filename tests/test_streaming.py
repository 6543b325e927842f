import json
import random

import pytest
from pyspark.sql import functions as F

from trawler.operators.sessions import end_turns, fold_events, saved_messages
from trawler.plans.store import Collection, CorpusStore
from trawler.streaming.events import MAX_WAITING, SAVED, _Run, normalize, stream_events
from trawler.streaming.refresh import stream_collection

RAW = [
    {"type": "task_started"},
    {"type": "agent_message", "message": "hello"},
    {"method": "item/agentMessage/delta", "params": {"item": {"delta": " world"}}},
    {"method": "item/started", "params": {"item": {"type": "commandExecution", "id": "c1", "command": "ls"}}},
    {"method": "item/completed", "params": {"item": {"type": "commandExecution", "id": "c1", "aggregatedOutput": "a b"}}},
    {"type": "patch_apply_begin", "call_id": "p1"},
    {"type": "agent_message", "message": "again"},
    {"method": "error", "params": {"error": {"message": "broken"}}},
    {"method": "other"},
    {"type": "agent_message", "message": ""},
]
WANT = [
    "TEXT_MESSAGE_START", "TEXT_MESSAGE_CONTENT", "TEXT_MESSAGE_CONTENT", "TEXT_MESSAGE_END", "TOOL_CALL_START",
    "TOOL_CALL_ARGS", "TOOL_CALL_END", "TOOL_CALL_RESULT", "TOOL_CALL_START", "TEXT_MESSAGE_START",
    "TEXT_MESSAGE_CONTENT", "RUN_ERROR", "TEXT_MESSAGE_END", "RUN_ERROR",
]


def note(method, **params):
    return {"method": method, "params": params}


TEXT = {"type": "agent_message", "message": "t"}
#: Runs and what ends them: (name, notifications, types of their last events).
TURNS = [
    ("idle before a turn", [note("thread/status/changed", status={"type": "idle"}), TEXT], ["TEXT_MESSAGE_CONTENT", "TEXT_MESSAGE_END"]),
    ("idle in a turn", [note("turn/started", turn={"id": "u"}), TEXT, note("thread/status/changed", status={"type": "idle"}), TEXT], ["TEXT_MESSAGE_END", "RUN_FINISHED"]),
    ("busy in a turn", [note("turn/started", turn={"id": "u"}), note("thread/status/changed", status={"type": "active"}), TEXT], ["TEXT_MESSAGE_CONTENT", "TEXT_MESSAGE_END"]),
    ("failed", [TEXT, note("turn/completed", turn={"status": "failed", "error": {"message": "why"}})], ["TEXT_MESSAGE_END", "RUN_ERROR:why"]),
    ("failed without words", [note("turn/completed", turn={"status": "failed"}), TEXT], ["RUN_ERROR:codex turn failed"]),
    ("aborted", [TEXT, {"type": "turn_aborted"}, {"type": "task_complete"}], ["TEXT_MESSAGE_END", "RUN_ERROR:turn was aborted"]),
    ("interrupted", [note("turn/completed", turn={"status": "interrupted"})], ["RUN_ERROR:turn was aborted"]),
    ("complete", [TEXT, {"type": "task_complete"}, TEXT, note("error", message="late")], ["TEXT_MESSAGE_END", "RUN_FINISHED"]),
]


def raw_rows(spark, runs):
    rows = [(run, i, json.dumps(e)) for run, notes in runs for i, e in enumerate(notes)]
    return spark.createDataFrame(rows, "run_id string, ordinal long, raw string")


def messages(spark, runs=("r1", "r2"), **how):
    return normalize(raw_rows(spark, [(run, RAW) for run in runs]), **how)


def batch_events(rows, bucket=None):
    return fold_events(end_turns(rows, "run_id", ["ordinal"]), "run_id", bucket, ["ordinal"])


def told(rows):
    """Events of each run in order, the END of a log that stops at its end."""
    runs = {}
    for r in sorted(rows, key=lambda r: (r.run_id, r.ordinal is None, r.ordinal or 0, r.seq)):
        runs.setdefault(r.run_id, []).append((r.ordinal, r.seq, r.type, r.message_no, r.call_id, r.body))
    return runs


def test_normalize(spark):
    rows = {r.ordinal: r for r in messages(spark, ("r1",)).collect()}
    assert [rows[i].kind for i in sorted(rows)] == [
        "status", "text", "text", "tool_use", "tool_result", "tool_use", "text", "error_end",
    ]
    assert rows[2].content == " world" and json.loads(rows[3].input) == {"command": "ls"}
    assert rows[4].output == "a b" and rows[5].tool == "patch_apply" and rows[5].input == ""
    assert messages(spark, ("r1",), keep_all=True).count() == len(RAW)


def test_other_threads(spark):
    rows = raw_rows(spark, [("r", [note("turn/started", threadId="a", turn={"id": "1"}), note("turn/started", threadId="b", turn={"id": "2"}), TEXT])])
    assert [r.turn_id for r in normalize(rows, thread="a").orderBy("ordinal").collect()] == ["1", ""]


def test_batch_fold(spark):
    rows = messages(spark).withColumn("bucket", F.floor(F.col("ordinal") / 2))
    one = told(batch_events(rows, "bucket").collect())
    assert [e[2] for e in one["r1"]] == WANT
    assert one["r1"][8][5] == "patch_apply" and one["r1"][8][3] == 1 and one["r1"][9][3] == 2
    assert told(batch_events(messages(spark)).collect()) == one
    saved = saved_messages(rows, "run_id", "bucket", ["ordinal"]).filter("run_id = 'r2'").collect()
    assert sorted((m.role, m.content) for m in saved) == [("assistant", "again"), ("assistant", "hello world"), ("tool", "a b")]


def test_turn_state(spark):
    got = told(batch_events(normalize(raw_rows(spark, [(name, notes) for name, notes, _ in TURNS]))).collect())
    for name, _, last in TURNS:
        ended = [f"{e[2]}:{e[5]}" if e[2] == "RUN_ERROR" else e[2] for e in got[name]]
        assert ended[-len(last) :] == last, name
        assert sum(e.startswith("RUN") for e in ended) <= 1, name


def streamed(spark, tmp_path, rows, parts, **how):
    """Rows of the stream fold after micro-batches of ``parts``."""
    source, name = str(tmp_path / "in"), f"folded_{tmp_path.name}"
    schema = rows.schema
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).json(source)
    query = stream_events(stream, **how).writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        for part in parts:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(source)
            query.processAllAvailable()
        yield spark.table(name).collect()
    finally:
        query.stop()


def test_stream_fold_equals_batch_in_any_order(spark, tmp_path):
    runs = [("r1", RAW), ("r2", RAW), *[(name, notes) for name, notes, _ in TURNS]]
    rows = normalize(raw_rows(spark, runs), keep_all=True)
    columns = ["run_id", "ordinal", "kind", "content", "tool", "call_id", "input", "output", "turn_id"]
    rows = rows.select(*columns)
    shuffled = rows.collect()
    random.Random(4).shuffle(shuffled)
    again = shuffled[:5]
    third = len(shuffled) // 3
    parts = [shuffled[:third], shuffled[third : 2 * third], again + shuffled[2 * third :]]
    # The stream cannot know that a log stops: ENDs without an ordinal are the batch fold's own.
    want = {k: [e for e in v if e[0] is not None] for k, v in told(batch_events(rows.filter("kind <> ''")).collect()).items()}
    for got in streamed(spark, tmp_path, rows, parts):
        events = [r for r in got if r.type != SAVED]
        assert told(events) == want
        saved = sorted((r.run_id, r.call_id or "", r.body) for r in got if r.type == SAVED and r.run_id in ("r1", "r2"))
    want = saved_messages(rows.filter("run_id IN ('r1', 'r2')"), "run_id", None, ["ordinal"]).collect()
    assert saved == sorted((m.run_id, m.tool_call_id or "", m.content) for m in want)


def test_stream_gap_and_bound():
    run = _Run(None, 0)
    text = ["text", "x", "", "", "", "", ""]
    run.take(2, text)
    assert run.release() == [] and _Run(run.values(), 0).waiting == {"2": text}
    run.take(1, text)
    assert [e[:3] for e in run.give_up()] == [
        (1, 0, "TEXT_MESSAGE_START"), (1, 1, "TEXT_MESSAGE_CONTENT"), (2, 1, "TEXT_MESSAGE_CONTENT"), (None, 0, "TEXT_MESSAGE_END"), (None, 0, SAVED),
    ]
    run.take(0, text)
    assert run.release() == [] and run.next == 3
    run.take(9, ["text", "x" * MAX_WAITING, "", "", "", "", ""])
    with pytest.raises(ValueError, match="message 3"):
        run.values()


def test_stream_refresh(spark, tmp_path, write_files):
    folder = write_files("docs", {"a.md": "# A\n\nfirst words\n"})
    store = CorpusStore(spark, str(tmp_path / "store"))
    store.add_collection(Collection("docs", str(folder)))
    stream_collection(store, "docs", str(tmp_path / "cp")).awaitTermination()
    assert store.search("first", "docs", 5).count() == 1
    (folder / "b.md").write_text("# B\n\nsecond words\n")
    stream_collection(store, "docs", str(tmp_path / "cp")).awaitTermination()
    assert {r.rel_path for r in store.search("words", "docs", 5).collect()} == {"a.md", "b.md"}
