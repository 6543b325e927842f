"""Agent notifications to client events, as a stream.

``normalize`` maps raw notifications to messages; ``stream_events`` keeps one
small state per run and emits what ``operators.sessions.end_turns`` and
``fold_events`` give for a finished log, whatever order the messages arrive in.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MESSAGE_FIELDS = ["kind", "content", "tool", "call_id", "input", "output", "turn_id"]

OUTPUT_SCHEMA = (
    "run_id string, ordinal long, seq int, type string, message_no long, call_id string, body string"
)
STATE_SCHEMA = "open boolean, message_no long, turn boolean, done boolean, next long, text string, waiting string"
#: Bytes of messages that may wait for an earlier one of their run.
MAX_WAITING = 16 << 20

# Legacy notification types, as (kind, tool).
LEGACY = {
    "agent_message": ("text", ""),
    "exec_command_begin": ("tool_use", "exec_command"),
    "exec_command_end": ("tool_result", "exec_command"),
    "patch_apply_begin": ("tool_use", "patch_apply"),
    "patch_apply_end": ("tool_result", "patch_apply"),
    "task_started": ("status", ""),
    "task_complete": ("end", ""),
    "turn_aborted": ("end", ""),
}
# Turn states of an abort, and what a failed or aborted turn without a message says.
ABORTED = ("cancelled", "canceled", "aborted", "interrupted")
ABORT_TEXT = "turn was aborted"
FAILURE_TEXT = "codex turn failed"
# Item notifications, as (method, item type) -> (kind, tool).
ITEMS = {
    ("item/started", "commandExecution"): ("tool_use", "exec_command"),
    ("item/completed", "commandExecution"): ("tool_result", "exec_command"),
    ("item/started", "fileChange"): ("tool_use", "patch_apply"),
    ("item/completed", "fileChange"): ("tool_result", "patch_apply"),
    ("item/completed", "agentMessage"): ("text", ""),
}
# Where an agent message may keep its text, first match wins.
TEXT_KEYS = ("delta", "text", "message", "content")


def _path(raw: Column, path: str) -> Column:
    return F.coalesce(F.get_json_object(raw, path), F.lit(""))


def _first(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def _lookup(table: dict, key: Column, at: int) -> Column:
    pairs = [F.lit(x) for k, v in table.items() for x in (k, v[at])]
    return F.try_element_at(F.create_map(*pairs), key)


def _command_json(command: Column) -> Column:
    return F.to_json(F.struct(command.alias("command")))


def normalize(notifications: DataFrame, raw: str = "raw", thread: str = "", keep_all: bool = False) -> DataFrame:
    """Add message columns to rows holding one JSON notification each.

    Legacy events have ``type``; newer ones have ``method`` and ``params``.
    Rows that mean nothing, or belong to another thread, are dropped, or kept with
    an empty kind for a reader that counts ordinals (``keep_all``). The end of a
    turn has its failure as content; ``turn_id`` names the turn a row opens. A thread
    gone ``idle`` ends an open turn only, which rows alone cannot tell: that is
    ``end_turns``' part, or the stream's state.
    """
    event = F.col(raw)
    method, item = _path(event, "$.method"), _path(event, "$.params.item.type")
    text = _first(*[_path(event, f"$.params.item.{k}") for k in TEXT_KEYS])
    failure = _first(_path(event, "$.params.error.message"), _path(event, "$.params.message"))
    turn = _path(event, "$.params.turn.status")
    item_key = F.concat_ws("|", method, item)
    items = {"|".join(k): v for k, v in ITEMS.items()}
    legacy_kind = _lookup(LEGACY, _path(event, "$.type"), 0)
    new_kind = (
        F.when(method == "turn/started", "status")
        .when(method == "turn/completed", "end")
        .when((method == "error") & (failure != ""), "error_end")
        .when((method == "thread/status/changed") & (_path(event, "$.params.status.type") == "idle"), "idle")
        .when(method == "item/agentMessage/delta", "text")
        .otherwise(_lookup(items, item_key, 0))
    )
    kind = F.when(method == "", legacy_kind).otherwise(new_kind)
    legacy_command = _path(event, "$.command")
    command = F.when(method == "", legacy_command).otherwise(_path(event, "$.params.item.command"))
    tool = F.coalesce(
        F.when(method == "", _lookup(LEGACY, _path(event, "$.type"), 1)).otherwise(_lookup(items, item_key, 1)),
        F.lit(""),
    )
    failed_turn = _first(_path(event, "$.params.turn.error.message"), F.lit(FAILURE_TEXT))
    aborted = turn.isin(*ABORTED) | ((method == "") & (_path(event, "$.type") == "turn_aborted"))
    content = (
        F.when(kind == "error_end", failure)
        .when((kind == "end") & aborted, F.lit(ABORT_TEXT))
        .when((kind == "end") & (turn == "failed"), failed_turn)
        .when(kind == "text", F.when(method == "", _path(event, "$.message")).otherwise(text))
    )
    if thread:
        other = _path(event, "$.params.threadId")
        kind = F.when((other == "") | (other == thread), kind)
    rows = notifications.withColumn("kind", F.coalesce(kind, F.lit("")))
    rows = (
        rows.withColumn("content", F.coalesce(content, F.lit("")))
        .withColumn("tool", tool)
        .withColumn("turn_id", F.when(method.isin("turn/started", "turn/completed"), _path(event, "$.params.turn.id")).otherwise(""))
        .withColumn("call_id", F.when(method == "", _path(event, "$.call_id")).otherwise(_path(event, "$.params.item.id")))
        .withColumn(
            "input",
            F.when((F.col("kind") == "tool_use") & (F.col("tool") == "exec_command"), _command_json(command)).otherwise(""),
        )
        .withColumn(
            "output",
            F.when(F.col("tool") == "exec_command", _first(_path(event, "$.output"), _path(event, "$.params.item.aggregatedOutput"))).otherwise(""),
        )
    )
    silent = (F.col("kind") == "text") & (F.col("content") == "")
    rows = rows.withColumn("kind", F.when(silent, "").otherwise(F.col("kind")))
    return rows if keep_all else rows.filter("kind <> ''")


class _Run:
    """State of one run: its open text, its turn, and what waits for an earlier message."""

    def __init__(self, values: tuple | None, first: int):
        self.open, self.number, self.turn, self.done, self.next, self.text, waiting = values or (
            False, 0, False, False, first, "", "{}",
        )
        self.waiting: dict[str, list] = json.loads(waiting)

    def values(self) -> tuple:
        waiting = json.dumps(self.waiting)
        if len(waiting) > MAX_WAITING:
            raise ValueError(f"over {MAX_WAITING} bytes wait for message {self.next} of a run")
        return bool(self.open), int(self.number), bool(self.turn), bool(self.done), int(self.next), self.text, waiting

    def _close(self, seq: int) -> list[tuple]:
        if not self.open:
            return []
        saved, self.open, self.text = self.text, False, ""
        return [(seq, "TEXT_MESSAGE_END", self.number, None, None), (seq, SAVED, self.number, None, saved)]

    def advance(self, kind, content, tool, call_id, given, output, turn_id) -> list[tuple]:
        """The events of one message."""
        if self.done or kind == "idle" and not self.turn:
            return []
        self.turn = self.turn or bool(turn_id)
        if kind == "text":
            if not content:
                return []
            made = []
            if not self.open:
                self.number, self.open = self.number + 1, True
                made.append((0, "TEXT_MESSAGE_START", self.number, None, None))
            self.text += content
            return [*made, (1, "TEXT_MESSAGE_CONTENT", self.number, None, content)]
        if kind == "error":
            return [(0, "RUN_ERROR", None, None, content)]
        if kind == "tool_use":
            made = [*self._close(0), (1, "TOOL_CALL_START", self.number, call_id, tool)]
            return [*made, (2, "TOOL_CALL_ARGS", self.number, call_id, given)] if given else made
        if kind == "tool_result":
            made = [*self._close(0), (1, "TOOL_CALL_END", self.number, call_id, None)]
            result = [(2, "TOOL_CALL_RESULT", self.number, call_id, output), (2, SAVED, self.number, call_id, output)]
            return [*made, *result] if output else made
        if kind in ("end", "idle", "error_end"):
            self.done, self.waiting = True, {}
            if kind == "error_end":
                return [(0, "RUN_ERROR", None, None, content), *self._close(1), (2, "RUN_ERROR", None, None, content)]
            failed = kind == "end" and content
            return [*self._close(0), (1, "RUN_ERROR" if failed else "RUN_FINISHED", None, None, content if failed else None)]
        return []

    def take(self, ordinal: int, message: list) -> None:
        if ordinal >= self.next and not self.done:
            self.waiting[str(ordinal)] = message

    def release(self) -> list[tuple]:
        """Events of the messages whose turn it is, with their ordinal."""
        made = []
        while (message := self.waiting.pop(str(self.next), None)) is not None:
            made += [(self.next, *event) for event in self.advance(*message)]
            self.next += 1
        return made

    def give_up(self) -> list[tuple]:
        """Events of all that waits, over the gaps, and the END of open text without an ordinal."""
        made = []
        while self.waiting:
            self.next = min(map(int, self.waiting))
            made += self.release()
        return [*made, *[(None, *event) for event in self._close(0)]]


#: Type of the rows that hold a message to store: its whole text, or a tool's output.
SAVED = "MESSAGE_SAVED"


def _fold_run(first: int, idle_ms: int):
    names = [part.split()[0] for part in OUTPUT_SCHEMA.split(", ")]

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = _Run(state.get if state.exists else None, first)
        if state.hasTimedOut:
            rows = run.give_up()
        else:
            rows = []
            for batch in batches:
                for row in batch.itertuples(index=False):
                    run.take(row.ordinal, [getattr(row, c) for c in MESSAGE_FIELDS])
                rows += run.release()
        state.update(run.values())
        if idle_ms and not state.hasTimedOut:
            state.setTimeoutDuration(idle_ms)
        out = pd.DataFrame([(key[0], *row) for row in rows], columns=names)
        for c in ("ordinal", "message_no"):
            out[c] = out[c].astype("Int64")
        yield out

    return fold


def stream_events(messages: DataFrame, first: int = 0, idle_ms: int = 0) -> DataFrame:
    """Client events of a stream of ``run_id, ordinal`` and message columns.

    Ordinals of a run count up from ``first`` without gaps, but may arrive in any
    order: a message waits in its run's state until all before it are there, so an ordinal
    comes out once and in order, and one that comes again is ignored. Rows of type
    ``SAVED`` hold the messages to store. A run's state is its open text and what
    waits (at most ``MAX_WAITING`` bytes, else the query fails); after its end, flags
    only. With ``idle_ms``, a run without messages for that long gives out what
    waits, over the gaps, and closes open text, as the batch fold does when a log stops.
    """
    columns = messages.select("run_id", F.col("ordinal").cast("long").alias("ordinal"), *MESSAGE_FIELDS)
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return columns.groupBy("run_id").applyInPandasWithState(
        _fold_run(first, idle_ms), OUTPUT_SCHEMA, STATE_SCHEMA, "append", timeout
    )
