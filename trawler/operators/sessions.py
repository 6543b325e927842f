"""Sessions, runs, messages and the event log, as keyed tables.

A key (a session or a run) may own any share of the rows. Ordered work is
therefore done per (key, bucket), where ``bucket`` is a coarse, order-preserving
function of the order columns; a window over one small row per bucket carries
the state from bucket to bucket. Where no bucket column is named, rows are cut into
ranges of (key, order), so that a bucket is as large as a task whatever the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawler.functions.text import shorten, trim_space
from trawler.session import settle

# Fixed values.
DEFAULT_AGENT = "codex"
DEFAULT_TITLE = "新对话"
SESSION_LIMIT = 50
TITLE_CHARS, AUTO_TITLE_CHARS = 80, 30

EVENT_FIELDS = "struct<seq:int,type:string,message_no:bigint,call_id:string,body:string>"


RANGE = "_range"


def in_ranges(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows with ``RANGE``, the number of their range of (key, order).

    Ranges are cut from a sample, so they are written once and read from there.
    """
    return settle(rows.repartitionByRange(key, *order).withColumn(RANGE, F.spark_partition_id()))


def number_rows(
    rows: DataFrame, key: str, bucket: str | None, order: list[str], name: str = "ordinal"
) -> DataFrame:
    """1-based position of each row within its key."""
    if bucket is None:
        return number_rows(in_ranges(rows, key, order), key, RANGE, order, name).drop(RANGE)
    within = Window.partitionBy(key, bucket).orderBy(*order)
    sizes = rows.groupBy(key, bucket).agg(F.count("*").alias("_size"))
    before = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(key, bucket, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    return (
        rows.withColumn("_at", F.row_number().over(within))
        .join(offsets, [key, bucket])
        .withColumn(name, F.col("_before") + F.col("_at"))
        .drop("_at", "_before")
    )


def last_write_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row of each key; combines before the shuffle."""
    others = [c for c in rows.columns if c != key]
    newest = F.max_by(F.struct(*others), F.struct(*order))
    return rows.groupBy(key).agg(newest.alias("_row")).select(key, "_row.*").select(*rows.columns)


def add_sessions(sessions: DataFrame, new: DataFrame) -> DataFrame:
    """Keep existing sessions as they are; fill the defaults of new ones."""
    fresh = new.join(sessions.select("id"), "id", "left_anti")
    title = trim_space(F.coalesce("title", F.lit("")))
    fresh = (
        fresh.withColumn("agent_id", F.coalesce(F.nullif("agent_id", F.lit("")), F.lit(DEFAULT_AGENT)))
        .withColumn("title", F.when(title != "", F.col("title")).otherwise(F.lit(DEFAULT_TITLE)))
        .withColumn("status", F.coalesce(F.nullif("status", F.lit("")), F.lit("idle")))
    )
    return sessions.unionByName(fresh, allowMissingColumns=True)


def update_sessions(sessions: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply run updates; an empty thread or run id leaves the old value.

    ``updates``: ``id, backend_thread_id, last_run_id, status, updated_at``,
    at most one row per session.
    """
    names = ["backend_thread_id", "last_run_id", "status", "updated_at"]
    changed = updates.select("id", *[F.col(n).alias(f"_{n}") for n in names], F.lit(True).alias("_hit"))
    joined = sessions.join(changed, "id", "left")
    for n in ("backend_thread_id", "last_run_id", "updated_at"):
        given = F.nullif(F.col(f"_{n}"), F.lit("")) if n != "updated_at" else F.col(f"_{n}")
        joined = joined.withColumn(n, F.coalesce(given, n))
    status = F.coalesce(F.nullif("_status", F.lit("")), F.lit("idle"))
    joined = joined.withColumn("status", F.when(F.col("_hit"), status).otherwise(F.col("status")))
    return joined.select(*sessions.columns)


def get_session(sessions: DataFrame, session: str) -> DataFrame:
    return sessions.filter(F.col("id") == session)


def rename_sessions(sessions: DataFrame, titles: DataFrame) -> DataFrame:
    """Apply ``id, title, updated_at`` rows, at most one per session; titles are cut."""
    given = titles.select("id", session_title(F.col("title")).alias("_title"), F.col("updated_at").alias("_at"))
    joined = sessions.join(given, "id", "left")
    joined = joined.withColumn("title", F.coalesce("_title", "title")).withColumn("updated_at", F.coalesce("_at", "updated_at"))
    return joined.select(*sessions.columns)


def delete_sessions(sessions: DataFrame, gone: DataFrame) -> DataFrame:
    """Sessions without those in ``gone`` (id). Runs, messages and events stay."""
    return sessions.join(gone.select("id").distinct(), "id", "left_anti")


def list_sessions(sessions: DataFrame, agent: str = "", limit: int = SESSION_LIMIT) -> DataFrame:
    """The ``limit`` sessions updated last; the default number if it is not positive."""
    limit = limit if limit > 0 else SESSION_LIMIT
    if agent.strip():
        sessions = sessions.filter(F.col("agent_id") == agent)
    return sessions.orderBy(F.desc("updated_at"), "id").limit(limit)


def start_runs(runs: DataFrame, requests: DataFrame) -> DataFrame:
    """Add requested runs (``id, session_id, agent_id, started_at``), except
    for sessions that are busy with a running one."""
    busy = runs.filter(F.col("status") == "running").select("session_id")
    started = (
        requests.join(busy, "session_id", "left_anti")
        .withColumn("agent_id", F.coalesce(F.nullif("agent_id", F.lit("")), F.lit(DEFAULT_AGENT)))
        .withColumn("status", F.lit("running"))
        .withColumn("created_at", F.col("started_at"))
        .withColumn("updated_at", F.col("started_at"))
    )
    return runs.unionByName(started, allowMissingColumns=True)


def finish_runs(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Apply ``id, status, error_code, error_message, finished_at`` rows, at
    most one per run; other runs stay as they are."""
    names = ["status", "error_code", "error_message", "finished_at"]
    done = results.select("id", *[F.col(n).alias(f"_{n}") for n in names])
    joined = runs.join(done, "id", "left")
    hit = F.col("_finished_at").isNotNull()
    for n in names:
        joined = joined.withColumn(n, F.when(hit, F.col(f"_{n}")).otherwise(F.col(n)))
    joined = joined.withColumn("updated_at", F.coalesce("_finished_at", "updated_at"))
    return joined.select(*runs.columns)


def running_run(runs: DataFrame, session: str) -> DataFrame:
    mine = runs.filter((F.col("session_id") == session) & (F.col("status") == "running"))
    return mine.orderBy(F.desc("updated_at"), "id").limit(1)


def list_messages(messages: DataFrame, session: str) -> DataFrame:
    return messages.filter(F.col("session_id") == session).orderBy("ordinal")


def session_title(title: Column) -> Column:
    cut = shorten(trim_space(title), TITLE_CHARS)
    return F.when(cut == "", F.lit(DEFAULT_TITLE)).otherwise(cut)


def auto_title(prompt: Column) -> Column:
    return shorten(trim_space(prompt), AUTO_TITLE_CHARS)


def latest_user_message(messages: DataFrame, key: str, order: str) -> DataFrame:
    """Per key the last non-empty message of the user (or of no role)."""
    mine = messages.filter(
        (F.coalesce("role", F.lit("")).isin("", "user")) & (F.coalesce("content", F.lit("")) != "")
    )
    last = F.max_by(F.struct(F.col(order).alias("at"), F.col("content").alias("text")), order)
    return mine.groupBy(key).agg(last.alias("m")).select(key, "m.at", "m.text")


def content_text(content: Column) -> Column:
    """Text of a message body: a JSON string, or its parts' texts by line."""
    parts = F.from_json(content, "array<struct<text:string>>")
    texts = F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t.isNotNull() & (t != ""))
    plain = F.from_json(F.concat(F.lit("["), content, F.lit("]")), "array<string>")[0]
    return F.when(content.rlike(r"^\s*\["), F.array_join(texts, "\n")).when(
        content.rlike(r'^\s*"'), plain
    ).otherwise(F.lit(""))


def json_map(content: Column) -> Column:
    """A JSON object as a map; anything malformed is null."""
    return F.from_json(content, "map<string,string>")


def run_status(events: DataFrame, key: str, order: Column) -> DataFrame:
    """Latest status of each run: started, then finished or failed."""
    status = (
        F.when(F.col("type") == "RUN_STARTED", "running")
        .when(F.col("type") == "RUN_FINISHED", "completed")
        .when(F.col("type") == "RUN_ERROR", "failed")
    )
    marked = events.withColumn("_status", status).filter(F.col("_status").isNotNull())
    return marked.groupBy(key).agg(
        F.max_by("_status", order).alias("status"), F.count("*").alias("changes")
    )


#: Kinds that end a run; ``error_end`` reports its failure before and after.
ENDS = ("end", "error_end")


def end_turns(messages: DataFrame, run: str, order: list[str]) -> DataFrame:
    """Messages up to the end of their run's turn, which is then of kind ``end`` or ``error_end``.

    The first end of a run counts and what follows it is left out. An ``idle`` row
    ends a turn only if one was opened before it (by a row with a ``turn_id``).
    Both facts are one small row per run, aggregated before the shuffle.
    """
    at = F.struct(*order)
    opened = messages.filter(F.coalesce("turn_id", F.lit("")) != "").groupBy(run).agg(F.min(at).alias("_opened"))
    idle = messages.filter("kind = 'idle'").select(run, at.alias("_at")).join(opened, run).filter("_at > _opened")
    ends = messages.filter(F.col("kind").isin(*ENDS)).select(run, at.alias("_at"))
    ended = ends.unionByName(idle.select(run, "_at")).groupBy(run).agg(F.min("_at").alias("_ended"))
    rows = messages.withColumn("_at", at).join(ended, run, "left")
    idles = F.col("kind") == "idle"
    rows = rows.filter(F.col("_ended").isNull() | (F.col("_at") <= F.col("_ended")))
    rows = rows.filter(~idles | F.coalesce(F.col("_at") == F.col("_ended"), F.lit(False)))
    return rows.withColumn("kind", F.when(idles, "end").otherwise(F.col("kind"))).drop("_at", "_ended")


def _linked(messages: DataFrame, run: str, bucket: str, order: list[str]) -> DataFrame:
    """Text, tool and end rows with ``after_text``, the number of the message, and
    ``_last`` on the last one of a run."""
    rows = messages.filter(
        ((F.col("kind") == "text") & (F.col("content") != "")) | F.col("kind").isin("tool_use", "tool_result", *ENDS)
    ).withColumn("_text", F.col("kind") == "text")
    within = Window.partitionBy(run, bucket).orderBy(*order)
    local = rows.withColumn("_prev", F.lag("_text").over(within)).withColumn(
        "_tail", F.lead("_text").over(within).isNull()
    )
    at = F.struct(*order)
    starts_inside = F.sum((F.col("_text") & ~F.coalesce("_prev", F.lit(True))).cast("long"))
    per_bucket = local.groupBy(run, bucket).agg(
        F.min_by("_text", at).alias("_first"), F.max_by("_text", at).alias("_last"), starts_inside.alias("_inside")
    )
    along = Window.partitionBy(run).orderBy(bucket)
    per_bucket = per_bucket.withColumn("_carried", F.coalesce(F.lag("_last").over(along), F.lit(False)))
    per_bucket = per_bucket.withColumn("_final", F.lead("_last").over(along).isNull())
    starts = F.col("_inside") + (F.col("_first") & ~F.col("_carried")).cast("long")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.withColumn("_starts", starts).withColumn(
        "_offset", F.coalesce(F.sum("_starts").over(before), F.lit(0))
    )
    joined = local.join(per_bucket.select(run, bucket, "_carried", "_offset", "_final"), [run, bucket])
    joined = joined.withColumn("after_text", F.coalesce("_prev", "_carried"))
    opened = (F.col("_text") & ~F.col("after_text")).cast("long")
    running = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        joined.withColumn("message_no", F.col("_offset") + F.sum(opened).over(running))
        .withColumn("_last", F.col("_tail") & F.col("_final"))
        .drop("_prev", "_carried", "_offset", "_tail", "_final")
    )


def fold_events(messages: DataFrame, run: str, bucket: str | None, order: list[str]) -> DataFrame:
    """Turn a message stream into client events.

    A text message is START, CONTENT*, END; a tool event or the end of the run
    closes open text first. A run that ends gives RUN_FINISHED, or RUN_ERROR
    if its end has content. Rows: run, order columns, ``seq`` within the source
    row, ``type``, ``message_no`` (the text message, or the one a tool call
    belongs to), ``call_id``, ``body``. The END of text still open when the log
    stops has null order columns and comes last.
    """
    if bucket is None:
        return fold_events(in_ranges(messages, run, order), run, RANGE, order)
    rows = _linked(messages, run, bucket, order)
    none, no_number = F.lit(None).cast("string"), F.lit(None).cast("long")

    def event(seq, kind, call=none, body=none, when=None, number=None, last=False):
        made = F.struct(
            F.struct(
                F.lit(seq).alias("seq"), F.lit(kind).alias("type"),
                (F.col("message_no") if number is None else number).alias("message_no"),
                call.alias("call_id"), body.alias("body"),
            ).cast(EVENT_FIELDS).alias("e"),
            F.lit(last).alias("last"),
        )
        return made if when is None else F.when(when, made)

    call = F.col("call_id")
    given = lambda name: F.coalesce(name, F.lit("")) != ""
    kind, body = F.col("kind"), F.col("content")

    def closing(seq):
        return event(seq, "TEXT_MESSAGE_END", when=F.col("after_text"))

    made = (
        F.when(
            kind == "text",
            F.array(
                event(0, "TEXT_MESSAGE_START", when=~F.col("after_text")),
                event(1, "TEXT_MESSAGE_CONTENT", body=body),
                event(0, "TEXT_MESSAGE_END", when=F.col("_last"), last=True),
            ),
        )
        .when(
            kind == "tool_use",
            F.array(
                closing(0),
                event(1, "TOOL_CALL_START", call, F.col("tool")),
                event(2, "TOOL_CALL_ARGS", call, F.col("input"), given("input")),
            ),
        )
        .when(
            kind == "tool_result",
            F.array(
                closing(0),
                event(1, "TOOL_CALL_END", call),
                event(2, "TOOL_CALL_RESULT", call, F.col("output"), given("output")),
            ),
        )
        .when(
            kind == "end",
            F.array(
                closing(0),
                event(1, "RUN_ERROR", body=body, when=given("content"), number=no_number),
                event(1, "RUN_FINISHED", when=~given("content"), number=no_number),
            ),
        )
        .otherwise(
            F.array(
                event(0, "RUN_ERROR", body=body, number=no_number),
                closing(1),
                event(2, "RUN_ERROR", body=body, number=no_number),
            )
        )
    )
    dealt = rows.select(run, *order, F.explode(F.array_compact(made)).alias("m"))
    events = dealt.select(run, *[F.when(~F.col("m.last"), F.col(c)).alias(c) for c in order], "m.e.*")
    failed = messages.filter(kind == "error").select(
        run,
        *order,
        F.lit(0).alias("seq"),
        F.lit("RUN_ERROR").alias("type"),
        no_number.alias("message_no"),
        none.alias("call_id"),
        body.alias("body"),
    )
    return events.unionByName(failed)


def saved_messages(messages: DataFrame, run: str, bucket: str | None, order: list[str]) -> DataFrame:
    """Messages to store: each text message joined up, and each tool output.

    The text of one message is one string value, so its pieces meet in one row.
    """
    if bucket is None:
        return saved_messages(in_ranges(messages, run, order), run, RANGE, order)
    rows = _linked(messages, run, bucket, order)
    piece = F.struct(*order, "content")
    texts = (
        rows.filter("_text")
        .groupBy(run, "message_no")
        .agg(F.array_sort(F.collect_list(piece)).alias("_pieces"))
        .select(
            run,
            "message_no",
            F.lit("assistant").alias("role"),
            F.lit(None).cast("string").alias("tool_call_id"),
            F.array_join(F.transform("_pieces", lambda p: p["content"]), "").alias("content"),
        )
    )
    tools = rows.filter((F.col("kind") == "tool_result") & (F.coalesce("output", F.lit("")) != "")).select(
        run, "message_no", F.lit("tool").alias("role"), F.col("call_id").alias("tool_call_id"),
        F.col("output").alias("content"),
    )
    return texts.unionByName(tools)
