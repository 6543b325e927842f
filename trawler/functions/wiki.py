"""Column functions for structured Markdown pages.

Pages have YAML front matter and named sections between comment markers such
as ``<!-- <namespace>:section id=card -->`` and ``<!-- /<namespace>:section -->``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trawler.functions.text import stem_of_path, trim_space

BLANK = r"[ \t\r\f\x0B]*"
# The sections a page must have.
REQUIRED_SECTIONS = ("card", "core", "explain")
PAGE_KINDS = ("topic", "workflow")
ANY_NAMESPACE = "[a-z]+"


def _start(namespace: str) -> str:
    return rf"<!--[ \t]*(?:{namespace}):section[ \t]+id=([A-Za-z0-9_-]+)[ \t]*-->"


def _end(namespace: str) -> str:
    return rf"<!-- /(?:{namespace}):section -->"


def meta_value(meta: Column, key: str) -> Column:
    """A top-level scalar of the front matter, without quotes; nested keys
    are indented and therefore never match."""
    raw = trim_space(F.regexp_extract(meta, rf"(?md)^{key}:[ \t]*([^\n]*)$", 1))
    plain = F.regexp_replace(raw, r"[ \t]+#.*$", "")
    quoted = raw.rlike(r"""^(".*"|'.*')$""")
    return F.when(quoted, F.regexp_replace(raw, r"""^["']|["']$""", "")).otherwise(plain)


def section_marks(lines: Column, namespace: str = ANY_NAMESPACE) -> Column:
    """Marker lines in order: line index, and the section id of a start
    marker (empty for an end marker)."""
    start, end = f"^{BLANK}{_start(namespace)}{BLANK}$", f"^{BLANK}{_end(namespace)}{BLANK}$"
    mark = lambda line, i: F.when(
        F.contains(line, F.lit("<!--")) & (line.rlike(start) | line.rlike(end)),
        F.struct(i.alias("line"), F.regexp_extract(line, start, 1).alias("id")),
    )
    return F.array_compact(F.transform(lines, mark))


def section_error(marks: Column) -> Column:
    """Null for well-formed sections, else what is wrong first: markers must
    alternate start, end, start, end."""
    indexed = F.transform(marks, lambda m, i: F.struct(i.alias("i"), m["id"].alias("id")))
    first = F.try_element_at(
        F.filter(indexed, lambda m: (m["id"] != "") != (m["i"] % 2 == 0)), F.lit(1)
    )
    last = F.try_element_at(marks, F.lit(-1))
    return (
        F.when(first["id"] != "", F.concat(F.lit('nested section "'), first["id"], F.lit('"')))
        .when(first.isNotNull(), F.lit("unexpected section end"))
        .when(F.size(marks) % 2 == 1, F.concat(F.lit('unclosed section "'), last["id"], F.lit('"')))
    )


def sections(lines: Column, marks: Column) -> Column:
    """``map<string,string>`` of section id to text, from well-formed marks;
    a repeated id keeps its last text."""
    count = F.size(marks) / 2
    spans = F.transform(
        F.sequence(F.lit(1), F.greatest(count.cast("int"), F.lit(1))),
        lambda k: F.struct(
            F.try_element_at(marks, k * 2 - 1)["id"].alias("id"),
            F.try_element_at(marks, k * 2 - 1)["line"].alias("a"),
            F.try_element_at(marks, k * 2)["line"].alias("b"),
        ),
    )
    whole = F.filter(spans, lambda s: s["b"].isNotNull())
    newest = F.filter(whole, lambda s: ~F.exists(whole, lambda o: (o["id"] == s["id"]) & (o["a"] > s["a"])))
    text = lambda s: F.array_join(F.slice(lines, s["a"] + 2, s["b"] - s["a"] - 1), "\n")
    return F.map_from_entries(
        F.transform(newest, lambda s: F.struct(s["id"], F.regexp_replace(text(s), r"\n+$", "")))
    )


def table_rows(text: Column) -> Column:
    """Data rows of the first pipe table, each an array of cells.

    Header and separator rows are dropped; an escaped pipe stays in its cell. Lines are
    tested one by one: a pattern over a whole table recurses once per line.
    """
    line = rf"(?d)^{BLANK}\|(?:[^\n]*\|)?{BLANK}$"
    every = F.split(text, "\n")
    start = F.array_position(F.transform(every, lambda x: x.rlike(line)), True)
    rest = F.when(start > 0, F.slice(every, F.greatest(start.cast("int"), F.lit(1)), F.size(every)))
    end = F.array_position(F.transform(rest, lambda x: x.rlike(line)), False).cast("int")
    block = F.slice(rest, F.lit(1), F.when(end > 0, end - 1).otherwise(F.size(rest)))
    lines = F.transform(F.when(text.isNotNull(), F.coalesce(block, F.array().cast("array<string>"))), trim_space)

    def cells(row: Column) -> Column:
        inner = F.regexp_replace(row, r"^\|+|(?<!\\)\|+$", "")
        return F.transform(
            F.split(inner, r"(?<!\\)\|"), lambda c: trim_space(F.replace(c, F.lit("\\|"), F.lit("|")))
        )

    body = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    return F.filter(F.transform(body, cells), lambda row: ~F.forall(row, lambda c: c.rlike("^[ :-]*$")))


def matches_any(queries: list[str], haystack: Column) -> Column:
    """Whether the text contains any query, ignoring case; none match all."""
    wanted = [q.strip().lower() for q in queries if q.strip()]
    if not wanted:
        return F.lit(True)
    low = F.lower(haystack)
    return F.exists(F.array(*[F.lit(q) for q in wanted]), lambda q: F.contains(low, q))


def in_kind_folder(path: Column, kind: str) -> Column:
    return F.startswith(path, F.lit(f"{kind}s/")) | F.contains(path, F.lit(f"/{kind}s/"))
