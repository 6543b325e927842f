"""Page listing, search and checks over ``rel_path, text`` rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawler.functions.text import pipe_cell, stem_of_path
from trawler.functions.wiki import (
    ANY_NAMESPACE,
    PAGE_KINDS,
    REQUIRED_SECTIONS,
    in_kind_folder,
    matches_any,
    meta_value,
    section_error,
    section_marks,
    sections,
    table_rows,
)
from trawler.operators.fusion import first_or_else

# Output columns of the table searches and the source column of each.
TABLE_COLUMNS = {
    "index": (("slug", 2), ("type", 0), ("description", 1)),
    "glossary": (("slug", 3), ("glossary", 0), ("type", 1), ("description", 2)),
}


def parse_pages(files: DataFrame, namespace: str = ANY_NAMESPACE) -> DataFrame:
    """Add the page columns to ``rel_path, text`` rows.

    ``error`` tells why a page cannot be read. Steps are separate projections,
    so the split text and the marker scan are computed once per page.
    """
    whole = F.regexp_replace("text", r"^\x{FEFF}", "")
    end = F.when(F.startswith(whole, F.lit("---\n")), F.locate("\n---", whole, 4)).otherwise(0)
    cut = files.withColumn("_text", whole).withColumn("_end", end)
    after = F.expr("substring(_text, _end + 4)")
    body = F.when(F.col("_end") > 0, F.regexp_replace(after, r"^\n", ""))
    split = cut.withColumn("_meta", F.expr("substring(_text, 5, _end - 5)")).withColumn("text", body)
    lines = F.split(F.replace("text", F.lit("\r\n"), F.lit("\n")), "\n")
    marked = split.withColumn("_lines", lines).withColumn("_marks", section_marks(F.col("_lines"), namespace))
    checked = marked.withColumn(
        "error",
        F.when(F.col("_end") == 0, "missing YAML frontmatter").otherwise(section_error(F.col("_marks"))),
    )
    value = lambda key: meta_value(F.col("_meta"), key)
    slug = F.coalesce(F.nullif(value("slug"), F.lit("")), stem_of_path(F.col("rel_path")))
    return (
        checked.withColumn("slug", slug)
        .withColumn("title", F.coalesce(F.nullif(value("title"), F.lit("")), "slug"))
        .withColumn("kind", value("kind"))
        .withColumn("status", value("status"))
        .withColumn("summary", value("summary"))
        .withColumn("sections", F.when(F.col("error").isNull(), sections(F.col("_lines"), F.col("_marks"))))
        .drop("_text", "_end", "_meta", "_lines", "_marks")
    )


def pages(files: DataFrame, kind: str, namespace: str = ANY_NAMESPACE) -> DataFrame:
    """Parsed pages of ``wiki/<kind>s/**.md``."""
    folder = F.col("rel_path").startswith(f"wiki/{kind}s/") & F.col("rel_path").endswith(".md")
    return parse_pages(files.filter(folder), namespace)


def search_table(files: DataFrame, kind: str, queries: list[str]) -> DataFrame:
    """Rows of the first table of each file that contain any query."""
    rows = files.select("rel_path", F.posexplode(table_rows(F.col("text"))).alias("row_no", "cells"))
    hits = rows.filter(matches_any(queries, F.array_join("cells", " ")))
    cells = [
        pipe_cell(F.coalesce(F.try_element_at("cells", F.lit(at + 1)), F.lit(""))).alias(name)
        for name, at in TABLE_COLUMNS[kind]
    ]
    return hits.select("rel_path", "row_no", *cells)


def search_pages(parsed: DataFrame, queries: list[str]) -> DataFrame:
    """Substring search over title, slug, summary and text."""
    haystack = F.concat_ws("\n", "title", "slug", "summary", "text")
    return parsed.filter(matches_any(queries, haystack)).select("rel_path", "slug", "title")


def page_hits(results: DataFrame, parsed: DataFrame, kind: str) -> DataFrame:
    """Search results inside the kind's folder, shown with page metadata."""
    hits = results.filter(in_kind_folder(F.col("rel_path"), kind)).withColumn(
        "_page",
        F.when(F.col("rel_path").startswith("wiki/"), F.col("rel_path")).otherwise(
            F.concat(F.lit("wiki/"), "rel_path")
        ),
    )
    known = parsed.filter(F.col("error").isNull()).select(
        F.col("rel_path").alias("_page"), F.col("slug").alias("_slug"), F.col("title").alias("_title")
    )
    slug = stem_of_path(F.col("rel_path"))
    return hits.join(known, "_page", "left").select(
        pipe_cell(F.coalesce("_slug", slug)).alias("slug"),
        pipe_cell(F.coalesce("_title", F.nullif("title", F.lit("")), slug)).alias("title"),
        F.round("score", 2).alias("score"),
    )


def find_pages(results: DataFrame, parsed: DataFrame, kind: str, queries: list[str]) -> DataFrame:
    """Pages of a kind: search results, or without any the pages that hold a query as a
    substring (no score)."""
    found = search_pages(parsed.filter(F.col("error").isNull() & in_kind_folder(F.col("rel_path"), kind)), queries)
    found = found.select(pipe_cell(F.col("slug")).alias("slug"), pipe_cell(F.col("title")).alias("title"))
    return first_or_else(page_hits(results, parsed, kind), found)


def check_documents(files: DataFrame, namespace: str = ANY_NAMESPACE) -> DataFrame:
    """One row per problem of the topic and workflow pages: unreadable, or a
    required section that is missing or blank."""
    folders = "|".join(f"{k}s" for k in PAGE_KINDS)
    mine = files.filter(F.col("rel_path").rlike(rf"^wiki/({folders})/.*\.md$"))
    parsed = parse_pages(mine.select("rel_path", "text"), namespace)
    text = lambda s: F.coalesce(F.try_element_at("sections", F.lit(s)), F.lit(""))
    missing = F.array_compact(
        F.array(*[
            F.when(~text(s).rlike(r"\S"), F.lit(f'missing required section "{s}"')) for s in REQUIRED_SECTIONS
        ])
    )
    problems = F.when(F.col("error").isNotNull(), F.array("error")).otherwise(missing)
    return parsed.select("rel_path", F.explode(problems).alias("problem")).select(
        "rel_path", F.concat("rel_path", F.lit(": "), "problem").alias("issue")
    )


def read_section(parsed: DataFrame, slug: str, view: str = "card") -> DataFrame:
    return parsed.filter(F.col("slug") == slug).select(
        "rel_path", F.try_element_at("sections", F.lit(view)).alias("section")
    )


def glossary_terms(files: DataFrame) -> DataFrame:
    """Non-empty first cells of the glossary table, in order."""
    rows = files.select(F.posexplode(table_rows(F.col("text"))).alias("row_no", "cells"))
    return rows.select("row_no", F.col("cells")[0].alias("term")).filter(F.col("term") != "")
