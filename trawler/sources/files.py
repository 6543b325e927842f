"""Read collections of files, and write result frames."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawler.functions.globs import included
from trawler.functions.text import pipe_cell

#: Chosen files named in one read.
PATHS_PER_READ = 50_000


def scan_files(spark: SparkSession, path: str, include: list[str], ignore: list[str] = ()) -> DataFrame:
    """``rel_path, abs_path, body, mtime, size_bytes`` of the wanted files.

    The folder is listed first, without contents; only the chosen files are opened.
    So a file that is not wanted may be unreadable or of any size.
    """
    root = path.rstrip("/")
    # Listings name files by URI (file:/x, s3://b/x), so cut after the root.
    full = F.regexp_replace("path", r"^file:/+", "/")
    plain = root[len("file:"):] if root.startswith("file:") else root
    reader = spark.read.format("binaryFile")

    def told(files: DataFrame) -> DataFrame:
        return files.withColumn("abs_path", full).withColumn(
            "rel_path", F.expr("substring(abs_path, length(%s) + 2)" % _quote(plain))
        )

    listed = told(reader.option("recursiveFileLookup", "true").load(root).select("path"))
    # The names of a listing are on the driver already.
    chosen = [r["path"] for r in listed.filter(included(F.col("rel_path"), list(include), list(ignore))).select("path").collect()]
    if not chosen:
        return spark.createDataFrame([], "rel_path string, abs_path string, body string, mtime timestamp, size_bytes long")
    reads = [
        spark.read.format("binaryFile").load([_glob_safe(p) for p in chosen[k : k + PATHS_PER_READ]])
        for k in range(0, len(chosen), PATHS_PER_READ)
    ]
    return told(reduce(DataFrame.unionByName, reads)).select(
        "rel_path",
        "abs_path",
        F.col("content").cast("string").alias("body"),
        F.col("modificationTime").alias("mtime"),
        F.col("length").alias("size_bytes"),
    )


def _glob_safe(path: str) -> str:
    """A listed path as one that names just this file: no character is a pattern."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Column functions that turn a file's text into the text to index, by suffix.
_extractors: dict[str, Callable[[Column], Column]] = {".md": lambda body: body}


def register_extractor(suffix: str, extract: Callable[[Column], Column]) -> None:
    """Index files of another suffix (``.txt``), read by a column function."""
    _extractors[suffix.lower()] = extract


def extracted(files: DataFrame) -> DataFrame:
    """``files`` with ``body`` as its suffix's extractor reads it.

    A file without an extractor fails the job, before anything is indexed.
    """
    suffix = F.lower(F.regexp_extract("rel_path", r"(\.[^./]*)$", 1))
    known = ", ".join(sorted(_extractors))
    body = F.raise_error(
        F.concat(F.lit(f"unsupported source file, only {known} is currently supported: "), "rel_path")
    ).cast("string")
    for name, extract in _extractors.items():
        body = F.when(suffix == name, extract(F.col("body"))).otherwise(body)
    return files.withColumn("body", body)


def json_lines(results: DataFrame) -> DataFrame:
    """One JSON document per result row."""
    return results.select(F.to_json(F.struct("*")).alias("value"))


def pipe_table(results: DataFrame) -> DataFrame:
    """One pipe-table line per result row; cells are escaped."""
    cells = [pipe_cell(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in results.columns]
    return results.select(F.concat(F.lit("|"), F.concat_ws("|", *cells), F.lit("|")).alias("value"))
