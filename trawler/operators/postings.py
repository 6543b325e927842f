"""Positional postings: one row per token occurrence.

Columns: ``term, rowid, field, pos, doc_len``. ``doc_len`` (all tokens of the
row, every field) rides on each posting so that scoring needs no join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawler.functions.stem import stems
from trawler.functions.text import tokens
from trawler.operators.lookup import small
from trawler.session import settle

POSTING_COLUMNS = ["term", "rowid", "field", "pos", "doc_len"]


def _occurrences(field: str) -> Column:
    return F.transform(
        field,
        lambda term, pos: F.struct(
            term.alias("term"), F.lit(field).alias("field"), pos.cast("int").alias("pos")
        ),
    )


def stem_terms(occurrences: DataFrame, stemmer: str) -> DataFrame:
    """Rows with ``term`` replaced by its stem.

    The rewrite table is made from the distinct terms and holds those that change. It is
    broadcast while it is small and joined by a shuffle (which splits a term that is
    everywhere) beyond that.
    """
    if stemmer != "porter":
        return occurrences
    # Written before the filter, which would else be pushed through all steps and copy them.
    told = settle(stems(occurrences.select("term").distinct()))
    changed = small(told.filter("stem <> term"))
    columns = [F.coalesce("stem", "term").alias("term") if c == "term" else F.col(c) for c in occurrences.columns]
    return occurrences.join(changed, "term", "left").select(*columns)


def tokenized(rows: DataFrame, fields: dict[str, Column], keep: list[str]) -> DataFrame:
    """``keep`` columns, one token array per field, and ``doc_len``."""
    arrays = rows.select(*keep, *[tokens(col).alias(name) for name, col in fields.items()])
    length = reduce(lambda a, b: a + b, [F.size(name) for name in fields])
    return arrays.withColumn("doc_len", length)


def explode_postings(token_rows: DataFrame, fields: list[str], keep: list[str]) -> DataFrame:
    """Flatten token arrays of every field into occurrences; no shuffle."""
    arrays = F.concat(*[_occurrences(name) for name in fields])
    return token_rows.select(*keep, "doc_len", F.inline(arrays))


def build_postings(rows: DataFrame, fields: dict[str, Column], stemmer: str) -> DataFrame:
    occurrences = explode_postings(tokenized(rows, fields, ["rowid"]), list(fields), ["rowid"])
    return stem_terms(occurrences, stemmer).select(*POSTING_COLUMNS)


#: Occurrences that one task sorts, about 100 MB of rows.
ROWS_PER_RANGE = 1_000_000


def ranges(session: SparkSession, rows: int) -> int:
    """Term ranges that ``rows`` occurrences are cut into, or 0 to leave it to the session.

    The session's number does not grow with the input, and the rows of a range are sorted in one task.
    """
    wanted = -(-rows // ROWS_PER_RANGE)
    return wanted if wanted > int(session.conf.get("spark.sql.shuffle.partitions")) else 0


def write_postings(postings: DataFrame, path: str, rows: int = 0) -> None:
    """Write ``rows`` occurrences sorted by term, so a query reads only the pages of its terms.

    Ranges are cut on (term, rowid): a term that holds a third of all
    occurrences is spread over many files instead of filling one task.
    """
    count = ranges(postings.sparkSession, rows)
    (
        postings.repartitionByRange(*[count] * bool(count), "term", "rowid")
        .sortWithinPartitions("term", "rowid")
        .write.mode("overwrite")
        .parquet(path)
    )


def corpus_stats(doc_lens: DataFrame) -> tuple[int, int]:
    """(rows, total tokens) from a narrow ``doc_len`` column."""
    row = doc_lens.agg(F.count("*").alias("n"), F.sum("doc_len").alias("t")).first()
    return row.n, row.t or 0
