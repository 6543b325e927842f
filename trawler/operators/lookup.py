"""Joins from a small ranked frame back to a large table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawler.config import BROADCAST_MAX_ROWS


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a frame of at most ``rows`` rows, if that is small."""
    return F.broadcast(df) if rows <= BROADCAST_MAX_ROWS else df


#: A measured frame is broadcast up to this size.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame) -> DataFrame:
    """Broadcast hint for a written frame whose measured size allows it.

    Strings count in full, any other value as 16 bytes.
    """
    texts = [F.octet_length(c) for c, kind in df.dtypes if kind == "string"]
    row = sum((F.coalesce(t, F.lit(0)) for t in texts), F.lit(16 * len(df.columns)))
    return F.broadcast(df) if (df.agg(F.sum(row)).first()[0] or 0) <= BROADCAST_BYTES else df


def fetch(table: DataFrame, picked: DataFrame, key: str, rows: int) -> DataFrame:
    """Inner join of ``picked`` (at most ``rows`` rows) with a large table.

    When both sides carry ``shard``, the table's partition column, the join
    uses it too, so only the shards of the picked rows are read.
    """
    keys = [key]
    if "shard" in table.columns and "shard" in picked.columns:
        keys.append("shard")
    return table.join(bounded(picked, rows), keys)


def top_per_group(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The ``k`` first rows of each group.

    Up to Spark's ``spark.sql.optimizer.windowGroupLimitThreshold`` (1,000) every
    task sends on at most k rows of a group; beyond it the rows are cut after the
    shuffle. The plan is the same for every k.
    """
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")
