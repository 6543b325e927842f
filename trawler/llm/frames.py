"""DataFrame helpers of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawler.session import shared_folder, ship_package

#: A side of a join is broadcast below this size; beyond it the join shuffles.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Paths settled in each open scope, the innermost last.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def settled(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back, to cut its lineage.

    Values of the columns ``by`` have files of their own. Inside ``scratch`` the files
    go with the scope.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm/{uuid.uuid4().hex}"
    if _scopes.get():
        _scopes.get()[-1].append(path)
    df.write.partitionBy(*by or []).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.settled_path = path
    return back


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a settled frame that nothing reads any more."""
    _delete(df.sparkSession, df.settled_path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete on leaving whatever was settled inside.

    Gives a function that settles a frame beyond the scope; only such frames, and frames
    made of nothing else, may be used later. A frame settled inside is passed on as it is.
    """
    outer = _scopes.get()
    own: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        path = getattr(df, "settled_path", None)
        if path in own:
            own.remove(path)
            if outer:
                outer[-1].append(path)
            return df
        token = _scopes.set(outer)
        try:
            return settled(df)
        finally:
            _scopes.reset(token)

    token = _scopes.set((*outer, own))
    try:
        yield keep
    finally:
        _scopes.reset(token)
        for path in own:
            _delete(spark, path)


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a settled frame for broadcast if its measured size allows it.

    Text counts in full, any other value as 16 bytes. A larger frame comes back
    unmarked and is joined by a shuffle, which splits hot keys (AQE).
    """
    texts = [F.octet_length(c) for c, kind in df.dtypes if kind == "string"]
    row = sum((F.coalesce(t, F.lit(0)) for t in texts), F.lit(16 * len(df.columns)))
    return F.broadcast(df) if (df.agg(F.sum(row)).first()[0] or 0) <= limit else df


def fold(*columns) -> "F.Column":
    """Null-safe text of a key column: null and empty are one key."""
    return F.coalesce(*[F.col(c).cast("string") if isinstance(c, str) else c for c in columns], F.lit(""))
