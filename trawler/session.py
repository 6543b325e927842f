"""Session helpers: shipping the package, and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()

#: Bytes of an Arrow batch. Spark holds a batch of texts about twice outside the heap while it
#: writes it, and a Python worker once, per running task.
ARROW_BYTES = 1 << 20


def bound_arrow_batches(spark: SparkSession) -> None:
    """Cut the batches that go to Python workers to ``ARROW_BYTES``, unless the session has them smaller."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = int(spark._jsparkSession.sessionState().conf().getConfString(name).removesuffix("b"))
    if held > ARROW_BYTES:
        spark.conf.set(name, f"{ARROW_BYTES}b")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, and bound the batches they get."""
    bound_arrow_batches(spark)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="trawler-"), "trawler.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder every node sees, as named by ``spark.checkpoint.dir``.

    Only a session that names none (a local test) gets a temporary one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all nodes share")
        named = tempfile.mkdtemp(prefix="trawler-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/{spark.sparkContext.applicationId}"


def settle(df: DataFrame) -> DataFrame:
    """Write a small result to the shared folder and read it back.

    For top-k results used more than once: the scans behind them run a single
    time, later plans start from a few known rows, and a lost executor costs
    nothing.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Shuffle by ``key`` only when the input has fewer splits than cores.

    A large input comes in many splits and passes through untouched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
