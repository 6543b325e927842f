"""Continuous ingest: new and changed files reach the store as they appear."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trawler.functions.globs import included
from trawler.plans.store import CorpusStore

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def stream_collection(store: CorpusStore, name: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Follow a collection's folder; each micro-batch is one refresh.

    A file stream never sees deletions, so files that are gone stay active
    until the next full ``update_collection``.
    """
    item = store.state.collections[name]
    root = item["path"].rstrip("/")
    files = (
        store.spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("recursiveFileLookup", "true")
        .load(root)
        .withColumn("abs_path", F.regexp_replace("path", r"^file:/+", "/"))
        .withColumn("rel_path", F.expr(f"substring(abs_path, {len(root) + 2})"))
        .filter(included(F.col("rel_path"), item["include"], item["ignore"]))
        .select(
            "rel_path", "abs_path", F.col("content").cast("string").alias("body"),
            F.col("modificationTime").alias("mtime"), F.col("length").alias("size_bytes"),
        )
    )

    def refresh(batch: DataFrame, _: int) -> None:
        # Several versions of one file in a batch: the newest counts.
        newest = F.max_by(F.struct("abs_path", "body", "mtime", "size_bytes"), "mtime")
        latest = batch.groupBy("rel_path").agg(newest.alias("f")).select("rel_path", "f.*")
        store.update_collection(name, latest, remove_missing=False)

    writer = files.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
