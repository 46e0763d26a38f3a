"""Watching a source tree: new file versions arrive as a stream and are folded into the store, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.incremental import changes
from ..store import GraphStore

SCHEMA = "file_path string, text string, mtime long"


def applied(store: GraphStore, batch: DataFrame, index: Callable[[GraphStore, DataFrame], None]) -> bool:
    """Fold one batch of file versions into the store; whether anything changed.

    The newest version of a file counts. Repeating a batch changes nothing: content that the manifest knows is skipped.
    """
    newest = batch.groupBy("file_path").agg(F.max_by(F.struct("text", "mtime"), F.struct("mtime", "text")).alias("v")).select("file_path", "v.text", "v.mtime")
    listing = newest.withColumn("sha256", F.sha2("text", 256))
    manifest = store.table("manifest")
    touched = changes(listing, manifest.join(listing.select("file_path"), "file_path", "left_semi")).where("state IN ('parse', 'refreshed')")
    if touched.isEmpty():
        return False
    parse = listing.join(touched.where("state = 'parse'").select("file_path"), "file_path", "left_semi")
    if not parse.isEmpty():
        index(store, parse)
    store.upsert("manifest", touched.select("file_path", "sha256", "mtime"))
    store.commit()
    return True


def watch(spark: SparkSession, folder: str, store: GraphStore, index: Callable[[GraphStore, DataFrame], None], checkpoint: str, interval: str | None = "1 second"):
    """A streaming query over JSON files of (file_path, text, mtime); without an interval it ends when all is read."""
    stream = spark.readStream.schema(SCHEMA).json(folder)
    writer = stream.writeStream.foreachBatch(lambda batch, _: applied(store, batch, index) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
