"""Continuous indexing: a stream of file versions keeps a project's files and chunks in a store up to date. Symbols come
from symbol indexes, which a stream of text hasn't; chunks are searched by their text until those are renewed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..chunkers import chunk_files
from ..functions import text as fx
from ..operators import derive
from ..operators.intervals import first_by
from ..operators.tables import Store


def latest(versions: DataFrame) -> DataFrame:
    """The last version of each path of a batch."""
    return first_by(versions, ["relative_path"], [F.desc("version"), F.desc("deleted")])


def apply_batch(store: Store, root: str, adapter: str, versions: DataFrame) -> None:
    """versions: relative_path, text, version, deleted. Files whose hash is the indexed one are left alone; a
    batch that is run again after a failure changes nothing."""
    now = latest(versions).withColumn("content_hash", fx.content_hash(F.col("text")))
    indexed = store.table("files").where((F.col("root_path") == root) & (F.col("adapter_id") == adapter))
    known = indexed.select("relative_path", F.col("content_hash").alias("known_hash"))
    changed = now.join(known, "relative_path", "left").where("deleted OR known_hash IS NULL OR known_hash <> content_hash")
    changed = changed.persist()  # used twice below; lost parts are computed again
    try:
        if changed.isEmpty():
            return
        there = changed.where("NOT deleted")
        rows = there.select("relative_path", "content_hash", fx.line_count(F.col("text")).alias("line_count"))
        chunks = chunk_files(there.select("relative_path", F.col("text").cast("binary").alias("content")))
        about = derive.preamble(F.col("name"), F.col("kind"), F.col("file_path"))
        chunks = chunks.withColumn("retrieval_text", F.concat(about, F.lit("\n\n"), F.col("text")))
        store.update(root, adapter, changed.select("relative_path"), {"files": rows, "chunks": chunks})
    finally:
        changed.unpersist()


def follow(stream: DataFrame, store: Store, root: str, adapter: str, checkpoint: str) -> StreamingQuery:
    """Starts indexing a stream of versions; a batch at a time is published, whole."""
    return (
        stream.writeStream.foreachBatch(lambda batch, _: apply_batch(store, root, adapter, batch))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
