"""Structured Streaming into an index: every micro-batch is one append."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lantern.plans.engine import SearchEngine


def index_stream(stream: DataFrame, engine: SearchEngine, checkpoint: str, id_col: str | None = None, **trigger) -> StreamingQuery:
    """Adds a stream's rows to ``engine`` and commits after each micro-batch.

    The manifest that publishes a batch also holds its number, so a batch that
    is replayed after a crash is known and left out.
    """

    def append(batch: DataFrame, number: int) -> None:
        if engine.streams.get(checkpoint, -1) >= number:
            return
        held = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if not held.isEmpty():
                engine.index_documents(held, id_col)
                engine.streams[checkpoint] = number
                engine.commit()
        finally:
            if engine.stored:  # the index reads the stored copy from here on
                held.unpersist()

    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
