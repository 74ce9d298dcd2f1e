"""Streamed changes of the kept mirror: files of JSON lines (``operators.mirror.CHANGE``) arrive, and each micro-batch makes the next version of the store from the buckets that it touches.

A batch that runs again after a failure finds its number in the newest version and is left out. Batches add up in the order of the stream, within a batch the last change by ``seq`` counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import mirror
from ..operators.components import cut
from ..sources import versions


def created(spark: SparkSession, store: str, tables: dict[str, DataFrame], buckets: int = versions.BUCKETS) -> versions.Versions:
    """The first version of a mirror, of the tables of ``mirror.whole``."""
    kept = {t: cut(rows) for t, rows in tables.items()}
    return versions.created(spark, store, kept, buckets, mirror.indexes_of(kept["ties"], kept["facts"]))


def sync(spark: SparkSession, store: str, changes: DataFrame, writer: str | None = None, batch: int | None = None) -> dict[str, int]:
    """One batch of changes as the next version: how many signed rows it came to, for each table. A batch that the store has seen does nothing."""
    v = versions.opened(spark, store)
    if writer is not None and v.record["writers"].get(writer, -1) >= batch:
        return {}
    after, gains, moved = mirror.changed(cut(changes), v, cut)
    v.commit(after, gains, writer, batch)
    return dict.fromkeys(("edges", "tags", "semantic"), 0) | {t: rows.count() for t, rows in moved.items()}


def start(spark: SparkSession, inbox: str, store: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Take all files that are there, ``files_per_batch`` at a time. The same checkpoint goes on where it stopped."""
    changes = spark.readStream.schema(mirror.CHANGE).option("maxFilesPerTrigger", files_per_batch).json(inbox)

    def add(batch: DataFrame, number: int) -> None:
        sync(batch.sparkSession, store, batch, checkpoint, number)

    return changes.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
