"""Loads from Structured Streaming: every micro-batch is one load."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from loomhouse.plans.store import Warehouse, made, unstage
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_load(stream: DataFrame, load: Callable[[DataFrame], Any], warehouse: Warehouse | None, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Run `load` (ensure, scdensure, insert, a step's process) on each micro-batch and commit after it.

    Operators keep their state between batches in the warehouse, so keys and versions go on.  The
    commit records the batch's number under the checkpoint's name: a batch that comes again after a
    failure is skipped if its commit was published, and run anew if not.  What a batch staged is deleted after its commit.
    """

    def one(batch: DataFrame, number: int) -> None:
        if warehouse is None:
            load(batch)
            return
        if warehouse.loaded(checkpoint) >= number:
            return
        before = len(made)
        kept = batch.persist()
        try:
            load(kept)
            warehouse.commit({checkpoint: number})
        except BaseException:
            warehouse.rollback()
            raise
        finally:
            kept.unpersist()
        unstage(batch.sparkSession, before)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed(stream: DataFrame, time: str, width: str, late: str, by: list[str], aggregates: dict[str, Column], slide: str | None = None) -> DataFrame:
    """Aggregates by event-time window; rows later than `late` are dropped by the watermark.  Batch DataFrames do too."""
    marked = stream.withWatermark(time, late) if stream.isStreaming else stream
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return marked.groupBy(window.alias("window"), *by).agg(*[v.alias(n) for n, v in aggregates.items()])


def sessions(stream: DataFrame, time: str, gap: str, late: str, by: list[str], aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates by session: rows of one key with gaps below `gap`."""
    marked = stream.withWatermark(time, late) if stream.isStreaming else stream
    return marked.groupBy(F.session_window(time, gap).alias("window"), *by).agg(*[v.alias(n) for n, v in aggregates.items()])
