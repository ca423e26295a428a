"""Structured Streaming into the change log.

A micro-batch is appended under the token ``<feed>:<batch id>``. After a restart Spark may
hand the same batch over again; its token is known then and the log stays as it is, so that
even additive deltas are applied exactly once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine
from ..operators.images import full_images
from ..sources.debezium import to_descriptors


def _start(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def _refresh_dependents(engine: Engine, table: str, origin: str) -> None:
    for v in engine.dependents(table, origin):
        if v.is_warm() and v.is_dirty():
            v.refresh()


def stream_changes(engine: Engine, table: str, changes: DataFrame, checkpoint: str, feed: str = "changes", interval: str | None = None) -> StreamingQuery:
    """A stream of change rows for views with an external feed."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        if engine.ingest(table, batch, f"{feed}:{batch_id}"):
            _refresh_dependents(engine, table, "external")

    return _start(changes, apply, checkpoint, interval)


def stream_debezium(engine: Engine, table: str, events: DataFrame, checkpoint: str, column: str = "value", feed: str = "debezium", interval: str | None = None) -> StreamingQuery:
    """A stream of JSON envelopes of one table."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        if engine.ingest(table, to_descriptors(batch, engine.catalog.table(table).schema, column), f"{feed}:{batch_id}"):
            _refresh_dependents(engine, table, "external")

    return _start(events, apply, checkpoint, interval)


def stream_inserts(engine: Engine, table: str, rows: DataFrame, checkpoint: str, feed: str = "inserts", interval: str | None = None) -> StreamingQuery:
    """A stream of new rows of a managed table; each micro-batch is an exactly-once insert."""
    t = engine.catalog.table(table)

    def apply(batch: DataFrame, batch_id: int) -> None:
        with engine.catalog.lock:
            logged = engine.log.append(t.name, full_images("create", None, batch, t.schema), "managed", f"{feed}:{batch_id}")
            if logged is not None:
                t.replace(t.rows().unionByName(engine.log.rows([logged], t.name, t.schema).select("after.*")))
        if logged is not None:
            _refresh_dependents(engine, table, "managed")

    return _start(rows, apply, checkpoint, interval)
