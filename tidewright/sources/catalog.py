"""Named base tables; writes through a managed table are captured in the change log."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Callable
from contextlib import suppress
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.images import full_images
from ..store import Conflict
from .changelog import ChangeLog


def table_name(name: str) -> str:
    """Lower-case identifier of a table name or class name; a leading colon goes."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name.lstrip(":")).lower()


def captured(write):
    """Log entry and new rows become visible together; dependents hear of them afterwards."""

    @wraps(write)
    def whole(self, *args, **options):
        with self._lock:
            write(self, *args, **options)
            self.version += 1
        self._published(self.name)

    return whole


class Table:
    """A base table: its newest rows, row id columns, and columns declared NOT NULL.

    Writes are merged on read: the table is the rows it had, without those that a write
    replaced or removed, and the rows that came. ``compact`` writes them out again.
    """

    def __init__(self, name: str, rows: DataFrame, row_id: tuple[str, ...], not_null: tuple[str, ...], log: ChangeLog, published: Callable[[str], None], lock: threading.RLock):
        self._lock = lock
        self.name, self.row_id, self.not_null = name, tuple(row_id), frozenset(not_null)
        self._rows, self._log, self._published = rows, log, published
        self.schema = rows.schema
        self.version = 0

    def rows(self) -> DataFrame:
        return self._rows

    def replace(self, rows: DataFrame) -> None:
        """New content without capture (a table that someone else writes)."""
        with self._lock:
            self._rows, self.version = rows.select(*self.schema.fieldNames()), self.version + 1

    def _record(self, changes: DataFrame) -> DataFrame:
        batch = self._log.append(self.name, changes, "managed")
        return self._log.rows([batch], self.name, self.schema)

    @captured
    def insert(self, rows: DataFrame) -> None:
        written = self._record(full_images("create", None, rows, self.schema))
        self._rows = self._rows.unionByName(written.select("after.*"))

    @captured
    def delete(self, condition: str) -> None:
        """Removes the rows for which the SQL condition is true."""
        gone = F.coalesce(F.expr(condition), F.lit(False))
        self._record(full_images("destroy", self._rows.where(gone), None, self.schema))
        self._rows = self._rows.where(~gone)

    @captured
    def update(self, condition: str, values: dict[str, str]) -> None:
        """Sets columns to SQL expressions over the old row, where the condition is true."""
        hit = F.coalesce(F.expr(condition), F.lit(False))
        old = F.struct(*(F.col(f.name) for f in self.schema))
        new = F.struct(*((F.expr(values[f.name]).cast(f.dataType) if f.name in values else F.col(f.name)).alias(f.name) for f in self.schema))
        names = F.array(*(F.lit(c) for c in self.schema.fieldNames()))
        changes = self._rows.where(hit).select(F.lit("update").alias("op"), old.alias("before"), new.alias("after"), names.alias("present_before"), names.alias("present_after"), F.lit(None).cast("long").alias("source_ts"))
        written = self._record(changes)
        self._rows = self._rows.where(~hit).unionByName(written.select("after.*"))

    @captured
    def upsert(self, rows: DataFrame) -> None:
        """Whole rows by row id: known ones are updated, others inserted."""
        if not self.row_id:
            raise ValueError(f"table {self.name!r} has no row id")
        rows = rows.select(*self.schema.fieldNames())
        old, new = self._rows.alias("o"), rows.alias("n")
        matched = new.join(old, [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in self.row_id], "left")
        image = lambda side: F.struct(*(F.col(f"{side}.{f.name}").cast(f.dataType).alias(f.name) for f in self.schema))
        known = F.col(f"o.{self.row_id[0]}").isNotNull()
        names, none = F.array(*(F.lit(c) for c in self.schema.fieldNames())), F.array().cast("array<string>")
        changes = matched.select(
            F.when(known, "update").otherwise("create").alias("op"), F.when(known, image("o")).alias("before"), image("n").alias("after"),
            F.when(known, names).otherwise(none).alias("present_before"), names.alias("present_after"), F.lit(None).cast("long").alias("source_ts"),
        )
        written = self._record(changes)
        ids = written.select("after.*").select(*self.row_id)
        kept = self._rows.join(ids, [self._rows[k].eqNullSafe(ids[k]) for k in self.row_id], "left_anti")
        self._rows = kept.unionByName(written.select("after.*"))

    def replay(self) -> None:
        """Brings the rows given at registration up to the log's head: what managed writes brought
        comes, as often as it was written, and what they removed goes, as often."""
        control, spark, start = self._log.control, self._rows.sparkSession, 0
        if bases := control.names(f"tables/{self.name}/bases"):
            base = control.read(f"tables/{self.name}/bases/{bases[-1]}")
            self._rows, start = spark.read.schema(self.schema).parquet(base["path"]), base["seq"]
        own = [b for b in self._log.batches(start) if b.origin == "managed"]
        changes = self._log.rows(own, self.name, self.schema)
        if changes is None:
            return
        gone = changes.where("before is not null").select("before.*")
        self._rows = self._rows.unionByName(changes.where("after is not null").select("after.*"))
        if gone.limit(1).count():
            self._rows = self._rows.exceptAll(gone.select(*self.schema.fieldNames()))

    def compact(self, path: str | None = None) -> None:
        """Writes the rows out, so that reads don't merge any more. The next engine that registers
        the table starts from them, whatever rows it is given, and replays only later writes."""
        with self._lock:
            head, rows = self._log.head(), self._rows
            path = path or f"{self._log.control.root}/tables/{self.name}/data/{uuid.uuid4().hex}"
            rows.write.parquet(path)
            with suppress(Conflict):  # the same moment was compacted already
                self._log.control.create(f"tables/{self.name}/bases/{head:012d}.json", {"path": path, "seq": head})
            self._rows = rows.sparkSession.read.schema(self.schema).parquet(path)


class Catalog:
    """The base tables of an engine, by name."""

    def __init__(self, log: ChangeLog, published: Callable[[str], None]):
        self._log, self._published, self._tables = log, published, {}
        self.lock = threading.RLock()

    def register(self, name: str, rows: DataFrame, row_id: tuple[str, ...] = (), not_null: tuple[str, ...] = (), replay: bool = True) -> Table:
        """``rows``: the content before the first write through the engine; writes that its log
        holds are replayed on it, unless ``rows`` has them already (``replay=False``)."""
        name = table_name(name)
        table = Table(name, rows, row_id, not_null, self._log, self._published, self.lock)
        if replay:
            table.replay()
        self._tables[name] = table
        return table

    def table(self, name: str) -> Table:
        try:
            return self._tables[table_name(name)]
        except KeyError:
            raise KeyError(f"no table {name!r}; known: {', '.join(sorted(self._tables)) or 'none'}") from None

    def read(self, name: str) -> DataFrame:
        return self.table(name).rows()

    def pinned(self) -> Callable[[str], DataFrame]:
        """A reader that keeps giving the tables as they are now."""
        now = {n: t.rows() for n, t in self._tables.items()}
        return lambda name: now[table_name(name)] if table_name(name) in now else self.read(name)

    def snapshot(self) -> tuple[int, Callable[[str], DataFrame]]:
        """The log's head and a reader of the tables as of exactly that entry."""
        with self.lock:
            return self._log.head(), self.pinned()

    def __len__(self) -> int:
        return len(self._tables)

    def __contains__(self, name: str) -> bool:
        return table_name(name) in self._tables
