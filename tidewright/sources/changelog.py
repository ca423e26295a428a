"""The append-only change log: numbered batches of change rows, one Parquet folder each.

A batch's number is the next file of the index, which can be created only once; two writers
that want the same number are told apart there. A batch may carry a token (a stream's batch
id); a table's token that is in the index already is not appended again.
"""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.images import change_schema
from ..store import Conflict, Control


@dataclass(frozen=True)
class Batch:
    seq: int
    table: str
    origin: str  # managed or external
    path: str | None = None
    widen: bool = False  # everything that depends on the table must be recomputed
    token: str | None = None


class ChangeLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.control = spark, Control(spark, root)
        self._known: dict[int, Batch] = {}
        self._tokens: set[tuple[str, str]] = set()  # (table, token) of the entries up to _read
        self._read = 0

    def head(self) -> int:
        names = self.control.names("log/index")
        return int(names[-1].split(".")[0]) if names else 0

    def batches(self, after: int, upto: int | None = None) -> list[Batch]:
        """Index entries with after < seq <= upto."""
        upto = self.head() if upto is None else upto
        for seq in range(after + 1, upto + 1):
            if seq not in self._known:
                self._known[seq] = Batch(**self.control.read(f"log/index/{seq:012d}.json"))
        return [self._known[seq] for seq in range(after + 1, upto + 1)]

    def append(self, table: str, changes: DataFrame | None, origin: str, token: str | None = None) -> Batch | None:
        """Writes ``changes`` (None: a widen mark) as the next batch; None if the token is known.

        The token is looked up among all entries before the number that the batch then claims, so
        of two writers with one token the second finds the first's entry or loses its number.
        """
        if token is not None and self.has(table, token, self.head()):
            return None
        path = None
        if changes is not None:
            path = f"{self.control.root}/log/{table}/{uuid.uuid4().hex}"
            changes.write.parquet(path)
        while True:
            head = self.head()
            if token is not None and self.has(table, token, head):
                return None
            batch = Batch(head + 1, table, origin, path, changes is None, token)
            try:
                self.control.create(f"log/index/{batch.seq:012d}.json", asdict(batch))
                return batch
            except Conflict:
                continue

    def has(self, table: str, token: str, upto: int) -> bool:
        """Is the table's token among the entries up to ``upto``? Each entry is read once."""
        self._tokens.update((b.table, b.token) for b in self.batches(self._read, upto) if b.token is not None)
        self._read = max(self._read, upto)
        return (table, token) in self._tokens

    def rows(self, batches: list[Batch], table: str, row_schema) -> DataFrame | None:
        """The change rows of one table's batches, in one scan; ``__seq`` numbers the batch."""
        own = [b for b in batches if b.table == table and b.path]
        if not own:
            return None
        schema = change_schema(row_schema)
        parts = [self.spark.read.schema(schema).parquet(b.path).withColumn("__seq", F.lit(b.seq)) for b in own]
        return reduce(lambda a, b: a.unionAll(b), parts)
