"""Capture without hooks: differences of two snapshots, and a durable outbox of them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.images import change_schema
from ..store import Control


def key_images(old: DataFrame, new: DataFrame, row_id: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """Change rows between two snapshots, with images of ``columns`` only (row id included).

    Rows are compared by a digest of all their values, so only ids, digests and the wanted
    columns are shuffled.
    """
    row, keep = old.schema, tuple(dict.fromkeys([*row_id, *columns]))
    digest = F.xxhash64(*(F.col(f.name) for f in row))
    side = lambda df, name: df.select(*(F.col(c).alias(f"{name}_{c}") for c in keep), digest.alias(f"{name}_d"))
    a, b = side(old, "o"), side(new, "n")
    both = a.join(b, [F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}")) for c in row_id], "full_outer")
    changed = both.where("o_d is null or n_d is null or o_d <> n_d")
    kind = change_schema(row)["before"].dataType

    def image(name: str):
        whole = F.struct(*((F.col(f"{name}_{f.name}") if f.name in keep else F.lit(None).cast(f.dataType)).alias(f.name) for f in row)).cast(kind)
        return F.when(F.col(f"{name}_d").isNotNull(), whole)

    names, nothing = F.array(*(F.lit(c) for c in keep)), F.array().cast("array<string>")
    op = F.when(F.col("o_d").isNull(), "create").when(F.col("n_d").isNull(), "destroy").otherwise("update")
    present = lambda name: F.when(F.col(f"{name}_d").isNotNull(), names).otherwise(nothing)
    return changed.select(op.alias("op"), image("o").alias("before"), image("n").alias("after"), present("o").alias("present_before"), present("n").alias("present_after"), F.lit(None).cast("long").alias("source_ts"))


class Outbox:
    """A durable queue of captured changes, one folder per capture, relayed at least once.

    ``drain`` hands captures over in order and removes each only after its relay succeeded. A
    capture whose relay fails is moved to quarantine, with its error, and the rest goes on; the
    next drain tries it again, before what is queued. Names are never used twice.
    """

    def __init__(self, spark, root: str):
        self.spark, self.root, self.control = spark, root, Control(spark, root)

    def names(self, folder: str = "queue") -> list[str]:
        return self.control.names(f"outbox/{folder}")

    def capture(self, table: str, changes: DataFrame) -> None:
        waiting = [*self.names(), *self.names("quarantine")]
        n = max((int(x.split("-")[0]) for x in waiting), default=0) + 1
        name = f"{n:012d}-{table}-{uuid.uuid4().hex[:12]}"
        path = f"{self.root}/outbox/data/{name}"
        changes.write.parquet(path)
        self.control.create(f"outbox/queue/{name}.json", {"table": table, "path": path})

    def drain(self, relay: Callable[[str, DataFrame], None], schema_of: Callable[[str], T.StructType], limit: int | None = None) -> int:
        """Relays captures, oldest first, at most ``limit``; how many were relayed."""
        done = 0
        for place, name in sorted((("quarantine", n) for n in self.names("quarantine")), key=lambda x: x[1]) + [("queue", n) for n in self.names()]:
            if limit is not None and done >= limit:
                break
            entry = self.control.read(f"outbox/{place}/{name}")
            try:
                relay(entry["table"], self.spark.read.schema(change_schema(schema_of(entry["table"]))).parquet(entry["path"]))
            except Exception as e:
                if place == "quarantine":
                    continue
                self.control.create(f"outbox/quarantine/{name}", entry | {"error": str(e)[:500]})
            else:
                done += 1
                self.control.remove(f"outbox/data/{entry['path'].rsplit('/', 1)[1]}")
            self.control.remove(f"outbox/{place}/{name}")
        return done
