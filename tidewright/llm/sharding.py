"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``cells`` equal arcs; every shard owns ``vnodes`` points on it, and an arc
belongs to the next point clockwise. Rows fall on arcs by the hash of their key. A shard
takes rows of its own arcs up to its capacity; what overflows continues clockwise to the
next points whose shards have room. Which rows go where depends only on how many rows each
arc holds, so the flow is solved on one number per arc (``cells`` numbers, a parameter) and
rows find their place by a rank inside their arc: one narrow shuffle, whatever the data.

All of it is DataFrame functions; no Python runs on executors.
"""

from __future__ import annotations

import bisect
import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import inline_rows


def ring_owners(n_shards: int, vnodes: int, cells: int) -> list[list[int]]:
    """For every arc, the shards met clockwise from it, each once."""
    points = sorted(
        (int.from_bytes(hashlib.sha1(f"shard {s} point {v}".encode()).digest()[:8], "big") % cells, s, v)
        for s in range(n_shards)
        for v in range(vnodes)
    )
    at = [p[0] for p in points]
    after: list[list[int]] = []
    for i in range(len(points)):
        seen = dict.fromkeys(points[(i + j) % len(points)][1] for j in range(len(points)))
        after.append(list(seen))
    return [after[bisect.bisect_left(at, c) % len(points)] for c in range(cells)]


def capacities(total: int, n_shards: int, epsilon: float | None) -> list[int]:
    """Rows each shard may hold: exact shares if ``epsilon`` is None (counts at most one
    apart), else ceil((1 + epsilon) * mean)."""
    if epsilon is None:
        return [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    return [-int(-(1 + epsilon) * total // n_shards)] * n_shards


def solve(counts: dict[int, int], owners: list[list[int]], room: list[int]) -> list[dict]:
    """Intervals of ranks: rows first..first+n-1 of arc ``cell`` are rows base.. of ``shard``."""
    room, used, out = list(room), [0] * len(room), []
    rest: list[tuple[int, int, int]] = []

    def give(cell: int, first: int, n: int, shard: int) -> int:
        n = min(n, room[shard])
        if n:
            out.append({"cell": cell, "first": first, "upto": first + n, "shard": shard, "base": used[shard]})
            room[shard] -= n
            used[shard] += n
        return n

    for cell in sorted(counts):
        n = give(cell, 0, counts[cell], owners[cell][0])
        if n < counts[cell]:
            rest.append((cell, n, counts[cell] - n))
    for cell, first, n in rest:
        for shard in owners[cell][1:]:
            took = give(cell, first, n, shard)
            first, n = first + took, n - took
            if not n:
                break
    return out


def assign(
    rows: DataFrame,
    key: str,
    n_shards: int = 16,
    vnodes: int = 64,
    cells: int = 4096,
    epsilon: float | None = None,
) -> DataFrame:
    """``rows`` with the columns ``shard`` (int) and ``slot`` (long, gapless from 0 in a shard).

    Rows with a null key are spread over the ring by the hash of all their columns. Rows with
    equal keys share an arc and may be split between shards where one is full. An empty table
    gives an empty result. Columns named like the two results are replaced.
    """
    spark: SparkSession = rows.sparkSession
    rows = rows.drop("shard", "slot")
    width = (1 << 63) // cells
    hashed = F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key))).otherwise(F.xxhash64(F.lit(1), *(F.col(c) for c in rows.columns)))
    placed = rows.withColumn("_h", F.shiftrightunsigned(hashed, 1)).withColumn("_cell", F.floor(F.col("_h") / F.lit(width)).cast("int"))
    placed = placed.withColumn("_cell", F.least(F.col("_cell"), F.lit(cells - 1)))
    counts = {r["_cell"]: r["n"] for r in placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `cells` rows
    flow = solve(counts, ring_owners(n_shards, vnodes, cells), capacities(sum(counts.values()), n_shards, epsilon))
    plan = inline_rows(spark, json.dumps(flow), "cell int, first bigint, upto bigint, shard int, base bigint")
    plan = plan.toDF("_to", "_first", "_upto", "shard", "_base")
    order = [F.col("_h"), *(F.col(c) for c in rows.columns)]
    ranked = placed.withColumn("_rank", F.row_number().over(Window.partitionBy("_cell").orderBy(*order)).cast("long") - 1)
    inside = (F.col("_cell") == F.col("_to")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_upto"))
    return (
        ranked.join(F.broadcast(plan), inside)  # at most cells + cells * shards rows
        .withColumn("slot", F.col("_base") + F.col("_rank") - F.col("_first"))
        .select(*rows.columns, "shard", "slot")
    )


def shard_documents(docs: DataFrame, n_shards: int = 16, **ring) -> DataFrame:
    """Documents by the law ``rows``: counts of any two shards are at most one apart.

    size: UTF-8 bytes of the text (null: none) plus 1; text_crc32: of those bytes.
    """
    narrow = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return assign(narrow, "doc_id", n_shards, **ring).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
