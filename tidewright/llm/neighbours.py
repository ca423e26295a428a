"""Approximate nearest neighbours by shifted Hilbert orderings.

Every ordering projects the unit vectors on a few random directions, shifts them, and sorts
them along a Hilbert curve. The keys are range-partitioned into blocks of near equal counts; a
query is compared with the blocks around its own in every ordering. Blocks that hold far more
rows than the others (many equal vectors) are dealt out by id, so a task stays small and no
row is left out; the queries that meet a block are dealt out in the same way. Candidates are
reranked by the exact cosine in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

ORDERINGS, DIRECTIONS, BITS = 5, 4, 10
#: Blocks of an ordering, and how many on each side of its own a query is compared with.
BLOCKS, REACH = 48, 9
#: Rows of a block, and queries that meet it, that are handled together.
TASK_ROWS, TASK_QUERIES = 8192, 4096


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of integer points (n, d), d * bits < 64."""
    x = cells.T.astype(np.int64).copy()
    d, q = len(x), 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap if i else 0
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn, q = np.zeros(x.shape[1], np.int64), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | x[i] >> b & 1
    return key


def keys_of(unit: np.ndarray, orderings: int) -> np.ndarray:
    """(n, orderings): each vector's key in each ordering."""
    n, dim = unit.shape
    out = np.zeros((n, orderings), np.int64)
    for k in range(orderings):
        rng = np.random.default_rng(1000 + k)
        d = min(DIRECTIONS, dim)
        directions = np.linalg.qr(rng.normal(size=(dim, d)))[0]
        spread = 4 / dim**0.5  # unit vectors project to about one over the root of dim
        place = (unit @ directions / spread + 1) / 2 + rng.uniform(-0.1, 0.1, d)
        out[:, k] = hilbert((np.clip(place, 0, 1 - 1e-9) * (1 << BITS)).astype(np.int64), BITS)
    return out


def matrix(column, dim: int) -> np.ndarray:
    """A column of lists of ``dim`` numbers each as an array (rows, dim) of doubles."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)


def lists(x: np.ndarray) -> pa.ListArray:
    """The rows of an array as a column of lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def indexed(vectors: DataFrame, orderings: int, vec: str) -> DataFrame:
    """(vec_id, v, keys) of the vectors that take part."""

    def run(batches):
        for batch in batches:
            ids, rows = batch.column(0), batch.column(1)
            lengths = pc.fill_null(pc.if_else(pc.is_valid(ids), pc.list_value_length(rows), 0), 0).to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths[lengths > 0]):
                at = np.flatnonzero(lengths == dim)
                for k in range(0, len(at), 1024):
                    part = pa.array(at[k : k + 1024])
                    x, part_ids = matrix(rows.take(part), int(dim)), ids.take(part).to_numpy(zero_copy_only=False).astype(np.int64)
                    top = np.abs(x).max(axis=1)
                    ok = np.isfinite(top) & (top > 0)  # a null component reads as NaN
                    x, part_ids = x[ok], part_ids[ok]
                    unit = x / top[ok][:, None]
                    unit /= np.linalg.norm(unit, axis=1)[:, None]
                    keys = keys_of(unit, orderings)
                    yield pa.RecordBatch.from_arrays([pa.array(part_ids), lists(x), pa.array(np.full(len(x), dim, np.int32)), lists(keys)], ["vec_id", "v", "dim", "keys"])

    return vectors.select("vec_id", F.col(vec)).mapInArrow(run, "vec_id bigint, v array<double>, dim int, keys array<bigint>")


def cosines(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, the same for equal rows wherever they stand."""
    return (q * c).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((c * c).sum(axis=1)))


def best_of(queries: np.ndarray, qid: np.ndarray, rows: np.ndarray, rid: np.ndarray, k: int):
    """(query position, row position, score): the best row of each of the k best ids of each query,
    ties to smaller ids."""
    unit = rows / np.abs(rows).max(axis=1)[:, None]
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    for a in range(0, len(queries), 256):
        part = queries[a : a + 256] / np.abs(queries[a : a + 256]).max(axis=1)[:, None]
        near = (part / np.linalg.norm(part, axis=1)[:, None]) @ unit.T
        near[qid[a : a + 256][:, None] == rid[None, :]] = -np.inf
        for i, s in enumerate(near):
            m = min(k, int((s > -np.inf).sum()))
            if not m:
                continue
            while True:
                least = np.partition(s, len(s) - m)[len(s) - m]
                j = np.flatnonzero(s >= least - 1e-9)
                j = j[s[j] > -np.inf]
                # rows with one id are one result: look further down until k ids are met
                if m >= int((s > -np.inf).sum()) or len(np.unique(rid[j])) >= k:
                    break
                m = min(2 * m, int((s > -np.inf).sum()))
            exact = cosines(np.broadcast_to(queries[a + i], (len(j), queries.shape[1])), rows[j])
            order = np.lexsort((rid[j], -exact))
            for o in order[np.sort(np.unique(rid[j][order], return_index=True)[1])[:k]]:
                yield a + i, j[o], exact[o]


def search(vectors: DataFrame, is_query: F.Column, k: int = 5, vec: str = "embedding", orderings: int = ORDERINGS, blocks: int = BLOCKS, reach: int = REACH) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest of all other vectors it meets.

    ``is_query`` is a condition on vec_id. Vectors that are null, empty, zero or hold null or
    non-finite components take no part, nor do rows without id; vectors of different lengths
    never meet. Rows with one id are one vector (that of the best score). Ties go to smaller ids.
    Columns besides vec_id and ``vec``, whatever their names, are left out. An empty table gives
    an empty result. Every table is cut into ``blocks`` blocks an ordering, however small.
    """
    scratch = Scratch(vectors.sparkSession, "neighbours")
    held = scratch.write(indexed(vectors, orderings, vec), "keys")
    flat = held.select("vec_id", "v", "dim", F.posexplode("keys").alias("ordering", "key"))
    # at most `blocks` bounds per ordering and vector length
    bounds = flat.groupBy("dim", "ordering").agg(F.percentile_approx("key", [i / blocks for i in range(1, blocks)], 20_000).alias("bounds"))
    lower = F.size(F.filter("bounds", lambda b: b < F.col("key")))
    drawn = flat.join(F.broadcast(bounds), ["dim", "ordering"]).select("vec_id", "v", "dim", "ordering", lower.alias("drawn"))
    # only blocks that hold rows count in reach: a hot key leaves empty numbers after it
    dense = F.dense_rank().over(Window.partitionBy("dim", "ordering").orderBy("drawn")) - 1
    numbers = drawn.select("dim", "ordering", "drawn").distinct().withColumn("block", dense)
    placed = drawn.join(F.broadcast(numbers), ["dim", "ordering", "drawn"]).drop("drawn")
    sizes = placed.groupBy("dim", "ordering", "block").agg(F.ceil(F.count(F.lit(1)) / TASK_ROWS).cast("int").alias("parts"))
    place = ["dim", "ordering", "block"]

    def meeting(frame: DataFrame) -> DataFrame:
        """``frame`` once for every block in reach."""
        return frame.withColumn("block", F.explode(F.sequence(F.greatest(F.col("block") - reach, F.lit(0)), F.least(F.col("block") + reach, F.lit(blocks - 1)))))

    queries = meeting(placed.where(is_query).groupBy(*place).agg(F.count(F.lit(1)).alias("n")))
    heaps = queries.groupBy(*place).agg(F.ceil(F.sum("n") / TASK_QUERIES).cast("int").alias("heaps"))
    cells = sizes.join(F.broadcast(heaps), place)  # a row per block that queries meet
    dealt = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = placed.join(F.broadcast(cells), place).withColumn("part", dealt("parts", 0)).withColumn("heap", every("heaps"))
    met = meeting(placed.where(is_query)).join(F.broadcast(cells), place).withColumn("heap", dealt("heaps", 1)).withColumn("part", every("parts"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [])
        if left.num_rows and right.num_rows:
            dim = right.column("dim")[0].as_py()
            q, c = (matrix(t.column("v"), dim) for t in (left, right))
            qid, cid = (t.column("vec_id").to_numpy() for t in (left, right))
            for i, j, s in best_of(q, qid, c, cid, k):
                out[0].append(int(qid[i])), out[1].append(int(cid[j])), out[2].append(float(s))
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    at = [*place, "part", "heap"]
    columns = [*at, "vec_id", "v"]
    asked, here = met.select(*columns).toDF(*columns), rows.select(*columns).toDF(*columns)
    found = asked.groupBy(*at).cogroup(here.groupBy(*at)).applyInArrow(compare, "query_id bigint, vec_id bigint, score double")
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
