"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

Two permutations make all coordinates of a signature: the first scatters shingles over
``SLOTS`` slots, the second is a permuted table of slot values, and coordinate k is the least
value of the table shifted circularly by k. Shifts of one slot are neighbours in memory, so a
shingle adds one contiguous slice of the table.

Documents with equal shingle sets form a class first, in a pre-aggregated pass. Classes that
agree in a band share a bucket. A bucket compares all its classes with one pivot (the class
with the most bucket mates, the same hub in most buckets of a group), so pairs grow with the
rows and not with their square; links are confirmed on full sets and components found by
label propagation.

What a star can't decide is decided after that. A pair of a bucket is undecided if it stands in
two components and neither its sizes nor its signatures rule out a link. One of the two then
lies outside the bucket's largest component: it is loose. Units of bounded size hold some loose
classes and some of the whole bucket, and a pair is looked at in its first shared band alone.
While that joins many, every loose class is compared with its nearest undecided partner; then
all undecided pairs are compared inside the units, by whole sets.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SLOTS = 1 << 21
BANDS, ROWS = 32, 6
COORDS = BANDS * ROWS
#: Classes, and shingles, of a bucket that are compared in one block.
BLOCK, BLOCK_SHINGLES = 512, 1 << 22
#: Rounds of nearest partners go on while at least one of so many finds a link.
WORTH = 4
#: Standard deviations of the signature's estimate that a compared pair may lack: a linked pair
#: that shares a band is taken for an unlinked one with a chance of less than 2e-8.
SLACK = 6.0
#: Bits of the map that thins out texts before they are shuffled.
BITS = 1 << 23

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@cache
def tables():
    """Values of bytes, and the second permutation as a table that runs on past its end."""
    rng = np.random.default_rng(20240229)
    byte = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    ring = rng.permutation(SLOTS).astype(np.uint32)
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([ring, ring[:COORDS]]), COORDS)
    bands = rng.integers(1, 1 << 63, (1, BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return byte, windows, bands


_STEP = np.uint64(0x9E3779B97F4A7C15)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    inverse = np.uint64(pow(int(_STEP), -1, 1 << 64))
    up, down = np.full(n, _STEP, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_POWERS: list[np.ndarray] = []


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words (runs of bytes other than blank and 9 to 13) of UTF-8
    ``raw``, A-Z read as a-z."""
    global _POWERS
    if not len(raw):
        return np.zeros(0, np.uint64)
    if not _POWERS or len(_POWERS[0]) < len(raw) + 1:
        _POWERS = list(powers(max(1 << 14, 2 * len(raw))))
    up, down = _POWERS
    inside = (raw != 32) & ((raw < 9) | (raw > 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    start, end = edge[::2], edge[1::2]
    byte = tables()[0]
    lower = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
    upto = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(byte[lower] * up[: len(raw)], out=upto[1:])
    return mix((upto[end] - upto[start]) * down[start])


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of ``size`` words; of all its words, if
    they are fewer; empty without words."""
    words = word_hashes(np.frombuffer((text or "").encode(), np.uint8))
    size = min(size, len(words))
    if not size:
        return words
    n, out = len(words) - size + 1, np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        out = mix(out * _STEP + words[k : k + n])
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """COORDS coordinates of a set that isn't empty."""
    windows, out = tables()[1], np.full(COORDS, 0xFFFFFFFF, np.uint32)
    slot = (shingles & np.uint64(SLOTS - 1)).astype(np.int64)
    for k in range(0, len(slot), 2048):
        np.minimum(out, windows[slot[k : k + 2048]].min(axis=0), out=out)
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 63-bit key per band, unlike in different bands."""
    x = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    keys = mix((x * tables()[2]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
    return (keys >> np.uint64(1)).astype(np.int64)


def features(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands, marks, low): bands holds the key of each band, marks
    32 bits of each key, low the coordinates' lowest bytes."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                sets = [shingle_set(x, size) for x in part.column(1).to_pylist()]
                signs = np.stack([signature(s) for s in sets]) if sets else np.zeros((0, COORDS), np.uint32)
                keys, some = band_keys(signs), [len(s) > 0 for s in sets]
                marks, low = (keys >> 31).astype("<u4"), signs.astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128(s.tobytes()).digest() if y else None for s, y in zip(sets, some, strict=True)], pa.binary()),
                        pa.array([r if y else None for r, y in zip(keys, some, strict=True)], pa.list_(pa.int64())),
                        *(pa.array([r.tobytes() if y else None for r, y in zip(x, some, strict=True)], pa.binary()) for x in (marks, low)),
                    ],
                    ["doc_id", "n_shingles", "set_key", "bands", "marks", "low"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, set_key binary, bands array<bigint>, marks binary, low binary")


def narrowed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the documents whose id is in ``ids`` (one column), and a few others.

    A bitmap of hashed ids, at most ``BITS`` bits whatever the data, goes to every task and
    drops most other texts before an exact join has to shuffle them.
    """
    slot = F.pmod(F.xxhash64(ids.columns[0]), F.lit(BITS))
    words = ids.withColumn("_slot", slot).groupBy(F.shiftright("_slot", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_slot & 63 as int))")).alias("_mask"))
    marked = docs.select("doc_id", "text").withColumn("_slot", F.pmod(F.xxhash64("doc_id"), F.lit(BITS)))
    maybe = marked.join(F.broadcast(words), F.shiftright("_slot", 6) == F.col("_word")).where("(_mask & shiftleft(1L, cast(_slot & 63 as int))) <> 0")
    return maybe.select(F.col("doc_id").alias("id"), "text")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = int(np.isin(a, b, assume_unique=True).sum())
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose full sets share at least ``percent`` % of their union.

    The texts of ``a`` meet that of ``b`` in units of about ``BLOCK`` pairs, so a ``b`` with
    many pairs is spread over tasks, and only its own text is repeated, once a unit.
    """
    hubs = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    many = hubs.where("parts > 1")
    spread = pairs.join(many, "b", "left").select("b", F.lit(1).alias("side"), F.col("a").alias("id"), F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    centre = hubs.select("b", F.lit(0).alias("side"), F.col("b").alias("id"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rows = spread.unionByName(centre).select(F.xxhash64("b", "part").alias("unit"), F.col("b").alias("hub"), "side", "id")
    texts = narrowed(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")))
    met = rows.join(texts, "id").select("unit", "hub", "side", "id", "text").repartition("unit").sortWithinPartitions("unit", "hub", "side", "id")

    def run(batches):
        now, held = None, []
        for batch in batches:
            good = []
            for unit, hub, side, i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (unit, hub) != now:
                    now, held = (unit, hub), []
                words = shingle_set(text, size)
                if not side:
                    held.append(words)  # one text, unless documents repeat the id
                elif any(similar(words, h, percent) for h in held):
                    good.append((i, hub))
            yield rows_batch(good, "a bigint, b bigint")

    return met.mapInArrow(run, "a bigint, b bigint").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component): the smallest id reachable, for every id that has a link. Labels pass
    to neighbours and then to the label's own label, until nothing changes; every round is
    written, so no lineage grows."""
    both = scratch.write(edges.select("a", "b").union(edges.select("b", "a")).toDF("id", "other").where("id <> other").distinct(), f"{name}-links")
    labels = scratch.write(both.groupBy("id").agg(F.min("other").alias("m")).select("id", F.least("id", "m").alias("component")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("component").alias("m"))
        spread = labels.join(near, "id").select("id", F.least("component", "m").alias("c"), F.col("component").alias("old"))
        owner = labels.select(F.col("id").alias("c"), F.col("component").alias("up"))
        jumped = spread.join(owner, "c", "left").select("id", F.least("c", "up").alias("component"), "old")
        written = scratch.write(jumped, f"{name}-{step}")
        changed = written.where("component <> old").limit(1).count()
        scratch.drop(f"{name}-{step - 1}")
        labels = written.select("id", "component")
        if not changed:
            scratch.drop(f"{name}-links")
            return labels


def starred(members: DataFrame) -> DataFrame:
    """Pairs (a, b): b is the pivot of a bucket that holds a. ``members``: (key, id, n)."""
    weight = members.groupBy("id").agg(F.sum("n").alias("w"))
    ranked = members.join(weight, "id").select("key", "id", F.struct("w", (-F.col("id")).alias("back")).alias("rank"))
    pivots = ranked.groupBy("key").agg(F.max("rank").alias("top")).select("key", (-F.col("top.back")).alias("b"))
    return members.join(pivots, "key").where("id <> b").select(F.col("id").alias("a"), "b").distinct()


def in_units(rows: DataFrame, work, schema: str) -> DataFrame:
    """``rows`` sorted by their first column ``unit``, and ``work`` on the columns of each unit
    in turn: one unit is in memory at a time, and units are of bounded size."""
    names = rows.columns[1:]

    def run(batches):
        unit, held = None, []
        for batch in batches:
            out = []
            for u, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if u != unit:
                    if len(held) > 1:
                        out += work(unit, dict(zip(names, zip(*held, strict=True), strict=True)))
                    unit, held = u, []
                held.append(row)
            yield rows_batch(out, schema)
        yield rows_batch(list(work(unit, dict(zip(names, zip(*held, strict=True), strict=True)))) if len(held) > 1 else [], schema)

    return rows.repartition("unit").sortWithinPartitions("unit", "side", "id").mapInArrow(run, schema)


def rows_batch(rows: list, schema: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array([None if x is None else int(x) for x in c], pa.int64()) for c in columns], names)


def partners(unit: dict, percent: int):
    """(i, js, agreements): the undecided pairs of the unit's loose row i that have their first
    shared band here. Rows: side 0 loose ones, 1 loose ones met by others, 2 all others."""
    ids, comps, sizes, side, band = (np.array(unit[c]) for c in ("id", "component", "n_shingles", "side", "band"))
    low = np.frombuffer(b"".join(unit["low"]), np.uint8).reshape(len(ids), -1)
    marks = np.frombuffer(b"".join(unit["marks"]), "<u4").reshape(len(ids), -1)
    least = percent / 100 - SLACK * (percent / 100 * (1 - percent / 100) / COORDS) ** 0.5
    others = np.flatnonzero(side > 0)
    for i in np.flatnonzero(side == 0):
        j = others[(comps[others] != comps[i]) & ((side[others] == 2) | (ids[others] > ids[i])) & (band[others] == band[i])]
        j = j[100 * np.minimum(sizes[j], sizes[i]) >= percent * np.maximum(sizes[j], sizes[i])]
        j = j[(marks[j] == marks[i]).argmax(axis=1) == band[i]] if len(j) else j
        if len(j):
            same = (low[j] == low[i]).mean(axis=1)
            j, same = j[same >= least], same[same >= least]
        if len(j):
            yield i, j, same


def in_blocks(count: str, shingles: str) -> F.Column:
    return F.ceil(F.greatest(F.col(count) / BLOCK, F.col(shingles) / BLOCK_SHINGLES)).cast("int")


def undecided(members: DataFrame, labels: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(unit, id, component, side, band, best, same): the classes of undecided pairs. best and
    same: the nearest undecided partner of a loose class in the unit, and their agreement.

    A bucket with ``l`` loose classes of ``m`` makes l / BLOCK times m / BLOCK units, so its rows
    grow with m as long as no more than a block of it is loose.
    """
    owned = members.join(labels, "id", "left").select("key", "band", "id", "n_shingles", F.coalesce("component", "id").alias("component"))
    counts = owned.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"), F.sum("n_shingles").alias("w"))
    top = F.max(F.struct("c", "component", "w")).alias("top")
    mixed = counts.groupBy("key").agg(top, F.sum("c").alias("m"), F.sum("w").alias("mw"), F.count(F.lit(1)).alias("k")).where("k > 1")
    mixed = mixed.select("key", F.col("top.component").alias("main"), "m", "mw", (F.col("m") - F.col("top.c")).alias("l"), (F.col("mw") - F.col("top.w")).alias("lw"))
    mixed = mixed.select("key", "main", in_blocks("l", "lw").alias("own"), in_blocks("m", "mw").alias("whole"))
    rows = owned.join(mixed, "key").join(classes.select("id", "low", "marks"), "id").withColumn("loose", F.col("component") != F.col("main"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    place = lambda c: F.pmod(F.xxhash64("id", "key"), F.col(c)).cast("int")
    columns = ["id", "component", "n_shingles", "low", "marks", "side", "band"]
    ask = rows.where("loose").withColumns({"side": F.lit(0), "x": place("own")}).withColumn("y", upto("whole"))
    meet = rows.withColumns({"side": F.when(F.col("loose"), 1).otherwise(2), "y": place("whole")}).withColumn("x", upto("own"))
    units = ask.select("key", "x", "y", *columns).unionByName(meet.select("key", "x", "y", *columns))

    def work(key, unit):
        found, best = set(), {}
        for i, j, same in partners(unit, percent):
            found.update((int(i), *map(int, j)))
            k = int(same.argmax())
            best[int(i)] = (unit["id"][j[k]], int(round(float(same[k]) * COORDS)))
        return [(key, *(unit[c][k] for c in ("id", "component", "side", "band")), *best.get(k, (None, None))) for k in sorted(found)]

    schema = "unit bigint, id bigint, component bigint, side bigint, band bigint, best bigint, same bigint"
    return in_units(units.select(F.xxhash64("key", "x", "y").alias("unit"), *columns), work, schema)


def links_within(active: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between components inside the units of ``active``, by whole sets. Linked
    components count as one within the unit from then on, so a unit gives fewer links than it
    has components."""

    def numbers(batches):
        for batch in batches:
            sets = [shingle_set(x, size).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "numbers"])

    sets = narrowed(docs, active.select("id")).mapInArrow(numbers, "id bigint, numbers binary")
    rows = active.join(classes.select("id", "n_shingles", "low", "marks"), "id").join(sets, "id")

    def work(key, unit):
        numbers = [np.frombuffer(x, np.uint64) for x in unit["numbers"]]
        ids, merged = unit["id"], {}

        def top(c):
            while c in merged:
                c = merged[c]
            return c

        for i, j, _ in partners(unit, percent):
            a = numbers[i]
            j = [k for k in j if top(unit["component"][k]) != top(unit["component"][i])]
            if not j or not len(a):
                continue
            every = np.concatenate([numbers[k] for k in j])
            at = np.minimum(np.searchsorted(a, every), len(a) - 1)
            upto = np.concatenate([[0], np.cumsum(a[at] == every)])
            both = np.diff(upto[np.concatenate([[0], np.cumsum([len(numbers[k]) for k in j])])])
            for k, n in zip(j, both, strict=True):
                x, y = top(unit["component"][i]), top(unit["component"][k])
                if x != y and 100 * int(n) >= percent * (len(a) + len(numbers[k]) - int(n)):
                    merged[x] = y
                    yield min(ids[i], ids[k]), max(ids[i], ids[k])

    columns = ["unit", "id", "component", "n_shingles", "low", "marks", "side", "band", "numbers"]
    return in_units(rows.select(*columns), work, "a bigint, b bigint").distinct()


def decided(members: DataFrame, links: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(links, labels) with what the undecided pairs add to ``links``."""
    step = 0
    while True:
        labels = components(links, scratch, f"labels-{step}")
        active = scratch.write(undecided(members, labels, classes, percent), f"active-{step}")
        nearest = active.where("best is not null").groupBy(F.col("id").alias("a")).agg(F.max(F.struct("same", (-F.col("best")).alias("back"))).alias("t"))
        pairs = scratch.write(nearest.select("a", (-F.col("t.back")).alias("b")), f"nearest-{step}")
        asked = pairs.count()
        if not asked:
            return links, labels
        more = scratch.write(verified(pairs, docs, size, percent), f"near-{step}")
        found = more.count()
        links = links.union(more)
        if WORTH * found < asked:
            labels = components(links, scratch, f"near-labels-{step}")
            now = active.drop("component").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
            rest = scratch.write(links_within(now, docs, classes, size, percent), "rest")
            if rest.limit(1).count():
                links = links.union(rest)
                labels = components(links, scratch, "labels")
            scratch.drop(f"active-{step}", f"nearest-{step}")
            return links, labels
        scratch.drop(f"active-{step}", f"nearest-{step}")
        step += 1


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Shingles are ``size`` consecutive words; two documents are linked where their sets share
    at least ``percent`` % of their union; component_id is the smallest doc_id reachable.
    Texts that are null or without words have no shingles and no links. Rows with one doc_id
    are one document. A row without doc_id is linked with nothing and kept. An empty table
    gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, f"minhash{size}")
    docs = docs.select("doc_id", "text")
    rows = scratch.write(features(docs, size), "rows")
    known = rows.where("set_key is not null and doc_id is not null")
    firsts = (F.first(c).alias(c) for c in ("n_shingles", "bands", "marks", "low"))
    by_set = scratch.write(known.groupBy("set_key").agg(F.min("doc_id").alias("id"), *firsts), "classes")
    classes = by_set.select("id", "n_shingles", "bands", "marks", "low")
    entries = classes.select("id", "n_shingles", F.posexplode("bands").alias("band", "key"))
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = scratch.write(entries.join(shared, "key"), "members")
    same = known.select("doc_id", "set_key").join(by_set.select("set_key", "id"), "set_key").where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    links = scratch.write(verified(starred(members), docs, size, percent), "star")
    links, labels = decided(members, links, docs, classes, size, percent, scratch)
    scratch.drop("members")
    split = by_set.groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").limit(1).count()
    if split or known.groupBy("doc_id").agg(F.count_distinct("set_key").alias("k")).where("k > 1").limit(1).count():
        labels = components(links.union(same), scratch, "all-labels")  # an id with several sets ties their classes together
        direct = rows.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    else:
        owner = by_set.join(labels, "id", "left").select("set_key", F.coalesce("component", "id").alias("component"))
        direct = rows.join(owner, "set_key", "left").select(
            "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
        )
    return direct.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows whose document isn't its group's smallest; of rows that
    repeat a doc_id one stays."""
    own = free_name(docs, "_keep")
    keep = near_duplicates(docs, size, percent).where("kept and doc_id is not null").select(F.col("doc_id").alias(own)).distinct()
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and doc_id is not null").select("doc_id")
    stay = docs.join(keep, F.col("doc_id") == F.col(own), "left_semi").unionByName(docs.where("doc_id is null"))
    if not repeated.limit(1).count():
        return stay
    number = free_name(docs, "_n")
    order = Window.partitionBy("doc_id").orderBy(*(F.col(f"`{c}`") for c in docs.columns))
    return stay.withColumn(number, F.row_number().over(order)).where((F.col(number) == 1) | F.col("doc_id").isNull()).drop(number)


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as keep it apart from the columns of ``docs``."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name
