"""Scoped recompute: which groups a change touches, and those groups computed anew."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import same_keys
from ..plans.compile import live_state
from ..plans.spec import ViewSpec
from .images import flat_rows, image_keys, lacks, mentions, sides

Read = Callable[[str], DataFrame]


def own_keys(spec: ViewSpec, table: str, columns: list[str]) -> dict[str, str] | None:
    """View key -> SQL over ``table``'s row, if that table alone gives every key."""
    if spec.relation is None:
        return {k: k for k in spec.scope} if len(spec.depends_on) == 1 and set(spec.scope) <= set(columns) else None
    derived = spec.relation.columns
    if any(j.alias and j.table == table for j in spec.relation.joins):
        return None
    out = {}
    for k in spec.scope:
        text = derived.get(k, k)
        if k in derived and spec.relation.joins or k not in derived and k not in columns:
            return None
        out[k] = text
    return out


def affected(spec: ViewSpec, table: str, changes: dict[str, DataFrame], read: Read) -> tuple[DataFrame, DataFrame | None] | None:
    """(keys with source_ts, images too partial to derive them from) of one table's changes.

    A resolver decides where one is declared. Else keys come from the images if the table
    holds them all, or from joining the images into the relation in the table's place. The
    other tables then count with the rows they lost in the same range, so that a fact finds
    its old and its new dimension row. None if nothing of this works: the view must widen.
    """
    own = changes[table]
    if table in spec.resolvers:
        found = spec.resolvers[table](own, read)
        return None if found is None else (found.select(*spec.scope, F.lit(None).cast("long").alias("source_ts")), None)
    row = own.schema["before"].dataType.fieldNames()
    if keys := own_keys(spec, table, row):
        return image_keys(own, keys)
    if spec.relation is None:
        return None
    needed = [c for c in row if used(spec, table, c)]
    partial = sides(own).where(lacks(needed))

    def substituted(at: str) -> DataFrame:
        if at == table:
            return flat_rows(own).drop("__sign")
        now = read(at)
        return now.unionByName(flat_rows(changes[at], -1).drop("__sign")) if at in changes else now

    def occurrence(k: int) -> DataFrame:
        """The relation with the images in the k-th place where the table stands."""
        place = iter(range(99))

        def one(at: str) -> DataFrame:
            if at != table:
                return substituted(at)
            return substituted(at) if next(place) == k else read(at).unionByName(flat_rows(own, -1).drop("__sign"))

        return replace(spec.relation, where=None).build(one).select(*spec.scope)

    times = sum(t == table for t in [spec.relation.table, *(j.table for j in spec.relation.joins)])
    found = occurrence(0)
    for k in range(1, times):
        found = found.unionAll(occurrence(k))
    return found.withColumn("source_ts", F.lit(None).cast("long")), partial


def used(spec: ViewSpec, table: str, column: str) -> bool:
    """Does the relation's join, predicate or key mention the column?"""
    texts = [*(j.on for j in spec.relation.joins), spec.relation.where or "", *spec.relation.columns.values(), *spec.scope]
    return any(mentions(t, column) for t in texts)


def recompute(spec: ViewSpec, read: Read, keys: DataFrame) -> DataFrame:
    """The groups with the given keys (a bounded set), computed from the tables. The filter
    stands above the aggregation and is pushed below it, to the table that owns the key."""
    whole = live_state(spec, read, spec.incremental_from)
    return whole.join(F.broadcast(keys), same_keys(whole, keys, spec.scope), "left_semi")


def without(stored: DataFrame, keys: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    return stored.join(F.broadcast(keys), same_keys(stored, keys, scope), "left_anti")
