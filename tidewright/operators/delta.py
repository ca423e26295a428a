"""Summary deltas: signed contributions per group, merged into the stored state.

One aggregation over the changed rows and one over (stored groups, deltas); the base tables
are never read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.compile import ROWS
from ..plans.spec import ViewSpec
from .images import flat_rows


def contributions(spec: ViewSpec) -> dict:
    out = {ROWS: F.lit(1).cast("long")}
    for a in spec.aggs:
        out |= a.contributions()
    return out


def build(spec: ViewSpec, changes: DataFrame) -> DataFrame:
    """Keys and signed sums of the changes; groups whose sums are all zero are left out."""
    parts = contributions(spec)
    rows = spec.relation.derive(flat_rows(changes))
    summed = rows.groupBy(*spec.keys).agg(*(F.sum(F.col("__sign") * x).alias(c) for c, x in parts.items()))
    return prune(summed, list(parts))


def prune(delta: DataFrame, states: list[str]) -> DataFrame:
    return delta.where(reduce(lambda a, b: a | b, (F.col(c) != 0 for c in states)))


def merge(spec: ViewSpec, *deltas: DataFrame) -> DataFrame:
    """The pointwise sum of deltas."""
    states = list(contributions(spec))
    both = reduce(lambda a, b: a.unionByName(b), deltas)
    return prune(both.groupBy(*spec.keys).agg(*(F.sum(c).alias(c) for c in states)), states)


def apply(spec: ViewSpec, stored: DataFrame, delta: DataFrame) -> DataFrame:
    """The stored state after the delta: new groups come, emptied groups go.

    Union and regroup instead of a full outer join: one shuffle, and null keys need no care.
    """
    states = list(contributions(spec))
    columns = [*spec.keys, *states]
    types = {c: stored.schema[c].dataType for c in columns}
    aligned = delta.select(*(F.col(c).cast(types[c]).alias(c) for c in columns))
    summed = stored.select(*columns).unionAll(aligned).groupBy(*spec.keys).agg(*(F.sum(c).cast(types[c]).alias(c) for c in states))
    return summed.where(F.col(ROWS) > 0)
