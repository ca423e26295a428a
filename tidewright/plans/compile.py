"""From declarations to lazy DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spec import Relation, ViewSpec

Read = Callable[[str], DataFrame]
#: Rows of a group; kept beside the aggregates of every grouped view.
ROWS = "__rows"


def grouped_state(spec: ViewSpec, rows: DataFrame) -> DataFrame:
    """Keys and aggregate states of the relation's rows."""
    states = {ROWS: F.count(F.lit(1))} if spec.keys else {}
    for a in spec.aggs:
        states |= a.built()
    out = rows.groupBy(*(F.col(k) for k in spec.keys)).agg(*(x.alias(c) for c, x in states.items()))
    if spec.having:
        visible = shown(spec, out)
        out = out.withColumns({c: visible_column(spec, out, c) for c in visible.columns if c not in out.columns}).where(spec.having).select(*out.columns)
    return out


def visible_column(spec: ViewSpec, state: DataFrame, name: str):
    return next(a.shown(state.schema) for a in spec.aggs if a.name == name)


def shown(spec: ViewSpec, state: DataFrame) -> DataFrame:
    """The columns that readers see of a stored or live state."""
    if spec.relation is None:
        return state
    return state.select(*spec.keys, *(a.shown(state.schema) for a in spec.aggs))


def live_state(spec: ViewSpec, read: Read, relation: Relation | None = None) -> DataFrame:
    """What would be stored if the view were built now."""
    if spec.relation is None:
        out = spec.query(read)
        if not isinstance(out, DataFrame):
            raise TypeError(f"view {spec.name!r}: its query must build a DataFrame, not {type(out).__name__}")
        return out
    return grouped_state(spec, (relation or spec.relation).build(read))


def live(spec: ViewSpec, read: Read) -> DataFrame:
    """The view's rows, computed from its tables."""
    return shown(spec, live_state(spec, read))


def schema_drift(stored: T.StructType, now: T.StructType) -> dict[str, list[str]]:
    """Columns that are missing from the store, left over in it, or of another type."""
    a, b = ({f.name: f.dataType.simpleString() for f in s} for s in (stored, now))
    return {"missing": sorted(b.keys() - a.keys()), "extra": sorted(a.keys() - b.keys()), "changed": sorted(c for c in a.keys() & b.keys() if a[c] != b[c])}


def create_table_ddl(name: str, schema: T.StructType) -> str:
    """A CREATE TABLE statement for a view's visible columns."""
    columns = ",\n  ".join(f"`{f.name}` {f.dataType.simpleString().upper()}{'' if f.nullable else ' NOT NULL'}" for f in schema)
    return f"CREATE TABLE {name} (\n  {columns}\n) USING parquet"
