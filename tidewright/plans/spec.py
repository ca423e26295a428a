"""A view's declaration: relation, keys, aggregates, dependencies and policy.

Everything is checked when the declaration is made. The declaration, not an analysed plan,
carries the meaning; maintenance plans are built from it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..functions.aggregates import COLUMN, Agg

FEEDS = ("managed", "external")
STRATEGIES = ("async", "immediate", "manual")
COLD_READS = ("read_through", "serve_stale", "raise")
MODES = ("incremental", "full")
RESERVED = "mv_"


@dataclass(frozen=True)
class Join:
    table: str
    on: str
    how: str = "inner"
    alias: str | None = None


@dataclass(frozen=True)
class Relation:
    """``table`` joined to others, with derived columns and a predicate (SQL text).

    A table that occurs twice gets an alias; its columns are then ``alias_column``.
    """

    table: str
    joins: tuple[Join, ...] = ()
    where: str | None = None
    columns: dict[str, str] = field(default_factory=dict)

    @property
    def tables(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys([self.table, *(j.table for j in self.joins)]))

    def build(self, read: Callable[[str], DataFrame]) -> DataFrame:
        """The rows before grouping; ``read`` gives each table's rows."""
        df = read(self.table)
        for j in self.joins:
            right = read(j.table)
            if j.alias:
                right = right.toDF(*(f"{j.alias}_{c}" for c in right.columns))
            left, other = df.alias("l"), right.alias("r")
            from pyspark.sql import functions as F

            df = left.join(other, F.expr(j.on), j.how)
        return self.derive(df)

    def derive(self, df: DataFrame) -> DataFrame:
        from pyspark.sql import functions as F

        if self.columns:
            df = df.withColumns({k: F.expr(v) for k, v in self.columns.items()})
        return df.where(self.where) if self.where else df


Keys = Callable[[DataFrame, Callable[[str], DataFrame]], DataFrame]


@dataclass(frozen=True)
class ViewSpec:
    """Declares a view.

    keys, aggs: GROUP BY columns and aggregates; ``distinct``: SELECT DISTINCT of the keys.
    query: any builder of a DataFrame instead of a relation; such a view is opaque, that is
    rebuilt only, or recomputed by its ``maintenance_keys`` where they are declared.
    resolvers: table -> function from change rows (before, after) to a DataFrame of keys.
    incremental_from: a relation that maintenance reads instead, still restricted to the keys.
    """

    name: str
    relation: Relation | None = None
    keys: tuple[str, ...] = ()
    aggs: tuple[Agg, ...] = ()
    having: str | None = None
    distinct: bool = False
    query: Callable[[Callable[[str], DataFrame]], DataFrame] | None = None
    depends_on: tuple[str, ...] = ()
    feed: str = "managed"
    strategy: str = "async"
    debounce: float | None = None
    cold_read: str | None = None
    max_staleness: float | Callable[[], float | None] | None = None
    mode: str = "incremental"
    maintenance_keys: tuple[str, ...] | None = None
    resolvers: dict[str, Keys] = field(default_factory=dict)
    incremental_from: Relation | None = None
    warm_keys: tuple[dict, ...] | Callable[[], list[dict]] = ()
    before_refresh: tuple[Callable, ...] = ()
    after_refresh: tuple[Callable, ...] = ()
    buckets: int = 4

    def __post_init__(self):
        def need(ok: bool, what: str):
            if not ok:
                raise ValueError(f"view {self.name!r}: {what}")

        need(bool(COLUMN.match(self.name)), "its name must be an identifier")
        need((self.relation is None) != (self.query is None), "declare a relation or a query")
        need(self.query is None or callable(self.query), "query must be a function that builds a DataFrame")
        for value, known, what in ((self.feed, FEEDS, "feed"), (self.strategy, STRATEGIES, "strategy"), (self.mode, MODES, "mode")):
            need(value in known, f"{what} {value!r} is none of {', '.join(known)}")
        need(self.cold_read is None or self.cold_read in COLD_READS, f"cold_read {self.cold_read!r} is none of {', '.join(COLD_READS)}")
        need(self.debounce is None or self.debounce >= 0, "debounce can't be negative")
        need(callable(self.max_staleness) or self.max_staleness is None or self.max_staleness >= 0, "max_staleness can't be negative")
        need(all(COLUMN.match(k) for k in self.keys), "keys are bare column names")
        need(not self.distinct or bool(self.keys) and not self.aggs, "a distinct view has keys and no aggregates")
        need(self.buckets > 0, "buckets must be positive")
        names = [*self.keys, *(a.name for a in self.aggs)]
        need(len(set(names)) == len(names), "column names must differ")
        if self.relation is not None:
            need(bool(names), "declare keys or aggregates")
            if not self.depends_on:
                object.__setattr__(self, "depends_on", self.relation.tables)
        need(bool(self.depends_on), "declare depends_on")
        need(not any(t.startswith(RESERVED) for t in self.depends_on), "a view can't depend on another view's table")
        need(not self.maintenance_keys or self.relation is None or set(self.maintenance_keys) <= set(self.keys), "maintenance keys must be group keys")

    @property
    def columns(self) -> list[str]:
        return [*self.keys, *(a.name for a in self.aggs)]

    @property
    def scope(self) -> tuple[str, ...]:
        """Keys that maintenance goes by: declared ones, else the group keys."""
        return tuple(self.maintenance_keys or self.keys)

    @property
    def grouped(self) -> bool:
        return bool(self.scope)

    def strictly_self_maintainable(self, not_null: frozenset[str] = frozenset()) -> bool:
        """The narrow class: one table, grouped, no HAVING, only counts and plain sums of
        columns that are declared NOT NULL, and a row count among them."""
        if self.relation is None or self.relation.joins or not self.keys or self.having or self.distinct:
            return False
        fit = all(a.kind in ("count_star", "count") or a.kind == "sum" and a.plain and a.arg in not_null for a in self.aggs)
        return fit and any(a.kind == "count_star" or a.kind == "count" and a.plain and a.arg in not_null for a in self.aggs)

    @property
    def by_delta(self) -> bool:
        """Can signed changes alone keep the view? Row and non-null counts are stored beside
        the aggregates, so nullable arguments, averages, DISTINCT and views without a visible
        count qualify too, and the predicate is evaluated on the changed rows."""
        return self.relation is not None and not self.relation.joins and bool(self.keys) and not self.having and self.scope == self.keys and self.incremental_from is None and all(a.additive for a in self.aggs)
