"""Aggregates as states: what a group stores, what one row adds to it, what a reader sees.

A distributive aggregate's state is a sum of contributions, so it can be built from scratch
and from signed changes by the same expression. The others are only built from scratch.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMN = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
KINDS = ("count_star", "count", "count_distinct", "sum", "avg", "min", "max")
ADDITIVE = frozenset({"count_star", "count", "sum", "avg"})


@dataclass(frozen=True)
class Agg:
    """``kind`` of the SQL expression ``arg`` (None for count_star), named ``name``."""

    name: str
    kind: str
    arg: str | None = None

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown aggregate {self.kind!r}; known: {', '.join(KINDS)}")
        if (self.arg is None) != (self.kind == "count_star"):
            raise ValueError(f"{self.kind} of {self.name!r}: an argument is {'not allowed' if self.kind == 'count_star' else 'needed'}")
        if not COLUMN.match(self.name) or self.name.startswith("__"):
            raise ValueError(f"{self.name!r} can't name a column of a view")

    @property
    def plain(self) -> bool:
        """Is the argument a bare column?"""
        return self.arg is None or bool(COLUMN.match(self.arg))

    @property
    def additive(self) -> bool:
        return self.kind in ADDITIVE

    def contributions(self) -> dict[str, Column]:
        """State column -> what one row adds to it (additive kinds)."""
        if self.kind == "count_star":
            return {self.name: F.lit(1).cast("long")}
        x = F.expr(self.arg)
        here = x.isNotNull().cast("long")
        if self.kind == "count":
            return {self.name: here}
        return {f"__sum_{self.name}": F.coalesce(x, F.lit(0)), f"__n_{self.name}": here}

    def built(self) -> dict[str, Column]:
        """State column -> aggregate over a group's rows."""
        if self.additive:
            return {c: F.sum(x) for c, x in self.contributions().items()}
        x = F.expr(self.arg)
        return {self.name: {"min": F.min, "max": F.max, "count_distinct": F.count_distinct}[self.kind](x)}

    def shown(self, schema: T.StructType) -> Column:
        """The reader's column. Sums of decimals keep their scale at 38 digits, averages are
        the exact sum divided once (so they don't depend on the order of rows)."""
        if self.kind not in ("sum", "avg"):
            return F.col(self.name)
        total, n = F.col(f"__sum_{self.name}"), F.col(f"__n_{self.name}")
        if self.kind == "avg":
            return F.when(n > 0, total.cast("double") / n).alias(self.name)
        kind = schema[f"__sum_{self.name}"].dataType
        if isinstance(kind, T.DecimalType):
            total = total.cast(T.DecimalType(38, kind.scale))
        return F.when(n > 0, total).alias(self.name)


def count_all(name: str) -> Agg:
    return Agg(name, "count_star")


def count_of(arg: str, name: str) -> Agg:
    return Agg(name, "count", arg)


def count_distinct(arg: str, name: str) -> Agg:
    return Agg(name, "count_distinct", arg)


def sum_of(arg: str, name: str) -> Agg:
    return Agg(name, "sum", arg)


def avg_of(arg: str, name: str) -> Agg:
    return Agg(name, "avg", arg)


def min_of(arg: str, name: str) -> Agg:
    return Agg(name, "min", arg)


def max_of(arg: str, name: str) -> Agg:
    return Agg(name, "max", arg)


def sum_length(arg: str, name: str) -> Agg:
    """Sum of lengths in characters."""
    return Agg(name, "sum", f"length({arg})")
