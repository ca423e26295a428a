"""Incremental materialized views on Spark."""

from .engine import Engine
from .functions import avg_of, count_all, count_distinct, count_of, max_of, min_of, sum_length, sum_of
from .plans import Join, Relation, ViewSpec
from .policy import Config

__all__ = [
    "Config", "Engine", "Join", "Relation", "ViewSpec", "avg_of", "count_all", "count_distinct", "count_of", "max_of", "min_of", "sum_length", "sum_of",
]
