"""Aggregates of a view, row digests and key expressions; all of them are Column builders."""

from .aggregates import Agg, avg_of, count_all, count_distinct, count_of, max_of, min_of, sum_length, sum_of
from .digest import canonical, row_digest
from .keys import bucket_of, key_filter, same_keys

__all__ = [
    "Agg", "avg_of", "bucket_of", "canonical", "count_all", "count_distinct", "count_of", "key_filter", "max_of", "min_of", "row_digest", "same_keys", "sum_length", "sum_of",
]
