"""Group keys: null is a key like any other."""

from __future__ import annotations

import datetime
import json
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many single keys a filter is written as a list, which scans can use; beyond that
#: keys are joined.
LISTED = 100


def same_keys(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in keys))


def bucket_of(keys: tuple[str, ...], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*(F.col(k) for k in keys)), F.lit(buckets)).cast("int") if keys else F.lit(0)


def key_filter(keys: tuple[str, ...], tuples: list[tuple]) -> Column:
    """Condition that a row has one of the key tuples."""
    if not keys or not tuples:
        raise ValueError("a key filter needs group keys and at least one tuple")
    if len(keys) == 1:
        known = [t[0] for t in tuples if t[0] is not None]
        parts = ([F.col(keys[0]).isin(known)] if known else []) + ([F.col(keys[0]).isNull()] if len(known) < len(tuples) else [])
    else:
        parts = [reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.lit(v)) for k, v in zip(keys, t, strict=True))) for t in tuples]
    return reduce(lambda a, b: a | b, parts)


def key_text(key: tuple) -> str:
    """A key tuple as a JSON text; values that JSON has no form for keep their type by name."""

    def typed(x):
        if isinstance(x, datetime.datetime):
            return {"timestamp": x.isoformat()}
        if isinstance(x, datetime.date):
            return {"date": x.isoformat()}
        if isinstance(x, Decimal):
            return {"decimal": str(x)}
        if isinstance(x, (bytes, bytearray)):
            return {"binary": bytes(x).hex()}
        raise TypeError(f"{x!r} can't be a group key")

    return json.dumps(list(key), default=typed)


def key_of(text: str) -> tuple:
    kinds = {"timestamp": datetime.datetime.fromisoformat, "date": datetime.date.fromisoformat, "decimal": Decimal, "binary": bytes.fromhex}

    def plain(x: dict):
        ((kind, value),) = x.items()
        return kinds[kind](value)

    return tuple(json.loads(text, object_hook=plain))
