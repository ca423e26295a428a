"""Comparison of a stored view with its live result, key by key, on the cluster."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.digest import row_digest
from ..functions.keys import same_keys

MODES = ("row_count", "checksum", "full")


@dataclass(frozen=True)
class Verification:
    """``drift``: (keys, status) with status missing (in the source only), extra (in the store
    only) or mismatched. ``skipped`` says why nothing was compared."""

    view: str
    mode: str
    total: int = 0
    checked: int = 0
    missing: int = 0
    extra: int = 0
    mismatched: int = 0
    drift: DataFrame | None = None
    skipped: str | None = None

    @property
    def ok(self) -> bool:
        return not (self.missing or self.extra or self.mismatched)


def tallied(df: DataFrame, keys: tuple[str, ...], mode: str) -> DataFrame:
    """Per key: rows, and an order-free digest of their values (0 for row_count)."""
    values = [c for c in df.columns if c not in keys]
    digest = row_digest(df.schema, values) if values and mode != "row_count" else F.lit("")
    signature = F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(38,0)") if mode == "checksum" else F.lit(0).cast("decimal(38,0)")
    return df.select(*keys, signature.alias("__d")).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.sum("__d").alias("__d"))


def drift(stored: DataFrame, live: DataFrame, keys: tuple[str, ...], mode: str) -> DataFrame:
    """(keys, status) of every key whose rows differ."""
    if mode not in MODES:
        raise ValueError(f"verification mode {mode!r} is none of {', '.join(MODES)}")
    if mode == "full":
        # multisets of rows: each side's rows counted with a sign, by key and signature
        values = [c for c in stored.columns if c not in keys]
        live = live.select(*keys, *(F.col(c).cast(stored.schema[c].dataType).alias(c) for c in values))
        sign = lambda df, s: df.select(*keys, (row_digest(stored.schema, values) if values else F.lit("")).alias("__d"), F.lit(s).alias("__s"))
        per_row = sign(stored, 1).unionAll(sign(live, -1)).groupBy(*keys, "__d").agg(F.sum("__s").alias("__s"), F.sum((F.col("__s") > 0).cast("long")).alias("__here"), F.count(F.lit(1)).alias("__n"))
        per_key = per_row.groupBy(*keys).agg(F.max(F.abs("__s")).alias("__off"), F.sum("__here").alias("__here"), F.sum("__n").alias("__n")).where("__off > 0")
        status = F.when(F.col("__here") == 0, "missing").when(F.col("__here") == F.col("__n"), "extra").otherwise("mismatched")
        return per_key.select(*keys, status.alias("status"))
    a, b = tallied(stored, keys, mode), tallied(live.select(*keys, *(F.col(c).cast(stored.schema[c].dataType).alias(c) for c in stored.columns if c not in keys)), keys, mode)
    both = a.withColumn("__side", F.lit(1)).unionAll(b.withColumn("__side", F.lit(-1)))
    per_key = both.groupBy(*keys).agg(
        F.max((F.col("__side") > 0).cast("int")).alias("here"), F.max((F.col("__side") < 0).cast("int")).alias("there"), F.sum(F.col("__n") * F.col("__side")).alias("n"), F.sum(F.col("__d") * F.col("__side")).alias("d")
    )
    status = F.when(F.col("here") == 0, "missing").when(F.col("there") == 0, "extra").when((F.col("n") != 0) | (F.col("d") != 0), "mismatched")
    return per_key.select(*keys, status.alias("status")).where("status is not null")


def sample_size(sample: int | float | None, total: int) -> int | None:
    """Keys to check: a count, or a share (rounded up); None for all of them."""
    if sample is None:
        return None
    if sample < 0:
        raise ValueError("a sample can't be negative")
    n = math.ceil(sample * total) if isinstance(sample, float) else sample
    return None if n >= total else n


def sampled_keys(stored: DataFrame, keys: tuple[str, ...], n: int, seed: int) -> DataFrame:
    """``n`` stored keys at random; what is sampled is the feature, so missing keys are not
    found this way."""
    return stored.select(*keys).distinct().orderBy(F.rand(seed)).limit(n)


def restricted(df: DataFrame, chosen: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return df.join(chosen, same_keys(df, chosen, keys), "left_semi")
