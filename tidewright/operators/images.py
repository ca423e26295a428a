"""Change rows: (op, before, after, present_before, present_after, source_ts).

before and after are structs of the table's row; the present arrays name the columns that the
change carried, so that a missing column is told from a null one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPS = ("create", "update", "destroy")


def change_schema(row: T.StructType) -> T.StructType:
    names = T.ArrayType(T.StringType())
    loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in row])
    return T.StructType([
        T.StructField("op", T.StringType()), T.StructField("before", loose), T.StructField("after", loose),
        T.StructField("present_before", names), T.StructField("present_after", names), T.StructField("source_ts", T.LongType()),
    ])


def full_images(op: str, before: DataFrame | None, after: DataFrame | None, row: T.StructType) -> DataFrame:
    """Change rows with whole images, of inserted (after) or deleted (before) rows."""
    df = after if after is not None else before
    kind = change_schema(row)["before"].dataType
    image, none = F.struct(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in row)), F.lit(None).cast(kind)
    names, nothing = F.array(*(F.lit(c) for c in row.fieldNames())), F.array().cast("array<string>")
    sides = (none, image, nothing, names) if after is not None else (image, none, names, nothing)
    return df.select(F.lit(op).alias("op"), *(c.alias(n) for c, n in zip(sides, ("before", "after", "present_before", "present_after"), strict=True)), F.lit(None).cast("long").alias("source_ts"))


def from_descriptors(spark, rows: list[dict], row: T.StructType) -> DataFrame:
    """Change rows of normalised descriptors: operation, before / after / key_attributes maps,
    source_ts. Key attributes stand for the image that the operation leaves out."""
    out = []
    for d in rows:
        op = str(d["operation"])
        if op not in OPS:
            raise ValueError(f"unsupported operation {op!r}")
        ts = d.get("source_ts")
        if ts is not None and (isinstance(ts, bool) or not isinstance(ts, int)):
            raise ValueError("source_ts must be an integer")
        keys, before, after = d.get("key_attributes"), d.get("before"), d.get("after")
        if op != "create":
            before = before if before is not None else keys
        if op != "destroy":
            after = after if after is not None else keys
        if op == "create" and after is None or op == "destroy" and before is None:
            raise ValueError(f"a {op} needs its row or key attributes")
        image = lambda m: None if m is None else tuple(m.get(c) for c in row.fieldNames())
        present = lambda m: [c for c in row.fieldNames() if m is not None and c in m]
        before, after = (before if op != "create" else None), (after if op != "destroy" else None)
        out.append((op, image(before), image(after), present(before), present(after), ts))
    return spark.createDataFrame(out, change_schema(row))


def sides(changes: DataFrame) -> DataFrame:
    """(image, present, sign, source_ts): -1 for rows that went, 1 for rows that came."""
    went = changes.where(F.col("op") != "create").select(F.col("before").alias("image"), F.col("present_before").alias("present"), F.lit(-1).alias("sign"), "source_ts")
    came = changes.where(F.col("op") != "destroy").select(F.col("after").alias("image"), F.col("present_after").alias("present"), F.lit(1).alias("sign"), "source_ts")
    return went.unionAll(came)


def flat_rows(changes: DataFrame, sign: int | None = None) -> DataFrame:
    """The table's rows in the images, with ``__sign``."""
    both = sides(changes).where(F.col("image").isNotNull())
    both = both if sign is None else both.where(F.col("sign") == sign)
    return both.select("image.*", F.col("sign").alias("__sign"))


def lacks(columns: list[str]) -> Column:
    """Does an image row lack one of the columns, or the image as a whole?"""
    return F.col("image").isNull() | ~reduce(lambda a, b: a & b, (F.array_contains("present", c) for c in columns), F.lit(True))


def image_keys(changes: DataFrame, keys: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(keys with source_ts, images that lack a key). ``keys``: view key -> SQL over the row.

    A key may be derived from columns, so the image must hold every column the expressions
    name; a null key is a key.
    """
    row = changes.schema["before"].dataType
    needed = [c for c in row.fieldNames() if any(mentions(x, c) for x in keys.values())]
    both = sides(changes)
    known = both.where(~lacks(needed)).select("image.*", "source_ts").select(*(F.expr(x).alias(k) for k, x in keys.items()), "source_ts")
    return known, both.where(lacks(needed))


def mentions(expression: str, column: str) -> bool:
    import re

    return re.search(rf"(?<![A-Za-z0-9_]){re.escape(column)}(?![A-Za-z0-9_])", expression) is not None


Resolver = Callable[[DataFrame], DataFrame]
