"""Signatures of rows for comparing stored with live results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Separates values; a null is told from an empty text by its tag.
UNIT = "\x1f"


def canonical(column: Column, kind: T.DataType) -> Column:
    """The value as text; floats at 12 significant digits, as sums of floats depend on the
    order of their terms beyond that."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        x = column.cast("double")
        plain = F.format_string("%.11e", x + F.lit(0.0))
        text = F.when(F.isnan(x), "NaN").when(x == float("inf"), "Inf").when(x == float("-inf"), "-Inf").when(x == 0, "0").otherwise(plain)
    elif isinstance(kind, T.BinaryType):
        text = F.hex(column)
    else:
        text = column.cast("string")
    return F.when(column.isNull(), "n").otherwise(F.concat(F.lit("v"), text))


def row_digest(schema: T.StructType, columns: list[str]) -> Column:
    """MD5 over the named columns in order."""
    return F.md5(F.concat_ws(UNIT, F.lit(""), *(canonical(F.col(c), schema[c].dataType) for c in columns)))
