"""Debezium change envelopes, one at a time or as a DataFrame of JSON texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.images import change_schema
from .catalog import table_name

# The wire format's operation codes.
OPERATIONS = {"c": "create", "r": "create", "u": "update", "d": "destroy"}


def to_descriptor(envelope: dict | None, table: str | None = None) -> dict | None:
    """A normalised descriptor; None for a tombstone. The envelope may be inside ``payload``."""
    if envelope is None:
        return None
    body = {str(k): v for k, v in envelope.items()}
    if isinstance(body.get("payload"), dict):
        body = {str(k): v for k, v in body["payload"].items()}
    elif "payload" in body and body["payload"] is None and "op" not in body:
        return None
    op = body.get("op")
    if op is None:
        raise ValueError("the envelope has no op")
    if str(op) not in OPERATIONS:
        raise ValueError(f"unsupported op {op!r}")
    source = {str(k): v for k, v in (body.get("source") or {}).items()}
    table = table or source.get("table")
    if not table:
        raise ValueError("the envelope names no table")
    out = {"table": str(table), "operation": OPERATIONS[str(op)]}
    for side in ("before", "after"):
        if body.get(side) is not None:
            out[side] = {str(k): v for k, v in body[side].items()}
    ts = source.get("ts_ms")
    if isinstance(ts, int) and not isinstance(ts, bool):
        out["source_ts"] = ts
    return out


def source_table(value: Column) -> Column:
    """The table that a JSON envelope names; null if none."""
    return F.coalesce(F.get_json_object(value, "$.payload.source.table"), F.get_json_object(value, "$.source.table"))


def holds_change(value: Column) -> Column:
    """Is the JSON text an envelope with a change? A text that isn't JSON raises when it is read."""
    body = F.trim(value)
    known = body.isNull() | F.get_json_object(body, "$").isNotNull() | (body == "null") | (body == "")
    whole = F.when(known, body).otherwise(F.raise_error(F.concat(F.lit("malformed envelope: "), F.substring(body, 1, 200))))
    parts = [F.get_json_object(whole, f"${at}.{f}") for at in ("", ".payload") for f in ("op", "before", "after")]
    return value.isNotNull() & F.coalesce(*parts).isNotNull()


def to_descriptors(events: DataFrame, row: T.StructType, column: str = "value", table: str | None = None) -> DataFrame:
    """Change rows of envelopes given as JSON texts; tombstones are left out.

    With ``table``, envelopes that name another table are left out too. Texts that aren't JSON
    and unknown operations raise when the rows are read.
    """
    events = events.where(holds_change(F.col(column)))
    if table is not None:
        named = source_table(F.col(column))
        key = F.lower(F.regexp_replace(F.regexp_replace(named, "^:+", ""), "(?<=[a-z0-9])(?=[A-Z])", "_"))  # table_name
        events = events.where(named.isNull() | (key == table_name(table)))
    side = T.MapType(T.StringType(), T.StringType())
    body = T.StructType([
        T.StructField("op", T.StringType()), T.StructField("before", T.StringType()), T.StructField("after", T.StringType()),
        T.StructField("source", T.StructType([T.StructField("table", T.StringType()), T.StructField("ts_ms", T.StringType())])),
    ])
    both = T.StructType([*body.fields, T.StructField("payload", body)])
    read = events.select(F.from_json(column, both).alias("e"))
    flat = read.select(*(F.coalesce(F.col(f"e.payload.{f.name}"), F.col(f"e.{f.name}")).alias(f.name) for f in body)).where("op is not null or before is not null or after is not null")
    op = F.lit(None).cast("string")
    for code, name in OPERATIONS.items():
        op = F.when(F.col("op") == code, name).otherwise(op)
    op = F.coalesce(op, F.raise_error(F.concat(F.lit("unsupported op "), F.coalesce("op", F.lit("null")))))
    kind = change_schema(row)["before"].dataType
    names = F.array(*(F.lit(c) for c in row.fieldNames()))
    nothing = F.array().cast("array<string>")

    def present(image: str):
        return F.when(F.col(image).isNull(), nothing).otherwise(F.filter(names, lambda n: F.array_contains(F.map_keys(F.from_json(image, side)), n)))

    def image(name: str, absent: str):
        return F.when(F.col("op") != absent, F.from_json(name, kind))

    ts = F.when(F.col("source.ts_ms").rlike("^-?[0-9]+$"), F.col("source.ts_ms").cast("long"))
    out = flat.select(op.alias("op"), F.col("before").alias("b"), F.col("after").alias("a"), ts.alias("source_ts"))
    return out.select("op", image("b", "create").alias("before"), image("a", "destroy").alias("after"), present("b").alias("present_before"), present("a").alias("present_after"), "source_ts")
