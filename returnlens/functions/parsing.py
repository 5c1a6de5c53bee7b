"""Column functions that turn raw text and rows into typed, JSON-safe values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def utc_timestamp(value: Column) -> Column:
    """ISO text to a UTC wall-clock timestamp; text without a zone is taken as UTC, bad text is null.

    The instant is counted from the epoch and never written on the session's clock, where an hour may come twice.
    """
    text = F.nullif(F.trim(value.cast("string")), F.lit(""))
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & F.contains(text, F.lit(":"))
    instant = F.try_to_timestamp(F.when(zoned, text).otherwise(F.concat(text, F.lit("Z"))))
    bare_date = F.try_to_timestamp(F.concat(text, F.lit(" 00:00:00Z")))
    moment = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), bare_date).otherwise(instant)
    seconds = (F.unix_micros(moment).cast("decimal(24,6)") / F.lit(1_000_000)).cast("decimal(18,6)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def calendar_date(value: Column) -> Column:
    """Date of ISO date or datetime text; blank or bad text is null."""
    text = F.nullif(F.trim(value.cast("string")), F.lit(""))
    return F.when(F.contains(text, F.lit("T")), utc_timestamp(text).cast("date")).otherwise(
        F.try_to_timestamp(F.concat(text, F.lit(" 00:00:00"))).cast("date")
    )


def midnight(day: Column) -> Column:
    return day.cast("timestamp_ntz")


def _json_value(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        finite = ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
        return F.when(finite, value)
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(value))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    if isinstance(kind, T.StructType):
        inner = [_json_value(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*inner))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda item: _json_value(item, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, item: _json_value(item, kind.valueType))
    return value


def json_payload(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Whole row as JSON text: times in ISO form, non-finite numbers null, bytes in hex."""
    names = columns or df.columns
    kinds = {f.name: f.dataType for f in df.schema.fields}
    safe = F.struct(*[_json_value(F.col(n), kinds[n]).alias(n) for n in names])
    return F.to_json(safe, {"ignoreNullFields": "false"})
