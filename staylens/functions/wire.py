"""Values as they leave the engine, and values read back from text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from staylens.functions.dates import timestamp_text
from staylens.functions.numbers import half_even


def _wire_value(name: str, kind: T.DataType) -> Column:
    value = F.col(f"`{name}`")
    if isinstance(kind, T.DateType):
        return F.date_format(value, "yyyy-MM-dd")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return timestamp_text(value)
    if isinstance(kind, T.DecimalType):
        return value.cast("double") if kind.scale <= 4 else half_even(value)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return half_even(F.when(~F.isnan(value), value))
    if isinstance(kind, T.ArrayType):
        return F.array_join(value, ",")
    return value


def normalize_record(df: DataFrame) -> DataFrame:
    """Dates as ISO text, decimals and doubles as four-digit doubles, NaN as null, arrays as joined text."""
    return df.select(*(_wire_value(field.name, field.dataType).alias(field.name) for field in df.schema.fields))


def metric_number(text: Column) -> Column:
    """The number a metric text holds, else null."""
    return text.try_cast("double")


def metric_field(text: Column, name: str) -> Column:
    """One field of a metric text that holds a flat JSON object, else null."""
    return F.try_variant_get(F.try_parse_json(text), f"$.{name}", "string")


def first_present(df: DataFrame, *names: str) -> Column:
    """The first non-null value among alias columns, of which the frame may lack some."""
    present = [F.col(name).cast("string") for name in names if name in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def alias_int(df: DataFrame, *names: str) -> Column:
    return F.coalesce(first_present(df, *names).try_cast("double").try_cast("bigint"), F.lit(0).cast("bigint"))


def alias_float(df: DataFrame, *names: str) -> Column:
    return half_even(F.coalesce(first_present(df, *names).try_cast("double"), F.lit(0.0)))
