"""Event text to typed events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from staylens import schemas as S

_DAMAGED = "_damaged"
#: Tells events apart that have a null in their keys.
DIGEST = "_digest"

# Every field is read as text, so that a field of an unexpected type cannot spoil the record.
_TEXT_EVENT = T.StructType(
    [T.StructField(name, T.StringType()) for name in [*S.EVENT_SCHEMA.names, _DAMAGED]]
)


def parse_events(lines: DataFrame) -> DataFrame:
    """Event fields from JSON text in `value`, which stays. A missing business time is the creation time."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _DAMAGED}
    parsed = lines.withColumn("_event", F.from_json("value", _TEXT_EVENT, options))

    def typed(field: T.StructField):
        text = F.col(f"_event.{field.name}")
        if isinstance(field.dataType, T.StringType):
            return text
        if isinstance(field.dataType, T.DoubleType):
            return text.try_cast("double")
        return F.coalesce(text.try_cast(field.dataType), text.try_cast("double").try_cast(field.dataType))

    fields = {field.name: typed(field) for field in S.EVENT_SCHEMA.fields}
    fields["business_time"] = F.coalesce(fields["business_time"], fields["generated_at"])
    readable = F.col(f"_event.{_DAMAGED}").isNull() & F.col("_event").isNotNull()
    return parsed.select(
        "value", *(column.alias(name) for name, column in fields.items()), readable.alias("is_readable")
    )


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("is_readable") & F.col("booking_id").isNotNull()).select(*S.EVENT_SCHEMA.names)


def rejected(parsed: DataFrame) -> DataFrame:
    """Lines that are not JSON objects or name no booking, with the reason."""
    reason = F.when(~F.col("is_readable"), "not readable").otherwise("booking_id is required")
    return parsed.where(~F.col("is_readable") | F.col("booking_id").isNull()).select("value", reason.alias("reason"))


def with_digest(events: DataFrame, keys: list[str]) -> DataFrame:
    """Add DIGEST: of all columns where a key is null, as such events have no name of their own; else null."""
    unnamed = reduce(lambda a, b: a | b, (F.col(key).isNull() for key in keys))
    whole = F.to_json(F.struct(*(F.col(name).cast("string").alias(name) for name in sorted(events.columns))))
    return events.withColumn(DIGEST, F.when(unnamed, F.sha2(whole, 256)))


def first_deliveries(events: DataFrame, keys: list[str]) -> DataFrame:
    """Each event of a stream once, although delivery is at least once and in any order.

    The keys of all events so far are in Spark's state store, spread by key, so a micro-batch looks up its own
    keys and reads nothing of the history; the store grows by a key per event. There is no event-time cut, so
    an event counts however late it comes. Events with a null in the keys are the same only if all their
    columns are. Of a key that comes with different contents, one row stays. Works on a table as well.
    """
    return with_digest(events, keys).dropDuplicates([*keys, DIGEST]).drop(DIGEST)
