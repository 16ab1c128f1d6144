"""Running and windowed metrics. Every function accepts a batch or a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from staylens.functions.numbers import four_digits, half_up, ratio

# Calendar windows. Spark counts weeks from a Thursday, so four days lead to Monday.
_WINDOWS = {"day": ("1 day", None, None), "week": ("1 week", "1 week", "4 days")}

_EXACT = "decimal(28,4)"


def _sums() -> list[Column]:
    return [
        F.count("*").alias("processed_count"),
        F.count_if(F.col("risk_level") == "high").alias("high_risk_count"),
        F.count_if(F.col("predicted_label") == 1).alias("predicted_cancellations"),
        F.sum(F.col("cancel_probability").cast(_EXACT)).cast(_EXACT).alias("probability"),
    ]


def running_summary(scored: DataFrame) -> DataFrame:
    """Totals since the start of the stream."""
    return scored.agg(*_sums()).select(*summary_columns())


def summary_columns() -> list[Column]:
    return [
        F.col("processed_count"),
        F.col("high_risk_count"),
        F.col("predicted_cancellations"),
        half_up(ratio(F.col("probability"), F.col("processed_count"))).alias("average_cancel_probability"),
    ]


def running_by(scored: DataFrame, name: str) -> DataFrame:
    """Counts and cancel rate per key since the start; a missing key counts as unknown."""
    return (
        scored.groupBy(F.coalesce(F.col(name), F.lit("unknown")).alias("name"))
        .agg(*_sums())
        .select("name", *rate_columns())
    )


def rate_columns() -> list[Column]:
    share = ratio(F.col("predicted_cancellations"), F.col("processed_count"))
    return [
        half_up(share).alias("value"),
        F.col("processed_count").alias("booking_count"),
        F.col("predicted_cancellations"),
        share.alias("rate"),
    ]


def with_cancel_rate(sums: DataFrame) -> DataFrame:
    share = half_up(ratio(F.col("predicted_cancellations"), F.col("inflow")))
    return sums.withColumn("cancel_rate", share)


def merge_trends(sums: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key from the sums of several batches."""
    added = [F.sum(name).alias(name) for name in ("inflow", "predicted_cancellations")]
    return sums.groupBy(*keys).agg(*added)


def trend_sums(scored: DataFrame, granularity: str, event_time: str = "predicted_at") -> DataFrame:
    """The mergeable sums per calendar period. A month has no fixed length, so it is a truncated timestamp."""
    if granularity == "month":
        start = F.date_trunc("month", event_time)
    else:
        length, slide, offset = _WINDOWS[granularity]
        start = F.window(event_time, length, slide, offset)
    grouped = scored.groupBy(start.alias("_period")).agg(
        F.count("*").alias("inflow"), F.count_if(F.col("predicted_label") == 1).alias("predicted_cancellations")
    )
    label = F.col("_period") if granularity == "month" else F.col("_period.start")
    return grouped.select(F.date_format(label, "yyyy-MM-dd").alias("label"), "inflow", "predicted_cancellations")


# --- running state as a small table -------------------------------------------------------------

# One row for the whole stream, one per country, one per channel.
_DIMENSIONS = {"all": None, "country": "country_name", "channel": "market_segment"}
STATE_KEYS = ["dimension", "name"]


def state_of(scored: DataFrame) -> DataFrame:
    """The mergeable sums of a set of events, per (dimension, key)."""
    keys = F.array(
        *(
            F.struct(
                F.lit(dimension).alias("dimension"),
                (F.coalesce(F.col(column), F.lit("unknown")) if column else F.lit("all")).alias("name"),
            )
            for dimension, column in _DIMENSIONS.items()
        )
    )
    needed = scored.select("risk_level", "predicted_label", "cancel_probability", F.inline(keys))
    return needed.groupBy(*STATE_KEYS).agg(*_sums())


def merge_states(before: DataFrame, batch: DataFrame) -> DataFrame:
    return (
        before.unionByName(batch)
        .groupBy(*STATE_KEYS)
        .agg(
            *(F.sum(name).alias(name) for name in ("processed_count", "high_risk_count", "predicted_cancellations")),
            F.sum("probability").cast(_EXACT).alias("probability"),
        )
    )


def metric_rows(state: DataFrame) -> DataFrame:
    """The long metric rows of one update: 13 fixed ones and one per country and channel.

    The three trend types carry the running totals; true calendar windows are `trend_sums`.
    """
    share = four_digits(ratio(F.col("predicted_cancellations"), F.col("processed_count")))
    text = lambda name: F.col(name).cast("string")
    average = four_digits(ratio(F.col("probability"), F.col("processed_count")))
    fixed = [
        ("summary", "processed_count", text("processed_count")),
        ("summary", "high_risk_count", text("high_risk_count")),
        ("summary", "average_cancel_probability", average),
        ("summary", "predicted_cancellations", text("predicted_cancellations")),
    ]
    for granularity in ("day", "week", "month"):
        fixed += [
            (f"trend_{granularity}", "inflow", text("processed_count")),
            (f"trend_{granularity}", "predicted_cancellations", text("predicted_cancellations")),
            (f"trend_{granularity}", "cancel_rate", share),
        ]

    def entry(kind: Column, name: Column, value: Column) -> Column:
        return F.struct(kind.alias("metric_type"), name.alias("metric_name"), value.alias("metric_value"))

    totals = F.array(*(entry(F.lit(kind), F.lit(name), value) for kind, name, value in fixed))
    keyed = F.array(entry(F.concat(F.col("dimension"), F.lit("_risk")), F.col("name"), share))
    at = [F.col("updated_at").alias(name) for name in ("window_start", "window_end", "updated_at")]
    return state.select(F.inline(F.when(F.col("dimension") == "all", totals).otherwise(keyed)), *at)
