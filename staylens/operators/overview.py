"""The cancellation overview: seven sections of aggregates over one filtered table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from staylens.functions.dates import period
from staylens.functions.numbers import half_even, rate, ratio
from staylens.functions.risk import RISK_PREDICATES


def _counts():
    return [F.count("*").alias("booking_count"), F.coalesce(F.sum("is_canceled"), F.lit(0)).alias("cancel_count")]


def _cancel_rate():
    return rate(F.col("cancel_count"), F.col("booking_count")).alias("cancel_rate")


def summary(df: DataFrame) -> DataFrame:
    """Bookings, cancellations, cancel rate and mean daily rate; zeros when there are no rows."""
    return df.agg(*_counts(), *_adr_sums()).select(
        "booking_count", "cancel_count", _cancel_rate(), _avg_adr().alias("avg_adr")
    )


def _adr_sums():
    return [F.sum("adr").alias("adr"), F.count("adr").alias("adr_rows")]


def _avg_adr():
    """Mean over the rows that have a rate."""
    return half_even(ratio(F.col("adr"), F.col("adr_rows")), 2)


def trend(df: DataFrame, granularity: str = "month") -> DataFrame:
    """Counts and cancel rate per day or month, in order; rows without a date belong to no period.

    Rows group by the date value; only the result is formatted as text.
    """
    return (
        df.where(F.col("arrival_date").isNotNull())
        .groupBy(_period_start(granularity).alias("start"))
        .agg(*_counts())
        .select(period(F.col("start"), granularity).alias("period"), "booking_count", "cancel_count", _cancel_rate())
        .orderBy("period")
    )


def _period_start(granularity: str):
    return F.trunc("arrival_date", "MM") if granularity == "month" else F.col("arrival_date")


def cancel_structure(df: DataFrame) -> DataFrame:
    return (
        df.where(F.col("is_canceled_label").isNotNull())
        .groupBy(F.col("is_canceled_label").alias("name"))
        .agg(F.count("*").alias("value"))
        .orderBy("name")
    )


def _tag_measures():
    """Row and cancel counts under each risk predicate. The predicates overlap, so no grouping can hold them."""
    measures = []
    for tag, predicate in RISK_PREDICATES.items():
        measures.append(F.count_if(predicate()).alias(f"n_{tag}"))
        measures.append(F.coalesce(F.sum(F.when(predicate(), F.col("is_canceled"))), F.lit(0)).alias(f"c_{tag}"))
    return measures


def _tag_rows():
    return F.inline(
        F.array(
            *(
                F.struct(
                    F.lit(tag).alias("name"),
                    F.col(f"n_{tag}").alias("booking_count"),
                    F.col(f"c_{tag}").alias("cancel_count"),
                )
                for tag in RISK_PREDICATES
            )
        )
    )


def _by_tag(df: DataFrame) -> DataFrame:
    """One row per risk tag from a single pass; none when the table is empty."""
    return df.agg(F.count("*").alias("n"), *_tag_measures()).where(F.col("n") > 0).select(_tag_rows())


def factor_rates(df: DataFrame) -> DataFrame:
    return _by_tag(df).select("name", F.col("name").alias("risk_tag"), _cancel_rate())


def risk_tag_counts(df: DataFrame) -> DataFrame:
    return _by_tag(df).select("name", F.col("booking_count").alias("value"))


def channel_ranking(df: DataFrame) -> DataFrame:
    """Count and cancel rate per market segment, largest first."""
    keys = ["market_segment", "market_segment_name"]
    return (
        df.dropna(subset=keys)
        .groupBy(*keys)
        .agg(*_counts())
        .select("market_segment", F.col("market_segment_name").alias("name"), "booking_count", _cancel_rate())
        .orderBy(F.desc("booking_count"), "market_segment", "name")
    )


def country_rates(df: DataFrame) -> DataFrame:
    keys = ["country_code", "country_name"]
    return (
        df.dropna(subset=keys)
        .groupBy(*keys)
        .agg(*_counts())
        .select(
            F.col("country_code").alias("code"),
            F.col("country_name").alias("name"),
            _cancel_rate().alias("value"),
            "booking_count",
        )
        .orderBy("code", "name")
    )


_CELL_KEYS = ["period", "is_canceled_label", "market_segment", "market_segment_name", "country_code", "country_name"]

# Section by the cell columns it keeps; grouping_id has a 1 bit for each column it drops.
_SECTIONS = {
    "summary": [],
    "trend": ["period"],
    "cancel_structure": ["is_canceled_label"],
    "channel_ranking": ["market_segment", "market_segment_name"],
    "country_map": ["country_code", "country_name"],
}


def _dropped_bits(kept: list[str]) -> int:
    return sum(1 << (len(_CELL_KEYS) - 1 - i) for i, name in enumerate(_CELL_KEYS) if name not in kept)


def sections(df: DataFrame) -> DataFrame:
    """All aggregate sections from one read of the table, in long form.

    The rows first combine into cells, one per combination of the section keys. That step does
    nearly all its work map side and is the only one that sees the rows; the sections are then
    grouping sets over the cells, so the rows are never multiplied by the number of sections.
    """
    cells = (
        df.withColumn("period", _period_start("month"))
        .groupBy(*_CELL_KEYS)
        .agg(*_counts(), *_adr_sums(), *_tag_measures())
    )
    measures = [name for name in cells.columns if name not in _CELL_KEYS]
    rolled = cells.groupingSets([[F.col(name) for name in kept] for kept in _SECTIONS.values()], *_CELL_KEYS).agg(
        *(F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in measures), F.grouping_id().alias("dropped")
    )
    section = F.coalesce(
        *(F.when(F.col("dropped") == _dropped_bits(kept), name) for name, kept in _SECTIONS.items())
    )
    month = period(F.col("period"), "month")
    named = rolled.withColumns(
        {
            "section": section,
            "code": F.coalesce(month, "market_segment", "country_code"),
            "name": F.coalesce(month, "is_canceled_label", "market_segment_name", "country_name"),
        }
    )
    whole = F.col("section") == "summary"
    none = F.lit(None).cast("string")

    def row(kind, code, name, bookings, canceled, average):
        return F.struct(
            kind.alias("section"), code.alias("code"), name.alias("name"), F.col(bookings).alias("booking_count"),
            F.col(canceled).alias("cancel_count"), average.alias("avg_adr"),
        )

    own = row(F.col("section"), F.col("code"), F.col("name"), "booking_count", "cancel_count", F.when(whole, _avg_adr()))
    unset = F.lit(None).cast("double")
    tags = [row(F.lit("risk_factor"), none, F.lit(tag), f"n_{tag}", f"c_{tag}", unset) for tag in RISK_PREDICATES]
    # The row over everything also carries the risk counts; they become rows of their own.
    rows = F.when(whole & (F.col("booking_count") > 0), F.array(own, *tags)).otherwise(F.array(own))
    return (
        named.where(whole | F.col("name").isNotNull())
        .select(F.inline(rows))
        .select(
            "section", "code", "name", "booking_count", "cancel_count", _cancel_rate(), "avg_adr"
        )
    )
