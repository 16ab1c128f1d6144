"""Derive the reservation tables from the test tables (see FIXTURES.md, section 5).

Only the registered queries and the tests use this module; the operators take any DataFrame
of the right schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from staylens import schemas as S
from staylens.functions import risk
from staylens.functions.labels import null_tokens
from staylens.functions.numbers import four_digits, ratio
from staylens.operators.cleaning import clean_bookings

CUTOFF, START = "2000-04-12", "2000-04-13"

EVENTS_SCHEMA = S.struct(
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)

_RAW_COLUMNS = {
    "hotel": "case when k%3=0 then 'Resort Hotel' when k%101=1 then 'Boutique Hotel' else 'City Hotel' end",
    "is_canceled": "case when k%97=0 then 'NULL' when o_orderstatus='F' then '1' else '0' end",
    "lead_time": "case when k%53=0 then 'abc' else cast((k*37+o_custkey)%300 as string) end",
    "arrival_date_year": "year(o_orderdate)",
    "arrival_date_month": "date_format(o_orderdate,'MMMM')",
    "arrival_date_day_of_month": "day(o_orderdate)",
    "stays_in_weekend_nights": "nl%3",
    "stays_in_week_nights": "nl%6",
    "adults": "1+k%3",
    "children": "case when k%29=0 then 'NA' else cast(k%2 as string) end",
    "babies": "case when k%11=0 then 1 else 0 end",
    "meal": "case k%6 when 0 then 'BB' when 1 then 'HB' when 2 then 'FB' when 3 then 'SC' when 4 then 'Undefined' end",
    "country": """case when k%41=0 then 'NULL' else case n_nationkey when 0 then 'PRT' when 1 then 'GBR'
        when 2 then 'FRA' when 3 then 'ESP' when 4 then 'DEU' when 5 then 'ITA' when 6 then 'IRL' when 7 then 'BRA'
        when 8 then 'USA' when 9 then 'CN' when 10 then 'CHN' else n_name end end""",
    "market_segment": """case c_mktsegment when 'AUTOMOBILE' then 'Online TA' when 'BUILDING' then 'Direct'
        when 'FURNITURE' then 'Corporate' when 'HOUSEHOLD' then 'Groups' else 'Offline TA/TO' end""",
    "distribution_channel": "case k%4 when 0 then 'TA/TO' when 1 then 'Direct' when 2 then 'Corporate' end",
    "is_repeated_guest": "case when k%503=5 then 2 when k%7=0 then 1 else 0 end",
    "previous_cancellations": "case when k%13=0 then 1+k%3 else 0 end",
    "previous_bookings_not_canceled": "o_custkey%5",
    "reserved_room_type": "case k%4 when 0 then 'A' when 1 then 'B' when 2 then 'C' else 'D' end",
    "assigned_room_type": """case when k%59=0 then null when k%5=0 then 'E' else
        case k%4 when 0 then 'A' when 1 then 'B' when 2 then 'C' else 'D' end end""",
    "booking_changes": "k%4",
    "deposit_type": """case o_orderpriority when '1-URGENT' then 'Non Refund' when '2-HIGH' then 'Refundable'
        when '5-LOW' then null else 'No Deposit' end""",
    "days_in_waiting_list": "k%10",
    "customer_type": """case o_custkey%5 when 0 then 'Transient' when 1 then 'Transient-Party' when 2 then 'Contract'
        when 3 then 'Group' end""",
    "adr": "case when k%61=0 then null else cast(cast(o_totalprice as decimal(10,2)) as string) end",
    "required_car_parking_spaces": "case when k%8=0 then 1 else 0 end",
    "total_of_special_requests": "k%6",
    "reservation_status": "case o_orderstatus when 'F' then 'Canceled' when 'O' then 'Check-Out' else 'No-Show' end",
    "reservation_status_date": "cast(o_orderdate as date)",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw row per order, all text, with the source position `src_pos`.

    The line counts are aggregated before the join, map side first, so an order with very many
    lines moves as one row. Catalyst drops the whole line branch when no nights are read.
    """
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = (
        table(spark, sf_dir, "orders")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .withColumns({"k": F.col("o_orderkey"), "nl": F.coalesce("n_lines", F.lit(0))})
    )
    columns = [f"cast({sql} as string) as {name}" for name, sql in _RAW_COLUMNS.items()]
    return joined.selectExpr("k as src_pos", *columns)


def raw_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw rows as the CSV reader returns them: missing-value tokens are null."""
    return raw_bookings(spark, sf_dir).select("src_pos", *(null_tokens(name, S.MISSING_TOKENS) for name in S.RAW_COLUMNS))


def bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned table; ids follow the source position, one row in nineteen is soft-deleted."""
    cleaned = clean_bookings(raw_with_nulls(spark, sf_dir), booking_id=F.col("src_pos") + 1)
    return cleaned.withColumn("is_deleted", F.when((F.col("booking_id") - 1) % 19 == 0, 1).otherwise(0))


def scored_events(events: DataFrame) -> DataFrame:
    """Prediction rows from the events table, batch or stream."""
    probability = F.col("cancel_probability")
    return (
        events.withColumn(
            "cancel_probability",
            (F.get_json_object("props", "$.k").cast("int") / F.lit(100.0)).cast("decimal(6,4)"),
        )
        .select(
            F.col("event_id").alias("prediction_id"),
            (F.col("event_id") * 2 + 1).alias("booking_id"),
            F.lit("random_forest_v1").alias("model_version"),
            "cancel_probability",
            risk.predicted_label(probability).alias("predicted_label"),
            risk.risk_band(probability).alias("risk_level"),
            F.when(F.col("event_type") == "signup", "api").otherwise(S.STREAM_SOURCE).alias("source"),
            F.col("ts").cast("timestamp").alias("predicted_at"),
        )
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_events(table(spark, sf_dir, "events"))


def stored_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly metrics in long form, as the stream job stores them."""
    hour = F.date_trunc("hour", "predicted_at")
    rows = predictions(spark, sf_dir).where(F.col("source") == S.STREAM_SOURCE).withColumn("window_start", hour)
    names = bookings(spark, sf_dir).select("booking_id", "country_name")
    by_country = (
        rows.join(names, "booking_id", "left")
        .groupBy("window_start", F.coalesce("country_name", F.lit("unknown")).alias("metric_name"))
        .agg(F.count("*").alias("n"), F.sum("predicted_label").alias("c"))
        .select("window_start", F.lit("country_risk").alias("metric_type"), "metric_name",
                four_digits(ratio(F.col("c"), F.col("n"))).alias("metric_value"))
    )
    by_hour = rows.groupBy("window_start").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("risk_level") == "high").alias("h"),
        F.sum("predicted_label").alias("c"),
        F.sum("cancel_probability").alias("p"),
    )
    values = {
        ("summary", "processed_count"): F.col("n").cast("string"),
        ("summary", "high_risk_count"): F.col("h").cast("string"),
        ("summary", "average_cancel_probability"): four_digits(ratio(F.col("p"), F.col("n"))),
        ("summary", "predicted_cancellations"): F.col("c").cast("string"),
        ("trend_day", "inflow"): F.col("n").cast("string"),
        ("trend_day", "predicted_cancellations"): F.col("c").cast("string"),
        ("trend_day", "cancel_rate"): four_digits(ratio(F.col("c"), F.col("n"))),
    }
    entries = [
        F.struct(F.lit(kind).alias("metric_type"), F.lit(name).alias("metric_name"), value.alias("metric_value"))
        for (kind, name), value in values.items()
    ]
    fixed = by_hour.select("window_start", F.inline(F.array(*entries)))
    end = F.col("window_start") + F.expr("interval 1 hour")
    return fixed.unionByName(by_country).select(
        "metric_type", "metric_name", "metric_value", "window_start", end.alias("window_end"), end.alias("updated_at")
    )
