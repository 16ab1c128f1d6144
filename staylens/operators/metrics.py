"""Stored metrics in long form, and what is served from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from staylens import schemas as S
from staylens.functions.dates import timestamp_text
from staylens.functions.numbers import half_even
from staylens.functions.wire import alias_float, alias_int, first_present, metric_field, metric_number

GRANULARITIES = ("day", "week", "month")


def latest_rows(metrics: DataFrame, types: list[str] = S.METRIC_TYPES) -> DataFrame:
    """The rows of the latest window of each metric type.

    Joined back by broadcast: the aggregate has at most one row per requested type, and joining
    on so few keys by shuffle would put nearly all rows into a handful of tasks.
    """
    wanted = metrics.where(F.col("metric_type").isin(types))
    newest = wanted.groupBy("metric_type").agg(F.max("window_end").alias("window_end"))
    return wanted.join(F.broadcast(newest), ["metric_type", "window_end"]).select(
        "metric_type", "metric_name", "metric_value", "window_start", "window_end", "updated_at"
    )


def _named(name: str) -> Column:
    return F.max(F.when(F.col("metric_name") == name, metric_number(F.col("metric_value"))))


def wide(metrics: DataFrame, names: list[str] = S.SUMMARY_METRICS) -> DataFrame:
    """One record per window from its long rows; the names are given, so no extra pass finds them."""
    return metrics.groupBy("window_start", "window_end").agg(
        *(_named(name).alias(name) for name in names), F.max(F.coalesce("updated_at", "window_end")).alias("updated_at")
    )


def latest_summary(metrics: DataFrame) -> DataFrame:
    """The latest summary record, with the update time as text."""
    return wide(latest_rows(metrics, ["summary"])).select(
        *S.SUMMARY_METRICS, timestamp_text(F.col("updated_at")).alias("updated_at")
    )


def points(metrics: DataFrame, names: list[str] = S.TREND_METRICS) -> DataFrame:
    """One trend point per window label."""
    label = timestamp_text(F.coalesce("window_start", "window_end")).alias("label")
    return metrics.groupBy(label).agg(*(_named(name).alias(name) for name in names))


def risk_items(metrics: DataFrame) -> DataFrame:
    """Risk rows from metric rows: the value is a number or a JSON object, whose own name wins."""
    text = F.col("metric_value")
    number = lambda name: metric_field(text, name)
    return metrics.select(
        F.coalesce(number("name"), F.col("metric_name")).alias("name"),
        F.coalesce(metric_number(text), number("value").try_cast("double")).alias("value"),
        number("booking_count").try_cast("bigint").alias("booking_count"),
        number("predicted_cancellations").try_cast("bigint").alias("predicted_cancellations"),
    )


def snapshot_rows(snapshot: DataFrame, granularity: str = "day") -> DataFrame:
    """Trend points of one granularity from snapshot records; an unknown granularity means day.

    A record holds its points under the granularity's name, else under `points`, else `items`.
    """
    granularity = granularity if granularity in GRANULARITIES else "day"
    held = [F.col(name) for name in (granularity, "points", "items") if name in snapshot.columns]
    return snapshot.select(F.inline(F.coalesce(*held)))


def trend_rows(rows: DataFrame) -> DataFrame:
    """Trend rows of any writer in the served form: each field from the first alias that has a value."""
    label = first_present(rows, "label", "period", "business_time", "window_start")
    return rows.select(
        label.alias("label"),
        alias_int(rows, "inflow", "processed_count", "booking_count").alias("inflow"),
        alias_int(rows, "predicted_cancellations", "cancel_count", "high_risk_count").alias("predicted_cancellations"),
        alias_float(rows, "cancel_rate", "latest_cancel_rate").alias("cancel_rate"),
    )


# --- serving: fresh snapshot, else stored metrics, else waiting ----------------------------------


def first_available(candidates: list[DataFrame]) -> DataFrame:
    """All rows of the first candidate that has any.

    Each candidate asks whether an earlier one has rows; that is a scalar subquery that stops at
    the first row found.
    """
    kept = []
    for position, candidate in enumerate(candidates):
        for earlier in candidates[:position]:
            candidate = candidate.where(~earlier.exists())
        kept.append(candidate)
    return reduce(DataFrame.unionByName, kept)


def _summary_of(rows: DataFrame, status: str, source: str) -> DataFrame:
    own = F.col("status") if "status" in rows.columns else F.lit(None).cast("string")
    return rows.select(
        alias_int(rows, "realtime_processed_count", "processed_count").alias("processed_count"),
        alias_int(rows, "high_risk_count", "latest_high_risk_count").alias("high_risk_count"),
        alias_float(rows, "average_cancel_probability", "avg_cancel_probability").alias("average_cancel_probability"),
        first_present(rows, "updated_at", "latest_business_time").alias("updated_at"),
        F.when(own.isin("running", "waiting"), own).otherwise(status).alias("status"),
        F.lit(source).alias("source"),
    )


def serve_summary(snapshot: DataFrame, metrics: DataFrame) -> DataFrame:
    """The running summary from the snapshot, else from stored metrics, else zeros that wait."""
    fresh = _summary_of(snapshot, "running", "redis")
    stored = _summary_of(latest_summary(metrics), "mysql_fallback", "mysql")
    waiting = snapshot.sparkSession.range(1).select(
        F.lit(0).cast("bigint").alias("processed_count"),
        F.lit(0).cast("bigint").alias("high_risk_count"),
        F.lit(0.0).alias("average_cancel_probability"),
        F.lit(None).cast("string").alias("updated_at"),
        F.lit("waiting").alias("status"),
        F.lit("none").alias("source"),
    )
    return first_available([fresh, stored, waiting])


def serve_trend(snapshot: DataFrame, metrics: DataFrame, granularity: str = "day") -> DataFrame:
    """Trend points of a granularity: snapshot, else its stored type, else the plain stored type."""
    granularity = granularity if granularity in GRANULARITIES else "day"

    def tagged(rows, source):
        return trend_rows(rows).withColumns(
            {"granularity": F.lit(granularity), "status": F.lit("running"), "source": F.lit(source)}
        )

    fresh = tagged(snapshot_rows(snapshot, granularity), "redis")
    stored = [tagged(points(latest_rows(metrics, [kind])), "mysql") for kind in (f"trend_{granularity}", "trend")]
    return first_available([fresh, *stored])


def serve_risk(snapshot: DataFrame, metrics: DataFrame, metric_type: str) -> DataFrame:
    """Risk rows of one kind: snapshot items, else all stored names of the latest window."""
    fresh = snapshot.select("name", "value", "booking_count", "predicted_cancellations").withColumn("source", F.lit("redis"))
    stored = risk_items(latest_rows(metrics, [metric_type])).withColumn("source", F.lit("mysql"))
    return first_available([fresh, stored]).withColumn("status", F.lit("running"))


def serve_recent(snapshot: DataFrame, stored: DataFrame, limit: int = 10) -> DataFrame:
    """The latest predictions: snapshot items, else the stored ones; no rows while the stream has none."""
    columns = ["booking_id", "hotel_name", "country_name", "cancel_probability", "risk_level_name", "business_time"]
    sides = [snapshot.select(*columns), stored.select(*columns)]
    rows = first_available([side.withColumn("cancel_probability", F.col("cancel_probability").cast("double")) for side in sides])
    return rows.orderBy(F.desc("business_time"), F.desc("booking_id")).limit(limit)


def top_risk(rows: DataFrame, limit: int = 5) -> DataFrame:
    """The highest rates per dimension with a total order for ties.

    Input has one row per key, already aggregated. Each task keeps the first rows of a dimension
    before the shuffle (Spark's group limit on a row number), so no task holds a dimension.
    """
    order = Window.partitionBy("dimension").orderBy(F.desc("rate"), F.desc("booking_count"), "name")
    return (
        rows.withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= limit)
        .select("dimension", "name", half_even(F.col("rate")).alias("value"), "booking_count", "predicted_cancellations")
    )


def dashboard_totals(offline: DataFrame, summary: DataFrame) -> DataFrame:
    """Offline base plus processed events. `offline` has one row with `offline_rows`; 0 means the fixed base."""
    base = F.coalesce(F.nullif(offline.select("offline_rows").scalar(), F.lit(0)), F.lit(S.DEFAULT_OFFLINE_ROWS))
    return summary.select(
        base.cast("bigint").alias("offline_base_rows"),
        F.col("processed_count").alias("realtime_processed_count"),
        (base + F.col("processed_count")).cast("bigint").alias("total_bookings"),
        "high_risk_count",
        "average_cancel_probability",
        "updated_at",
        "status",
    )


def listed_total(totals: DataFrame, dashboard: DataFrame, filtered: bool) -> DataFrame:
    """The total a list page shows: its own under a filter, else the dashboard's."""
    return totals.select("total") if filtered else dashboard.select(F.col("total_bookings").alias("total"))


def output_checks(predictions: DataFrame, metrics: DataFrame, summary: DataFrame) -> DataFrame:
    """One row: how much the stream job wrote to each output, and whether that passes."""
    stream = predictions.where(F.col("source") == S.STREAM_SOURCE).agg(F.count("*").alias("prediction_results"))
    counted = stream.select(
        "prediction_results",
        metrics.agg(F.count("*")).scalar().alias("realtime_metrics"),
        F.coalesce(summary.agg(F.max("processed_count")).scalar(), F.lit(0)).cast("bigint").alias("processed_count"),
    )
    return counted.withColumns(
        {
            "tables_ok": (F.col("prediction_results") > 0) & (F.col("realtime_metrics") > 0),
            "snapshots_ok": F.col("processed_count") > 0,
        }
    )
