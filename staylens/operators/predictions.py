"""Prediction results: joins with bookings, daily batches, integrity, classifier quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from staylens import schemas as S
from staylens.functions.dates import timestamp_text
from staylens.functions.numbers import half_even, ratio
from staylens.functions.risk import risk_name

_RESULT = ["booking_id", "hotel_name", "country_name", "cancel_probability", "predicted_label", "risk_level"]


def _from_stream(predictions: DataFrame) -> DataFrame:
    return predictions.where(F.col("source") == S.STREAM_SOURCE)


def with_booking(predictions: DataFrame, bookings: DataFrame) -> DataFrame:
    """Stream predictions with hotel and country of their booking; a prediction without one keeps nulls.

    Deleted bookings take part. The join is on a unique key of `bookings`, so rows never multiply.
    """
    names = bookings.select("booking_id", "hotel_name", "country_name")
    return (
        _from_stream(predictions)
        .join(names, "booking_id", "left")
        .select(
            "prediction_id",
            *_RESULT,
            timestamp_text(F.col("predicted_at")).alias("business_time"),
            risk_name(F.col("risk_level")).alias("risk_level_name"),
        )
    )


def recent(predictions: DataFrame, bookings: DataFrame, limit: int = 10) -> DataFrame:
    """The latest stream predictions with their bookings.

    The limit applies before the join, which is on a unique key; the `limit` ids then filter the
    bookings scan, without a hint: Catalyst knows the size of a limit and broadcasts a small one.
    """
    newest = (
        _from_stream(predictions).orderBy(F.desc("predicted_at"), F.desc("prediction_id")).limit(limit)
    )
    wanted = bookings.join(newest.select("booking_id"), "booking_id", "left_semi")
    return with_booking(newest, wanted).orderBy(F.desc("business_time"), F.desc("prediction_id"))


def daily_batches(predictions: DataFrame) -> DataFrame:
    """One batch per day and source of the stream predictions."""
    grouped = (
        _from_stream(predictions)
        .groupBy(F.to_date("predicted_at").alias("business_date"), "source")
        .agg(
            F.count("*").alias("total_count"),
            F.count_if(F.col("predicted_label") == 1).alias("predicted_cancel_count"),
            F.count_if(F.col("risk_level") == "high").alias("high_risk_count"),
            F.sum("cancel_probability").alias("probability"),
            F.min("predicted_at").alias("first_at"),
            F.max("predicted_at").alias("last_at"),
        )
    )
    clock = lambda name: F.date_format(name, "HH:mm:ss")
    return grouped.select(
        F.concat_ws("-", "source", F.date_format("business_date", "yyyy-MM-dd")).alias("batch_id"),
        F.date_format("business_date", "yyyy-MM-dd").alias("business_date"),
        F.concat_ws("-", clock("first_at"), clock("last_at")).alias("time_window"),
        "total_count",
        "predicted_cancel_count",
        "high_risk_count",
        half_even(ratio(F.col("probability"), F.col("total_count"))).alias("avg_cancel_probability"),
        "source",
        timestamp_text(F.col("last_at")).alias("created_at"),
    )


def batch_page(predictions: DataFrame, page: int = 1, size: int = 10) -> DataFrame:
    """Batches newest first. There is one per day, so even a late page is a small top-k."""
    size = max(min(int(size or 10), 100), 1)
    offset = (max(int(page or 1), 1) - 1) * size
    return daily_batches(predictions).orderBy(F.desc("created_at"), F.desc("batch_id")).offset(offset).limit(size)


def batch_total(predictions: DataFrame) -> DataFrame:
    days = _from_stream(predictions).select(F.to_date("predicted_at").alias("day"), "source").distinct()
    return days.agg(F.count("*").alias("total"))


def batches_or_summary(predictions: DataFrame, summary: DataFrame) -> DataFrame:
    """The daily batches, or one batch made from the latest summary metrics when there are none.

    `summary` is the one-row output of `metrics.latest_summary`.
    """
    batches = daily_batches(predictions)
    fallback = summary.where(F.col("processed_count") > 0).select(
        F.lit("storm-metrics-latest").alias("batch_id"),
        F.substring("updated_at", 1, 10).alias("business_date"),
        F.lit("latest").alias("time_window"),
        F.col("processed_count").cast("bigint").alias("total_count"),
        F.coalesce(F.col("predicted_cancellations").cast("bigint"), F.lit(0)).alias("predicted_cancel_count"),
        F.coalesce(F.col("high_risk_count").cast("bigint"), F.lit(0)).alias("high_risk_count"),
        half_even(F.coalesce("average_cancel_probability", F.lit(0.0))).alias("avg_cancel_probability"),
        F.lit("storm_metrics").alias("source"),
        F.col("updated_at").alias("created_at"),
    )
    return batches.unionByName(fallback.where(~_from_stream(predictions).exists()))


def orphans(predictions: DataFrame, bookings: DataFrame) -> DataFrame:
    """Predictions whose booking does not exist."""
    return predictions.join(bookings.select("booking_id"), "booking_id", "left_anti").select("prediction_id", "booking_id")


# --- classifier quality ----------------------------------------------------------------------


def confusion_matrix(scored: DataFrame, *group: str, actual: str = "label", predicted: str = "predicted_label") -> DataFrame:
    """The four counts, per group if one is given. Rows lacking either label count nowhere."""
    cell = lambda a, p: F.count_if((F.col(actual) == a) & (F.col(predicted) == p))
    return scored.groupBy(*group).agg(
        cell(0, 0).alias("true_negative"),
        cell(0, 1).alias("false_positive"),
        cell(1, 0).alias("false_negative"),
        cell(1, 1).alias("true_positive"),
    )


def quality(matrix: DataFrame, *group: str) -> DataFrame:
    """Accuracy, precision, recall and F1 of confusion matrices; 0 where undefined."""
    tn, fp, fn, tp = (F.col(c) for c in ("true_negative", "false_positive", "false_negative", "true_positive"))
    measures: dict[str, Column] = {
        "accuracy": ratio(tp + tn, tn + fp + fn + tp),
        "precision_score": ratio(tp, tp + fp),
        "recall_score": ratio(tp, tp + fn),
        "f1_score": ratio(2 * tp, 2 * tp + fp + fn),
    }
    return matrix.select(*group, *(half_even(value).alias(name) for name, value in measures.items()))


def best_model(qualities: DataFrame, name: str = "model_name") -> DataFrame:
    """The model with the highest F1, then accuracy, then name."""
    rank = F.struct("f1_score", "accuracy", name)
    return qualities.agg(
        F.max_by(name, rank).alias("selected_model"), F.max("f1_score").alias("f1_score")
    ).where(F.col("selected_model").isNotNull())


def comparison_rows(documents: DataFrame, document: str = "document") -> DataFrame:
    """Model comparison documents, JSON maps of model name to metrics, as rows; an absent metric is 0."""
    parsed = F.from_json(F.col(document), "map<string,map<string,double>>")
    value = lambda name: F.coalesce(F.try_element_at(F.col("metrics"), F.lit(name)), F.lit(0.0)).alias(name)
    names = ["accuracy", "precision_score", "recall_score", "f1_score"]
    return documents.select(F.explode(parsed).alias("model_name", "metrics")).select("model_name", *(value(n) for n in names))
