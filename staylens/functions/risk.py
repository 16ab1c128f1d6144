"""Risk bands, labels, tags and the predicates behind them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

LEAD_TIME_HIGH = 90

# The predicates that both the filters and the aggregates use, by tag.
RISK_PREDICATES = {
    "lead_time_high": lambda: F.col("lead_time") >= LEAD_TIME_HIGH,
    "no_special_requests": lambda: F.col("total_of_special_requests") == 0,
    "previous_cancellations": lambda: F.col("previous_cancellations") > 0,
}


def risk_band(probability: Column, high: float = 0.6, medium: float = 0.3, inclusive: bool = True) -> Column:
    """high, medium or low. Scoring counts the bounds in, the dashboard pill (0.7, 0.35) does not."""
    reaches = (lambda bound: probability >= bound) if inclusive else (lambda bound: probability > bound)
    return F.when(reaches(high), "high").when(reaches(medium), "medium").otherwise("low")


def risk_name(band: Column) -> Column:
    return F.when(band.isin("high", "medium", "low"), F.concat(band, F.lit("_risk"))).otherwise(band)


def predicted_label(probability: Column) -> Column:
    return (probability >= 0.5).cast("int")


def predicted_label_name(probability: Column) -> Column:
    return F.when(probability >= 0.5, "may_cancel").otherwise("likely_keep")


def reason_tags() -> Column:
    """Array of the tags that apply to a booking; a default tag when none does.

    Missing inputs count as 0, as an absent field does.
    """
    filled = lambda name: F.coalesce(F.col(name), F.lit(0))
    tags = F.array_compact(
        F.array(
            F.when(filled("lead_time") >= LEAD_TIME_HIGH, "lead_time_high"),
            F.when(filled("previous_cancellations") > 0, "previous_cancellations"),
            F.when(filled("total_of_special_requests") == 0, "no_special_requests"),
            F.when(F.col("deposit_type") == "Non Refund", "non_refund_deposit"),
        )
    )
    return F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("model_probability")))
