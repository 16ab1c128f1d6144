"""The tables behind the charts: one row per (x, series, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from staylens import schemas as S
from staylens.functions.labels import label_or_code
from staylens.functions.numbers import half_even

# Series and axis names.
OVERVIEW_SERIES = {"booking_count": "订单数", "cancel_count": "已取消订单", "cancel_rate": "取消率"}
REALTIME_SERIES = {"inflow": "预订流入", "predicted_cancellations": "预测取消", "cancel_rate": "取消率"}
QUALITY_SERIES = {"accuracy": "准确率", "precision_score": "精确率", "recall_score": "召回率", "f1_score": "F1 值"}
MATRIX_CELLS = {"true_negative": (0, 0), "false_positive": (1, 0), "false_negative": (0, 1), "true_positive": (1, 1)}


def long_series(df: DataFrame, x: str, series: dict[str, str]) -> DataFrame:
    """Wide rows as (x, series, value), the values as doubles."""
    doubles = df.select(F.col(x).alias("x"), *(F.col(name).cast("double").alias(label) for name, label in series.items()))
    return doubles.unpivot(["x"], list(series.values()), "series", "value")


def named_values(df: DataFrame, name: str, *values: str) -> DataFrame:
    """One series: the name and the first value column the frame has, 0 when it is missing."""
    present = [F.col(v) for v in values if v in df.columns]
    value = F.coalesce(*present, F.lit(0)) if present else F.lit(0)
    return df.select(F.col(name).alias("name"), half_even(value).alias("value"))


def country_series(df: DataFrame) -> DataFrame:
    """Map series: English country names by code, else the row's own name; rows without either are left out."""
    name = label_or_code("code", S.WORLD_MAP_NAMES, "name")
    return named_values(df.withColumn("map_name", name).where(F.coalesce("map_name", F.lit("")) != ""), "map_name", "cancel_rate", "value")


def quality_series(qualities: DataFrame, *ids: str) -> DataFrame:
    renamed = qualities.select(*ids, *(F.col(name).alias(label) for name, label in QUALITY_SERIES.items()))
    return renamed.unpivot(list(ids), list(QUALITY_SERIES.values()), "name", "value")


def matrix_series(matrix: DataFrame, *ids: str) -> DataFrame:
    """Heat map cells with their positions, and the largest count for the colour scale."""
    cells = [
        F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(name).alias("count"))
        for name, (x, y) in MATRIX_CELLS.items()
    ]
    return matrix.withColumn("scale_max", F.greatest(*MATRIX_CELLS)).select(*ids, "scale_max", F.inline(F.array(*cells)))
