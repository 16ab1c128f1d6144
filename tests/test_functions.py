"""Rounding, coercion, dates and risk expressions on literal values."""

import datetime as dt
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from staylens.functions import dates, labels, numbers, risk, wire


def column(spark, values, kind):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i")


def results(df, expression):
    return [row[0] for row in df.select(expression.alias("r"), "i").orderBy("i").select("r").collect()]


def test_half_even_equals_python_round(spark):
    chooser = random.Random(7)
    ties = [n / 32 for n in range(-40, 40)] + [(2 * n + 1) / 20000 for n in range(0, 4000, 7)]
    quotients = [chooser.randint(0, 5000) / chooser.randint(1, 5000) for _ in range(2000)]
    money = [chooser.randint(-10**9, 10**9) / 100000 for _ in range(500)]
    values = ties + quotients + money + [0.0, 17.04255, 0.02805, 2.675, 123456789.00005]
    df = column(spark, values, "double")
    assert results(df, numbers.half_even(F.col("v"))) == [round(v, 4) for v in values]
    assert results(df, numbers.half_even(F.col("v"), 2)) == [round(v, 2) for v in values]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(min_value=-1e9, max_value=1e9, allow_nan=False), min_size=1, max_size=200))
def test_half_even_equals_python_round_on_any_double(spark, values):
    df = column(spark, values, "double")
    assert results(df, numbers.half_even(F.col("v"))) == [round(v, 4) for v in values]


def test_half_up_on_a_binary_tie(spark):
    df = column(spark, [1 / 32, 3 / 32, 0.0, 0.5], "double")
    assert results(df, numbers.half_up(F.col("v"))) == [0.0313, 0.0938, 0.0, 0.5]
    assert results(df, numbers.half_even(F.col("v"))) == [0.0312, 0.0938, 0.0, 0.5]
    assert results(df, numbers.four_digits(F.col("v"))) == ["0.0313", "0.0938", "0.0000", "0.5000"]


def test_lenient_int(spark):
    texts = ["7", " 8 ", "3.9", "-2.7", "1e3", "abc", None, "", "NaN", "Infinity", "12d", "99999999999", "2.9999999"]
    expected = [7, 8, 3, -2, 1000, 0, 0, 0, 0, 0, 0, 0, 2]
    assert results(column(spark, texts, "string"), numbers.lenient_int("v")) == expected


def test_lenient_money(spark):
    texts = ["98.126", None, "free", "12f", "-6.38"]
    got = results(column(spark, texts, "string"), numbers.lenient_money("v"))
    assert [float(v) for v in got] == [98.13, 0.0, 0.0, 0.0, -6.38]


@pytest.mark.parametrize("size, total, pages", [(20, 0, 0), (20, 1, 1), (20, 20, 1), (20, 21, 2), (7, 50, 8)])
def test_ceil_div(spark, size, total, pages):
    assert spark.range(1).select(numbers.ceil_div(F.lit(total).cast("bigint"), size)).first()[0] == pages


def test_assembled_dates(spark):
    rows = [("2016", "February", "29"), ("2017", "February", "29"), ("2017", "Feb", "1"), ("2017.0", "July", "4"),
            (None, "July", "4"), ("2017", "December", "31"), ("2017", "April", "0"), ("99999", "May", "1")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, y string, m string, d string")
    got = results(df, dates.assemble_date("y", "m", "d"))
    assert got == [dt.date(2016, 2, 29), None, None, dt.date(2017, 7, 4), None, dt.date(2017, 12, 31), None, None]


def test_strict_date_fails(spark):
    df = spark.createDataFrame([("2017", "February", "30")], "y string, m string, d string")
    with pytest.raises(Exception, match="DATE|date"):
        df.select(dates.assemble_date("y", "m", "d", strict=True)).collect()


def test_month_bounds():
    assert dates.month_bounds("2016-12") == (dt.date(2016, 12, 1), dt.date(2017, 1, 1))
    assert dates.month_bounds("2017-02") == (dt.date(2017, 2, 1), dt.date(2017, 3, 1))


def test_bands_and_labels_at_their_bounds(spark):
    df = column(spark, [0.6, 0.5999, 0.3, 0.2999, 0.5, 0.7, 0.71, 0.35, 0.36], "double")
    assert results(df, risk.risk_band(F.col("v"))) == [
        "high", "medium", "medium", "low", "medium", "high", "high", "medium", "medium"]
    pill = risk.risk_band(F.col("v"), high=0.7, medium=0.35, inclusive=False)
    assert results(df, pill) == ["medium", "medium", "low", "low", "medium", "medium", "high", "low", "medium"]
    assert results(df, risk.predicted_label(F.col("v"))) == [1, 1, 0, 0, 1, 1, 1, 0, 0]


def test_reason_tags(spark):
    rows = [(0, 90, 0, 0, "Non Refund"), (1, 89, 1, 2, "No Deposit"), (2, 10, 0, 1, "Refundable"), (3, None, None, None, None)]
    df = spark.createDataFrame(
        rows, "i int, lead_time int, previous_cancellations int, total_of_special_requests int, deposit_type string")
    assert results(df, risk.reason_tags()) == [
        ["lead_time_high", "no_special_requests", "non_refund_deposit"],
        ["previous_cancellations"],
        ["model_probability"],
        ["no_special_requests"],
    ]


def test_labels_keep_or_drop_unknown_codes(spark):
    df = column(spark, ["a", "z", None], "string")
    assert results(df, labels.label_or_code("v", {"a": "it's A"})) == ["it's A", "z", None]
    flags = column(spark, [0, 1, 2, None], "int")
    assert results(flags, labels.label_or_null("v", {0: "no", 1: "yes"})) == ["no", "yes", None, None]


def test_wire_form(spark):
    df = spark.sql("""SELECT date'2017-01-02' AS d, timestamp'2017-01-02 03:04:05' AS t, cast(1.005 AS decimal(6,4)) AS n,
        cast('NaN' AS double) AS nan, array('a','b') AS tags, 5 AS i, 'x' AS s""")
    row = wire.normalize_record(df).first()
    assert tuple(row) == ("2017-01-02", "2017-01-02 03:04:05", 1.005, None, "a,b", 5, "x")


def test_metric_text(spark):
    df = column(spark, ["0.42", '{"name": "PRT", "value": 0.5}', "waiting"], "string")
    assert results(df, wire.metric_number(F.col("v"))) == [0.42, None, None]
    assert results(df, wire.metric_field(F.col("v"), "value")) == [None, "0.5", None]


def test_aliases_take_the_first_value(spark):
    df = spark.createDataFrame([(0, None, 7), (1, "3.9", 5), (2, None, None)], "i int, inflow string, booking_count int")
    assert results(df, wire.alias_int(df, "inflow", "processed_count", "booking_count")) == [7, 3, 0]
    assert results(df, wire.alias_float(df, "cancel_rate")) == [0.0, 0.0, 0.0]
