"""Date parsing and period bounds."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

from staylens.functions.labels import literal_list
from staylens.functions.numbers import int_or_null

# English month names in calendar order.
MONTHS = (
    "January February March April May June July August September October November December"
).split()


def month_number(name: str) -> Column:
    """1 to 12, or null for a name that is not an English month."""
    return F.expr(f"cast(nullif(array_position(array({literal_list(MONTHS)}), `{name}`), 0) AS int)")


def assemble_date(year: str, month_name: str, day: str, strict: bool = False) -> Column:
    """Date from its three text columns. An impossible date is null, or an error when strict."""
    y, m, d = int_or_null(year), month_number(month_name), int_or_null(day)
    if strict:
        return F.make_date(y, m, d)
    month_start = F.when(y.between(1, 9999), F.make_date(y, m, F.lit(1)))
    return F.when(d.between(1, F.day(F.last_day(month_start))), F.date_add(month_start, d - 1))


def iso_date(text: Column, strict: bool = False) -> Column:
    return text.cast("date") if strict else text.try_cast("date")


def month_bounds(month: str) -> tuple[dt.date, dt.date]:
    """First day of a `yyyy-MM` month and of the month after it."""
    first = dt.datetime.strptime(month, "%Y-%m").date()
    return first, (first + dt.timedelta(days=32)).replace(day=1)


def period(date: Column, granularity: str) -> Column:
    return F.date_format(date, "yyyy-MM-dd" if granularity == "day" else "yyyy-MM")


def timestamp_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
