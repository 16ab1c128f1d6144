"""Lenient numeric coercion, rates and the two rounding rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MONEY = "decimal(10,2)"

# Wide enough for any int and for more fraction digits than a double holds. Unlike the double
# parser, the decimal parser takes neither `12d` nor `Infinity` for a number.
_ANY_NUMBER = "decimal(38,18)"

# The coercions take column names: as one SQL expression they cost one call into the JVM each.


def _int(name: str) -> str:
    """Number text truncated to an int, else null. Plain digits take the short way."""
    return f"coalesce(try_cast(`{name}` AS int), try_cast(try_cast(`{name}` AS {_ANY_NUMBER}) AS int))"


def int_or_null(name: str) -> Column:
    return F.expr(_int(name))


def lenient_int(name: str) -> Column:
    """Number text truncated to an int; anything else counts as 0. Never raises under ANSI."""
    return F.expr(f"coalesce({_int(name)}, 0)")


def lenient_money(name: str) -> Column:
    """Number text as a two-digit decimal; anything else counts as 0."""
    return F.expr(f"coalesce(try_cast(`{name}` AS {MONEY}), cast(0 AS {MONEY}))")


def half_even(value: Column, digits: int = 4) -> Column:
    """Rounding of the batch reports: half to even on the exact binary value, as Python rounds.

    `bround` works on the shortest decimal text of the double, so it sees a tie in 17.04255,
    whose binary value lies just below. Here the value is split into two parts that multiply by
    the scale without error (`digits` at most 4), which shows the side of the tie exactly.
    """
    x, scale = value.cast("double"), float(10**digits)
    widened = x * 134217729.0
    high = widened - (widened - x)
    below = F.floor(x * scale).cast("double")
    past_half = (high * scale - (below + 0.5)) + (x - high) * scale
    up = (past_half > 0) | ((past_half == 0) & (F.pmod(below, F.lit(2.0)) == 1))
    return F.when(F.abs(x) < 1e11, (below + up.cast("double")) / scale).otherwise(F.bround(x, digits))


def half_up(value: Column, digits: int = 4) -> Column:
    """Rounding of the running stream metrics: the scaled value plus a half, floored."""
    scale = float(10**digits)
    return F.floor(value.cast("double") * scale + 0.5).cast("double") / scale


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double, 0 when the whole is 0 or missing."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def rate(part: Column, whole: Column, digits: int = 4) -> Column:
    return half_even(ratio(part, whole), digits)


def ceil_div(total: Column, size: int) -> Column:
    """Integer ceiling without going through doubles."""
    return F.call_function("div", total + F.lit(size - 1), F.lit(size)).cast("bigint")


def four_digits(value: Column) -> Column:
    """Text with exactly four decimals, half up on the decimal text of the double."""
    return F.format_string("%.4f", F.round(value.cast("double"), 4))
