"""Filters, lookups, pages and option lists over the bookings table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from staylens import schemas as S
from staylens.functions.dates import month_bounds
from staylens.functions.numbers import ceil_div, half_even, ratio
from staylens.functions.risk import RISK_PREDICATES
from staylens.session import stored

MAX_PAGE_SIZE = 100

# Up to this many leading rows a page is a top-k; beyond it the page's id ranges are looked up.
TOP_K_ROWS = 100_000
# Rows of an id range.
RANGE_ROWS = 10_000

OPTION_COLUMNS = {
    "hotels": ("hotel", "hotel_name"),
    "countries": ("country_code", "country_name"),
    "market_segments": ("market_segment", "market_segment_name"),
    "customer_types": ("customer_type", "customer_type_name"),
    "cancel_statuses": ("is_canceled", "is_canceled_label"),
}


def active_bookings(df: DataFrame) -> DataFrame:
    """Rows not soft-deleted. Plain comparisons, so that the scan evaluates them."""
    return df.where((F.col("is_deleted") == 0) | F.col("is_deleted").isNull())


def _all(df: DataFrame, conditions: list[Column]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, conditions)) if conditions else df


def filter_bookings(
    df: DataFrame,
    hotel: str | None = None,
    country_code: str | None = None,
    market_segment: str | None = None,
    customer_type: str | None = None,
    is_canceled: int | str | None = None,
    keyword: str | None = None,
) -> DataFrame:
    """Active rows under the given conditions; an empty value sets no condition.

    The keyword is a literal, case-insensitive part of the id, the country name or its code.
    """
    equal = {
        "hotel": hotel,
        "country_code": country_code,
        "market_segment": market_segment,
        "customer_type": customer_type,
    }
    conditions = [F.col(name) == value for name, value in equal.items() if value]
    if is_canceled not in (None, ""):
        conditions.append(F.col("is_canceled") == int(is_canceled))
    if keyword:
        needle = str(keyword).lower()
        searched = [F.col("booking_id").cast("string"), F.lower("country_name"), F.lower("country_code")]
        conditions.append(reduce(lambda a, b: a | b, (F.coalesce(c.contains(needle), F.lit(False)) for c in searched)))
    return _all(active_bookings(df), conditions)


def in_month(month: str) -> Column:
    """Arrival in a `yyyy-MM` month, as a date range that the scan can evaluate."""
    first, following = month_bounds(month)
    return (F.col("arrival_date") >= F.lit(first)) & (F.col("arrival_date") < F.lit(following))


def filter_overview(
    df: DataFrame,
    country_code: str | None = None,
    month: str | None = None,
    market_segment: str | None = None,
    customer_type: str | None = None,
    risk_tag: str | None = None,
) -> DataFrame:
    """Active rows under the overview's five filters; an unknown risk tag sets no condition."""
    equal = {"country_code": country_code, "market_segment": market_segment, "customer_type": customer_type}
    conditions = [F.col(name) == value for name, value in equal.items() if value]
    if month:
        conditions.append(in_month(month))
        if "arrival_month" in df.columns:  # folders of the stored table
            conditions.append(F.col("arrival_month") == month)
    if risk_tag in RISK_PREDICATES:
        conditions.append(RISK_PREDICATES[risk_tag]())
    return _all(active_bookings(df), conditions)


def lookup_by_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Active bookings whose id occurs in `ids`. No hint: Catalyst broadcasts `ids` only when its size is known to be small."""
    return active_bookings(df).join(ids.select("booking_id"), "booking_id", "left_semi")


def _page_bounds(page, size, default_size: int) -> tuple[int, int]:
    size = max(min(int(size or default_size), MAX_PAGE_SIZE), 1)
    return (max(int(page or 1), 1) - 1) * size, size


def id_ranges(df: DataFrame, rows_per_range: int = RANGE_ROWS) -> DataFrame:
    """(first_id, last_id, rows, start) of consecutive id ranges of a table, `start` rows lying before each.

    Made once per version of a table or of a filtered view of it, and stored beside it: `slice_by_ranges` then
    needs no more than the ranges of a page. All rows of an id are in one range. It takes a range sort of the
    ids alone; the window that adds the counts up has a row per range.
    """
    parts = df.count() // rows_per_range + 1
    ids = df.select("booking_id").repartitionByRange(parts, "booking_id").withColumn("_part", F.spark_partition_id())
    ranges = ids.groupBy("_part").agg(
        F.min("booking_id").alias("first_id"), F.max("booking_id").alias("last_id"), F.count("*").alias("rows")
    )
    before = Window.orderBy("first_id").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.select("first_id", "last_id", "rows", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))


def slice_by_ranges(df: DataFrame, ranges: DataFrame, offset: int, count: int) -> DataFrame:
    """The rows at positions [offset, offset + count) in id order, reading only the id ranges that hold them.

    `ranges` are the stored `id_ranges` of the same rows. The scan prunes by the ids, and a top-k per task over
    the rows of the few ranges gives the slice.
    """
    overlap = ranges.where((F.col("start") < offset + count) & (F.col("start") + F.col("rows") > offset))
    found = overlap.agg(F.min("first_id"), F.max("last_id"), F.min("start")).first()
    if found[0] is None:
        return df.limit(0)
    inside = df.where(F.col("booking_id").between(found[0], found[1]))
    return inside.orderBy("booking_id").offset(offset - found[2]).limit(count)


def slice_by_id(df: DataFrame, offset: int, count: int, top_k_rows: int = TOP_K_ROWS, ranges: DataFrame | None = None) -> DataFrame:
    """The rows at positions [offset, offset + count) in id order: `count` rows, or what is left, also where ids repeat.

    Near the front this is a top-k per task. Far back that would move every row before the slice
    through one task, so there the slice is found from the id ranges of the table: stored ones if
    given, else they are made for this slice.
    """
    if offset + count <= top_k_rows:
        return df.orderBy("booking_id").offset(offset).limit(count)
    if ranges is None:
        ranges = stored(id_ranges(df), "id-ranges")
    return slice_by_ranges(df, ranges, offset, count)


def paginate(
    df: DataFrame, page: int = 1, size: int = 20, fields: list[str] = S.LIST_COLUMNS, top_k_rows: int = TOP_K_ROWS,
    ranges: DataFrame | None = None,
) -> DataFrame:
    """One page of rows by booking id; page at least 1, size 1 to MAX_PAGE_SIZE. `ranges` are the table's stored `id_ranges`."""
    offset, size = _page_bounds(page, size, 20)
    return slice_by_id(df, offset, size, top_k_rows, ranges).select(*fields)


def page_after(df: DataFrame, last_id: int, size: int = 20, fields: list[str] = S.LIST_COLUMNS) -> DataFrame:
    """The page that follows a known id: the id bound prunes row groups, whatever the depth."""
    _, size = _page_bounds(1, size, 20)
    return df.where(F.col("booking_id") > last_id).orderBy("booking_id").limit(size).select(*fields)


def page_totals(df: DataFrame, size: int = 20) -> DataFrame:
    return df.agg(F.count("*").alias("total")).select("total", ceil_div(F.col("total"), size).alias("total_pages"))


def page_stats(page: DataFrame) -> DataFrame:
    """Row count, cancel rate and mean rate of one page."""
    rows = F.count("*")
    return page.agg(
        rows.alias("row_count"),
        half_even(ratio(F.count_if(F.col("is_canceled") == 1), rows)).alias("cancel_rate"),
        half_even(ratio(F.sum("adr"), rows), 1).alias("avg_adr"),
    )


def filter_options(df: DataFrame) -> DataFrame:
    """Distinct (value, label) pairs of the five filter dimensions, from one pass over the table.

    The rows combine into their distinct combinations first, so that only those are multiplied by
    the number of dimensions.
    """
    pairs = [
        F.struct(
            F.lit(dimension).alias("dimension"),
            F.col(value).cast("string").alias("value"),
            F.col(label).alias("label"),
        )
        for dimension, (value, label) in OPTION_COLUMNS.items()
    ]
    return (
        active_bookings(df)
        .select(*(name for pair in OPTION_COLUMNS.values() for name in pair))
        .distinct()
        .select(F.inline(F.array(*pairs)))
        .dropna(subset=["value", "label"])
        .distinct()
        .orderBy("dimension", "label", "value")
    )


def sample_orders(df: DataFrame, rows: int = 10) -> DataFrame:
    return df.orderBy("booking_id").limit(rows).select(*S.SAMPLE_COLUMNS)
