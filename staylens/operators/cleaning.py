"""Raw rows to the 41-column contract, and the checks on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from staylens import schemas as S
from staylens.functions.dates import assemble_date, iso_date
from staylens.functions.labels import label_or_code, label_or_null
from staylens.functions.numbers import lenient_int, lenient_money
from staylens.session import stored


#: Splits of the input files up to which their offsets, two longs each, are broadcast.
BROADCAST_SPLITS = 1_000_000


def dense_position(df: DataFrame, *order: str, name: str = "position", parts: int | None = None) -> DataFrame:
    """Add the 1-based position of each row under a total order.

    A global `row_number` would sort everything in one task. Instead the rows are range
    partitioned and sorted, stored once as Parquet in the shared folder so that both reads below see
    the same partitions, and each partition's offset is the number of rows in the partitions
    before it. The offsets table has one row per shuffle partition, which bounds the broadcast
    and the one unpartitioned window. All columns of `order` together must be unique: ties are
    then never split at random, and a frequent first column still spreads over partitions. `parts`
    is the number of ranges, `spark.sql.shuffle.partitions` unless given.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_rank", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33)),
        "positions",
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_part")
        .agg(F.count("*").alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        ranged.join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_offset") + F.col("_rank") + 1).cast("bigint"))
        .drop("_part", "_rank", "_offset")
    )


def position_in_files(read: DataFrame, name: str = "position") -> DataFrame:
    """Add the 1-based position of each row in its files, which `files.file_position` has marked.

    A split holds a run of consecutive rows, so a row's position is the number of rows in the
    splits before it plus its rank in the split. That takes one more read, of the marks only. The
    offsets are found in two levels, files and the splits of a file, and have one row per split,
    known by a number; up to BROADCAST_SPLITS of them are broadcast and the rows aren't shuffled.
    """
    splits = read.groupBy("file_path", "split_start").agg(F.count("*").alias("_rows"), F.min("split_row").alias("_first"))
    splits = stored(splits, "splits")
    paths = splits.groupBy("file_path").agg(F.sum("_rows").alias("_rows"))
    before = Window.orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)
    paths = paths.select("file_path", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("file_path").orderBy("split_start").rowsBetween(Window.unboundedPreceding, -1)
    rows_before = F.col("_before") + F.coalesce(F.sum("_rows").over(inside), F.lit(0))
    number = F.xxhash64("file_path", "split_start")
    offsets = splits.join(paths, "file_path").select(
        "file_path", "split_start", number.alias("_split"), (rows_before - F.col("_first")).alias("_offset")
    )
    offsets = stored(offsets, "split-offsets")
    known, numbers = offsets.agg(F.count("*"), F.count_distinct("_split")).first()
    if known == numbers and known <= BROADCAST_SPLITS:
        placed = read.withColumn("_split", number).join(F.broadcast(offsets.select("_split", "_offset")), "_split").drop("_split")
    else:
        placed = read.join(offsets.drop("_split"), ["file_path", "split_start"])
    return placed.withColumn(name, (F.col("_offset") + F.col("split_row") + 1).cast("bigint")).drop(
        "file_path", "split_start", "split_row", "_offset"
    )


def coerced_ints() -> dict[str, Column]:
    return {name: lenient_int(name) for name in S.INT_COLUMNS}


def filled_codes() -> dict[str, Column]:
    return {name: F.coalesce(F.col(name), F.lit(value)) for name, value in S.MISSING_CODE.items()}


def total_nights() -> Column:
    return F.col("stays_in_weekend_nights") + F.col("stays_in_week_nights")


def total_guests() -> Column:
    return F.col("adults") + F.col("children") + F.col("babies")


def room_type_changed() -> Column:
    return (F.col("reserved_room_type") != F.col("assigned_room_type")).cast("int")


def derived_labels() -> dict[str, Column]:
    """Label columns from the code columns; used by the cleaning job and again after edits."""
    return {
        "hotel_name": label_or_code("hotel", S.HOTEL_LABELS),
        "is_canceled_label": label_or_null("is_canceled", S.CANCELED_LABELS),
        "meal_name": label_or_code("meal", S.MEAL_LABELS),
        "country_name": label_or_code("country_code", S.COUNTRY_LABELS),
        "market_segment_name": label_or_code("market_segment", S.SEGMENT_LABELS),
        "is_repeated_guest_label": label_or_null("is_repeated_guest", S.REPEATED_GUEST_LABELS),
        "deposit_type_name": label_or_code("deposit_type", S.DEPOSIT_LABELS),
        "customer_type_name": label_or_code("customer_type", S.CUSTOMER_LABELS),
    }


def clean_bookings(raw: DataFrame, booking_id: Column, strict: bool = False) -> DataFrame:
    """Raw text rows to the contract: three projections that Catalyst folds into one.

    `strict=True` fails the job on an impossible date; otherwise the date is missing and
    `rejected_rows` reports the row.
    """
    arrival = assemble_date("arrival_date_year", "arrival_date_month", "arrival_date_day_of_month", strict)
    typed = raw.withColumns(
        {
            **coerced_ints(),
            **filled_codes(),
            "booking_id": booking_id.cast("bigint"),
            "adr": lenient_money("adr"),
            "arrival_date": arrival,
            "reservation_status_date": iso_date(F.col("reservation_status_date"), strict),
            "is_deleted": F.lit(0),
        }
    ).withColumnRenamed("country", "country_code")
    derived = typed.withColumns(
        {
            **derived_labels(),
            "event_date": F.col("arrival_date"),
            "total_nights": total_nights(),
            "total_guests": total_guests(),
            "room_type_changed": room_type_changed(),
        }
    )
    return derived.select(*S.CONTRACT_COLUMNS)


def import_bookings(raw: DataFrame, *order: str, strict: bool = False) -> DataFrame:
    """The whole cleaning job: number the rows by the given order, then clean them."""
    numbered = dense_position(raw, *order, name="_id")
    return clean_bookings(numbered, F.col("_id"), strict)


def import_files(marked: DataFrame, strict: bool = False) -> DataFrame:
    """The whole cleaning job with ids in file order; input from `files.read_raw_csv(…, positions=True)`."""
    return clean_bookings(position_in_files(marked, "_id"), F.col("_id"), strict)


def rejected_rows(cleaned: DataFrame) -> DataFrame:
    """Rows whose arrival or status date could not be read."""
    return cleaned.where(F.col("arrival_date").isNull() | F.col("reservation_status_date").isNull())


def align_to_contract(df: DataFrame) -> DataFrame:
    """Add absent contract columns with their defaults, then project to the contract."""
    absent = {
        name: F.lit(S.CONTRACT_DEFAULTS.get(name)).cast(kind)
        for name, kind in S.CONTRACT_TYPES.items()
        if name not in df.columns
    }
    return df.withColumns(absent).select(*S.CONTRACT_COLUMNS) if absent else df.select(*S.CONTRACT_COLUMNS)


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    absent = [name for name in names if name not in df.columns]
    if absent:
        raise ValueError(f"required columns are absent: {absent}")
    return df


def not_null_violations(df: DataFrame, names: list[str]) -> DataFrame:
    """Null count per required column: one pass, then one row per column."""
    require_columns(df, names)
    counts = df.agg(*(F.count_if(F.col(name).isNull()).alias(name) for name in names))
    return counts.unpivot([], names, "column_name", "null_count")


def duplicate_keys(df: DataFrame, keys: list[str], table_name: str) -> DataFrame:
    """Key values that occur more than once, with their counts; hot keys combine map side."""
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("row_count"))
        .where(F.col("row_count") > 1)
        .select(
            F.lit(table_name).alias("table_name"),
            F.concat_ws("|", *(F.col(key).cast("string") for key in keys)).alias("key_value"),
            "row_count",
        )
    )
