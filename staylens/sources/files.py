"""Batch file and table sources and sinks."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession, functions as F, types as T

from staylens import schemas as S
from staylens.functions.dates import iso_date
from staylens.functions.labels import null_tokens
from staylens.session import fresh_dir


LOOKUP_BUCKETS = 64
POSITION_COLUMNS = ["file_path", "split_start", "split_row"]


def read_raw_csv(
    spark: SparkSession, path: str, schema: T.StructType = S.RAW_SCHEMA, positions: bool = False
) -> DataFrame:
    """Raw booking rows, every column as text, missing-value tokens as null.

    The reader's `nullValue` takes one token only, so the token list is a projection. With
    `positions` the rows carry the marks of `file_position`.
    """
    rows = spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").csv(path)
    marks = POSITION_COLUMNS if positions else []
    rows = file_position(rows) if positions else rows
    return rows.select(*marks, *(null_tokens(field.name, S.MISSING_TOKENS) for field in schema.fields))


def file_position(df: DataFrame) -> DataFrame:
    """Add the columns that order rows as they stand in their files.

    A split is read front to back by one task, so path, split start and the row's rank in the
    task give the input order without a sort key in the data.
    """
    return df.withColumns(
        {
            "file_path": F.col("_metadata.file_path"),
            "split_start": F.col("_metadata.file_block_start"),
            "split_row": F.monotonically_increasing_id(),
        }
    )


def write_raw_csv(raw: DataFrame, path: str) -> None:
    raw.write.option("header", True).csv(path)


def _text_dates_schema() -> T.StructType:
    return T.StructType(
        [
            T.StructField(field.name, T.StringType() if field.name in S.DATE_COLUMNS else field.dataType)
            for field in S.CONTRACT_SCHEMA.fields
        ]
    )


def read_clean_csv(spark: SparkSession, path: str) -> DataFrame:
    """The cleaned table from CSV; a date that does not parse is missing."""
    rows = spark.read.schema(_text_dates_schema()).option("header", True).csv(path)
    return lenient_dates(rows)


def lenient_dates(df: DataFrame) -> DataFrame:
    present = [name for name in S.DATE_COLUMNS if name in df.columns]
    return df.withColumns({name: iso_date(F.col(name).cast("string")) for name in present})


def write_clean_csv(cleaned: DataFrame, path: str) -> None:
    """Fixed column order, ISO dates, header, UTF-8 without a byte-order mark."""
    cleaned.select(*S.CONTRACT_COLUMNS).write.option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)


def write_bookings_table(cleaned: DataFrame, path: str) -> None:
    """Parquet by arrival month, so that month filters prune folders and id ranges prune row groups.

    Ranging on (month, id) gives each task one or few months, hence few files, and splits a month
    that holds a large share of the rows over several tasks.
    """
    _by_month(cleaned.withColumn("arrival_month", F.date_format("arrival_date", "yyyy-MM"))).parquet(path)


def _by_month(rows: DataFrame) -> DataFrameWriter:
    ranged = rows.repartitionByRange("arrival_month", "booking_id").sortWithinPartitions("arrival_month", "booking_id")
    return ranged.write.partitionBy("arrival_month")


def read_bookings_table(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([*S.CONTRACT_SCHEMA.fields, T.StructField("arrival_month", T.StringType())])
    return spark.read.schema(schema).parquet(path)


def rewrite_months(spark: SparkSession, path: str, ids: DataFrame, edit: Callable[[DataFrame], DataFrame]) -> list[str | None]:
    """Replace the month folders of a bookings table that hold any of `ids` by what `edit` makes of their rows.

    The folders of all other months keep their files. `edit` leaves the arrival date alone, as edits, soft
    deletes and replacements of rows do, so no row changes its month. Returns the months, None for rows
    without a date. The edited rows are stored aside first: if the exchange of the folders breaks off,
    `exchange_months` with the folder named in the error's notes finishes it.
    """
    table = read_bookings_table(spark, path)
    touched = table.join(ids.select("booking_id"), "booking_id", "left_semi").select("arrival_month").distinct()
    months = [row["arrival_month"] for row in touched.collect()]  # a row per month
    if not months:
        return []
    month = F.col("arrival_month")
    inside = month.isin([m for m in months if m is not None])
    rows = table.where(inside | month.isNull() if None in months else inside)
    staged = fresh_dir(spark, "edited-months")
    _by_month(edit(rows).select(*table.columns)).parquet(staged)
    try:
        exchange_months(spark, staged, path)
    except Exception as error:
        error.add_note(f"the edited months are in {staged}")
        raise
    return months


def exchange_months(spark: SparkSession, staged: str, path: str) -> None:
    """Put the month folders of one bookings table in the place of another's; running it again does no harm."""
    rows = read_bookings_table(spark, staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    rows.partitionBy("arrival_month").parquet(path)


def write_lookup_table(cleaned: DataFrame, path: str, buckets: int = LOOKUP_BUCKETS) -> None:
    """Parquet in buckets by id, sorted in each, for `read_lookup_table`.

    A join by id then reads the buckets in place. Choose `buckets` so that one is some 100 MB; they stay with
    the table.
    """
    name = f"lookup_{uuid.uuid4().hex}"
    (
        cleaned.select(*S.CONTRACT_COLUMNS)
        .repartition(buckets, "booking_id")
        .write.bucketBy(buckets, "booking_id")
        .sortBy("booking_id")
        .option("path", f"{path}/buckets={buckets}")
        .saveAsTable(name)
    )
    cleaned.sparkSession.sql(f"DROP TABLE {name}")  # the catalog's entry; the files stay


def read_lookup_table(spark: SparkSession, path: str) -> DataFrame:
    """The bookings of a lookup table. Buckets are known to a catalog only, so the folder is entered under a name of its own."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [status.getPath().getName() for status in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    buckets = next(int(name.removeprefix("buckets=")) for name in names if name.startswith("buckets="))
    name = f"lookup_{hashlib.md5(f'{path}/{buckets}'.encode()).hexdigest()}"
    spark.sql(
        f"""CREATE TABLE IF NOT EXISTS {name} ({S.CONTRACT_SCHEMA.toDDL()}) USING parquet
            CLUSTERED BY (booking_id) SORTED BY (booking_id) INTO {buckets} BUCKETS LOCATION '{path}/buckets={buckets}'"""
    )
    spark.catalog.refreshTable(name)
    return spark.table(name)


def read_jdbc_table(
    spark: SparkSession, url: str, table: str, lower: int, upper: int, partitions: int, key: str = "booking_id", **options
) -> DataFrame:
    """A database table read in parallel ranges of its key; the driver jar is the caller's."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=key, lowerBound=lower, upperBound=upper, numPartitions=partitions)
        .options(**options)
        .load()
    )


def append_jdbc_table(df: DataFrame, url: str, table: str, batch_size: int = 1000, **options) -> None:
    (
        df.write.format("jdbc")
        .options(url=url, dbtable=table, batchsize=batch_size)
        .options(**options)
        .mode("append")
        .save()
    )


def append_event_log(events: DataFrame, path: str) -> None:
    """Events as JSON lines; null fields are written out, as the event contract has them."""
    line = F.to_json(F.struct(*events.columns), {"ignoreNullFields": "false"})
    events.select(line.alias("value")).write.mode("append").text(path)


def export_page(page: DataFrame, path: str) -> None:
    """One result page as CSV with a header; a page is at most 100 rows, so one file."""
    page.coalesce(1).write.option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)
