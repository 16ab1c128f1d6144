"""Streaming sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def kafka_lines(spark: SparkSession, servers: str, topic: str, max_offsets: int = 1_000_000, **options) -> DataFrame:
    """Event text from a Kafka topic, from the earliest offset on the first run; the connector jar is the caller's.

    A micro-batch takes at most `max_offsets` messages, the rest waits for the next.
    """
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("maxOffsetsPerTrigger", max_offsets)
        .options(**options)
        .load()
        .select(F.col("value").cast("string").alias("value"))
    )


def file_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Event text from a folder to which files are added."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(path)


def parquet_stream(spark: SparkSession, path: str, schema: T.StructType, glob: str | None = None, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)
