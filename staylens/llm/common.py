"""Helpers that several operators share."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.session import fresh_dir

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Rows in an Arrow batch: very long texts then stay far below a worker's memory.
BATCH_ROWS = "1000"


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the operators rely on; they can change while a session runs."""
    for name, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS,
    }.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: later jobs neither recompute it nor depend on an executor."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A class is hot when it has one row in this many; so there are at most this many hot classes.
HOT_CLASSES = 1_000


def join_class(rows: DataFrame, classes: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join ``rows`` with ``classes``, unique by ``key``, whose column ``copies`` says how many rows each has.

    The rows of hot classes meet their class by broadcast, of at most HOT_CLASSES rows, and those without a
    key have none: both stay where they are; the others are shuffled by the key. Both tables are read several
    times, so the caller should hold them.
    """
    hot = F.col("copies") * HOT_CLASSES >= rows.count()
    near = rows.join(F.broadcast(classes.filter(hot)), key)
    others = rows.filter(F.col(key).isNotNull()).join(F.broadcast(classes.filter(hot).select(key)), key, "left_anti")
    out = near.unionByName(others.join(classes.filter(~hot), key, how))
    if how == "left":
        out = out.unionByName(rows.filter(F.col(key).isNull()), allowMissingColumns=True)
    return out


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def crc_remainder(key: Column, divisor: int) -> Column:
    """crc32 of the key as text, modulo the divisor; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % divisor


def ascii_lower_words(text: str | None) -> list[bytes]:
    """Words of the UTF-8 text with A-Z in lower case. For bytes, both calls know ASCII only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit integers evenly (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle, an empty one none."""
    words = ascii_lower_words(text)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    if not len(ids):
        return ids
    many = min(width, len(ids))
    shingles = np.full(len(ids) - many + 1, many, dtype=np.uint64)
    for i in range(many):
        shingles = mix(shingles * np.uint64(0x9E3779B97F4A7C15) + ids[i : len(ids) - many + 1 + i])
    return np.unique(shingles)
