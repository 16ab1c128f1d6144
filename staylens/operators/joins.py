"""A join that a hot key cannot stall."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# A key is hot when it holds at least one row in this many; so there are at most this many hot keys.
HOT_KEYS = 1000


def join_unique(many: DataFrame, one: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join `many` with `one`, whose `key` is unique, where some keys of `many` may hold a large share of the rows.

    The rows of the hot keys meet their few partners by broadcast and stay where they are; only
    the other rows are shuffled by the key. The hot keys, HOT_KEYS at most, are found first and named to the
    scans; where there are none, one plain join is left. Batch jobs leave skew to adaptive execution, which
    streams do not have. `many` is read several times, so the caller should hold it.
    """
    total = many.agg(F.count("*")).scalar()
    counts = many.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_rows"))
    hot = [row[key] for row in counts.where(F.col("_rows") * HOT_KEYS >= total).select(key).collect()]
    if not hot:
        return many.join(one, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    hot_joined = many.where(is_hot).join(F.broadcast(one.where(is_hot)), key, how)
    return hot_joined.unionByName(many.where(~is_hot).join(one, key, how))
