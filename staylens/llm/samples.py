"""Bounded samples of labelled documents for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import materialize


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, rows: int, use: Column | None = None) -> DataFrame:
    """(text, y double) of at most ``rows`` labelled documents, those with the smallest hash of their doc_id.

    The sampled ids are at most ``rows`` and so may be broadcast; texts aren't shuffled. ``use`` is a
    condition on doc_id; rows for which it is null or false aren't used. Null labels and ids are left out,
    several labels of a document are averaged, and of several documents with one id a single one is used.
    """
    chosen = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("double").alias("y"))
    if use is not None:
        chosen = chosen.filter(use)
    chosen = chosen.filter("doc_id is not null and y is not null").groupBy("doc_id").agg(F.avg("y").alias("y"))
    chosen = materialize(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "sample")
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")
    return materialize(texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")), "texts").select(
        F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("y") >= 0.5, 1.0).otherwise(0.0).alias("y")
    )
