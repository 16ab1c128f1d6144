"""Batch edits, soft deletes and upserts. Each returns the new state of the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from staylens import schemas as S
from staylens.operators.cleaning import derived_labels


def latest_per_key(df: DataFrame, key: str, sequence: str) -> DataFrame:
    """The last row per key by a sequence column; map-side combining keeps a hot key cheap."""
    rest = [name for name in df.columns if name != key]
    newest = F.max_by(F.struct(*rest), F.col(sequence)).alias("_row")
    return df.groupBy(key).agg(newest).select(key, *(F.col(f"_row.{name}").alias(name) for name in rest))


def apply_edits(base: DataFrame, edits: DataFrame, sequence: str | None = None, relabel: bool = True) -> DataFrame:
    """Set the editable columns of the rows named in `edits`; a null leaves the old value.

    Columns of `edits` that are not editable are ignored. With `relabel` the label columns follow
    the edited codes. Give `sequence` when an id may occur more than once: the last edit wins.
    """
    if sequence:
        edits = latest_per_key(edits, "booking_id", sequence)
    editable = [name for name in S.EDITABLE_COLUMNS if name in edits.columns]
    changes = edits.select("booking_id", *(F.col(name).alias(f"_new_{name}") for name in editable))
    edited = base.join(changes, "booking_id", "left").withColumns(
        {name: F.coalesce(F.col(f"_new_{name}").cast(S.CONTRACT_TYPES[name]), F.col(name)) for name in editable}
    )
    if relabel:
        labels = derived_labels()
        edited = edited.withColumns(
            {f"{name}_name": labels[f"{name}_name"] for name in editable if f"{name}_name" in labels}
        )
    return edited.select(*base.columns)


def edit_counts(base: DataFrame, edits: DataFrame) -> DataFrame:
    """How many edits name an existing row, and how many name none."""
    known = base.select("booking_id", F.lit(1).alias("_known"))
    return edits.select("booking_id").distinct().join(known, "booking_id", "left").agg(
        F.count("_known").alias("matched"), F.count_if(F.col("_known").isNull()).alias("unmatched")
    )


def soft_delete(base: DataFrame, ids: DataFrame) -> DataFrame:
    """Mark the named rows deleted."""
    marked = ids.select("booking_id").distinct().withColumn("_gone", F.lit(1))
    return (
        base.join(marked, "booking_id", "left")
        .withColumn("is_deleted", F.coalesce("_gone", "is_deleted"))
        .select(*base.columns)
    )


def upsert_by_key(base: DataFrame, incoming: DataFrame, sequence: str | None = None, key: str = "booking_id") -> DataFrame:
    """Insert new keys and replace existing ones; the incoming row wins as a whole."""
    if sequence:
        incoming = latest_per_key(incoming, key, sequence)
    incoming = incoming.select(*base.columns)
    return incoming.unionByName(base.join(incoming.select(key), key, "left_anti").select(*base.columns))
