"""The realtime job: one stream, every output, from one pass over each micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from staylens import schemas as S
from staylens.operators.joins import join_unique
from staylens.operators.metrics import top_risk
from staylens.session import fresh_dir
from staylens.sources.versions import complete_versions, read_version, write_version
from staylens.streaming.events import accepted, first_deliveries, parse_events, rejected
from staylens.streaming.metrics import (
    merge_states,
    merge_trends,
    metric_rows,
    rate_columns,
    state_of,
    summary_columns,
    trend_sums,
    with_cancel_rate,
)
from staylens.streaming.sinks import append_batches, read_batches, run_available

RECENT_ROWS = 10

STATE_SCHEMA = T.StructType(
    [
        T.StructField("dimension", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("processed_count", T.LongType()),
        T.StructField("high_risk_count", T.LongType()),
        T.StructField("predicted_cancellations", T.LongType()),
        T.StructField("probability", T.DecimalType(28, 4)),
        T.StructField("updated_at", T.TimestampType()),
    ]
)
RECENT_SCHEMA = T.StructType(
    [
        T.StructField("prediction_id", T.LongType()),
        T.StructField("booking_id", T.LongType()),
        T.StructField("hotel_name", T.StringType()),
        T.StructField("country_name", T.StringType()),
        T.StructField("cancel_probability", T.DecimalType(6, 4)),
        T.StructField("risk_level_name", T.StringType()),
        T.StructField("predicted_at", T.TimestampType()),
    ]
)


TREND_SCHEMA = T.StructType(
    [
        T.StructField("granularity", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("inflow", T.LongType()),
        T.StructField("predicted_cancellations", T.LongType()),
    ]
)


#: A batch with at most this many different ids names them to the scan of the bookings.
NAMED_IDS = 1_000


def known_bookings(batch: DataFrame, bookings: DataFrame) -> DataFrame:
    """The bookings that a held batch names.

    The different ids of the batch meet the bookings, a row each. From `files.read_lookup_table` these come in
    buckets by id and stay where they are: only the ids are shuffled. Where the ids are few, the scan knows
    them and skips the buckets without any.
    """
    ids = batch.select("booking_id").where(F.col("booking_id").isNotNull()).distinct()
    few = [row["booking_id"] for row in ids.limit(NAMED_IDS + 1).collect()]
    if len(few) <= NAMED_IDS:
        bookings = bookings.where(F.col("booking_id").isin(few))
    return bookings.join(ids, "booking_id", "left_semi")


@contextmanager
def lookup(batch: DataFrame, bookings: DataFrame) -> Iterator[DataFrame]:
    """Each event of a held batch with its booking; `is_known` tells whether there is one. Held while it is in use.

    Columns that the event has too come from the booking. One lookup serves the resolved and the
    unresolved output.
    """
    own = [name for name in batch.columns if name == "booking_id" or name not in bookings.columns]
    known = known_bookings(batch, bookings).withColumn("is_known", F.lit(True))
    found = join_unique(batch.select(*own), known, "booking_id")
    found = found.withColumn("is_known", F.coalesce("is_known", F.lit(False))).persist()
    try:
        yield found
    finally:
        found.unpersist()


def resolved(looked_up: DataFrame) -> DataFrame:
    return looked_up.where("is_known").drop("is_known")


def unresolved(looked_up: DataFrame, *columns: str) -> DataFrame:
    """Events whose booking is unknown or deleted."""
    return looked_up.where(~F.col("is_known")).select("booking_id", *columns)


def newest(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("predicted_at"), F.desc("prediction_id")).limit(RECENT_ROWS)


def keep_recent(path: str) -> Callable[[DataFrame, int], None]:
    """The last ten predictions: the stored ten and the batch's ten, of which ten remain."""

    def write(batch: DataFrame, batch_id: int) -> None:
        before = read_version(batch.sparkSession, path, RECENT_SCHEMA, before=batch_id)
        ten = newest(batch.select(*RECENT_SCHEMA.names))
        write_version(newest(before.unionByName(ten)), path, batch_id, keep=2)

    return write


def _next_stamp(before: DataFrame, scored: DataFrame):
    """The time of an update: the latest event so far, but always after the update before.

    Unlike the clock it is the same when a batch is replayed, and unlike the batch's own latest
    event it grows even if batches come out of order, so the latest metric rows are the newest.
    """
    last = before.agg(F.max("updated_at")).scalar()
    return F.greatest(scored.agg(F.max("predicted_at")).scalar(), last + F.expr("interval 1 second"))


def calendar_sums(scored: DataFrame) -> DataFrame:
    """Sums per day, week and month of the event time."""
    sums = [
        trend_sums(scored, granularity).select(F.lit(granularity).alias("granularity"), "*")
        for granularity in ("day", "week", "month")
    ]
    return reduce(DataFrame.unionByName, sums)


def event_keys(batch: DataFrame) -> list[str]:
    """What tells two events apart: the id of the prediction, else booking and creation time; see events.first_deliveries() for nulls."""
    return ["prediction_id"] if "prediction_id" in batch.columns else ["booking_id", "generated_at"]


def realtime_outputs(out: str, bookings: DataFrame, score: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """The batch function of the realtime job; its stream holds each event once, see `run_events`.

    Events resolve against `bookings`, `score` adds the prediction columns, and the scored batch
    is held once for all outputs under `out`:

    predictions, unresolved   rows of each batch
    trends                    sums per calendar day, week and month of each batch; late events count in their period
    state                     running sums per country, channel and overall
    summary, risk             snapshots from the state
    recent                    the last ten predictions
    metrics                   long metric rows, one set per batch

    Running totals are the previous version of the state, a row per country and channel, plus the batch, so a
    replay of batch N starts again from N-1 and every output is the same as the first time. A batch number
    below the newest stored one means a fresh checkpoint over old outputs, and is refused.
    """
    by_period = append_batches(f"{out}/trends", combine=lambda sums: merge_trends(sums, ["granularity", "label"]))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stored = complete_versions(spark, f"{out}/state")
        if stored and batch_id < stored[-1]:
            raise RuntimeError(f"{out} holds batch {stored[-1]}, but the stream is at {batch_id}: wrong checkpoint")
        event_only = [name for name in batch.columns if name not in bookings.columns]
        batch = batch.persist()
        with lookup(batch, bookings) as found:
            scored = score(resolved(found)).persist()
            append_batches(f"{out}/unresolved")(unresolved(found, *event_only), batch_id)
            append_batches(f"{out}/predictions")(scored.select(*S.PREDICTION_SCHEMA.names), batch_id)
            by_period(calendar_sums(scored), batch_id)
            before = read_version(spark, f"{out}/state", STATE_SCHEMA, before=batch_id)
            merged = merge_states(before.drop("updated_at"), state_of(scored))
            write_version(merged.withColumn("updated_at", _next_stamp(before, scored)), f"{out}/state", batch_id, keep=2)
            state = read_version(spark, f"{out}/state", STATE_SCHEMA, before=batch_id + 1)
            everything = state.where(F.col("dimension") == "all")
            write_version(everything.select(*summary_columns()), f"{out}/summary", batch_id, keep=2)
            keyed = state.where(F.col("dimension") != "all").select(*("dimension", "name"), *rate_columns())
            write_version(top_risk(keyed), f"{out}/risk", batch_id, keep=2)
            append_batches(f"{out}/metrics")(metric_rows(state), batch_id)
            keep_recent(f"{out}/recent")(scored, batch_id)
            scored.unpersist()
        batch.unpersist()

    return write


def run_events(
    events: DataFrame, out: str, bookings: DataFrame, score: Callable[[DataFrame], DataFrame], checkpoint: str | None = None
) -> str:
    """Run the realtime job over a stream of events, which may come again and in any order. Returns the checkpoint."""
    once = first_deliveries(events, event_keys(events))
    return run_available(once, realtime_outputs(out, bookings, score), checkpoint=checkpoint)


def run_lines(
    lines: DataFrame, out: str, bookings: DataFrame, score: Callable[[DataFrame], DataFrame], checkpoint: str | None = None
) -> str:
    """Run the realtime job over a stream of event text; lines that are no events go to `rejected` under `out`.

    The two are queries of their own, with a checkpoint each under `checkpoint`.
    """
    checkpoint = checkpoint or fresh_dir(lines.sparkSession, "stream-checkpoint")
    parsed = parse_events(lines)
    run_available(rejected(parsed), append_batches(f"{out}/rejected"), checkpoint=f"{checkpoint}/rejected")
    run_events(accepted(parsed), out, bookings, score, f"{checkpoint}/events")
    return checkpoint


def realtime_tables(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The outputs as tables: all batches of the row outputs, the newest of the snapshots."""
    summary = T.StructType(
        [
            T.StructField("processed_count", T.LongType()),
            T.StructField("high_risk_count", T.LongType()),
            T.StructField("predicted_cancellations", T.LongType()),
            T.StructField("average_cancel_probability", T.DoubleType()),
        ]
    )
    risk = T.StructType(
        [
            T.StructField("dimension", T.StringType()),
            T.StructField("name", T.StringType()),
            T.StructField("value", T.DoubleType()),
            T.StructField("booking_count", T.LongType()),
            T.StructField("predicted_cancellations", T.LongType()),
        ]
    )
    return {
        "predictions": read_batches(spark, f"{out}/predictions", S.PREDICTION_SCHEMA),
        "metrics": read_batches(spark, f"{out}/metrics", S.METRIC_SCHEMA),
        "state": read_version(spark, f"{out}/state", STATE_SCHEMA),
        "summary": read_version(spark, f"{out}/summary", summary),
        "risk": read_version(spark, f"{out}/risk", risk),
        "trends": with_cancel_rate(
            merge_trends(read_batches(spark, f"{out}/trends", TREND_SCHEMA), ["granularity", "label"])
        ),
        "recent": read_version(spark, f"{out}/recent", RECENT_SCHEMA),
    }
