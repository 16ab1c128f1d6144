"""Micro-batch sinks that a replay cannot spoil."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery

from staylens.session import fresh_dir
from staylens.sources import versions
from staylens.sources.versions import write_version
from staylens.streaming.metrics import merge_trends, trend_sums

BatchFunction = Callable[[DataFrame, int], None]
Combine = Callable[[DataFrame], DataFrame]

#: So many closed batches go into one folder, then so many of these folders into one, and so on.
COMPACT_EVERY = 10
#: Bytes per file of a compacted folder, about.
FILE_BYTES = 128 << 20


def append_batches(path: str, combine: Combine | None = None, every: int = COMPACT_EVERY) -> BatchFunction:
    """Each micro-batch is one folder named by its id; a replayed batch replaces its own folder.

    Every `every` batches the closed ones are compacted, see `compact`. With `combine` the rows are mergeable
    sums, which compaction merges too; the reader applies it to what it reads.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        write_version(batch, path, batch_id)
        if batch_id and batch_id % every == 0:
            compact(batch.sparkSession, path, batch.schema, batch_id, combine, every)

    return write


def compact(spark: SparkSession, path: str, schema: T.StructType, batch_id: int, combine: Combine | None, every: int) -> None:
    """Put the batches before `batch_id`, a multiple of `every`, into folders of ranges.

    The last `every` batches become one folder, the last `every` of these folders the next, as often as the id
    divides: there are never more than about twice `every` folders of a size, so the number of folders grows
    with the logarithm of the batches, and a row is rewritten as often. Only batches below the running one are
    taken, which can't be replayed any more. A folder counts when it is finished, and readers prefer the larger
    range, so a crash at any point neither loses nor doubles a row. What a range replaces is deleted at the
    next compaction, so that a reader which has listed it before has time to finish.
    """
    found = versions.complete_pieces(spark, path)
    for piece in found - versions.cover(found):
        versions.delete_piece(spark, path, piece)
    span = every
    while batch_id % span == 0:
        whole = (batch_id - span, batch_id - 1)
        inside = versions.cover({piece for piece in found if whole[0] <= piece[0] and piece[1] <= whole[1]})
        if inside and whole not in found:
            rows = versions.read_pieces(spark, path, schema, inside)
            parts = 1 + sum(versions.piece_bytes(spark, path, piece) for piece in inside) // FILE_BYTES
            versions.write_piece((combine(rows) if combine else rows).coalesce(parts), path, whole)
            found.add(whole)
        span *= every


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all finished micro-batches."""
    return versions.read_pieces(spark, path, schema, versions.cover(versions.complete_pieces(spark, path)))


def append_trend(path: str, granularity: str) -> BatchFunction:
    """Calendar sums of each batch, for `read_trend`: rows count in their own period, however late they come.

    A batch writes the sums of the periods that it has rows of and reads none.
    """
    append = append_batches(path, combine=lambda sums: merge_trends(sums, ["label"]))
    return lambda batch, batch_id: append(trend_sums(batch, granularity), batch_id)


def read_trend(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return merge_trends(read_batches(spark, path, schema), ["label"])


def overwrite_snapshot(path: str) -> BatchFunction:
    """The newest result as a whole; the one before it stays until the next."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_version(batch, path, batch_id, keep=2)

    return write


def run_available(
    stream: DataFrame, write: BatchFunction, mode: str = "append", checkpoint: str | None = None
) -> str:
    """Process everything that is there, then stop. Returns the checkpoint, to go on from later."""
    checkpoint = checkpoint or fresh_dir(stream.sparkSession, "stream-checkpoint")
    query = (
        stream.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return checkpoint


def run_until_stopped(
    stream: DataFrame, write: BatchFunction, interval: str, checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """A micro-batch per `interval`, such as "10 seconds", until the caller stops the query. The checkpoint is the caller's to keep."""
    return (
        stream.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=interval)
        .start()
    )
