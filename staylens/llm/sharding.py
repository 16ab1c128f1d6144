"""Shards by fixed virtual slots and a versioned map from slot to shard."""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from staylens.llm.common import materialize, prepare
from staylens.session import fresh_dir

#: Slots are fixed for good: a record's slot never changes, only the shard that a slot is on.
SLOTS = 4_096

_MAP = "virtual_slot int, unit int, shard int"
_DATA = "cast(coalesce(text, '') as binary)"


#: A slot with more than one part in this many of a shard's fair share of the bytes is split.
SPLIT = 16


def with_slots(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, spread): size is the UTF-8 bytes of the text, null as none, plus 1.

    A record's slot comes from doc_id and checksum. ``spread`` tells records of a slot apart where it is split,
    equal records too; it comes from the record's place in the input, so the caller holds the table.
    """
    data = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.expr(f"pmod(xxhash64(doc_id, crc32({_DATA})), {slots})").cast("int").alias("virtual_slot"),
        F.xxhash64(F.monotonically_increasing_id()).alias("spread"),
    )


def in_units(rows: DataFrame, units: DataFrame) -> DataFrame:
    """Add ``unit``, the part of its slot that a record is in; ``units`` (virtual_slot, units) has the split slots alone.

    There are at most SPLIT of them for each shard, which bounds the broadcast.
    """
    known = rows.join(F.broadcast(units), "virtual_slot", "left")
    return known.withColumn("unit", F.expr("cast(pmod(spread, coalesce(units, 1)) as int)")).drop("units")


def slot_sizes(rows: DataFrame) -> DataFrame:
    """(virtual_slot, unit, bytes, records) of rows with units; how many rows there are doesn't depend on the input."""
    return rows.groupBy("virtual_slot", "unit").agg(F.sum("size").alias("bytes"), F.count("*").alias("records"))


def split_slots(rows: DataFrame, shards: int, split: int = SPLIT) -> DataFrame:
    """(virtual_slot, units): into how many parts the slots are cut that hold much of a shard's fair share."""
    sizes = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"))  # a row per slot at most
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    share = max(total / (shards * split), 1.0)
    return sizes.filter(F.col("bytes") > share).select("virtual_slot", F.ceil(F.col("bytes") / share).cast("int").alias("units"))


Unit = tuple[int, int]


def balance(sizes: dict[Unit, int], units: Iterable[Unit], shards: int, current: dict[Unit, int] | None = None) -> dict[Unit, int]:
    """The next version of the map, from (slot, unit) to shard. ``sizes`` has the bytes of each, absent ones none.

    Without a current map, units are dealt by falling size to the lightest shard. With one, they stay where
    they are, but for those whose shard is gone and for moves from the heaviest to the lightest shard, each
    the largest unit that makes the two more equal, until no move does.
    """
    units = list(units)
    placed = {unit: current[unit] for unit in units if current and current.get(unit, shards) < shards}
    load = [0] * shards
    for unit, shard in placed.items():
        load[shard] += sizes.get(unit, 0)
    lightest = [(weight, shard) for shard, weight in enumerate(load)]
    heapq.heapify(lightest)
    homeless = [unit for unit in units if unit not in placed]
    for unit in sorted(homeless, key=lambda u: (-sizes.get(u, 0), u)):
        weight, shard = heapq.heappop(lightest)
        placed[unit] = shard
        load[shard] = weight + sizes.get(unit, 0)
        heapq.heappush(lightest, (load[shard], shard))
    for _ in range(len(placed)):
        low, high = min(range(shards), key=lambda s: (load[s], s)), max(range(shards), key=lambda s: (load[s], -s))
        gap = load[high] - load[low]
        movable = [u for u, shard in placed.items() if shard == high and 0 < sizes.get(u, 0) < gap]
        if not movable:
            break
        unit = min(movable, key=lambda u: (abs(gap - 2 * sizes[u]), u))
        placed[unit] = low
        load[high] -= sizes[unit]
        load[low] += sizes[unit]
    return dict(sorted(placed.items()))


def write_map(spark: SparkSession, path: str, version: int, slot_map: dict[Unit, int]) -> None:
    """Store a version of the map; earlier ones stay, so records can be found while they move."""
    rows = [(slot, unit, shard) for (slot, unit), shard in slot_map.items()]
    spark.createDataFrame(rows, _MAP).coalesce(1).write.parquet(f"{path}/version={version}")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the stored versions of the map, ascending."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [status.getPath() for status in files.listStatus(folder) if status.getPath().getName().startswith("version=")]
    make = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(int(name.getName()[8:]) for name in names if files.exists(make(name, "_SUCCESS")))


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(virtual_slot, unit, shard) of a version, the newest one unless given; one row per slot or part of it."""
    version = versions(spark, path)[-1] if version is None else version
    return spark.read.schema(_MAP).parquet(f"{path}/version={version}")


def units_of(slot_map: DataFrame) -> DataFrame:
    """(virtual_slot, units) of the slots that a map splits."""
    return slot_map.groupBy("virtual_slot").agg((F.max("unit") + 1).alias("units")).filter("units > 1")


def rebalance(docs: DataFrame, path: str, shards: int) -> int:
    """Edit the newest map for the present ``docs`` and number of shards; returns the number of the version it writes.

    Slots stay whole or cut as they are, but for whole ones that have become too heavy: those are cut, and their
    parts but the first are dealt anew. Other units move only if their shard is gone or too heavy.
    """
    spark = prepare(docs.sparkSession)
    rows = materialize(with_slots(docs), "records")
    old_map = read_map(spark, path)
    current = {(row["virtual_slot"], row["unit"]): row["shard"] for row in old_map.collect()}
    split = split_slots(rows, shards).join(units_of(old_map).select("virtual_slot"), "virtual_slot", "left_anti")
    cut = units_of(old_map).union(split)
    version = versions(spark, path)[-1] + 1
    _write_balanced(spark, path, version, rows, cut, shards, current)
    return version


def _write_balanced(
    spark: SparkSession, path: str, version: int, rows: DataFrame, cut: DataFrame, shards: int, current: dict[Unit, int] | None
) -> None:
    """Write a balanced map; what comes to the driver are a row per slot and part of a slot."""
    parts = {row["virtual_slot"]: row["units"] for row in cut.collect()}
    held = spark.createDataFrame(list(parts.items()), "virtual_slot int, units int")
    sizes = {(row["virtual_slot"], row["unit"]): row["bytes"] for row in slot_sizes(in_units(rows, held)).collect()}
    units = [(slot, unit) for slot in range(SLOTS) for unit in range(parts.get(slot, 1))]
    write_map(spark, path, version, balance(sizes, units, shards, current))


def assign(docs: DataFrame, shards: int = 8, map_path: str | None = None, version: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, unit) of every row of ``docs``.

    The law is ``bytes``: shards are near equal in the sum of sizes. Rows go where the stored map under
    ``map_path`` says, in its newest version unless another is given; where there is none, version 1 is made
    from the rows. A slot with a large part of the bytes, such as that of an id and text which a third of the
    rows repeat, is cut into units. slot is the row's place in its shard, from 0 without gaps, in the order of
    virtual slot, unit, doc_id and checksum. Null and empty texts have size 1; a null doc_id is an id like
    others; repeated rows get a place each; an empty table gives an empty table. Other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    rows = materialize(with_slots(docs), "records")
    path = map_path or fresh_dir(spark, "slot-map")
    if not versions(spark, path):
        _write_balanced(spark, path, 1, rows, split_slots(rows, shards), shards, None)
    slot_map = read_map(spark, path, version)
    rows = in_units(rows, units_of(slot_map))
    # Both tables have a row per slot or part of one, so these windows and the broadcast are of a fixed size.
    slots = slot_sizes(rows).join(F.broadcast(slot_map), ["virtual_slot", "unit"])
    before = Window.partitionBy("shard").orderBy("virtual_slot", "unit").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("offset", F.coalesce(F.sum("records").over(before), F.lit(0)))
    order = Window.partitionBy("virtual_slot", "unit").orderBy("doc_id", "text_crc32", "size")
    out = rows.withColumn("place", F.row_number().over(order) - 1)
    out = out.join(F.broadcast(slots.select("virtual_slot", "unit", "shard", "offset")), ["virtual_slot", "unit"])
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("offset") + F.col("place")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        "unit",
    )
