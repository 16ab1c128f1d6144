"""Mix sources to target weights: pivotal dependent rounding of fractional copies, in a reduction tree."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staylens.llm.common import materialize, prepare, word_count
from staylens.operators.cleaning import dense_position

#: No document is taken more often.
MOST_COPIES = 3
#: Most documents of a source that are rounded together (half as many on average), and remainders that meet in a node
#: of the tree. Documents of one id and size go there in blocks of a twentieth.
CHUNK = 10_000
FAN_IN = 256
#: Rows of one id, source and size are many if they are one row in so many; so there are at most this many such groups.
HOT_GROUPS = 1_000
SEED = 11


def source_targets(sizes: DataFrame, weights: Sequence[float]) -> DataFrame:
    """(source, place, documents, source_size, target) from rows (doc_id, source, size).

    Sources in code point order, null last, weigh as ``weights`` say, which repeat. They share the sum of
    all sizes by weight; no target exceeds MOST_COPIES times its source's size, and the excess is shared
    again by weight among the rest until none does. There is a row per source from here on, and there may be
    very many: places come from a range sort, and each round of sharing is one sum over the sources.
    """
    sources = sizes.groupBy("source").agg(F.count("*").alias("documents"), F.sum("size").alias("source_size"))
    sources = materialize(sources.withColumn("absent", F.col("source").isNull()), "sources")
    parts = sources.count() // CHUNK + 1
    place = (F.col("position") - 1).cast("int")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * float(MOST_COPIES)
    sources = dense_position(sources, "absent", "source", parts=parts).withColumn("place", place)
    sources = sources.withColumn("weight", weight).withColumn("limit", limit)
    sources = materialize(sources.withColumn("room", F.col("limit") / F.col("weight")), "rooms")
    level, full = 0.0, -1  # what a unit of weight gets, and how many sources are at their limit
    while level is not None:
        is_full = F.col("room") < level
        left = F.sum("source_size") - F.coalesce(F.sum(F.when(is_full, F.col("limit"))), F.lit(0.0))
        many, share = sources.agg(F.count_if(is_full), left / F.sum(F.when(~is_full, F.col("weight")))).first()
        if many == full:
            break
        level, full = share, many
    target = F.least(F.col("limit"), F.coalesce(F.lit(level).cast("double"), F.col("room")) * F.col("weight"))
    return sources.withColumn("target", target).select("source", "place", "documents", "source_size", "target")


def round_copies(rows: pd.DataFrame, seed: Sequence[int], last: bool) -> pd.DataFrame:
    """Pivotal rounding of the rows (size > 0, mass): masses end at 0 or at size, but for one row at most.

    Two rows with unsettled mass give and take, in words, until one of them is settled; which way is drawn
    so that every row's expected mass stays. The sum of all masses stays too. With ``last`` the remaining
    row is drawn as well. The result depends on the rows and the seed alone.
    """
    rng = np.random.default_rng([abs(int(s)) for s in seed])
    draws = rng.random(len(rows) + 1).tolist()
    size, mass = rows["size"].tolist(), rows["mass"].tolist()
    settled = [True] * len(rows)
    held = -1
    for j, (s, m) in enumerate(zip(size, mass)):
        if m <= 1e-9 * s or m >= (1 - 1e-9) * s:
            mass[j] = s if m * 2 > s else 0
            continue
        if held < 0:
            held = j
            continue
        i = held
        up, down = min(size[i] - mass[i], m), min(mass[i], s - m)
        if draws[j] * (up + down) < down:
            mass[i], mass[j] = mass[i] + up, m - up
        else:
            mass[i], mass[j] = mass[i] - down, m + down
        for k in (i, j):
            part = mass[k] / size[k]
            if part < 1e-9 or part > 1 - 1e-9:
                mass[k] = size[k] if part > 0.5 else 0
        unsettled = [k for k in (i, j) if 0 < mass[k] < size[k]]
        held = unsettled[0] if unsettled else -1
    if held >= 0:
        if last:
            mass[held] = size[held] if draws[-1] * size[held] < mass[held] else 0
        else:
            settled[held] = False
    return rows.assign(mass=np.asarray(mass, dtype=float), settled=settled)


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), size: Column | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, source) for every row of ``docs`` (doc_id, source, text).

    size is the number of words unless given; taken is copies times size, repeats counted, with at most
    MOST_COPIES copies. A document's expected copies are its source's target by its source's size, whole
    copies are certain, and the rest is rounded so that the words taken from a source miss its target by
    less than one document. Reruns agree.

    Null and empty texts have size 0, take 0 words, and draw their copies alone. A null source is a source.
    Repeated rows are documents of their own. A source without words has target 0. An empty table gives an
    empty table; other columns are ignored.
    """
    prepare(docs.sparkSession)
    size = word_count(F.col("text")) if size is None else size
    rows = materialize(docs.select("doc_id", "source", size.cast("long").alias("size")), "sizes")
    targets = materialize(source_targets(rows, weights), "targets")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    chunks = targets.withColumn("chunks", F.ceil(2 * F.col("documents") / CHUNK)).withColumn("expected", expected)
    rows = rows.join(chunks.select("source", "place", "chunks", "expected"), rows["source"].eqNullSafe(chunks["source"]))
    rows = rows.select(
        "doc_id",
        "place",
        "size",
        F.floor("expected").cast("int").alias("whole"),
        (F.col("size") * (F.col("expected") - F.floor("expected"))).alias("mass"),
        "chunks",
        "expected",
    )
    alone = F.expr(f"pmod(xxhash64({SEED}, doc_id), 1000000) / 1000000.0") < F.col("expected") - F.col("whole")
    copies = F.col("whole") + F.round(F.col("mass") / F.col("size")).cast("int")
    done = rows.filter("size = 0").select("doc_id", "place", "size", (F.col("whole") + alone.cast("int")).alias("copies"))
    open_rows = _blocks(rows.filter("size > 0"))
    most = targets.agg(F.max("documents")).first()[0] or 1
    nodes, level = -(-2 * most // CHUNK), 0
    while True:
        rounded = materialize(_round_level(open_rows, level, nodes == 1), "rounded")
        done = done.union(rounded.filter("settled").select("doc_id", "place", "size", copies.alias("copies")))
        if nodes == 1:
            break
        open_rows = rounded.filter("not settled").drop("settled")
        open_rows = open_rows.withColumn("node", F.floor(F.col("node") / FAN_IN))
        nodes, level = -(-nodes // FAN_IN), level + 1
    out = done.join(targets.select("place", "source", "source_size", "target"), "place")
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return out.select("doc_id", "size", "source_size", "target", taken, "copies", "source")


def _blocks(rows: DataFrame) -> DataFrame:
    """Equal rows counted, in blocks, each with the ``node`` in which it is rounded: rows of one id are no hot group."""
    block = max(CHUNK // 20, 1)
    counted = rows.groupBy("doc_id", "place", "size", "whole", "mass", "chunks").agg(F.count("*").alias("rows"))
    counted = counted.withColumn("block", F.explode(F.expr(f"sequence(0L, (rows - 1) div {block})")))
    return counted.select(
        "doc_id",
        "place",
        "size",
        "whole",
        "mass",
        F.expr("pmod(xxhash64(doc_id, size, block), chunks)").alias("node"),
        F.least(F.lit(block), F.col("rows") - F.col("block") * block).cast("long").alias("many"),
    )


def _round_level(rows: DataFrame, level: int, last: bool) -> DataFrame:
    """Round the rows of each node of each source; what isn't settled goes up the tree."""

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        group = group.loc[group.index.repeat(group["many"])].assign(many=1)
        group = group.sort_values(["doc_id", "size", "mass"], kind="stable", na_position="first")
        seed = [SEED, level, int(group["place"].iat[0]), int(group["node"].iat[0])]
        return round_copies(group, seed, last)

    schema = "doc_id long, place int, size long, whole int, mass double, node long, many long, settled boolean"
    return rows.groupBy("place", "node").applyInPandas(settle, schema)


def repeat_documents(docs: DataFrame, weights: Sequence[float] = (1, 2, 3)) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, each as often as the mix takes it.

    Rows that repeat doc_id, source and size share out their decisions, in the order of a hash of their texts, the
    most copies first. Decisions are counted, not gathered. Where such rows are more than CHUNK and one row in
    HOT_GROUPS, they are numbered within the partitions in which they stand, with the counts of the partitions
    before them, so a doc_id may repeat without limit.
    """
    # One key, equal where its fields are or are both null: window and join share a shuffle of the texts.
    key_type = "struct<doc_id:bigint,source:string,size:bigint>"
    many = [F.sum((F.col("copies") >= n).cast("long")).alias(f"take{n}") for n in range(1, MOST_COPIES + 1)]
    decisions = mix(docs, weights).groupBy(F.struct("doc_id", "source", "size").cast(key_type).alias("key"))
    decisions = materialize(decisions.agg(F.count("*").alias("rows"), *many), "decisions")
    total = decisions.agg(F.sum("rows")).first()[0] or 0
    is_hot = (F.col("rows") > CHUNK) & (F.col("rows") * HOT_GROUPS >= total)
    hot = decisions.filter(is_hot)
    words = word_count(F.col("text")).alias("size")
    # A hash of the text orders the rows; the text itself would be shuffled a second time.
    order = F.xxhash64("text").alias("order")
    rows = docs.select(F.struct("*").alias("doc"), F.struct("doc_id", "source", words).cast(key_type).alias("key"), order)
    by_text = Window.partitionBy("key").orderBy("order")
    if hot.limit(1).count():
        few = rows.join(F.broadcast(hot.select("key")), "key", "left_anti")
        found = materialize(rows.join(F.broadcast(hot), "key").withColumn("part", F.spark_partition_id()), "hot-rows")
        before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        starts = found.groupBy("key", "part").agg(F.count("*").alias("n"))
        starts = materialize(starts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), "starts")
        inside = F.row_number().over(Window.partitionBy("key", "part").orderBy("order"))
        more = _repeated(found.join(starts, ["key", "part"]).withColumn("place", F.col("start") + inside))
        rows, decisions = few, decisions.filter(~is_hot)
    else:
        more = None
    out = _repeated(rows.withColumn("place", F.row_number().over(by_text)).join(decisions.hint("merge"), "key"))
    return out if more is None else out.union(more)


def _repeated(numbered: DataFrame) -> DataFrame:
    """The documents of rows (doc, place, take1 ...), each as often as its place says."""
    copies = sum((F.col("place") <= F.col(f"take{n}")).cast("int") for n in range(1, MOST_COPIES + 1))
    times = numbered.select("doc", copies.alias("times")).filter("times > 0")
    return times.select("doc", F.explode(F.sequence(F.lit(1), F.col("times")))).select("doc.*")
