"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import materialize, prepare, word_count

LENGTHS = (512, 1_024, 2_048, 4_096, 8_192)
#: What a sequence costs besides its length, in words.
SEQUENCE_COST = 64
#: Most pieces that are packed together. The loss by packing apart is a few bins in thousands.
GROUP = 20_000


def pack(sizes: Sequence[int], lengths: Sequence[int], sequence_cost: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of every piece, and the length of every bin. No size may be 0 or over the largest length.

    Pieces go, the largest first, into the open bin that they leave the least room in. When none has room, a
    bin opens: for each permitted length that holds the piece, the pieces to come are tried, always the largest
    that fits, and the length with the least cost per packed word is taken, the smaller of equals. At the end
    a bin shrinks to the smallest permitted length that holds its contents.
    """
    lengths = sorted(lengths)
    count = np.bincount(np.asarray(sizes, dtype=np.int64), minlength=lengths[-1] + 1).tolist()
    waiting = sum(1 << size for size, n in enumerate(count) if n)  # bit s: pieces of size s are still to come
    rooms = 0  # bit r: some open bin has room r
    open_bins: dict[int, list[int]] = {}
    held: list[int] = []
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    capacity: list[int] = []
    for piece in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        size = sizes[piece]
        count[size] -= 1
        if not count[size]:
            waiting &= ~(1 << size)
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            chosen = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            room = _cheapest(size, lengths, sequence_cost, waiting, count)
            chosen = len(capacity)
            capacity.append(room)
            held.append(0)
        bins[piece], offsets[piece] = chosen, held[chosen]
        held[chosen] += size
        if room > size:
            open_bins.setdefault(room - size, []).append(chosen)
            rooms |= 1 << (room - size)
    return bins, offsets, [min(length for length in lengths if length >= h) for h in held]


def _cheapest(size: int, lengths: Sequence[int], sequence_cost: int, waiting: int, count: list[int]) -> int:
    best = None
    for length in lengths:
        if length < size:
            continue
        filled, used = size, {}
        while filled < length:
            fitting = waiting & ((2 << (length - filled)) - 1)
            while fitting:
                largest = fitting.bit_length() - 1
                if used.get(largest, 0) < count[largest]:
                    break
                fitting &= ~(1 << largest)
            else:
                break
            many = min(count[largest] - used.get(largest, 0), (length - filled) // largest)
            used[largest] = used.get(largest, 0) + many
            filled += many * largest
        cost = (length + sequence_cost) / filled
        if best is None or cost < best[0]:
            best = (cost, length)
    return best[1]


def best_fit(
    docs: DataFrame,
    lengths: Sequence[int] = LENGTHS,
    sequence_cost: int = SEQUENCE_COST,
    size: Column | None = None,
) -> DataFrame:
    """(doc_id, piece, start, size, bin_id, bin_offset, bin_length): where every word of ``docs`` goes.

    Pieces are counted by id, place and size and dealt to the groups that are packed together in blocks, so
    that rows of one id are no large group.

    size is the number of words unless given. A document longer than the largest permitted length is cut
    into pieces of that length and a rest. bin_id is unique over the table. Null and empty texts have one
    row of size 0 without a bin; repeated rows are packed each; an empty table gives an empty table. Other
    columns are ignored.
    """
    prepare(docs.sparkSession)
    size = word_count(F.col("text")) if size is None else size
    largest = max(lengths)
    documents = materialize(docs.select("doc_id", size.cast("long").alias("words")), "sizes")
    pieces = documents.withColumn(
        "piece", F.explode(F.expr(f"sequence(0L, greatest(cast(ceil(words / {largest}D) as long) - 1, 0L))"))
    )
    pieces = pieces.withColumn("start", F.col("piece") * largest)
    pieces = pieces.withColumn("size", F.least(F.col("words") - F.col("start"), F.lit(largest)))
    total = pieces.filter("size > 0").count()
    groups = 2 * total // GROUP + 1  # half a GROUP in each on average

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.loc[rows.index.repeat(rows["many"])].drop(columns="many")
        rows = rows.sort_values(["doc_id", "piece", "size"], kind="stable").reset_index(drop=True)
        bins, offsets, capacity = pack(rows["size"].tolist(), lengths, sequence_cost)
        first = int(rows["grp"].iat[0]) << 32
        return rows.assign(
            bin_id=[first + b for b in bins], bin_offset=offsets, bin_length=[capacity[b] for b in bins]
        ).drop(columns="grp")

    schema = "doc_id long, piece long, start long, size long, bin_id long, bin_offset long, bin_length long"
    block = max(GROUP // 20, 1)
    counted = pieces.filter("size > 0").groupBy(F.col("doc_id").cast("long").alias("doc_id"), "piece", "start", "size").agg(
        F.count("*").alias("rows")
    )
    counted = counted.withColumn("block", F.explode(F.expr(f"sequence(0L, (rows - 1) div {block})")))
    grouped = counted.select(
        "doc_id",
        "piece",
        "start",
        "size",
        F.least(F.lit(block), F.col("rows") - F.col("block") * block).cast("long").alias("many"),
        F.expr(f"pmod(xxhash64(doc_id, piece, size, block), {groups})").alias("grp"),
    )
    out = grouped.groupBy("grp").applyInPandas(packed, schema)
    nothing = F.lit(None).cast("long")
    empty = pieces.filter("size <= 0").select(
        F.col("doc_id").cast("long"), "piece", "start", F.lit(0).cast("long").alias("size"),
        nothing.alias("bin_id"), nothing.alias("bin_offset"), nothing.alias("bin_length"),
    )
    return out.union(empty)
