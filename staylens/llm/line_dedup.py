"""Repeated lines dropped by probing sharded minimal perfect hashes of the distinct line hashes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from staylens.llm.common import materialize, mix, prepare

#: A line is told by the 128-bit hash of its key; keys shorter than this many code points are left alone.
LEAST_CHARS = 40
LEAST_DOCS = 5
#: Lines in a shard of the index, on average.
SHARD_LINES = 1 << 16
#: An index of up to this many bytes is broadcast; a larger one is probed shard by shard.
BROADCAST_BYTES = 64 << 20
#: Probes of a shard that meet it in one task.
PROBES = 1 << 20

#: Bits per line that is still without a place, in each level of a minimal perfect hash.
ROOM = 2
LEVELS = 40

#: Below all ids: where a document without an id stands.
NO_ID = -(1 << 63)

_CONTINUATION = bytes(range(0x80, 0xC0))
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)

_SHARD = "shard int, levels array<binary>, fingerprints binary, counts binary, holders binary"


@dataclass
class LineIndex:
    """Shards of the index, a row each, and how many lines they hold."""

    shards: DataFrame
    many: int
    lines: int


def drop_repeated_lines(
    docs: DataFrame,
    least_chars: int = LEAST_CHARS,
    least_docs: int = LEAST_DOCS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) for every row of ``docs`` (doc_id long, text string).

    A text is split at line feeds. A line's key is the line without white space (space, tab, line feed,
    vertical tab, form feed, carriage return) at its ends and with A-Z in lower case. Lines whose key has
    ``least_chars`` code points and stands in ``least_docs`` documents stay in the largest doc_id that holds
    the key, all of them, and are dropped elsewhere; the rest stays, joined by line feeds.

    A null or empty text is one empty line and comes back empty. Rows that repeat a doc_id are one document
    for the count and keep or lose lines alike; rows without an id together count as one document below all
    ids. An empty table gives an empty table; other columns are ignored.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    index = build(rows, least_chars, least_docs)
    size = index.shards.agg(F.sum(_row_bytes())).first()[0] or 0
    if size <= broadcast_bytes:
        held = rows.sparkSession.sparkContext.broadcast([Shard.of(row) for row in index.shards.collect()])
        many = index.many

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shards = {shard.number: shard for shard in held.value}
            for batch in batches:
                yield _cleaned(batch, least_chars, lambda hashes, ids: probe(shards, many, hashes, ids))

        out = rows.mapInArrow(clean, "doc_id long, text binary, n_lines long, n_dropped long")
    else:
        rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
        dropped = _probe_by_shard(index, rows, least_chars)
        lists = dropped.groupBy("row").agg(F.collect_list(F.struct("hi", "lo")).alias("dropped"))  # of one text each

        def clean_listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _cleaned(batch, least_chars, None)

        out = rows.join(lists, "row", "left").mapInArrow(clean_listed, "doc_id long, text binary, n_lines long, n_dropped long")
    return out.withColumn("text", F.col("text").cast("string"))


def build(rows: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> LineIndex:
    """Index the lines of ``rows`` (doc_id, text binary) that stand in at least ``least_docs`` documents.

    A document's hashes are made distinct in its task, then over the rows of its id, and counted per line;
    both steps combine map side, so a line in every document is no hot group. Each shard is built in a task.
    """

    hashes = _line_hashes(rows, least_chars).distinct()
    holders = materialize(hashes.select("hi", "lo", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id")), "line-holders")
    counted = holders.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.max("doc_id").alias("holder"))
    counted = materialize(counted.filter(F.col("n") >= least_docs), "line-counts")
    known = counted.count()
    many = known // SHARD_LINES + 1

    def place(group: pd.DataFrame) -> pd.DataFrame:
        hashes = group[["hi", "lo"]].to_numpy(dtype=np.int64)
        levels = minimal_perfect_hash(hashes)
        at = places(levels, ranks(levels), hashes)
        fingerprints, counts, last = (np.empty(len(hashes), dtype=t) for t in (np.int64, np.uint32, np.int64))
        fingerprints[at] = hashes[:, 1]
        counts[at] = np.minimum(group["n"].to_numpy(), np.iinfo(np.uint32).max)
        last[at] = group["holder"].to_numpy()
        row = (int(group["shard"].iat[0]), [v.tobytes() for v in levels], fingerprints.tobytes(), counts.tobytes(), last.tobytes())
        return pd.DataFrame([row], columns=["shard", "levels", "fingerprints", "counts", "holders"])

    shards = counted.withColumn("shard", _shard_column(many)).groupBy("shard").applyInPandas(place, _SHARD)
    return LineIndex(materialize(shards, "line-index"), many, known)


def _line_hashes(rows: DataFrame, least_chars: int) -> DataFrame:
    """(hi, lo) of the distinct long lines of each row of ``rows`` (text binary), with the row's other columns, all longs."""
    others = [name for name in rows.columns if name != "text"]

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, owner = [], []
            for at, text in enumerate(batch.column("text")):
                found = {digest for _, digest in long_lines((text.as_py() or b"").split(b"\n"), least_chars)}
                digests += found
                owner += [at] * len(found)
            hashes, owner = as_hashes(digests), pa.array(owner, type=pa.int64())
            columns = [pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), *(batch.column(name).take(owner) for name in others)]
            yield pa.RecordBatch.from_arrays(columns, names=["hi", "lo", *others])

    return rows.mapInArrow(lines, ", ".join(f"{name} long" for name in ["hi", "lo", *others]))


def long_lines(lines: list[bytes], least_chars: int) -> Iterator[tuple[int, bytes]]:
    """Position and 128-bit hash of the key of each line that is long enough."""
    for at, line in enumerate(lines):
        if len(line) < least_chars:
            continue
        key = line.strip().lower()  # of bytes, both calls know ASCII only
        if len(key) >= least_chars and (key.isascii() or len(key.translate(None, _CONTINUATION)) >= least_chars):
            yield at, xxhash.xxh3_128_digest(key)


def as_hashes(digests: list[bytes]) -> np.ndarray:
    """128-bit hashes as rows of two 64-bit integers."""
    return np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)


def _shard_column(many: int):
    return F.expr(f"cast(pmod(hi, {many}) as int)")


def _row_bytes():
    levels = F.aggregate("levels", F.lit(0).cast("long"), lambda size, level: size + F.octet_length(level))
    return levels + F.octet_length("fingerprints") + F.octet_length("counts") + F.octet_length("holders")


# --- a minimal perfect hash: levels of bits -----------------------------------------------------


def _bit(hashes: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Where the hashes fall in a level."""
    unsigned = hashes.view(np.uint64)
    seeds = [mix(np.array([2 * level + k], dtype=np.uint64) + _GOLDEN) for k in (1, 2)]
    mixed = mix(mix(unsigned[:, 0] ^ seeds[0]) * _GOLDEN + (unsigned[:, 1] ^ seeds[1]))
    return (mixed % np.uint64(bits)).astype(np.int64)


def minimal_perfect_hash(hashes: np.ndarray) -> list[np.ndarray]:
    """Levels of bits, in words, for distinct hashes: one that is alone at its bit sets it, the others go to the next level."""
    levels, left = [], hashes
    while len(left):
        if len(levels) == LEVELS:
            raise ValueError("equal hashes have no minimal perfect hash")
        bits = -(-ROOM * len(left) // 64) * 64
        at = _bit(left, len(levels), bits)
        alone = np.bincount(at, minlength=bits) == 1
        levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
        left = left[~alone[at]]
    return levels


def ranks(levels: list[np.ndarray]) -> list[np.ndarray]:
    """For each word of each level the number of set bits before it, in all levels."""
    out, before = [], 0
    for words in levels:
        counts = np.bitwise_count(words).astype(np.int64)
        out.append(before + np.cumsum(counts) - counts)
        before += int(counts.sum())
    return out


def places(levels: list[np.ndarray], before: list[np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """The place of each hash: the number of set bits before its own. Unknown hashes get -1 or any place."""
    out = np.full(len(hashes), -1, dtype=np.int64)
    open_rows = np.arange(len(hashes))
    for number, words in enumerate(levels):
        at = _bit(hashes[open_rows], number, 64 * len(words))
        word, bit = words[at >> 6], (at & 63).astype(np.uint64)
        hit = (word >> bit) & np.uint64(1) == 1
        lower = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
        out[open_rows[hit]] = before[number][at[hit] >> 6] + np.bitwise_count(lower)
        open_rows = open_rows[~hit]
        if not len(open_rows):
            break
    return out


class Shard:
    """A shard as arrays: bits and their running counts by level, fingerprint, count and last holder by place."""

    def __init__(self, number: int, levels: list[bytes], fingerprints: bytes, counts: bytes, holders: bytes):
        self.number = number
        self.levels = [np.frombuffer(level, dtype=np.uint64) for level in levels]
        self.before = ranks(self.levels)
        self.fingerprints = np.frombuffer(fingerprints, dtype=np.int64)
        self.counts = np.frombuffer(counts, dtype=np.uint32)
        self.holders = np.frombuffer(holders, dtype=np.int64)

    @classmethod
    def of(cls, row: Row | dict) -> Shard:
        return cls(row["shard"], list(row["levels"]), row["fingerprints"], row["counts"], row["holders"])

    def is_dropped(self, hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which of the lines, told by hash and document, are known and belong to a larger document."""
        at = places(self.levels, self.before, hashes)
        known = (at >= 0) & (self.fingerprints[at] == hashes[:, 1])
        return known & (self.holders[at] != ids)


def probe(shards: dict[int, Shard], many: int, hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which of the lines are dropped, from all shards."""
    dropped = np.zeros(len(hashes), dtype=bool)
    number = np.mod(hashes[:, 0], many)
    order = np.argsort(number, kind="stable")
    edges = np.searchsorted(number[order], np.arange(many + 1))
    for shard, (a, b) in enumerate(zip(edges, edges[1:])):
        if a < b and shard in shards:
            rows = order[a:b]
            dropped[rows] = shards[shard].is_dropped(hashes[rows], ids[rows])
    return dropped


def _cleaned(batch: pa.RecordBatch, least_chars: int, probing) -> pa.RecordBatch:
    """The batch's texts without dropped lines, which ``probing`` or the rows' own lists name."""
    ids = [NO_ID if doc_id is None else doc_id for doc_id in batch.column("doc_id").to_pylist()]
    split = [(text.as_py() or b"").split(b"\n") for text in batch.column("text")]
    where, digests = [], []
    for row, lines in enumerate(split):
        for at, digest in long_lines(lines, least_chars):
            where.append((row, at))
            digests.append(digest)
    if probing is not None:
        owner = np.array([ids[row] for row, _ in where], dtype=np.int64)
        dropped = probing(as_hashes(digests), owner) if where else []
    else:
        listed = [
            {(pair["hi"], pair["lo"]) for pair in pairs.as_py() or ()} if pairs.is_valid else () for pairs in batch.column("dropped")
        ]
        dropped = [tuple(pair) in listed[row] for (row, _), pair in zip(where, as_hashes(digests).tolist())]
    gone: dict[int, set[int]] = {}
    for (row, at), is_gone in zip(where, dropped):
        if is_gone:
            gone.setdefault(row, set()).add(at)
    texts = [
        b"\n".join(line for at, line in enumerate(lines) if at not in gone[row]) if row in gone else b"\n".join(lines)
        for row, lines in enumerate(split)
    ]
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"),
            pa.array(texts, type=pa.binary()),
            pa.array([len(lines) for lines in split], type=pa.int64()),
            pa.array([len(gone.get(row, ())) for row in range(len(split))], type=pa.int64()),
        ],
        names=["doc_id", "text", "n_lines", "n_dropped"],
    )


def _probe_by_shard(index: LineIndex, rows: DataFrame, least_chars: int) -> DataFrame:
    """(row, hi, lo) of the lines that ``rows`` (row, doc_id, text) lose, for an index too large to broadcast.

    The hashes of the lines, not the lines, go to the shards. A shard with more than PROBES of them is sent to
    several tasks, each with a part of its probes, so a frequent line doesn't make a hot task.
    """
    probes = materialize(_line_hashes(rows, least_chars).withColumn("shard", _shard_column(index.many)), "probes")
    parts = probes.groupBy("shard").agg(F.ceil(F.count("*") / PROBES).cast("int").alias("parts"))
    parts = materialize(parts, "probe-parts")  # a row per shard
    probes = probes.join(parts, "shard").withColumn("part", F.expr("cast(pmod(xxhash64(row), parts) as int)"))
    copies = index.shards.join(parts.select("shard", F.expr("sequence(0, parts - 1)").alias("copies")), "shard")
    copies = copies.withColumn("part", F.explode("copies")).drop("copies")

    def dropped(asked: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        found = asked[["row", "hi", "lo"]]
        if not len(shard) or not len(asked):
            return found.iloc[:0]
        hashes = np.ascontiguousarray(asked[["hi", "lo"]].to_numpy(dtype=np.int64))
        ids = asked["doc_id"].to_numpy()
        return found[Shard.of(shard.iloc[0].to_dict()).is_dropped(hashes, ids)]

    return (
        probes.select("shard", "part", "row", "hi", "lo", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"))
        .groupBy("shard", "part")
        .cogroup(copies.groupBy("shard", "part"))
        .applyInPandas(dropped, "row long, hi long, lo long")
    )
