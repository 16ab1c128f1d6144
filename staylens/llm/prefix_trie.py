"""The prefix trie of conversations, by union-find over the common prefixes of sorted neighbours."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staylens.llm.common import materialize, prepare

#: Bytes of a turn's digest in a path; paths sort by bytes as their conversations sort by turns.
DIGEST = 16
#: Distinct sequences, and bytes of their paths, in a partition of the sorted order, on average; and fewest partitions.
PART_ROWS = 20_000
PART_BYTES = 16 << 20
LEAST_PARTS = 8
#: Neighbouring partitions whose forests are merged in a task.
FAN_IN = 64

_TURN = "struct<digest:string,bytes:bigint>"
_FOREST = (
    "kind string, grp int, idx int, depth int, low int, n long, least long, kids long, leaves long, saved long, "
    "ends long, bytes array<long>, up string, item string, parent_id long"
)


@dataclass
class Trie:
    """nodes: a row per prefix; members: (ends, conv_id), the conversations that end at the node with that ``ends``."""

    nodes: DataFrame
    members: DataFrame


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) from rows (conv_id, turn, role, text): turns in order, as digests and UTF-8 bytes of the text.

    Null turns come first, rows of one turn in the order of their digests; null role or text counts as empty.
    Rows without a conv_id belong to no conversation. A conversation is one row, of about 50 bytes a turn.
    """
    role, text = (F.coalesce(name, F.lit("")).cast("binary") for name in ("role", "text"))
    # The length of the role keeps (ab, c) and (a, bc) apart.
    whole = F.concat(F.octet_length(role).cast("string").cast("binary"), F.lit(b":"), role, text)
    digest = F.substring(F.sha2(whole, 256), 1, 2 * DIGEST)
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.struct(F.col("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")).alias("t")
    )
    ordered = F.sort_array(F.collect_list("t"))
    return turns.groupBy("conv_id").agg(ordered.alias("t")).select(
        "conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))).cast(f"array<{_TURN}>").alias("turns")
    )


def rebuild(found: DataFrame, group: int = 5, longest: int = 8) -> DataFrame:
    """``found`` (conv_id, turns) with the heads replaced: conversation c starts with the first h turns of conversation
    c - c % group (all of them if fewer, none if it isn't there), then come its own turns after its first h.

    h is the unsigned crc32 of c in decimal, modulo ``longest`` + 1; the remainder of a negative c is negative.
    """
    found = materialize(found, "sequences")
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (longest + 1)
    own = found.select("conv_id", "turns", head.cast("int").alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    heads = found.filter(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", F.lit(1), F.lit(longest)).alias("head")
    )
    start = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.expr(f"cast(array() as array<{_TURN}>)"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return own.join(heads, "base", "left").select("conv_id", F.concat(start, rest).alias("turns"))


def build(found: DataFrame) -> Trie:
    """The trie of the sequences ``found`` (conv_id unique long, turns of digest and bytes).

    nodes: conv_id (the smallest member) and depth, which name a node; parent_conv_id (null for the root), n_convs,
    n_children, n_leaves, saved_bytes (of each node of the subtree, n_convs - 1 times the bytes of its last turn,
    summed), ends (the smallest conversation that ends here, null if none does).

    Equal sequences are one with a count. The distinct ones are sorted over partitions. In each, the common
    prefixes of neighbours are taken in descending depth by union-find, and every merge of components is a
    branching node. What lies deeper than the common prefixes with the neighbouring partitions is final; the
    rest, a node per depth at most on either side, goes up a tree of merges over the neighbouring partitions.
    No task holds more than its partition, or FAN_IN such borders. No sequences give no nodes.
    """
    prepare(found.sparkSession)
    paths = materialize(
        found.select(
            "conv_id",
            F.unhex(F.array_join(F.col("turns.digest"), "")).alias("path"),
            F.col("turns.bytes").alias("bytes"),
        ).withColumn("ends_key", F.sha2("path", 256)),
        "paths",
    )
    classes = paths.groupBy("ends_key").agg(
        F.min("conv_id").alias("ends"), F.count("*").alias("n"), F.first("path").alias("path"), F.first("bytes").alias("bytes")
    )
    classes = materialize(classes, "classes")
    many, size = classes.agg(F.count("*"), F.sum(F.octet_length("path"))).first()
    parts = max(LEAST_PARTS, many // PART_ROWS + 1, (size or 0) // PART_BYTES + 1)
    ranged = classes.select("path", "bytes", "ends", "n").repartitionByRange(parts, "path")
    ranged = materialize(ranged.withColumn("part", F.spark_partition_id()), "sorted")
    level = ranged.join(_borders(ranged), "part").groupBy("grp").applyInPandas(_leaf_forest, _FOREST)
    levels = []
    while True:
        level = materialize(level, "forest")
        levels.append(level)
        last = level.filter("kind = 'item'").agg(F.max("grp")).first()[0]
        if last is None:
            break
        items = level.filter("kind = 'item'").withColumn("above", F.floor(F.col("grp") / FAN_IN).cast("int"))
        level = items.groupBy("above").applyInPandas(_merging(len(levels), last < FAN_IN, last // FAN_IN), _FOREST)
    nodes = reduce(DataFrame.unionByName, (one.filter("kind = 'node'") for one in levels))
    nodes = nodes.join(_node_of_items(levels), nodes["up"] == F.col("known"), "left")
    members = paths.select("conv_id", "ends_key").join(classes.select("ends_key", "ends"), "ends_key").select("ends", "conv_id")
    return Trie(_prefixes(nodes), members)


def ends_sha256(members: DataFrame) -> DataFrame:
    """(ends, ends_sha256) from rows (ends, conv_id): the hash of the decimal ids, ascending, joined by commas.

    The ids are sorted over all partitions, which cuts a node with many of them, and each task joins its ids to
    texts of at most an Arrow batch. A hash reads its input in order, so the texts of a node then stream
    through one task, sorted by Spark, which spills; that task holds a hash state and an Arrow batch.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, ids = batch.column("ends").to_numpy(), batch.column("conv_id").to_numpy()
            edges = np.flatnonzero(np.diff(ends, prepend=ends[:1] - 1))
            spans = list(zip(edges, [*edges[1:], len(ends)]))
            texts = [",".join(ids[a:b].astype(str)) for a, b in spans]
            columns = [pa.array(ends[edges]), pa.array(ids[edges]), pa.array(texts, type=pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["ends", "first", "text"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            done: list[tuple[int, str]] = []
            for ends, text in zip(batch.column("ends").to_pylist(), batch.column("text").to_pylist()):
                if ends == current:
                    state.update(b"," + text.encode())
                    continue
                if state is not None:
                    done.append((current, state.hexdigest()))
                current, state = ends, hashlib.sha256(text.encode())
            yield _digest_rows(done)
        if state is not None:
            yield _digest_rows([(current, state.hexdigest())])

    ordered = members.repartitionByRange("ends", "conv_id").sortWithinPartitions("ends", "conv_id")
    texts = ordered.mapInArrow(joined, "ends long, first long, text string")
    texts = texts.repartition("ends").sortWithinPartitions("ends", "first")
    return texts.mapInArrow(digests, "ends long, ends_sha256 string")


def _digest_rows(rows: list[tuple[int, str]]) -> pa.RecordBatch:
    ends, digests = [row[0] for row in rows], [row[1] for row in rows]
    return pa.RecordBatch.from_arrays([pa.array(ends, type=pa.int64()), pa.array(digests, type=pa.string())], names=["ends", "ends_sha256"])


# --- sorted partitions and their borders --------------------------------------------------------


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two paths share from the start."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    step = 1
    while low + step <= high and a[low * DIGEST : (low + step) * DIGEST] == b[low * DIGEST : (low + step) * DIGEST]:
        low, step = low + step, 2 * step
    high = min(high, low + step - 1)
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * DIGEST : middle * DIGEST] == b[low * DIGEST : middle * DIGEST]:
            low = middle
        else:
            high = middle - 1
    return low


def _borders(ranged: DataFrame) -> DataFrame:
    """(part, grp, before, after): a dense number for each partition and the turns its ends share with its neighbours, -1 without one.

    One row per shuffle partition.
    """
    ends = materialize(ranged.groupBy("part").agg(F.min("path").alias("first"), F.max("path").alias("last")), "borders")
    order = Window.orderBy("part")
    ends = ends.withColumns(
        {"grp": F.row_number().over(order) - 1, "earlier": F.lag("last").over(order), "later": F.lead("first").over(order)}
    )

    @F.pandas_udf("int")
    def shared(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([-1 if x is None or y is None else common_turns(x, y) for x, y in zip(a, b)], dtype="int32")

    known = ends.select("part", "grp", shared("earlier", "first").alias("before"), shared("last", "later").alias("after"))
    return materialize(known, "borders")


# --- the forest of a run of neighbours ----------------------------------------------------------


@dataclass
class Forest:
    """Nodes over a run of sorted items, as lists: what hangs below each node, without the node's own chain upwards."""

    depth: list[int]
    n: list[int]
    least: list[int | None]
    kids: list[int]
    leaves: list[int]
    saved: list[int]
    ends: list[int | None]
    #: Bytes of the turns from the root, of some sequence below the node: its first ``depth`` entries count.
    bytes: list[np.ndarray]
    parent: list[int] = field(default_factory=list)
    alias: list[int] = field(default_factory=list)
    #: Sums of bytes up to each depth.
    sums: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self):
        self.parent = [-1] * len(self.depth)
        self.alias = list(range(len(self.depth)))
        self.sums = [np.concatenate([[0], np.cumsum(b, dtype=np.int64)]) for b in self.bytes]

    def node(self, i: int) -> int:
        """The node that i has become part of."""
        while self.alias[i] != i:
            self.alias[i] = i = self.alias[self.alias[i]]
        return i

    def join(self, a: int, b: int, depth: int) -> int:
        """Merge the components under the nodes a and b, which share a prefix of ``depth`` turns; returns the node there."""
        if self.depth[a] != depth:
            a, b = b, a
        if self.depth[a] != depth:
            top = len(self.depth)
            for name, value in (("depth", depth), ("n", 0), ("least", None), ("kids", 0), ("leaves", 0), ("saved", 0), ("ends", None)):
                getattr(self, name).append(value)
            self.bytes.append(self.bytes[a])
            self.sums.append(self.sums[a])
            self.parent.append(-1)
            self.alias.append(top)
            self._hang(a, top)
            a = top
        if self.depth[b] == depth:
            self._absorb(b, a)
        else:
            self._hang(b, a)
        return a

    def _hang(self, child: int, top: int) -> None:
        self.parent[child] = top
        n, kids, leaves, saved = self.branch(child, top)
        self.n[top] += n
        self.kids[top] += kids
        self.leaves[top] += leaves
        self.saved[top] += saved
        self.least[top] = _smaller(self.least[top], self.least[child])

    def branch(self, child: int, top: int) -> tuple[int, int, int, int]:
        """What a child adds to the members, children, leaves and saved bytes of the node above it."""
        chain = int(self.sums[child][self.depth[child]] - self.sums[child][self.depth[top]])
        return self.n[child], 1, max(1, self.leaves[child]), self.saved[child] + (self.n[child] - 1) * chain

    def _absorb(self, other: int, into: int) -> None:
        self.alias[other] = into
        self.n[into] += self.n[other]
        self.least[into] = _smaller(self.least[into], self.least[other])
        self.kids[into] += self.kids[other]
        self.leaves[into] += self.leaves[other]
        self.saved[into] += self.saved[other]
        self.ends[into] = _smaller(self.ends[into], self.ends[other])


def _smaller(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def link(forest: Forest, shared: list[int]) -> int:
    """Union-find over the edges between neighbouring items, deepest first; ``shared[i]`` is the prefix of items i and i + 1.

    Returns the node over all items.
    """
    group = list(range(len(shared) + 1))
    top = list(range(len(group)))

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = i = group[group[i]]
        return i

    for i in np.argsort(-np.asarray(shared, dtype=np.int64), kind="stable").tolist():
        a, b = root(i), root(i + 1)
        joined = forest.join(top[a], top[b], shared[i])
        group[b] = a
        top[a] = joined
    return top[root(0)]


def _spine(forest: Forest, item: int) -> list[int]:
    """The nodes from the one that holds an item up to the top."""
    out = [forest.node(item)]
    while forest.parent[out[-1]] >= 0:
        out.append(forest.node(forest.parent[out[-1]]))
    return out


def _leaf_forest(rows: pd.DataFrame) -> pd.DataFrame:
    """The forest of a partition of distinct sequences."""
    rows = rows.sort_values("path", kind="stable")
    number, before, after = (int(rows[name].iat[0]) for name in ("grp", "before", "after"))
    paths = rows["path"].tolist()
    n, least, sizes = rows["n"].tolist(), rows["ends"].tolist(), list(rows["bytes"])
    depth = [len(path) // DIGEST for path in paths]
    shared = [common_turns(a, b) for a, b in zip(paths, paths[1:])]
    ends = list(least)
    # Empty items stand for the neighbours: they make a node where a neighbour's sequences branch off.
    if before >= 0:
        depth, n, least, ends, sizes, shared = [before, *depth], [0, *n], [None, *least], [None, *ends], [sizes[0], *sizes], [before, *shared]
    if after >= 0:
        depth, n, least, ends, sizes, shared = [*depth, after], [*n, 0], [*least, None], [*ends, None], [*sizes, sizes[-1]], [*shared, after]
    if before < 0 and after < 0:  # the only partition: the root is closed here
        depth, n, least, ends, sizes, shared = [*depth, 0], [*n, 0], [*least, None], [*ends, None], [*sizes, sizes[-1]], [*shared, 0]
    zero = [0] * len(depth)
    forest = Forest(depth, n, least, zero, list(zero), list(zero), ends, sizes)
    top = link(forest, shared)
    return _forest_rows(forest, top, len(shared) + 1, 0, number, before >= 0, after >= 0, [None] * (len(shared) + 1))


def _merging(level: int, is_top: bool, last: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The task function of a level of merges, whose groups are 0 to ``last``."""
    return lambda rows: _merged_forest(rows, level, is_top, last)


def _merged_forest(rows: pd.DataFrame, level: int, is_top: bool, last: int) -> pd.DataFrame:
    """The forest over the borders of neighbouring partitions or groups."""
    rows = rows.sort_values(["grp", "idx"], kind="stable")
    number = int(rows["above"].iat[0])

    def whole(name: str) -> list[int | None]:
        return [None if pd.isna(v) else int(v) for v in rows[name]]

    depth = whole("depth")
    shared = [min(a, b) for a, b in zip(depth, depth[1:])]
    items = rows["item"].tolist()
    sizes, n, least, kids, leaves, saved, ends = list(rows["bytes"]), *(whole(c) for c in ("n", "least", "kids", "leaves", "saved", "ends"))
    if is_top:  # the root, in case that all sequences share a turn
        depth, shared, items = [*depth, 0], [*shared, 0], [*items, None]
        sizes, n, least, kids, leaves, saved, ends = [*sizes, sizes[-1]], [*n, 0], [*least, None], [*kids, 0], [*leaves, 0], [*saved, 0], [*ends, None]
    forest = Forest(depth, n, least, kids, leaves, saved, ends, sizes)
    top = link(forest, shared)
    return _forest_rows(forest, top, len(shared) + 1, level, number, not is_top and number > 0, not is_top and number < last, items)


def _forest_rows(
    forest: Forest, top: int, many: int, level: int, number: int, has_left: bool, has_right: bool, items: list[str | None]
) -> pd.DataFrame:
    """Closed nodes, the border as items of the next level, and for each given item what became of it.

    The border are the nodes over the first item, if there is a neighbour before, and over the last, if
    there is one after: they may have more below them than this run knows.
    """
    left = _spine(forest, 0) if has_left else [top] if has_right else []
    right = _spine(forest, many - 1) if has_right else [top] if has_left else []
    border = left + right[-2::-1]  # the top stands in both
    place = {node: idx for idx, node in enumerate(border)}
    own = {i: [forest.n[i], forest.kids[i], forest.leaves[i], forest.saved[i]] for i in border}
    for i in border:
        if forest.parent[i] >= 0:  # its parent is border too and counts it as a branch; the next level will do that
            above = forest.node(forest.parent[i])
            for at, value in enumerate(forest.branch(i, above)):
                own[above][at] -= value
    name = f"{level}.{number}."
    out = []
    for i in range(len(forest.depth)):
        if forest.alias[i] != i or i in place:
            continue
        above = forest.node(forest.parent[i]) if forest.parent[i] >= 0 else -1
        low = forest.depth[above] + 1 if above >= 0 else 0
        chain = forest.bytes[i][low - 1 : forest.depth[i]] if low else [0]
        tails = np.cumsum(np.asarray(chain, dtype=np.int64)[::-1])[::-1].tolist()
        parent_id = None if above < 0 or above in place else forest.least[above]
        up = name + str(place[above]) if above in place else None
        here = (forest.n[i], forest.least[i], forest.kids[i], forest.leaves[i], forest.saved[i], forest.ends[i])
        out.append(("node", number, None, forest.depth[i], low, *here, tails, up, None, parent_id))
    for i in border:
        n, kids, leaves, saved = own[i]
        here = (n, forest.least[i], kids, leaves, saved, forest.ends[i])
        path = forest.bytes[i][: forest.depth[i]].tolist()
        out.append(("item", number, place[i], forest.depth[i], None, *here, path, None, name + str(place[i]), None))
    for i, item in enumerate(items):
        if item is not None:
            at = forest.node(i)
            up = name + str(place[at]) if at in place else None
            out.append(("moved", number, *[None] * 9, None, up, item, None if up else forest.least[at]))
    names = [part.split()[0] for part in _FOREST.split(", ")]
    whole = ("idx", "depth", "low", "n", "least", "kids", "leaves", "saved", "ends", "parent_id")
    return pd.DataFrame(out, columns=names).astype({name: "Int64" for name in whole})


def _node_of_items(levels: list[DataFrame]) -> DataFrame:
    """(known, node_id): for every border item of every level the smallest member of its node, from the top level down."""
    found = levels[-1].filter("kind = 'moved'").select(F.col("item").alias("known"), F.col("parent_id").alias("node_id"))
    out = found = materialize(found, "nodes-of-items")
    for level in levels[-2::-1]:
        moved = level.filter("kind = 'moved'").join(found, F.col("up") == F.col("known"), "left")
        found = moved.select(F.col("item").alias("known"), F.coalesce("parent_id", "node_id").alias("node_id"))
        found = materialize(found, "nodes-of-items")
        out = out.union(found)
    return out


def _prefixes(chains: DataFrame) -> DataFrame:
    """A row per node from rows per chain of nodes with the same members, from depth ``low`` down to ``depth``."""
    parent = F.coalesce("parent_id", "node_id")
    each = chains.select("*", F.posexplode("bytes").alias("at", "tail")).withColumn("here", F.col("low") + F.col("at"))
    is_last = F.col("here") == F.col("depth")
    return each.select(
        F.col("least").alias("conv_id"),
        F.col("here").cast("long").alias("depth"),
        F.when(F.col("at") > 0, F.col("least")).otherwise(parent).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(is_last, F.col("kids")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.greatest("leaves", F.lit(1)).cast("long").alias("n_leaves"),
        (F.col("saved") + (F.col("n") - 1) * F.col("tail")).alias("saved_bytes"),
        F.when(is_last, F.col("ends")).alias("ends"),
    )
