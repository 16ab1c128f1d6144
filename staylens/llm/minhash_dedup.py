"""Near-duplicates by an inverted join over MinHash signature coordinates, confirmed on the full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staylens.llm.common import join_class, materialize, mix, prepare, shingle_set
from staylens.llm.components import connected_components

#: A coordinate is made of three minima, so that two texts which have little but frequent shingles in
#: common seldom share one. Two sets of similarity 0.8 agree in a coordinate with probability 0.512, and in
#: at least MATCHES of COORDINATES with probability 0.99998: that many must match before sets are compared.
MINIMA = 3
COORDINATES = 32
MATCHES = 5
SEED = 20_240_613

#: A group of candidates beyond either number is split into blocks that are compared pair by pair.
BLOCK_TEXTS = 2_048
BLOCK_SHINGLES = 1 << 21


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, coordinates: int = COORDINATES, matches: int = MATCHES
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id long, text string).

    Two documents are linked when 100 * |intersection| >= percent * |union| of their shingle sets;
    component_id is the smallest doc_id reachable over links, kept marks that document. ``matches`` of
    ``coordinates`` is meant for percent >= 80; lower it with the percentage.

    Null or empty texts have 0 shingles and no links; texts shorter than ``width`` words are one shingle.
    Rows that repeat a doc_id are one document: each comes back, with the smallest component that any of
    its texts reaches. A null doc_id is never linked: component_id is null, kept is true. Other columns
    of ``docs`` are ignored.
    """
    profiles, classes = _classes(docs, width, percent, coordinates, matches, one_per_id=True)
    keyed = profiles.select("doc_id", "n_shingles", F.when(_can_link(), F.col("fingerprint")).alias("fingerprint"))
    out = join_class(keyed, classes.select("fingerprint", "copies", F.col("first.doc_id").alias("component_id")), "fingerprint")
    out = out.withColumn(
        "component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    )
    return out.select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.expr("doc_id = component_id"), F.lit(True)).alias("kept")
    )


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, one of each group of near-duplicates.

    The row with the smallest doc_id of a group stays, of several texts under that id one. Every text is judged
    by itself: rows that share a doc_id with a dropped row stay if nothing links them. Of rows that repeat both
    doc_id and text one stays; rows with a null doc_id all stay.
    """
    profiles, classes = _classes(docs, width, percent, COORDINATES, MATCHES, one_per_id=False)
    linked = profiles.filter(_can_link()).select("doc_id", "text_key", "fingerprint")
    judged = join_class(linked, classes.select("fingerprint", "copies", "first"), "fingerprint", "inner")
    key = F.concat_ws(" ", F.col("doc_id").cast("string"), F.coalesce("text_key", F.lit("")))
    dropped = judged.filter(F.struct("doc_id", "text_key") != F.col("first")).select(key.alias("key")).distinct()
    # The same key for join and window: the texts are shuffled once.
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long"), text_key().alias("text_key"))
    key = F.when(F.col("doc_id").isNotNull(), key).otherwise(F.concat(F.lit("null "), F.monotonically_increasing_id()))
    rows = rows.select("doc", key.alias("key")).join(dropped.hint("merge"), "key", "left_anti")
    order = Window.partitionBy("key").orderBy(F.lit(0))
    return rows.withColumn("place", F.row_number().over(order)).filter("place = 1").select("doc.*")


def text_key() -> Column:
    """What tells the texts of one doc_id apart."""
    return F.md5(F.col("text").cast("binary"))


def _can_link() -> Column:
    return F.expr("n_shingles > 0 and doc_id is not null")


def _classes(
    docs: DataFrame, width: int, percent: int, coordinates: int, matches: int, one_per_id: bool
) -> tuple[DataFrame, DataFrame]:
    """Profiles of all rows, and the classes of equal shingle sets: (fingerprint, copies, first).

    ``first`` is the smallest (doc_id, text_key) of all classes that links connect with this one. With
    ``one_per_id``, a doc_id with several texts connects their classes too.
    """
    prepare(docs.sparkSession)
    profiles = materialize(_profiles(docs, width, coordinates), "profiles")
    linkable = profiles.filter(_can_link())
    classes = linkable.groupBy("fingerprint").agg(
        F.min(F.struct("doc_id", "text_key")).alias("rep"),
        F.count("*").alias("copies"),
        F.first("n_shingles").alias("n"),
        F.first("signature").alias("signature"),
    )
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    groups = connected_components(_collisions(classes, matches))
    links = _confirm(docs, classes, groups, width, percent, coordinates, matches)
    if one_per_id:
        text = F.xxhash64("fingerprint")
        several = linkable.groupBy("doc_id").agg(F.min(text).alias("low"), F.max(text).alias("high")).filter("low != high")
        repeated = materialize(linkable.join(several, "doc_id", "left_semi").select("doc_id", "fingerprint"), "repeated")
        repeated = materialize(join_class(repeated, classes.select("fingerprint", "node", "copies"), "fingerprint", "inner"), "repeated")
        leaders = materialize(repeated.groupBy("doc_id").agg(F.min("node").alias("leader")), "leaders")
        links = links.union(repeated.join(leaders, "doc_id").select(F.col("node").alias("a"), F.col("leader").alias("b")))
    components = connected_components(links)
    members = components.union(components.select(F.col("component").alias("node"), "component").distinct())
    members = materialize(members.join(classes.select("node", "rep"), "node"), "members")
    firsts = materialize(members.groupBy("component").agg(F.min("rep").alias("first")), "firsts")
    found = members.join(firsts, "component").select("node", "first")
    labelled = classes.join(found, "node", "left").select("fingerprint", "copies", F.coalesce("first", "rep").alias("first"))
    return profiles, materialize(labelled, "labelled")


def hash_family(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and shifts of the affine hashes whose minima make up a signature."""
    rng = np.random.default_rng(SEED)
    factor = rng.integers(0, 1 << 63, coordinates * MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return factor, rng.integers(0, 1 << 63, coordinates * MINIMA, dtype=np.uint64)


def signature(shingles: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A hash of each coordinate's minima and of its position, as 64-bit integers."""
    factor, shift = family
    best = np.full(len(factor), np.iinfo(np.uint64).max)
    for start in range(0, len(shingles), 2048):
        best = np.minimum(best, (shingles[start : start + 2048, None] * factor + shift).min(axis=0))
    best = best.reshape(-1, MINIMA)
    value = np.arange(len(best), dtype=np.uint64)
    for k in range(MINIMA):
        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + best[:, k])
    return value.view(np.int64)


def _profiles(docs: DataFrame, width: int, coordinates: int) -> DataFrame:
    family = hash_family(coordinates)

    def profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(text, width) for text in batch["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "text_key": batch["text_key"],
                    "n_shingles": [len(s) for s in sets],
                    "fingerprint": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                    "signature": [signature(s, family) if len(s) else None for s in sets],
                }
            )

    return docs.select(F.col("doc_id").cast("long"), "text", text_key().alias("text_key")).mapInPandas(
        profile, "doc_id long, text_key string, n_shingles long, fingerprint binary, signature array<long>"
    )


def _collisions(classes: DataFrame, matches: int) -> DataFrame:
    """Edges that connect at least all pairs of classes which share ``matches`` coordinate values.

    Values that only one class has can't collide. Of the m others of a class, in the order of their
    frequency, the m - matches + 1 rarest are posted (prefix) and the frequent rest is skipped: two
    classes with enough common values meet in a posted one. A class with m < matches has no partner.
    Each posting list becomes a star around its smallest class, never all its pairs.
    """
    values = classes.select("node", F.explode("signature").alias("value"))
    frequency = values.groupBy("value").agg(F.count("*").alias("n")).filter("n > 1")
    shared = values.join(frequency, "value").groupBy("node").agg(F.collect_list(F.struct("n", "value")).alias("shared"))
    posted = materialize(
        shared.filter(F.size("shared") >= matches)
        .withColumn("shared", F.slice(F.sort_array("shared"), F.lit(1), F.size("shared") - matches + 1))
        .select("node", F.explode("shared.value").alias("value")),
        "postings",
    )
    leaders = posted.groupBy("value").agg(F.min("node").alias("leader"))
    return (
        posted.join(leaders, "value")
        .filter("node != leader")
        .select(F.col("node").alias("a"), F.col("leader").alias("b"))
        .distinct()
    )


def _confirm(
    docs: DataFrame, classes: DataFrame, groups: DataFrame, width: int, percent: int, coordinates: int, matches: int
) -> DataFrame:
    """Star edges (a, b) of the classes that are linked, from the full sets of every candidate group.

    Small groups share a task, each with all its sets. A large group is cut into blocks by hash, and
    every two blocks meet in one task; a task holds two blocks at most.
    """
    members = groups.select("node", F.col("component").alias("grp")).union(
        groups.select(F.col("component").alias("node"), F.col("component").alias("grp")).distinct()
    )
    members = members.join(classes.select("node", "n", "fingerprint", "rep.doc_id", "rep.text_key"), "node")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sizes = members.groupBy("grp").agg(blocks.alias("blocks"), F.sum("n").alias("total"))
    members = materialize(members.join(sizes.select("grp", "blocks"), "grp"), "members")
    total = sizes.agg(F.sum("total")).first()[0] or 0
    bins = int(total // BLOCK_SHINGLES + 1) * 4

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()  # rows that repeat id and text meet in a task, one of them will do
        for batch in batches:
            batch = batch[~batch["node"].isin(seen)].drop_duplicates("node")
            seen.update(batch["node"])
            found = [shingle_set(text, width) for text in batch["text"]]
            right = [xxhash.xxh3_128_digest(s.tobytes()) == f for s, f in zip(found, batch["fingerprint"])]
            out = batch[["node", "grp", "blocks"]].assign(shingles=[s.tobytes() for s in found])
            yield out[np.array(right, dtype=bool)]

    full = (
        docs.select(F.col("doc_id").cast("long"), "text", text_key().alias("text_key"))
        .join(members.select("node", "grp", "blocks", "fingerprint", "doc_id", "text_key").hint("merge"), ["doc_id", "text_key"])
        .select("node", "grp", "blocks", "fingerprint", "text")
        .mapInPandas(sets, "node long, grp long, blocks int, shingles binary")
    )
    # A block b of k meets the pairs (0, b) ... (b, b) ... (b, k - 1).
    full = full.withColumn("block", F.when(F.col("blocks") > 1, F.expr("pmod(xxhash64(node), blocks)")).otherwise(0))
    full = full.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    full = full.select(
        "node",
        "grp",
        "block",
        "shingles",
        F.when(F.col("blocks") > 1, F.col("grp")).otherwise(F.expr(f"pmod(xxhash64(grp), {bins})")).alias("task"),
        (F.col("blocks") > 1).alias("large"),
        F.least("block", "other").alias("first"),
        F.greatest("block", "other").alias("second"),
    )

    family = hash_family(coordinates)

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        edges: list[tuple[int, int]] = []
        across = rows["first"].iat[0] != rows["second"].iat[0]
        for _, group in rows.groupby("grp", sort=False):
            group = group.drop_duplicates("shingles").sort_values("node")
            nodes = group["node"].tolist()
            found = [np.frombuffer(s, dtype=np.uint64) for s in group["shingles"]]
            side = group["block"].to_numpy() if across else None
            roots = link_sets(found, percent, family, matches, side)
            edges += [(nodes[i], nodes[r]) for i, r in enumerate(roots) if i != r]
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    return full.groupBy("large", "task", "first", "second").applyInPandas(links, "a long, b long")


def link_sets(
    sets: list[np.ndarray],
    percent: int,
    family: tuple[np.ndarray, np.ndarray],
    matches: int,
    side: np.ndarray | None = None,
) -> list[int]:
    """For each set the position of the first set of its component. With ``side``, only sets of unlike sides are compared.

    Sets that are connected already aren't compared again. A set with several partners counts its common
    shingles with all of them in one pass over an index from shingle to sets.
    """
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    sizes = np.array([len(s) for s in sets])
    signatures = np.stack([signature(s, family) for s in sets])
    starts = holders = None
    labels = np.arange(len(sets))
    for i in range(len(sets) - 1):
        small, large = np.minimum(sizes[i], sizes[i + 1 :]), np.maximum(sizes[i], sizes[i + 1 :])
        mask = (100 * small >= percent * large) & (labels[i + 1 :] != labels[i])
        if side is not None:
            mask &= side[i + 1 :] != side[i]
        partners = np.flatnonzero(mask) + i + 1
        if len(partners):
            partners = partners[(signatures[partners] == signatures[i]).sum(axis=1) >= matches]
        if len(partners) > 8 and starts is None:
            values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
            order = np.argsort(inverse, kind="stable")
            holders = np.repeat(np.arange(len(sets)), sizes)[order]
            starts = np.searchsorted(inverse[order], np.arange(len(values) + 1))
        if len(partners) > 8:
            at = np.searchsorted(values, sets[i])
            lists = [holders[a:b] for a, b in zip(starts[at].tolist(), starts[at + 1].tolist())]
            common = np.bincount(np.concatenate(lists), minlength=len(sets))[partners]
        else:
            common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in partners], dtype=int)
        linked = partners[100 * common >= percent * (sizes[i] + sizes[partners] - common)]
        if len(linked):
            tops = {root(i), *(root(j) for j in linked.tolist())}
            first = min(tops)
            for top in tops:
                parent[top] = first
            labels[np.isin(labels, list(tops))] = first
    return [root(i) for i in range(len(sets))]
