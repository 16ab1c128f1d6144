"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosines, distributed components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import join_class, materialize, prepare
from staylens.llm.components import connected_components

#: A pair at the threshold is missed with this probability; closer pairs less often.
MISS = 1e-4
#: Vectors that a bucket holds on average. More vectors take more signs per table, and so more tables.
BUCKET = 256
#: A larger bucket is cut into blocks that are compared pair by pair.
BLOCK = 2_048
#: Rows of small buckets that share a task.
TASK_ROWS = 100_000
SEED = 5


def usable(vector: Column) -> Column:
    """Whether the vector takes part: not null or empty, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def table_plan(vectors: int, threshold: float, bucket: int = BUCKET, miss: float = MISS) -> tuple[int, int]:
    """Signs per table and tables, for so many vectors: buckets stay small and recall stays as stated."""
    bits = min(30, max(2, math.floor(math.log2(max(vectors, 1) / bucket + 1))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-agree))


def near_duplicates(embeddings: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``embeddings`` (vec_id long, embedding array).

    Two rows are linked if the cosine of their vectors, in double precision, is at least the threshold. n_links
    counts the other rows a row is linked with; component_id is the smallest vec_id reachable; kept marks it.
    Equal vectors are compared once and counted as often as they come.

    Rows with a null, empty or zero vector, with a null or non-finite component, or with a null vec_id link
    with nothing (for a null vec_id component_id is null and kept true). Vectors of unlike length don't link.
    Rows that repeat a vec_id are each counted and form one node. An empty table gives an empty table; labels
    and other columns are ignored.
    """
    prepare(embeddings.sparkSession)
    part = F.col("vec_id").isNotNull() & usable(F.col("embedding"))
    rows = embeddings.select(F.col("vec_id").cast("long"), F.when(part, F.col("embedding").cast("array<double>")).alias("v"))
    bits, tables = table_plan(rows.filter("v is not null").count(), threshold)
    keyed = materialize(rows.mapInPandas(_key, "vec_id long, key binary, vector binary"), "vectors")
    classes = keyed.filter("key is not null").groupBy("key").agg(
        F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("vector").alias("vector")
    )
    hashed = materialize(
        classes.mapInPandas(
            _hash(bits, tables), "key binary, node long, copies long, vector binary, dim int, codes array<int>"
        ),
        "codes",
    )
    found = materialize(_compare(hashed, bits, threshold), "links")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    # A vec_id with several vectors connects their classes.
    vector = F.xxhash64("key")
    usable_rows = keyed.filter("key is not null").select("vec_id", "key")
    several = usable_rows.groupBy("vec_id").agg(F.min(vector).alias("low"), F.max(vector).alias("high")).filter("low != high")
    several = materialize(usable_rows.join(several, "vec_id", "left_semi"), "repeated")
    several = join_class(several, hashed.select("key", "node", "copies"), "key", "inner")
    edges = found.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    components = connected_components(edges.union(several.select(F.col("vec_id").alias("a"), F.col("node").alias("b"))))
    labelled = hashed.select("key", "node", "copies").join(links, "key", "left").join(components, "node", "left")
    labelled = labelled.select(
        "key",
        "copies",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("component_id"),
    )
    out = join_class(keyed.select("vec_id", "key"), materialize(labelled, "labelled"), "key").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.expr("vec_id = component_id"), F.lit(True)))


def _key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The vector's bytes and a 128-bit key of them."""
    for batch in batches:
        # Adding 0 turns -0 into 0.
        data = [None if v is None else (np.asarray(v, dtype=np.float64) + 0.0).tobytes() for v in batch["v"]]
        keys = [None if d is None else xxhash.xxh3_128_digest(d) for d in data]
        yield pd.DataFrame({"vec_id": batch["vec_id"], "key": keys, "vector": data}).astype({"vec_id": "Int64"})


def _hash(bits: int, tables: int):
    """In each table a vector's code has a bit per hyperplane: the side it lies on."""

    def codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            out = []
            for data in batch["vector"]:
                vector = np.frombuffer(data)
                dim = len(vector)
                if dim not in planes:
                    planes[dim] = np.random.default_rng([SEED, dim]).normal(size=(tables * bits, dim))
                sides = (planes[dim] @ (vector / np.abs(vector).max()) > 0).reshape(tables, bits)
                out.append((sides @ (1 << np.arange(bits))).astype(np.int32))
            yield batch.assign(dim=[len(d) // 8 for d in batch["vector"]], codes=out)

    return codes


def _compare(hashed: DataFrame, bits: int, threshold: float) -> DataFrame:
    """(key, node, links, root) from every bucket for the classes that link within it, partial sums.

    A pair counts in the first table that its vectors share, so no pairs need to be gathered. A bucket emits a
    row per class at most. Small buckets share tasks; a large one is cut into blocks by hash, and every two
    blocks meet in one task.
    """
    buckets = hashed.select("key", "dim", F.posexplode("codes").alias("table", "code"))
    large = buckets.groupBy("dim", "table", "code").count().filter(F.col("count") > BLOCK)
    large = large.select("dim", "table", "code", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    split = buckets.join(large, ["dim", "table", "code"]).groupBy("key")
    split = split.agg(F.map_from_entries(F.collect_list(F.struct("table", "blocks"))).alias("blocks"))
    rows = hashed.join(split, "key", "left").withColumn(
        "blocks", F.coalesce("blocks", F.create_map().cast("map<int,int>"))
    )
    tables = F.size("codes")
    tasks = F.expr(f"cast(ceil({hashed.count()}L * size(codes) / {TASK_ROWS}D) as int)")
    rows = rows.withColumn("table", F.explode(F.sequence(F.lit(0), tables - 1)))
    rows = rows.withColumn("code", F.element_at("codes", F.col("table") + 1))
    rows = rows.withColumn("blocks", F.coalesce(F.element_at("blocks", F.col("table")), F.lit(1)))
    rows = rows.withColumn("block", F.expr("cast(pmod(xxhash64(key), blocks) as int)"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    alone = F.col("blocks") == 1
    rows = rows.withColumn("tasks", tasks).select(
        "key", "node", "copies", "vector", "codes", "dim", "table", "code", "block",
        F.when(alone, F.lit(-1)).otherwise(F.col("table")).alias("t"),
        F.when(alone, F.expr("pmod(xxhash64(dim, table, code), greatest(1, tasks))")).otherwise(F.col("code")).alias("c"),
        F.when(alone, F.lit(0)).otherwise(F.col("dim")).alias("d"),
        F.least("block", "other").alias("first"),
        F.greatest("block", "other").alias("second"),
    )

    def links(task: pd.DataFrame) -> pd.DataFrame:
        across = task["first"].iat[0] != task["second"].iat[0]
        out = []
        for (_, table, _), bucket in task.groupby(["dim", "table", "code"], sort=False):
            if len(bucket) > 1:
                found = link_bucket(bucket, int(table), threshold, across)
                if found is not None:
                    out.append(found)
        if not out:
            return pd.DataFrame({"key": [], "node": [], "links": [], "root": []})
        return pd.concat(out)

    return rows.groupBy("d", "t", "c", "first", "second").applyInPandas(
        links, "key binary, node long, links long, root long"
    )


def link_bucket(bucket: pd.DataFrame, table: int, threshold: float, across: bool) -> pd.DataFrame | None:
    """Links that each class of a bucket has first in this table, and the smallest node it reaches by them."""
    vectors = np.stack([np.frombuffer(v) for v in bucket["vector"]])
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    norms = np.sqrt((vectors**2).sum(axis=1))
    codes = np.stack(bucket["codes"].to_numpy())
    side = bucket["block"].to_numpy()
    n = len(vectors)
    left, right = [], []
    for start in range(0, n, 512):
        part = slice(start, start + 512)
        cosine = (vectors[part] @ vectors.T) / (norms[part, None] * norms)
        i, j = np.nonzero(cosine >= threshold)
        i += start
        wanted = i < j
        if across:
            wanted &= side[i] != side[j]
        left.append(i[wanted]), right.append(j[wanted])
    i, j = np.concatenate(left), np.concatenate(right)
    first = np.zeros(len(i), dtype=bool)
    for start in range(0, len(i), 100_000):
        part = slice(start, start + 100_000)
        first[part] = (codes[i[part]] == codes[j[part]]).argmax(axis=1) == table
    i, j = i[first], j[first]
    if not len(i):
        return None
    copies, nodes = bucket["copies"].to_numpy(), bucket["node"].to_numpy()
    links = np.bincount(i, copies[j], minlength=n) + np.bincount(j, copies[i], minlength=n)
    root = nodes.copy()
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        if (root == before).all():
            break
    linked = links > 0
    return pd.DataFrame(
        {"key": bucket["key"][linked], "node": nodes[linked], "links": links[linked].astype("int64"), "root": root[linked]}
    )
