"""Approximate nearest neighbours by a permutation index: ordered nearest pivots, inverted files, footrule, rerank."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staylens.llm.common import materialize, prepare
from staylens.llm.embedding_dedup import usable

#: Pivots are that many vectors of the table, those with the smallest hash of their id; a vector is
#: represented by its nearest ones, in order.
PIVOTS = 1_024
NEAREST = 64
#: The share of a block's vectors that is reranked for a query.
RERANK_SHARE = 0.16
#: Rows of a block whose cosines with a query tell what a footrule distance means, in so many groups of them, and how
#: many deviations above a group's mean a row of its distance may lie.
SAMPLE = 512
GROUPS = 16
DEVIATIONS = 2
#: Vectors and queries that meet in a task.
BLOCK = 32_768
QUERIES = 16_384
LEAST_BLOCKS = 6


@dataclass
class PermutationIndex:
    """The pivots, and (vec_id, block, vector, pivots): every vector with its nearest pivots in order."""

    pivots: dict[int, np.ndarray]
    rows: DataFrame
    blocks: int


def build(embeddings: DataFrame, pivots: int = PIVOTS, nearest: int = NEAREST) -> PermutationIndex:
    """Index every usable row of ``embeddings`` (vec_id, embedding); see search() for what isn't usable.

    Pivots are chosen for each vector length: at most ``pivots`` rows, which alone reach the driver.
    """
    spark = prepare(embeddings.sparkSession)
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    dims = [row["dim"] for row in rows.select(F.size("v").alias("dim")).distinct().collect()]
    chosen: dict[int, np.ndarray] = {}
    for dim in sorted(dims):
        sample = rows.filter(F.size("v") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
        chosen[dim] = np.array([row["v"] for row in sample])
    blocks = max(LEAST_BLOCKS, -(-rows.count() // BLOCK))

    def order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data, near = [], []
            for dim, group in batch.groupby(batch["v"].map(len), sort=False):
                vectors = np.array(group["v"].tolist())
                cosine = vectors / np.sqrt((vectors**2).sum(axis=1, keepdims=True)) @ unit(chosen[dim]).T
                ordered = np.argsort(-cosine, axis=1, kind="stable")[:, :nearest].astype(np.int16)
                data += list(zip(group.index, (v.tobytes() for v in vectors), (o.tobytes() for o in ordered)))
            data.sort(key=lambda row: row[0])
            yield pd.DataFrame(
                {"vec_id": batch["vec_id"], "vector": [row[1] for row in data], "pivots": [row[2] for row in data]}
            )

    indexed = rows.mapInPandas(order, "vec_id long, vector binary, pivots binary")
    indexed = indexed.withColumn("block", F.expr(f"cast(pmod(xxhash64(vec_id, 1), {blocks}) as int)"))
    return PermutationIndex(chosen, materialize(indexed, "index"), blocks)


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors**2).sum(axis=1, keepdims=True))


def search(index: PermutationIndex, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each of the ``queries`` (rows of the index).

    Score is the inner product in double precision, ties go to the smaller vec_id; a query's own row is no
    candidate. Each block of the index posts its vectors under their pivots, adds up the footrule distances
    to the queries along the posting lists, and reranks RERANK_SHARE of the block by the score, at whatever size,
    but more than ``k`` rows; the best of all blocks remain. So the rows reranked grow with the index. They are those with the
    largest length times cosine, where the cosine is a high estimate from the footrule, see reach(): among
    vectors of one length the nearest by footrule, else long vectors at larger angles too.

    Null, empty and zero vectors, vectors with null or non-finite components, and rows with a null id take no
    part. Only vectors of one length are compared. Rows that repeat an id are candidates each, but for the
    query's own id, and queries each: every row of ``queries`` gets its own ranks from 1. An empty table gives an empty table; other columns are ignored.
    """
    asked = materialize(queries.withColumn("query_row", F.monotonically_increasing_id()), "queries")
    parts = asked.count() // QUERIES + 1
    blocks = index.blocks
    asked = asked.withColumn("part", F.expr(f"cast(pmod(xxhash64(vec_id, 2), {parts}) as int)"))
    asked = asked.drop("block").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = index.rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def nearest(candidates: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        found = []
        for size, own in wanted.groupby(wanted["vector"].map(len), sort=False):
            block = candidates[candidates["vector"].map(len) == size].sort_values("vec_id")
            if len(block):
                best = search_block(block, own, k)
                found.append(best.assign(query_row=own["query_row"].to_numpy()[best["query"]]))
        if not found:
            return pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "score": []})
        return pd.concat(found)[["query_row", "query_id", "vec_id", "score"]]

    best = (
        rows.groupBy("block", "part")
        .cogroup(asked.groupBy("block", "part"))
        .applyInPandas(nearest, "query_row long, query_id long, vec_id long, score double")
    )
    by_score = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def postings(pivots: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each pivot the positions of the vectors that have it, and its ranks there."""
    flat = pivots.ravel().astype(np.int64)
    order = np.argsort(flat, kind="stable")
    position, rank = np.divmod(order, pivots.shape[1])
    edges = np.flatnonzero(np.diff(flat[order])) + 1
    return {
        int(flat[order[a]]): (position[a:b], rank[a:b].astype(np.int32))
        for a, b in zip(np.concatenate([[0], edges]), np.append(edges, len(order)))
    }


def reach(nearness: np.ndarray, cosine: np.ndarray, top: int) -> np.ndarray:
    """The cosine that a row may have at each nearness 0..top, from the nearness and cosine of sampled rows.

    Mean plus DEVIATIONS in groups of like nearness, never falling, and 1 at the top; a small slope keeps
    the order by nearness where it would be flat.
    """
    groups = [g for g in np.array_split(np.argsort(nearness, kind="stable"), GROUPS) if len(g)]
    at = np.array([nearness[g].mean() for g in groups] + [top])
    high = np.array([cosine[g].mean() + DEVIATIONS * cosine[g].std() for g in groups] + [1.0])
    steps = np.arange(top + 1)
    return np.interp(steps, at, np.maximum.accumulate(np.minimum(high, 1.0))) + 1e-6 * steps


def search_block(block: pd.DataFrame, queries: pd.DataFrame, k: int, chunk: int = 128) -> pd.DataFrame:
    """The best ``k`` of a block for each query, by footrule and length and then by inner product; ``query`` is its place."""
    ids = block["vec_id"].to_numpy()
    vectors = np.stack([np.frombuffer(v) for v in block["vector"]])
    lists = postings(np.stack([np.frombuffer(p, dtype=np.int16) for p in block["pivots"]]))
    # The query's own row may be among them.
    keep = min(len(ids), max(k + 1, int(np.ceil(RERANK_SHARE * len(ids)))))
    lengths = np.sqrt((vectors**2).sum(axis=1))
    sample = np.random.default_rng(len(ids)).permutation(len(ids))[:SAMPLE]
    directions = unit(vectors[sample])
    out = []
    for start in range(0, len(queries), chunk):
        part = queries.iloc[start : start + chunk]
        asked = np.stack([np.frombuffer(v) for v in part["vector"]])
        permuted = np.stack([np.frombuffer(p, dtype=np.int16) for p in part["pivots"]])
        width = permuted.shape[1]
        # The footrule sums |rank difference| over all pivots, where an absent pivot has rank `width`. A pivot
        # that both have takes 2 * (width - larger rank) off the sum that they have without any in common.
        nearness = np.zeros((len(part), len(ids)), dtype=np.int32)
        if keep < len(ids):
            for pivot, (query, query_rank) in postings(permuted).items():
                if pivot in lists:
                    position, rank = lists[pivot]
                    nearness[np.ix_(query, position)] += 2 * (width - np.maximum(query_rank[:, None], rank))
            cosine = unit(asked) @ directions.T
        for q, (query_id, vector) in enumerate(zip(part["vec_id"], asked)):
            near = np.arange(len(ids))
            if keep < len(ids):
                high = reach(nearness[q, sample], cosine[q], width * (width + 1))
                near = np.argpartition(-lengths * high[nearness[q]], keep - 1)[:keep]
            near = near[ids[near] != query_id]
            score = vectors[near] @ vector
            if len(near) > k:  # all that tie with the k-th stay
                near = near[score >= np.partition(score, -k)[-k] - 1e-9 * (1 + np.abs(score).max())]
            score = (vectors[near] * vector).cumsum(axis=1)[:, -1]  # summed in the order of the components
            top = np.lexsort((ids[near], -score))[:k]
            out.append(pd.DataFrame({"query": start + q, "query_id": query_id, "vec_id": ids[near][top], "score": score[top]}))
    return pd.concat(out)
