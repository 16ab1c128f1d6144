"""Connected components of an edge table, without bringing edges or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label every node of ``edges`` (a long, b long) with the smallest node it can reach.

    Returns (node, component) for nodes that have an edge and are not the smallest of their component;
    every other node is its own component. Null ends and loops are ignored, repeated edges count once;
    an empty table gives an empty table.

    Alternating large-star and small-star steps: each joins a node's neighbours to the smallest one, so
    the number of edges never grows. A round is aggregated map side, joined on the node and written to the
    shared folder. So are the smallest neighbours: adaptive execution can split a hub's rows in a join of
    two shuffled tables, but not where one side is aggregated in the same stage.
    """
    stars = materialize(
        edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .filter("a is not null and b is not null and a != b")
        .distinct(),
        "edges",
    )
    for _ in range(max_rounds):
        if _is_star_forest(stars):
            return stars.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        stars = materialize(_small_star(_large_star(stars)), "edges")
    raise RuntimeError(f"no convergence after {max_rounds} rounds")


def _is_star_forest(stars: DataFrame) -> bool:
    """Every node has one parent and no parent has a parent."""
    roots = stars.select(F.col("lo").alias("hi")).distinct()
    if stars.join(roots, "hi", "left_semi").limit(1).count():
        return False
    return not stars.groupBy("hi").count().filter("count > 1").limit(1).count()


def _large_star(stars: DataFrame) -> DataFrame:
    both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
        stars.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    smallest = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "smallest")
    return (
        both.filter("v > u").join(smallest, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
    )


def _small_star(stars: DataFrame) -> DataFrame:
    smallest = materialize(stars.groupBy("hi").agg(F.min("lo").alias("m")), "smallest")
    moved = stars.join(smallest, "hi").filter("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.union(smallest.select("hi", F.col("m").alias("lo"))).distinct()
