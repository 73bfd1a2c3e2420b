"""Connected components of the product graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmatch.operators.ranking import ordinal
from pairmatch.session import settle, unbroadcast


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.where("v > u").join(unbroadcast(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    ).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link the smaller neighbours of a node, and the node, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    siblings = down.join(unbroadcast(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return siblings.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def component_roots(pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``id, root`` for every item of the edge table; the root is the smallest id.

    Alternating large-star and small-star rounds need O(log^2 n) rounds whatever the
    diameter, and only ever aggregate a node's neighbours to a minimum, so a hub item is
    combined map-side. Each round is checkpointed; the loop ends when the edges are stable.
    """
    ends = pairs.where("id1 is not null and id2 is not null")
    edges = settle(
        ends.where("id1 <> id2")
        .select(F.greatest("id1", "id2").alias("u"), F.least("id1", "id2").alias("v"))
        .distinct()
    )
    before = None
    for _ in range(max_rounds):
        edges = settle(_small_star(_large_star(edges)))
        state = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = ends.select(F.explode(F.array("id1", "id2")).alias("id")).distinct()
    found = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return nodes.join(unbroadcast(found), "id", "left").select(
        "id", F.coalesce("root", "id").alias("root")
    )


def component_ids(pairs: DataFrame) -> DataFrame:
    """Add a dense ``component_id`` (0, 1, ... by smallest item id) to every pair.

    All edges count, whatever their label.
    """
    roots = settle(component_roots(pairs))
    numbered = ordinal(roots.select("root").distinct(), [], [F.col("root")], "_n").select(
        "root", (F.col("_n") - 1).alias("component_id")
    )
    lookup = roots.join(unbroadcast(numbered), "root").select(F.col("id").alias("id1"), "component_id")
    return pairs.join(unbroadcast(lookup), "id1").select(*pairs.columns, "component_id")
