"""Connected components of a graph of pairs, in rounds of joins and aggregates.

Alternating star contraction: a *large star* links the larger neighbours of each
node to the smallest node around it, a *small star* does so with the smaller
neighbours and the node itself.  The number of rounds grows with the logarithm of
the longest path.  A node's neighbours are never collected: the smallest one is a
combining aggregate, and it is joined back to the pairs, those of a crowded centre in
parts.  The rounds end when all pairs are stars, which one aggregate over nodes tells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.operators.skew import spread_join
from pagesift.sources.scratch import cut


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (columns ``a``, ``b``, of one type).

    ``component`` is the smallest node of the component.  Pairs of a node with
    itself and pairs with a null are ignored; order and repeats do not matter.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = cut(pairs)
    while not are_stars(pairs):
        pairs = cut(small_star(large_star(pairs)))
    stars = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.unionByName(centres)


def are_stars(pairs: DataFrame) -> bool:
    """Whether every ``u`` has one pair and is no other pair's ``v``; then each ``v`` is the smallest of its component."""
    ends = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("u").alias("node"), F.lit(1).alias("up")),
                F.struct(F.col("v").alias("node"), F.lit(0).alias("up")),
            )
        ).alias("e")
    ).select("e.*")
    nodes = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return nodes.filter("ups > 1 or (ups = 1 and least = 0)").isEmpty()


def large_star(pairs: DataFrame) -> DataFrame:
    """Pairs (u, v), u > v: every neighbour larger than u goes to the smallest of u and its neighbours."""
    around = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    moved = spread_join(around.filter("v > u"), least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.distinct()


def small_star(pairs: DataFrame) -> DataFrame:
    """Pairs (u, v), u > v: u and its smaller neighbours go to the smallest of them."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = pairs.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
