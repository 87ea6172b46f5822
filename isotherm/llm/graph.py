"""Connected components of an edge table, without collecting a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotherm.session import materialize

#: a round at least halves the height of every tree; a chain of 2^40 nodes would need so many
MAX_ROUNDS = 80


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``a, b`` edges; the root is the smallest node reachable.

    Alternates two steps until nothing changes: every node links its larger neighbours to its smallest neighbour, then
    its smaller neighbours to their smallest. Both are one aggregation and one join by node; each round is a written table.
    Self-loops and repeated edges are harmless; no edges give no rows.
    """
    links = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("to")).distinct(), "links")
    for _ in range(MAX_ROUNDS):
        both = links.unionByName(links.select(F.col("to").alias("node"), F.col("node").alias("to")))
        least = both.groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("low"))
        # larger neighbours of a node hang on the least of all
        large = both.where("to > node").join(least, "node").select(F.col("to").alias("node"), F.col("low").alias("to")).where("node <> to").distinct()
        small_least = large.groupBy("node").agg(F.min("to").alias("low"))
        small = large.join(small_least, "node").select(F.explode(F.array(F.struct("node", F.col("low").alias("to")), F.struct(F.col("to").alias("node"), F.col("low").alias("to")))).alias("e"))
        turned = materialize(small.select("e.*").where("node <> to").distinct(), "links")
        # done when every node has one link and nothing hangs on a node that hangs itself
        manifold = turned.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1)
        chained = turned.select(F.col("to").alias("node")).distinct().join(turned.select("node").distinct(), "node").limit(1)
        links = turned
        if manifold.isEmpty() and chained.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return links.select("node", F.col("to").alias("root")).unionByName(links.select(F.col("to").alias("node"), F.col("to").alias("root")).distinct())
