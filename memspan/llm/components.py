"""Connected components of an edge table, by alternating large and small stars.

Every step is an aggregation with map-side partial minima and an equi-join back, so a vertex
with very many neighbours is never gathered in one task; adaptive execution splits its side of
the join. Each round is written to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspan.llm.durable import stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, component) for every vertex of ``edges``; component is its smallest vertex.

    Loops and repeated edges change nothing; null ends are dropped; without edges the result
    is empty. The number of rounds grows with the logarithm of the longest path; they end when
    every edge leads to a vertex that has no smaller neighbour.
    """
    pairs = stored(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    while _unfinished(pairs):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = _dealt_anew(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        parents = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(_dealt_anew(parents), "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        pairs = stored(small.unionByName(parents.select("u", F.col("m").alias("v"))).distinct(), "edges")
    roots = pairs.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(roots)


def _unfinished(pairs: DataFrame) -> bool:
    """Whether a vertex has several parents, or a parent and children; in one aggregation with partial results."""
    up = pairs.select(F.col("u").alias("k"), "v", F.lit(True).alias("up"))
    down = pairs.select(F.col("v").alias("k"), F.lit(None).cast("long").alias("v"), F.lit(False).alias("up"))
    seen = up.unionByName(down).groupBy("k").agg(F.min("v").alias("x"), F.max("v").alias("y"), F.bool_or("up").alias("child"), F.bool_or(~F.col("up")).alias("parent"))
    return seen.where("x <> y OR (child AND parent)").limit(1).count() > 0


def _dealt_anew(lowest: DataFrame) -> DataFrame:
    """The same rows with a key that the planner does not know to be partitioned: the join then has
    an exchange on either side, and adaptive execution may split a vertex with many edges."""
    return lowest.select(F.bitwise_not(F.bitwise_not("u")).alias("u"), "m")
