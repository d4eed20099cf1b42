"""Connected components of an edge table by randomised contraction, all of it in written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Rounds halve the nodes or better on average: this many are never needed.
ROUNDS = 1000


def components(edges: DataFrame, folder: str) -> DataFrame:
    """node, root for every node of edges (a, b); nodes are connected exactly if their roots are equal.

    In each round every node points to the one of itself and its neighbours that comes first in an order drawn
    anew, edges move to the nodes pointed to, and those within one node go; a constant share of the nodes
    goes on average, so rounds grow with the logarithm of the largest component. Hubs are pre-aggregated.
    An empty table gives an empty one. Edges that are left after ROUNDS rounds raise: no label is given out that is not final.
    """
    spark = edges.sparkSession
    current = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), folder, "edges")
    label = None
    for r in range(ROUNDS + 1):
        if label is not None and current.isEmpty():
            break
        if r == ROUNDS:
            raise RuntimeError(f"edges are left after {ROUNDS} rounds")
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(r)).alias("o"), F.col(c).alias("n"))  # noqa: B023, E731
        ways = current.select("a", order("b").alias("to")).union(current.select(F.col("b").alias("a"), order("a").alias("to")))
        step = ways.groupBy("a").agg(F.min("to").alias("to")).select(F.col("a").alias("node"), F.least(order("a"), F.col("to")).getField("n").alias("root"))
        step = cut(step, folder, f"step{r}")
        if label is None:
            label = step
        else:
            later = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            label = cut(label.join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root")), folder, f"label{r}")
        a, b = (step.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        moved = current.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        current = cut(moved.distinct(), folder, f"edges{r}")
    return label if label is not None else spark.createDataFrame([], "node long, root long")
