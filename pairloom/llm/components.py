"""Connected components by alternating large-star and small-star steps, each a distributed join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written


def _moved(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Each v to the least m of its u. The table of these is written first, so that the join has two plain
    sides: Spark broadcasts a small one, and its skew join cuts up the edges of a node that has many."""
    return edges.join(written(least, "least"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to the least of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _moved(both.where("v > u"), least).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the least of these."""
    edges = written(edges, "edges")
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return _moved(edges, least).unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 64) -> DataFrame:
    """node and root (the least node that is connected to it) of each node that has an edge to another.

    Nodes may be of any ordered type; edges may repeat and point either way; those with a null or
    between a node and itself do not count. Each round's edges are written to the shared folder, so no
    round depends on executors of an earlier one; rounds grow with the logarithm of the nodes.
    """
    high, low = F.greatest(a, b), F.least(a, b)
    now = written(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(high.alias("u"), low.alias("v")).where("u != v").distinct(), "edges")
    state = None
    for _ in range(most):
        now = written(_small(_large(now)), "edges")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = mark
    raise RuntimeError(f"components did not settle in {most} rounds")
