"""Connected components of an edge table, by alternating large-star and small-star steps.

The edges never leave the executors. Each round is a group minimum (combined before the shuffle) and a
join on the vertex; a hub's rows are split by adaptive skew handling. Each round is written to the shared
folder, so lineage doesn't grow and a lost executor costs one round at most; the round before is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("m")).withColumn("m", F.least("src", "m"))
    return both.join(least, "src").where("dst > src and dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src <> dst")
    least = down.groupBy("src").agg(F.min("dst").alias("m"))
    moved = down.join(least, "src").where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return moved.unionByName(least.select("src", F.col("m").alias("dst"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): for every end of an edge, the least node reachable.

    `edges` has columns src and dst (long); repeats, loops and either direction are allowed; nulls are
    ignored. A node that has only a loop, or none, isn't in the result. Empty in, empty out.
    """
    e = cut(edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src <> dst").distinct(), "edges")
    for _ in range(rounds):
        sums = e.agg(F.count("*").alias("n"), F.count_distinct("src").alias("k")).first()
        hanging = e.join(e.select(F.col("src").alias("dst")), "dst", "left_semi").limit(1).count() if sums.n == sums.k else 1
        if not hanging:  # every node has one edge, to a node that has none: stars only
            roots = e.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
            return e.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots)
        e, old = cut(_small_star(_large_star(e)), "edges"), e
        drop(old)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
