"""Connected components of a graph that is spread over a cluster."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """``edges``: columns a, b (long, in either direction, repeats allowed). Returns node, root for every node that has
    an edge to another node: root is the smallest node of its component.

    Every round lets each node take the smallest root among its own and its neighbours' and then jumps to the root of
    that root, so chains shrink by doubling. Rounds end when nothing changes; each is written to the shared checkpoint
    folder, so a lost executor costs one round at most. A hub costs no single task: roots meet by minimum, which is
    combined before the shuffle, and the joins have the small table (one row per node) on one side.
    """
    links = edges.where(F.col("a") != F.col("b"))
    links = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
                        .distinct())
    roots = materialize(links.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")))
    while True:
        offered = (links.join(roots.select(F.col("node").alias("b"), "root"), "b")
                   .select(F.col("a").alias("node"), "root"))
        lowest = roots.union(offered).groupBy("node").agg(F.min("root").alias("root"))
        upper = lowest.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = lowest.join(upper, "root", "left").select("node", F.least("root", F.coalesce("above", "root")).alias("new"))
        step = materialize(jumped.join(roots, "node").select("node", F.col("new").alias("root"),
                                                             (F.col("new") < F.col("root")).alias("changed")))
        roots = step.select("node", "root")
        if not step.where("changed").limit(1).count():
            return roots
