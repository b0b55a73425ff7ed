"""Connected components by contraction: hook every node to its least neighbour, shorten the pointers, relabel the edges, repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, write_table

JUMPS = 3


def components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) -> (node, root): root is the least node of the component; nodes without edges aren't listed.

    Each round at least halves the nodes that still have edges. Tables of each round are written in the shared folder, so
    a lost executor costs one round at most. A hub's edges meet in partial aggregates and in joins that can be split.
    """
    spark = edges.sparkSession
    current = write_table(spark, edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    roots: DataFrame | None = None
    while not current.isEmpty():
        both = current.select("a", "b").unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root"))
        hooks = write_table(spark, hooks, "hooks")
        for _ in range(JUMPS):
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("up"))
            jumped = write_table(spark, hooks.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "hooks")
            drop_tables(spark, hooks)
            hooks = jumped
        left, right = hooks.select(F.col("node").alias("a"), F.col("root").alias("ra")), hooks.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges_next = current.join(left, "a").join(right, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        following = write_table(spark, edges_next, "edges")
        if roots is None:
            joined = hooks
        else:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("up"))
            joined = write_table(spark, roots.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "roots")
            drop_tables(spark, roots, hooks)
        drop_tables(spark, current)
        roots, current = joined, following
    if roots is None:
        return spark.createDataFrame([], "node long, root long")
    return roots
