"""Connected components by distributed union-find: hooking and pointer jumping over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id in ``edges`` (a, b): the smallest id that links reach.

    Each round turns the edges into edges between current roots, hooks every root onto the smallest
    root next to it and jumps pointers until trees are flat; rounds at least halve what is left of
    each component. A vertex with very many edges only meets partial aggregation.
    """
    both = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = materialise(both, "edges")
    parents = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = materialise(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("root")), "hooks")
        while True:  # pointer jumping: parents only get smaller, so there are no cycles
            up = hook.select(F.col("id").alias("root"), F.col("root").alias("top"))
            jumped = materialise(hook.join(up, "root").select("id", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")), "hooks")
            moved = not jumped.filter("moved").isEmpty()
            hook = jumped.drop("moved")
            if not moved:
                break
        if parents is None:
            parents = hook
        else:  # earlier vertices follow their root
            up = hook.withColumnRenamed("root", "top").withColumnRenamed("id", "root")
            parents = materialise(parents.join(up, "root", "left").select("id", F.coalesce("top", "root").alias("root")), "parents")
        a = hook.select(F.col("id").alias("a"), F.col("root").alias("ra"))
        b = hook.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        edges = edges.join(a, "a").join(b, "b").filter("ra <> rb")
        edges = materialise(edges.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    return parents if parents is not None else edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
