"""Connected components of links, by contraction with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import cut


def contract(edges: DataFrame) -> DataFrame:
    """`(node, root)` for each node of `edges (a, b)`: root is the smallest node of its component.

    Every node hooks onto its smallest neighbour, chains of hooks are halved by pointer jumping, links are renamed and thinned, until
    none is left; each round at least halves the nodes that have links. Nulls and loops relate nothing; repeated links count once; an
    empty table gives an empty one. Lineage is cut after every round.
    """
    edges = cut(edges.where("a IS NOT NULL AND b IS NOT NULL AND a != b").select("a", "b").distinct(), "links")
    maps = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hook = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root")), "hooks")
        while True:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = cut(hook.join(up, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "jumps")
            hook = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        maps.append(hook)
        ends = edges.join(hook.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(hook.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        edges = cut(ends.where("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    total = maps.pop()
    while maps:  # a later map speaks of an earlier map's roots only, a fraction of the one before
        lower = maps.pop()
        later = total.select(F.col("node").alias("root"), F.col("root").alias("top"))
        total = cut(lower.join(later, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")
    return total


def star(keyed: DataFrame, key: str, node: str) -> DataFrame:
    """`(a, b)`: each node beside the smallest that shares its key: links for a key's nodes without all pairs of them."""
    seen = keyed.where(F.col(key).isNotNull()).select(key, node).distinct()
    least = seen.groupBy(key).agg(F.min(node).alias("a"), F.count("*").alias("n")).where("n > 1")
    return seen.join(least, key).where(F.col(node) != F.col("a")).select("a", F.col(node).alias("b"))
