"""Connected components of a large edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import discard, join_hot, measured, scratch

MOST_ROUNDS = 60


def _least(edges: DataFrame) -> tuple[DataFrame, dict]:
    """(u, m, n): each node's smallest neighbour and its number of edges, and totals; partial sums come before the shuffle.

    odd is 0 where the edges, taken both ways, are stars about their smallest nodes.
    """
    smaller, larger = F.count_if(F.col("v") < F.col("u")), F.count_if(F.col("v") > F.col("u"))
    by = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"), ((smaller > 1) | ((smaller > 0) & (larger > 0))).alias("odd"))
    return measured(by, "least", total=F.sum("n"), most=F.max("n"), odd=F.count_if("odd"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge; root is the component's smallest node.

    edges: (u, v) of any ordered type, in either direction, with repeats; an edge with a null end is none.
    What each round writes goes to the shared folder, so a lost executor costs one round at most, and is
    deleted a round later. A node's edges meet its smallest neighbour by join_hot, so hot centres are split.
    """
    now = scratch(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(MOST_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, seen = _least(both)
        if not seen["odd"]:
            break
        large = join_hot(both, least.drop("odd"), "u", seen).where(F.col("v") > F.col("u"))
        large = scratch(large.select(F.col("v").alias("u"), F.least("u", "m").alias("v")), "large")
        lower, seen = _least(large)
        small = join_hot(large, lower.drop("odd"), "u", seen).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct(), "small")
        discard(now, least, large, lower)
        now = after
    else:
        raise RuntimeError(f"no end after {MOST_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
