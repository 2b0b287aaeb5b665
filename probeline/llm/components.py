"""Connected components of a table of links, without bringing it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probeline.llm.common import release, spill


def components(links: DataFrame, a: str = "a", b: str = "b", turns: int | None = None) -> DataFrame:
    """(node, root): each node of a link with the smallest node that it reaches.

    Alternating large and small stars: every node hangs its larger, then its
    smaller neighbours under its smallest one, until no link changes.  A star
    settles in one turn, a chain of n in about log n.  Links to itself are
    passed over, repeated ones count once, an empty table gives no rows.

    With `turns`, so many are made at most: then nodes of one root are in one
    component, but a component may have several roots still.
    """
    edges = links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where(F.col("u") < F.col("v")).distinct()
    edges = spill(edges, "edges")
    mark, turn = None, 0
    while True:
        turn += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: larger neighbours go under the smallest of the node and its neighbours
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("m").alias("u"), "v").where(F.col("u") < F.col("v")).distinct()
        # small star: the node and its smaller neighbours go under the smallest of them
        smallest = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(smallest, "v").select(F.col("m").alias("u"), F.explode(F.array("v", "u")).alias("v"))
        before, edges = edges, spill(small.where(F.col("u") < F.col("v")).distinct(), "small-star")
        release(before)
        if turn == turns:
            break
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    # settled: every node hangs directly under its root
    roots = edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("root"))
    tops = edges.select(F.col("u").alias("node")).distinct().join(roots, "node", "left_anti").select("node", F.col("node").alias("root"))
    out = spill(roots.unionByName(tops), "components")
    release(edges)
    return out
