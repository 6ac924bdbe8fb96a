"""Connected components by contraction in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.scratch import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node with an edge to another one; nodes of one component share their root.

    In each round every node points to the neighbour of lowest hash, if that is below its own, and edges move to where
    their ends point; hashed order shrinks chains as fast as stars, so rounds grow with the logarithm of the node
    count. Rounds are written to the shared folder. Self loops and nulls are ignored, repeated edges don't matter.
    """
    e = materialize(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    steps = []
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), "b")).alias("low"))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("b"))
        parent = materialize(low.select(F.col("a").alias("node"), F.least("low", own)["b"].alias("root")), "parents")
        steps.append(parent)
        left = parent.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = parent.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = e.join(left, "a").join(right, "b").where("ra <> rb")
        e = materialize(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    if not steps:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = steps[0]
    for step in steps[1:]:
        then = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
        found = found.join(then, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return materialize(found, "components")
