"""Connected components by alternating large and small stars over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.plans.storage import materialise_measured

def _mark():
    return F.bit_xor(F.xxhash64("a", "b"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the larger (or the smaller) neighbours of each node to its least neighbour."""
    if large:
        pairs = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    linked = pairs.join(least, "a")
    if large:
        out = linked.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            least.select("a", F.col("least").alias("b"))
        )
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, label: str = "component") -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b) but the least of each component,
    which is the label. Each round is written once; rounds grow with the logarithm of
    the size of a component, and end when the table of edges stays the same."""
    edges = edges.select("a", "b").where("a <> b")
    current, seen = materialise_measured(edges, "edges", mark=_mark())
    state = None
    while seen["rows"]:
        current, seen = materialise_measured(_star(_star(current, True), False), "edges", mark=_mark())
        if (seen["rows"], seen["mark"]) == state:
            break
        state = (seen["rows"], seen["mark"])
    return current.select(F.col("a").alias("node"), F.col("b").alias(label))
