"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velospan.llm.columns import require
from velospan.staging import staged


def _towards_least(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the node's least neighbour (or itself)."""
    both = edges.select(F.col("high").alias("u"), F.col("low").alias("v"))
    both = both.union(edges.select(F.col("low").alias("u"), F.col("high").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = both.filter("v > u").join(least, "u")
    return tied.filter("v <> m").select(F.col("v").alias("high"), F.col("m").alias("low"))


def _within_below(edges: DataFrame) -> DataFrame:
    """Every node and its neighbours below are tied to the least of those."""
    least = edges.groupBy("high").agg(F.min("low").alias("m"))
    below = edges.join(least, "high").select(F.col("low").alias("high"), F.col("m").alias("low")).filter("high <> low")
    return below.union(least.select("high", F.col("m").alias("low")))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (the least node it reaches) for every node that has an edge to another.

    Edges are repeatedly tied to ever lower neighbours until each component is a star
    around its least node; every round is written out, so a lost executor costs one
    round. Minima are taken before rows meet, so a hub needs no task of its own. Loops
    and edges with a null end tie nothing.
    """
    require(edges, a, b)
    ends = edges.filter(F.col(a) != F.col(b))
    now = staged(ends.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("high", "low") % 1_000_000_007).alias("h")).first()
        if state == before or state["n"] == 0:
            return now.select(F.col("high").alias("node"), F.col("low").alias("root"))
        before = state
        lower = _towards_least(now).distinct()
        now = staged(_within_below(lower).distinct(), "edges")
