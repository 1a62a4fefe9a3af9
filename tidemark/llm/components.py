"""Connected components of a link table, by alternating large and small stars (a published map-reduce method)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges: high, low with high > low.  Large: hang every larger neighbour on the least; small: the others."""
    both = edges.select(F.col("high").alias("at"), F.col("low").alias("to"))
    if large:
        both = both.union(edges.select(F.col("low").alias("at"), F.col("high").alias("to")))
    least = both.groupBy("at").agg(F.least(F.col("at"), F.min("to")).alias("least"))
    if large:
        out = both.where("to > at").join(least, "at").select(F.col("to").alias("high"), F.col("least").alias("low"))
    else:
        out = both.join(least, "at").select(F.col("to").alias("high"), F.col("least").alias("low")).union(least.select("at", "least"))
    return out.where("high > low").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root (the least node of its component) for every node of links (a, b) that is not a root.

    Each round writes its edges to the shared folder; it ends when a round changes nothing.
    """
    a, b = F.col("a"), F.col("b")
    edges = stored(links.where("a != b").select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).distinct(), "links")
    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("high", "low").cast("decimal(20,0)"))).first())
    before = state(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        edges = stored(_stars(_stars(edges, large=True), large=False), "stars")
        after = state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("high").alias("node"), F.col("low").alias("root"))
