"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import runtime


def _to_least(e: DataFrame, least: DataFrame) -> DataFrame:
    """Edges (u, v) with m, their node's least neighbour. A hub's edges are a skewed join, which adaptive execution splits."""
    return e.join(least, "u")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, label) for each node of an edge in (a, b); the label is the component's smallest node.

    Every round writes its edges to the checkpoint folder, so that lost executors cost a round at most. Rounds grow with
    the logarithm of the longest path.
    """
    sign = {"n": F.count(F.lit(1)), "s": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}
    e, seen = runtime.counted(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), **sign)
    for _ in range(most):
        if not seen["n"]:
            break
        both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _to_least(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        step = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")
        small = _to_least(large, least).select(step).select("e.u", "e.v").where("u <> v").distinct()
        (after, now), before = runtime.counted(small, **sign), e
        runtime.forget(before)
        e = after
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
