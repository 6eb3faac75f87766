"""Components of an equivalence given by shared keys or edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def shared_key_edges(df: DataFrame, row_id: str, keys: list[Column]) -> DataFrame:
    """(a, b): each row with the least row of every given key that it has; blank keys join nothing.

    One star a key value, so a value with many rows gives as many edges, not their square.
    """
    parts = []
    for i, key in enumerate(keys):
        rows = df.where(key.isNotNull() & (F.trim(key.cast("string")) != "")).select(F.col(row_id).alias("a"), F.concat(F.lit(f"{i}:"), key.cast("string")).alias("k"))
        least = rows.groupBy("k").agg(F.min("a").alias("b"))
        parts.append(rows.join(least, "k").where("a <> b").select("a", "b"))
    return reduce(DataFrame.unionByName, parts)


def components(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """(node, component): the least node that each can reach, by alternating large and small stars.

    Only minima are kept of a neighbourhood, and every round's edges are checkpointed.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while (state := now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()) != before:
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(both.groupBy("a").agg(F.min("b").alias("m")), "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        pairs = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = materialise(pairs.select("e.a", "e.b").where("a <> b").distinct())
    return nodes.select(node).distinct().join(now.withColumnRenamed("a", node), node, "left").select(node, F.coalesce("b", node).alias("component"))
