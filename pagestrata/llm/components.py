"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestrata.llm import base


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _hang(edges: DataFrame, least: DataFrame) -> DataFrame:
    return edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node reachable.

    Every round is written to the shared folder. Minima are combined before the exchange, and the joins have one row per
    node on one side, so a node with very many edges can be split. The number of rounds grows with the logarithm
    of the longest path.
    """
    now = base.stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = _state(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = base.stage(_hang(both.filter("v > u"), least).distinct(), "edges")  # larger neighbours hang on the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _hang(large, least).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        now = base.stage(small.distinct(), "edges")
        after = _state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
