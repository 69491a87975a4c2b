"""Connected components of an undirected graph of BIGINT nodes, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import settle


def _lowest(pairs: DataFrame) -> DataFrame:
    """Each node ``u`` with the least of itself and its neighbours ``v``."""
    return pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    """Every greater neighbour of a node is tied to the node's least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_lowest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """A node and its lesser neighbours are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = _lowest(down)
    tied = down.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(lowest.select("u", F.col("m").alias("v")))


def _print_of(edges: DataFrame):
    pair: Column = F.xxhash64("u", "v")
    return edges.agg(F.count("*"), F.sum(pair % 1_000_003), F.sum(pair % 998_244_353)).first()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): every node that occurs in an edge with the least node it can reach.

    Each round works on a table of distinct edges in the shared folder; only a count and two sums come to the driver. The number of
    rounds grows with the logarithm of the longest path. NULL ends and loops link nothing.
    """
    current = settle(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    before = None
    while (seen := _print_of(current)) != before and seen[0]:
        before = seen
        current = settle(_small(_large(current).distinct()).where("u <> v").distinct())
    return current.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
