"""Connected components of an edge table, without gathering nodes or edges anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), the root being the smallest node reachable.

    Each round hangs all neighbours of a node on its smallest one, first the larger neighbours, then
    the smaller ones; both steps are an aggregation and a join, and their edge tables are stored. It
    ends when a round changes nothing, after about log(nodes) rounds. Edges with nulls are left out.
    """
    current = stage(_ordered(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))), "edges")
    seen = _signature(current)
    while seen[0]:
        current = stage(_small_star(_large_star(current)), "edges")
        now = _signature(current)
        if now == seen:
            break
        seen = now
    return current.select(F.col("v").alias("node"), F.col("u").alias("root")).union(current.select("u", "u")).distinct()


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select("v", "u"))
    least = stage(both.groupBy("x").agg(F.min(F.least("x", "y")).alias("m")), "least")  # stored, so that a hub's join can be split
    return _ordered(both.join(least, "x").where("y > x").select(F.col("m").alias("u"), F.col("y").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = stage(edges.groupBy("v").agg(F.min("u").alias("m")), "least")
    return _ordered(edges.join(least, "v").select(F.col("m").alias("u"), F.col("u").alias("v")).union(least.select("m", "v")))
