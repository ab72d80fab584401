"""Connected components of links that no one machine has to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import drop_saved, saved


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one edge and no node is both below and above another."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable, itself included) of every node of links (u, v: long).

    Large and small stars in turn: each node's larger neighbours, then its smaller ones, are hung
    below its smallest neighbour, until nothing changes. Each round is a table in the shared folder.
    Joins have tables on both sides, so a node of very many links is split by the join itself.
    """
    edges = saved(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while not _stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        old, least = edges, saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "stars")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = saved(large.distinct(), "links")
        drop_saved(old, least)
        least = saved(large.groupBy("u").agg(F.min("v").alias("m")), "stars")
        hung = large.join(least, "u")
        edges = saved(hung.select("u", F.col("m").alias("v")).union(hung.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), "links")
        drop_saved(large, least)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
