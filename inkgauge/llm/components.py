"""Connected components of links, by rounds of joins; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, root: the smallest node reachable, for every node that has a link.

    Alternating star rounds: first each node's larger neighbours are tied to its smallest neighbour, then each node and
    its smaller neighbours are. Both keep components; links become stars around the smallest node in about log rounds.
    Sums over neighbours are partial aggregates, so that a hub costs no task more than others. Every round is a written
    table, so lost executors cost one round.
    """
    edges = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that both sides of the joins come by an exchange, which Spark splits where a centre is frequent
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = written(large.groupBy("u").agg(F.min("v").alias("m")))
        edges = written(large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether no node is on both sides and each outer node has one link: all centres are then least."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("outer"), F.lit(0).alias("centre")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("outer"), F.lit(1).alias("centre")))
    return ends.groupBy("x").agg(F.sum("outer").alias("outer"), F.max("centre").alias("centre")).where("outer > 1 or (outer > 0 and centre > 0)").isEmpty()
