"""Connected classes of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .skew import join_counted

#: Rounds before giving up; pointer jumping halves distances, so this covers chains of 2**30 links.
ROUNDS = 30


def connected_classes(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``class`` for every linked node; the class is its least node.

    Star contraction: each round links every node's greater neighbours, and the
    node itself, to its least neighbour, then each node's smaller ones, until the
    links form stars. Every round only shuffles links, pre-aggregated by node;
    no class is gathered in one task. Order of links and repeats don't matter.
    """
    edges = durable(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    for _ in range(ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = join_counted(both, least, ["u"], "n").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_counted(large, floor, ["u"], "n").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(floor.select("u", F.col("m").alias("v")))
        fresh = durable(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        same = fresh.count() == edges.count() and fresh.join(edges, ["u", "v"], "left_anti").isEmpty()
        edges = fresh
        if same:
            break
    else:
        raise RuntimeError("links didn't settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("class")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("class")).distinct())
