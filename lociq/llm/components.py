"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.llm.session import keep, release


def _to_minimum(edges: DataFrame) -> DataFrame:
    """For edges (u, v): u's smallest neighbour or itself, beside every v."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return edges.join(least, "u")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every u of the different edges (u, v), u > v, has one edge and no v has one of its own: then each v is its component's smallest node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up = 1 AND down = 1").agg(F.count("*")).first()[0] == 0


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node in links (a, b); component is the smallest node reachable.

    Each round is two aggregations and two joins, spread by node; nothing is collected but whether stars are left.
    """
    edges = keep(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _are_stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_minimum(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = keep(large.filter("u <> v"), "large-star")  # a row an edge at most; equal ones go after the small star
        small = _to_minimum(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        after = keep(small.filter("u <> v").distinct(), "small-star")
        release(edges, large)
        edges = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
