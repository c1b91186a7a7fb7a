"""Connected components of a link table by alternating star contraction.

Each pass is two grouped minima and two joins over the links; the table of links
never grows, hubs are pre-aggregated and split by the skew join, and only whether all
components are stars by now reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges`` (a, b: long) -> (node, component): the smallest node reachable,
    for every node that has a link. Empty links give an empty table."""
    e = scratch.save(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    while not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # every larger neighbour of u goes to u's smallest neighbour
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # every smaller neighbour of u, and u itself, goes to the smallest
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        nxt = scratch.save(small.where("u <> v").distinct())
        scratch.drop(e)
        e = nxt
    centres = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres)


def _stars(e: DataFrame) -> bool:
    """Whether every node has one link to a centre and no centre has one."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("links"), F.lit(0).alias("centre")).unionByName(
        e.select(F.col("v").alias("x"), F.lit(0).alias("links"), F.lit(1).alias("centre"))
    )
    both = ends.groupBy("x").agg(F.sum("links").alias("links"), F.max("centre").alias("centre"))
    return not both.where("links + centre > 1").head(1)
