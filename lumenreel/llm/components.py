"""Connected components of a table of links, by stars.

Every round lets each node point its larger neighbours to its smallest neighbour, then its smaller ones; the
links end as stars around the smallest node of each component. Rounds are few (logarithmic in practice) and
each is two aggregations with map-side combine and two joins that the engine can split at hot nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _smallest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.filter("v > u").join(_smallest(both), "u")
    return joined.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u > v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Links point from larger ``u`` to smaller ``v``."""
    smallest = _smallest(links)
    joined = links.join(smallest, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct()


def _state(links: DataFrame):
    return links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(links: DataFrame) -> DataFrame:
    """``links`` has two node columns ``a`` and ``b``; returns node and root (the smallest of its component).

    Only nodes with links are returned. Loops, repeated links and null ends don't matter.
    """
    links = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    links = written(links.filter("u is not null and v is not null and u > v").distinct())
    state = _state(links)
    while True:
        links = written(_small_star(_large_star(links)))
        now = _state(links)
        if now == state:
            break
        state = now
    roots = links.select(F.col("v").alias("node")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )
