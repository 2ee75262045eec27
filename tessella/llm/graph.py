"""Connected components by alternating star contractions; links and labels stay in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.tables import written


def _star(edges: DataFrame) -> DataFrame:
    """Every ``dst`` of a ``src`` linked to the smallest of them instead, and so is ``src``."""
    least = edges.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("least"))
    return edges.join(least, "src").select("src", "dst", "least")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, component``: for each node of ``edges`` (``a``, ``b``) the smallest node it is linked with, directly or not.

    Each round links the larger neighbours of a node, then its smaller ones, to the smallest. The links turn into stars in a number
    of rounds about the logarithm of the longest chain. A node with very many links is split by the adaptive join.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst")).distinct()
    links = written(links, "links")
    known = None
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        large = _star(both).where("dst > src").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
        near = _star(large.distinct())
        nodes = near.select(F.explode(F.array("src", "dst")).alias("src"), F.col("least").alias("dst"))
        links = written(nodes.where("src <> dst").distinct(), "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.hash("src", "dst").cast("long")), F.count_distinct("src")).first()
        if tuple(now) == known and now[0] == now[2]:
            break
        known = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(links.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
