"""Connected components of a link table, as joins and minima; no group is gathered anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link: ``root`` is the component's smallest node.

    Each round points a node at the smallest of its parents, links its other parents to that one, and
    then skips to the parent's parent. Rounds grow with the logarithm of the longest chain. Joins on a
    parent shared by many nodes have plain exchanges on both sides, which adaptive execution can split.
    """
    shared_dir(links.sparkSession)
    up = links.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("p")).where("v <> p").distinct().checkpoint()
    while True:
        least = up.groupBy("v").agg(F.min("p").alias("m")).checkpoint()
        above = least.select(F.col("v").alias("m"), F.col("m").alias("mm"))
        own = least.join(above, "m", "left").select("v", F.coalesce("mm", "m").alias("p"), F.col("mm").isNotNull().alias("moved"))
        others = up.join(least, "v").where("p <> m").select(F.col("p").alias("v"), F.col("m").alias("p"), F.lit(True).alias("moved"))
        up = own.union(others).groupBy("v", "p").agg(F.max("moved").alias("moved")).checkpoint()
        if up.where("moved").isEmpty():
            return up.select(F.col("v").alias("node"), F.col("p").alias("root")).union(up.select(F.col("p").alias("node"), F.col("p").alias("root")).distinct())
        up = up.select("v", "p")
