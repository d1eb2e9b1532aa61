"""Connected components of a link table, as DataFrame joins only.

Alternating large-star and small-star steps (Kiveris et al., 2014): each node hangs its larger, then its smaller
neighbours under the smallest one it sees, until the edges are stars. A step groups by node with a minimum, which Spark
combines before the shuffle, and joins that one row per node back: a hub's edges are streamed past its one row, never collected, and where they
outgrow a task adaptive execution splits that side of the join.
Every round is written to the checkpoint folder; neither links nor components reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def _large_star(edges: DataFrame) -> DataFrame:
    """edges (u > v). For each node the larger neighbours move under the smallest of it and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    # A node's larger neighbours are the u of the edges in which it is v.
    return edges.join(least.withColumnRenamed("u", "v"), "v").select("u", F.col("m").alias("v")).filter("u > v")


def _small_star(edges: DataFrame) -> DataFrame:
    """edges (u > v). For each node its smaller neighbours and itself move under the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): for every node of a link the smallest node that links reach. Links may repeat, be reversed or loop; null ends are ignored.

    The result is exact: rounds go on until nothing changes. ``max_rounds`` is far above the logarithmic number that
    is needed; if it were met, an error is raised.
    """
    edges = durable(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u is not null and v is not null and u > v").distinct())
    before = None
    for _ in range(max_rounds):
        edges = durable(_small_star(_large_star(edges)).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components didn't settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
