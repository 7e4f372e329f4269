"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.session import materialize


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _pulled(edges: DataFrame) -> DataFrame:
    """Every node hands the smallest node that it sees to its larger neighbours (large star)."""
    seen = edges.select(F.col("v").alias("at"), F.col("u").alias("other")).union(edges.select("u", "v"))
    least = seen.groupBy("at").agg(F.min("other").alias("low")).select("at", F.least("at", "low").alias("low"))
    return edges.join(least, edges["v"] == least["at"]).select("u", F.col("low").alias("v")).where("u <> v")


def _gathered(edges: DataFrame) -> DataFrame:
    """Every node points its smaller neighbours, and itself, to the smallest of them (small star)."""
    least = edges.groupBy("u").agg(F.min("v").alias("low"))
    moved = edges.join(least.withColumnRenamed("u", "at"), F.col("u") == F.col("at")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.where("u <> v").union(least.select("u", F.col("low").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` for every node of an edge, the component being its smallest node.

    Rounds of large star and small star on rows (u, v), u > v: the edges shrink to one star per component in a number of
    rounds that grows with the logarithm of the longest path. A star's centre may have any number of rows: minima are
    combined on the map side, and the join back has one row per node on one side, so Spark may split the other. Each
    round is a written table, which also ends the lineage; only two numbers a round come to the driver.
    Loops, nulls and repeated edges are dropped.
    """
    start = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"`{a}` <> `{b}`")
    now = materialize(start.distinct(), "edges")
    before = None
    while (signature := _signature(now)) != before:
        before = signature
        now = materialize(_gathered(_pulled(now)), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
