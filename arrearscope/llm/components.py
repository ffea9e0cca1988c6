"""Distributed union-find: connected components of an edge table by alternating star contractions.

Each round links every node's larger neighbours to its smallest one (large star), then every node and its smaller
neighbours to the smallest of them (small star); the result is a forest of stars in a logarithmic number of rounds
in practice. Minima are combined map-side, so a hub is reduced before it is shuffled; joins on hubs are equi-joins
that Spark splits when skewed. Each round is written to the shared folder; only whether all components are stars reaches
the driver.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node on an edge with two different ends; root is the component's smallest node."""
    e = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "cc-edges")
    while not stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.explode(F.array(*[F.struct(F.col(x).alias("u"), F.col("m").alias("v")) for x in ("u", "v")]))
        e = stored(large.join(low, "u").select(ends.alias("x")).select("x.*").filter("u <> v").distinct(), "cc-round")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def stars(e: DataFrame) -> bool:
    """Whether every smaller end ``v`` is a root and every larger end ``u`` has one, so that a further round changes nothing."""
    ends = (e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
            .unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1 and up > 0").isEmpty()
