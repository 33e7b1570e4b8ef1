"""Connected components by alternating large-star and small-star steps on tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import bounded, written


def _settled(edges: DataFrame) -> bool:
    """Whether edges are stars: every u once, and no v is a u. Then each component is a star around its least node."""
    if edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1):
        return False
    return not edges.join(bounded(edges.select(F.col("v").alias("w")).distinct()), F.col("u") == F.col("w"), "left_semi").take(1)


def components(edges: DataFrame) -> DataFrame:
    """(u, v): every node but the least of each component of edges (u, v), with the component's least node.

    A step joins each node's neighbours with the least of them; minima combine before they are dealt, so a node with
    very many neighbours costs one row a task. Each step is a written table. The number of steps is logarithmic.
    """
    e = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    while e.take(1):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = bounded(written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))))
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(bounded(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        if _settled(e):
            break
    return e
