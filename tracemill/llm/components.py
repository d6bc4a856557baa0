"""Connected components of an edge table by large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, files_for, release


def _star(edges: DataFrame, larger: bool, files: int) -> DataFrame:
    """Hang each vertex's neighbours (the larger ones, or itself and the smaller ones) on the smallest."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    if larger:
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), files)  # so that Spark can split a hub's rows in the join
        hung = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        below = both.where("v < u")
        least = cut(below.groupBy("u").agg(F.min("v").alias("m")), files)
        hung = below.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return hung.where("a < b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every vertex of an edge; root is the smallest vertex that it reaches.

    Each round's edges are written to the shared folder, so the lineage stays short. Loops (a = b) leave
    their vertex alone in its component unless another edge has it.
    """
    pairs = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    now = cut(pairs.where("a < b").distinct())
    files = files_for(now.count())
    while not _stars(now):
        after = cut(_star(_star(now, True, files), False, files), files)
        release(now)
        now = after
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every vertex hangs on one that hangs on none: no vertex has two below it, or one above and below."""
    ends = edges.select(F.col("b").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("a").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up > 1 OR up > 0 AND down > 0").isEmpty()
