"""Seeded samples: bottom-k by stratum, nested subsets, strides, orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import positions

#: Cells of the histogram that bounds what a stratum's last sort sees.
CELLS = 4096


def bottom_k(df: DataFrame, strata: list[str], priority: str, k: Column, ties: list[str], span: int) -> DataFrame:
    """Of each stratum the ``k`` rows (a column constant within it) of smallest ``priority``, ties by ``ties``.

    priority: a whole number from 0 to span - 1. A histogram over all rows finds the cell of each stratum in
    which the k-th row lies; only rows up to that cell are sorted, so a stratum of any size costs about k rows.
    """
    cell = F.floor(F.col(priority) / F.lit(span / CELLS)).cast("int")
    rows = df.withColumns({"_cell": cell, "_k": k})
    counts = rows.groupBy(*strata, "_cell").agg(F.count("*").alias("_n"), F.first("_k").alias("_k"))
    before = Window.partitionBy(*strata).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    last = counts.withColumn("_less", F.coalesce(F.sum("_n").over(before), F.lit(0))).where(F.col("_less") < F.col("_k")).groupBy(*strata).agg(F.max("_cell").alias("_last"))
    same = None
    for s in strata:
        same = F.col(f"a.{s}").eqNullSafe(F.col(f"b.{s}")) if same is None else same & F.col(f"a.{s}").eqNullSafe(F.col(f"b.{s}"))
    near = rows.alias("a").join(last.alias("b"), (F.lit(True) if same is None else same) & (F.col("_cell") <= F.col("_last"))).select("a.*")
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy(priority, *ties))
    return near.withColumn("_rank", rank).where(F.col("_rank") <= F.col("_k")).drop("_cell", "_k", "_rank")


def quota(size: int, share: float, flagged: Column) -> Column:
    """Rows wanted of a stratum: the flagged ones get ``share`` of the size, halves rounded to even."""
    marked = F.bround(F.lit(size * share), 0).cast("long")
    return F.when(flagged, marked).otherwise(F.lit(size).cast("long") - marked)


def stratified_sample(df: DataFrame, split: str, flag: str, sizes: dict[str, int], share: float, priority: str, ties: list[str], span: int) -> DataFrame:
    """The bottom-k sample by split and flag with the quotas above; splits that ``sizes`` lacks give nothing."""
    wanted = F.lit(0).cast("long")
    for name, size in sizes.items():
        wanted = F.when(F.col(split) == name, quota(size, share, F.col(flag))).otherwise(wanted)
    return bottom_k(df, [split, flag], priority, wanted, ties, span)


def undersupply(sample: DataFrame, split: str, flag: str, sizes: dict[str, int], share: float) -> DataFrame:
    """Strata that hold fewer rows than their quota: a row each; none for a good sample."""
    spark = sample.sparkSession
    strata = spark.createDataFrame([(s, f, n) for s, n in sizes.items() for f in (True, False)], f"{split} string, {flag} boolean, size long")
    marked = F.bround(F.col("size") * share, 0).cast("long")
    strata = strata.select(split, flag, F.when(F.col(flag), marked).otherwise(F.col("size") - marked).alias("wanted"))
    found = sample.groupBy(split, flag).agg(F.count("*").alias("found"))
    return strata.join(found, [split, flag], "left").select(split, flag, "wanted", F.coalesce("found", F.lit(0)).alias("found")).where("found < wanted")


def every_kth(df: DataFrame, order: list[str], k: int) -> DataFrame:
    return positions(df, order, "_at").where(F.col("_at") % k == 0).drop("_at")


def smallest(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The first ``n`` rows of an order: each task keeps its own first n before they meet."""
    return df.orderBy(*order).limit(n)


def subset(df: DataFrame, order: list[str], count: int) -> DataFrame:
    """The first ``count`` rows of a seeded permutation; a larger count only adds rows."""
    return positions(df, order, "_at").where(F.col("_at") < count).drop("_at")
