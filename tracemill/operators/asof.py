"""As-of joins: the first boundary at or after a cut, the last at or before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _merged(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_first: bool) -> tuple[DataFrame, list]:
    a = left.select("*", F.col(at).alias("_at"), F.lit(1 if right_first else 0).alias("_side"))
    b = right.select(*keys, F.col(at).alias("_at"), F.lit(0 if right_first else 1).alias("_side"))
    return a.unionByName(b, allowMissingColumns=True), [F.col("_at"), F.col("_side")]


def first_at_or_after(left: DataFrame, right: DataFrame, keys: list[str], at: str) -> DataFrame:
    """``left`` with ``found``: the smallest ``at`` of ``right`` with the same keys that is not before its own.
    Both sides are laid in one order within the keys, so rows are shuffled once and no pairs are made."""
    rows, order = _merged(left, right, keys, at, right_first=False)
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    found = F.first(F.when(F.col("_side") == 1, F.col("_at")), ignorenulls=True).over(w)
    return rows.withColumn("found", found).where("_side = 0").select(*left.columns, "found")


def last_at_or_before(left: DataFrame, right: DataFrame, keys: list[str], at: str) -> DataFrame:
    rows, order = _merged(left, right, keys, at, right_first=True)
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = F.last(F.when(F.col("_side") == 0, F.col("_at")), ignorenulls=True).over(w)
    return rows.withColumn("found", found).where("_side = 1").select(*left.columns, "found")
