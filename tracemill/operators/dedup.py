"""Deduplication by key, occurrence counts, exclusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def occurrences(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``occurrence`` (running count within the keys) and ``is_last``. Keys include what bounds a group, a game
    or a document."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({"occurrence": F.row_number().over(w), "is_last": F.lead(F.lit(1)).over(w).isNull()})


def keep_best(df: DataFrame, keys: list[str], score: str, order: list[str]) -> DataFrame:
    """One row per key: the highest score, the first of ties. An aggregation, so each task reduces its own rows
    first and a frequent key costs one row per task."""
    rest = [c for c in df.columns if c not in keys]
    first = F.struct(*(F.col(c) for c in order), *(F.col(c) for c in rest if c not in order))
    top = df.groupBy(*keys, score).agg(F.min(first).alias("_first"))
    best = top.groupBy(*keys).agg(F.max_by(F.struct(score, "_first"), score).alias("_best"))
    return best.select(*keys, *(F.col(f"_best.{c}" if c == score else f"_best._first.{c}").alias(c) for c in rest))


def upsert_counts(df: DataFrame, keys: list[str], score: str, order: list[str]) -> DataFrame:
    """Per key: rows, replacements (rows that beat all rows before them, the first left out) and duplicates (all
    others but the first). A score is a record where its first row comes before that of every higher score, so
    counting takes one row per key and distinct score, not the rows in order."""
    firsts = df.groupBy(*keys, score).agg(F.min(F.struct(*order)).alias("_at"), F.count("*").alias("_n"))
    higher = Window.partitionBy(*keys).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    marked = firsts.withColumn("_next", F.min("_at").over(higher))
    record = F.col("_next").isNull() | (F.col("_at") < F.col("_next"))
    out = marked.groupBy(*keys).agg(F.sum("_n").alias("occurrences"), (F.count_if(record) - 1).cast("long").alias("replacements"))
    return out.withColumn("duplicates", F.col("occurrences") - 1 - F.col("replacements"))


def first_seen(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key, with the number of its copies."""
    rest = df.columns
    found = df.groupBy(key.alias("_key")).agg(F.min(F.struct(*order)).alias("_first"), F.count("*").alias("copies"))
    return df.join(found.select(*(F.col(f"_first.{c}").alias(c) for c in order), "copies"), order).select(*rest, "copies")


def excluding(df: DataFrame, selected: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not selected yet."""
    return df.join(selected.select(*keys), keys, "left_anti")


def keeping(df: DataFrame, selected: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(selected.select(*keys), keys, "left_semi")


def duplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side holds more often than the other: empty for equal tables."""
    cols = left.columns
    return left.exceptAll(right.select(*cols)).withColumn("side", F.lit("left")).unionByName(right.select(*cols).exceptAll(left).withColumn("side", F.lit("right")))


def fill_missing(cache: DataFrame, wanted: DataFrame, keys: list[str], made: DataFrame) -> DataFrame:
    """The cache with rows added for wanted keys that it lacks; rows it has are never replaced."""
    missing = wanted.select(*keys).distinct().join(cache.select(*keys), keys, "left_anti")
    return cache.unionByName(made.join(missing, keys, "left_semi"))
