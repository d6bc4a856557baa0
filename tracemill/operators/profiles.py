"""Profiles: zero-filled buckets, order statistics of two kinds, grouping sets, running champions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import positions as P
from ..functions.arrays import trajectory_shape
from ..tables import positions


def bucket_counts(df: DataFrame, bucket: Column, names: list[str]) -> DataFrame:
    """(bucket, n, share) for every name, those without rows too, in the order given."""
    spark = df.sparkSession
    every = spark.createDataFrame([(i, b) for i, b in enumerate(names)], "ordinal int, bucket string")
    counts = df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    out = every.join(counts, "bucket", "left").select("ordinal", "bucket", F.coalesce("n", F.lit(0)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return out.join(F.broadcast(total)).select("ordinal", "bucket", "n", F.round(F.coalesce(F.col("n") / F.col("total"), F.lit(0.0)), 6).alias("share"))


def range_buckets(df: DataFrame, value: str, ranges: DataFrame) -> DataFrame:
    """Rows with the range (low <= value < high) they fall in; ``ranges`` is a short table (name, low, high)."""
    return df.join(F.broadcast(ranges), (F.col("low") <= F.col(value)) & (F.col(value) < F.col("high")), "left")


def pool_profile(pool: DataFrame) -> DataFrame:
    """(section, bucket, n, share) over roots with repetition, halfmove and fullmove: repetitions, halfmove
    deciles, phases and what makes a draw claimable."""
    parts = [
        ("repetition", F.col("repetition").cast("string"), [str(k) for k in range(1, 5)]),
        ("halfmove", P.halfmove_bucket(F.col("halfmove")), P.HALFMOVE_BUCKETS),
        ("phase", P.fullmove_phase(F.col("fullmove")), [p[0] for p in P.PHASES]),
        ("claimable", P.claimable(F.col("repetition"), F.col("halfmove")).cast("string"), ["true", "false"]),
    ]
    out = None
    for name, bucket, names in parts:
        one = bucket_counts(pool, bucket, names).select(F.lit(name).alias("section"), "ordinal", "bucket", "n", "share")
        out = one if out is None else out.unionByName(one)
    return out


def _picked(df: DataFrame, keys: list[str], value: str, ties: list[str]) -> DataFrame:
    """Each row's place from 0 and the rows of its group."""
    kept = df.where(F.col(value).isNotNull()).select(*keys, value, *ties)
    sizes = kept.groupBy(*keys).agg(F.count("*").alias("_n"))
    return positions(kept, [value, *ties], "_at", keys).join(sizes, keys)


def nearest_rank(df: DataFrame, keys: list[str], value: str, ties: list[str], percents: list[int]) -> DataFrame:
    """Per group the values at place floor(n * p / 100) from 0, and n, min, max, mean (3 digits), median.

    Places come from range-dealt running counts, so no group is collected or sorted in one task.
    """
    rows = _picked(df, keys, value, ties)
    at = lambda place: F.max(F.when(F.col("_at") == place, F.col(value)))
    n = F.col("_n")
    picks = [at(F.floor(n * p / 100)).alias(f"p{p}") for p in percents]
    low, high = at(F.floor((n - 1) / 2)), at(F.floor(n / 2))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(value).alias("min"), *picks, ((low + high) / 2).alias("median"), F.max(value).alias("max"), F.round(F.avg(value), 3).alias("mean"))


def interpolated(df: DataFrame, keys: list[str], value: str, ties: list[str], percents: list[int]) -> DataFrame:
    """Per group the percentiles by linear interpolation between neighbours."""
    rows = _picked(df, keys, value, ties)
    out = []
    for p in percents:
        h = (F.col("_n") - 1) * (p / 100)
        low, part = F.floor(h), h - F.floor(h)
        share = F.when(F.col("_at") == low, 1 - part).when(F.col("_at") == low + 1, part)
        out.append(F.sum(F.when(share > 0, share * F.col(value))).alias(f"p{p}"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *out)


def shapes(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Per group (a root's rounds) how the values run; nulls are left out."""
    listed = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, value))).alias("_rows"))
    return listed.select(*keys, trajectory_shape(F.col(f"_rows.{value}")).alias("shape"))


def running_champion(df: DataFrame, keys: list[str], order: list[str], score: str, name: str) -> DataFrame:
    """The best row so far within the group, first come first kept, and whether it just changed."""
    w = Window.partitionBy(*keys).orderBy(*order)
    numbered = df.withColumn("_n", F.row_number().over(w))
    so_far = F.max_by(F.col(name), F.struct(F.col(score), -F.col("_n"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    held = numbered.withColumn("champion", so_far)
    return held.withColumn("changed", F.coalesce(F.col("champion") != F.lag("champion").over(w), F.lit(False))).drop("_n")


def round_audit(df: DataFrame, keys: list[str], order: str, champion: str) -> DataFrame:
    """Per root: rounds, distinct champions, overturned rounds, the round since which the champion stands, the
    length of that stable tail, and whether the first champion is the last."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = df.withColumns({"_n": F.row_number().over(w), "_new": F.coalesce(F.col(champion) != F.lag(champion).over(w), F.lit(False))})
    since = F.coalesce(F.max(F.when(F.col("_new"), F.col("_n"))), F.lit(1))
    return marked.groupBy(*keys).agg(
        F.count("*").alias("rounds"),
        F.count_distinct(champion).alias("champions"),
        F.count_if("_new").alias("overturned"),
        since.cast("long").alias("stable_since"),
        (F.count("*") - since + 1).cast("long").alias("stable_tail"),
        (F.min_by(champion, "_n") == F.max_by(champion, "_n")).alias("first_is_last"),
    )


def slices(df: DataFrame, sets: list[str], tokens: str, atoms: str) -> DataFrame:
    """Totals and tokens per atom over each of the columns in ``sets`` and over everything, in one pass."""
    grouped = df.groupingSets([[F.col(s)] for s in sets] + [[]], *(F.col(s) for s in sets))
    out = grouped.agg(F.grouping_id().alias("_set"), F.count("*").alias("documents"), F.sum(tokens).alias("tokens"), F.sum(atoms).alias("atoms"))
    # bit i of the grouping id (from the left) is 0 for the column that is grouped by
    ids = {(1 << len(sets)) - 1 - (1 << (len(sets) - 1 - i)): s for i, s in enumerate(sets)}
    section, value = F.lit("all"), F.lit(None).cast("string")
    for g, s in ids.items():
        section, value = F.when(F.col("_set") == g, s).otherwise(section), F.when(F.col("_set") == g, F.col(s).cast("string")).otherwise(value)
    return out.select(section.alias("section"), value.alias("value"), "documents", "tokens", "atoms", F.round(F.try_divide(F.col("tokens").cast("double"), F.col("atoms")), 6).alias("ratio"))


def corpus_summary(df: DataFrame, position: str, tokens: str) -> DataFrame:
    """One row: documents, distinct positions, tokens, distinct tokens. The distinct counts are aggregations on
    the values, so nothing is collected."""
    whole = df.agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.size(tokens)), F.lit(0)).cast("long").alias("atoms"))
    keys = df.select(position).where(F.col(position).isNotNull()).distinct().agg(F.count("*").alias("positions"))
    used = df.select(F.explode(tokens).alias("t")).distinct().agg(F.count("*").alias("distinct_atoms"))
    return whole.join(F.broadcast(keys)).join(F.broadcast(used))


def encode_stats(df: DataFrame, length: str, atoms: str, cap: int, ties: list[str]) -> DataFrame:
    """One row over encoded documents: counts, ratio, nearest-rank lengths, how many fit the cap."""
    totals = df.agg(
        F.count("*").alias("documents"),
        F.sum(length).cast("long").alias("tokens"),
        F.round(F.sum(length) / F.sum(atoms), 6).alias("ratio"),
        F.count_if(F.col(length) <= cap).alias("eligible"),
        F.count_if(F.col(length) > cap).alias("ineligible"),
    )
    ranks = nearest_rank(df.withColumn("_all", F.lit(1)), ["_all"], length, ties, [50, 90, 95, 99]).select("p50", "p90", "p95", "p99", "max")
    return totals.join(F.broadcast(ranks))
