"""Reading tables, cutting lineage through the shared folder, and exact positions without one big sort."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a folder of this machine only where nothing is set and Spark is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tracemill-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def release(*frames: DataFrame) -> None:
    """Delete the files of ``stored`` tables that no later plan reads."""
    for df in frames:
        if path := getattr(df, "_stored_at", None):
            target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
            df._stored_at = None


def in_ranges(df: DataFrame, *order: str | Column) -> DataFrame:
    """``df`` dealt to sorted ranges of ``order`` and stored, with the range's number as _part."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))


def running(df: DataFrame, keys: list[str], order: list[str | Column], totals: dict[str, str | Column]) -> DataFrame:
    """Sums over all earlier rows of the same ``keys``, the row itself left out, for each name of ``totals``.

    ``order`` is total within a key. The rows are dealt to ranges of (keys, order); a range's running sums come
    from a window inside it, and what earlier ranges hold of the same key from one row per range and key. So a
    key may have any number of rows and no task holds it whole.
    """
    tag = {k: f"_before_{k}" for k in totals}
    rows = in_ranges(df.withColumns({f"_add_{k}": F.col(v) if isinstance(v, str) else v for k, v in totals.items()}), *keys, *order)
    per_part = rows.groupBy("_part", *keys).agg(*(F.sum(f"_add_{k}").alias(f"_sum_{k}") for k in totals))
    earlier = Window.partitionBy(*keys or [F.lit(0)]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = per_part.select("_part", *keys, *(F.coalesce(F.sum(f"_sum_{k}").over(earlier), F.lit(0)).alias(tag[k]) for k in totals))
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({k: F.coalesce(F.sum(f"_add_{k}").over(inside), F.lit(0)) for k in totals})
    right = before.select(F.col("_part").alias("_p"), *(F.col(k).alias(f"_k_{k}") for k in keys), *tag.values())
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = rows.join(right, same)
    return out.select(*df.columns, *((F.col(k) + F.col(tag[k])).alias(k) for k in totals))


def positions(df: DataFrame, order: list[str | Column], out: str, keys: list[str] | None = None) -> DataFrame:
    """The row's number from 0 within ``keys`` (all rows, if none) in the given total order."""
    return running(df, keys or [], order, {out: F.lit(1).cast("long")})
