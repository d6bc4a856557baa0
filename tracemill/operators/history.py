"""Training histories: which snapshots stay, which log records a resumed run keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def retained(snapshots: DataFrame, keys: list[str], update: str, current: int, keep: int) -> DataFrame:
    """The ``keep`` latest snapshots per run that are not beyond the current update."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(update)))
    return snapshots.where(F.col(update) <= current).withColumn("_rank", rank).where(F.col("_rank") <= keep).drop("_rank")


def read_history(spark: SparkSession, path: str, schema: str, cutoff: int) -> DataFrame:
    """Records of a JSON-lines log up to ``cutoff``; a torn last line is dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where(F.col("update") <= cutoff)
