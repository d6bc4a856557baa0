"""Pieces that several operators share: lineage cuts, row numbers, table reads."""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark's setting by which a query's shuffle files are deleted when it ends, not at some later collection of garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset and Spark is local (tests), one of this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tracemill-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def cut(df: DataFrame, files: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: its lineage ends there, and a lost
    executor costs a re-read instead of a re-computation. ``release`` removes what was written, and so does the
    end of a function that is ``tidy``. The shuffle files of the writing go when it is done.

    files: at most so many, for tables whose rows are few for the shuffle partitions that they come from.
    """
    df = df if files is None else df.coalesce(files)
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracemill-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.select("*").write.parquet(path)  # a new plan, which has the setting
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return owned(spark.read.schema(df.schema).parquet(path), path)


def owned(df: DataFrame, path: str) -> DataFrame:
    """``df``, the files at ``path`` being deleted with it."""
    df._tracemill_path = path
    if _scopes():
        _scopes()[-1].append(df)
    return df


_local = threading.local()


def _scopes() -> list[list[DataFrame]]:
    if not hasattr(_local, "scopes"):
        _local.scopes = []
    return _local.scopes


def tidy(f):
    """A function of small results: its result is written, and every table that it cut on the way is deleted."""

    @wraps(f)
    def run(*args, **kwargs):
        _scopes().append([])
        try:
            out = f(*args, **kwargs)
            made = _scopes()[-1]
            _scopes()[-1] = []
            out = cut(out)
            _scopes()[-1] = made
        finally:
            release(*_scopes().pop())
        if _scopes():
            _scopes()[-1].append(out)
        return out

    return run


def release(*frames: DataFrame) -> None:
    """Delete the files behind tables made by ``cut`` that no later plan reads."""
    for df in frames:
        path = getattr(df, "_tracemill_path", None)
        if path:
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
            df._tracemill_path = None


def collect_garbage(spark: SparkSession) -> None:
    """Let the driver forget plans that no one reads any more. Spark frees their broadcasts and shuffle files only when the
    driver collects its garbage, which a loop of many small jobs else puts off until the heap is full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def with_row_number(df: DataFrame, name: str = "_row") -> DataFrame:
    """A number for each row that is unique within this plan; cut() the result before using it in two plans."""
    return df.withColumn(name, F.monotonically_increasing_id())


def files_for(rows: int) -> int:
    """Files of a narrow table of up to ``rows`` rows."""
    return max(8, rows // 25_000)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` has the name."""
    while wanted.lower() in {c.lower() for c in df.columns}:
        wanted = "_" + wanted
    return wanted


def packed(df: DataFrame, columns: list[str], **others) -> DataFrame:
    """The given columns as one struct ``_doc`` beside ``others``, so that no name of theirs can clash."""
    doc = F.struct(*(F.col(f"`{c}`") for c in columns)) if columns else F.struct(F.lit(None).alias("_none"))
    return df.select(doc.alias("_doc"), *(c.alias(n) for n, c in others.items()))


def unpacked(columns: list[str]) -> list:
    return [F.col(f"_doc.`{c}`") for c in columns]


def schema_of(df: DataFrame, columns: list[str], added: str) -> T.StructType:
    """Fields of ``df`` and then those that the string ``added`` names."""
    extra = T.StructType.fromDDL(added) if added else T.StructType()
    return T.StructType([df.schema[c] for c in columns] + list(extra))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def frequent(counts: DataFrame, count_col: str, most: int) -> DataFrame:
    """The rows with the highest counts, ``most`` at most: all rows from a count upwards at which so many
    still fit. The count is found from a histogram over eighths of powers of two, so no row is sorted."""
    bucket = F.floor(F.log2(F.col(count_col)) * 8)
    least, taken = None, 0
    for b, k in sorted(counts.groupBy(bucket.alias("b")).count().collect(), reverse=True):
        if taken + k > most:
            break
        least, taken = b, taken + k
    return counts.where(F.lit(False) if least is None else bucket >= least)


def slices(batches, rows: int = 512):
    """Arrow batches cut to ``rows`` rows, so that what Python holds at a time stays small."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)
