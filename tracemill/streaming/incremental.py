"""New files as they come: curation of roots not seen yet, first-wins deduplication, running counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def curate(new: DataFrame, make: Callable[[DataFrame], DataFrame], key: str, out: str, checkpoint: str, ts: str | None = None, delay: str = "7 days") -> StreamingQuery:
    """Make each key's rows once, until the input is used up. Which keys came before is the stream's own state, so a
    batch costs what is new in it; its rows go to a folder of its number, which a batch that is run again after a
    failure writes anew as a whole. With a time column ``ts`` a key is forgotten ``delay`` after it came, which bounds
    the state; without, every key is kept."""

    def batch(df: DataFrame, number: int) -> None:
        make(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    once = new.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key]) if ts else new.dropDuplicates([key])
    return once.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_wins(stream: DataFrame, key: str, order: str, ts: str, delay: str) -> DataFrame:
    """The row of smallest ``order`` per key among those that arrive within ``delay``, once the watermark has
    passed; what comes later for the key opens a new entry, as its state is gone."""
    from pyspark.sql.types import StructType

    fields = stream.schema
    state = StructType([f for f in fields])

    def keep(_: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        best = list(held.get) if held.exists else None
        if held.hasTimedOut:
            held.remove()
            yield pd.DataFrame([best], columns=fields.names)
            return
        at = fields.names.index(order)
        for pdf in frames:
            row = pdf.sort_values(order).iloc[0].tolist()
            best = row if best is None or row[at] < best[at] else best
        held.update(tuple(best))
        held.setTimeoutTimestamp(max(int(pd.Timestamp(best[fields.names.index(ts)]).timestamp() * 1000), held.getCurrentWatermarkMs()) + 1)

    return stream.withWatermark(ts, delay).groupBy(key).applyInPandasWithState(keep, state, state, "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(stream: DataFrame, ts: str, by: list[str], value: str, width: str, delay: str) -> DataFrame:
    """Rows and sum per window of time, complete once the watermark has passed its end."""
    windows = stream.withWatermark(ts, delay).groupBy(F.window(ts, width), *by)
    return windows.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *by, "n", "total")
