"""Mixing sources to target weights: Pfair windows and earliest deadline first.

Each source is cut into blocks. With share w of the target weights, its block j (from 0) is released at slot
floor(j/w) and due by slot ceil((j+1)/w); each slot takes the released block with the earliest deadline, ties by
name. So up to any slot a source's number of blocks differs from its share by less than one, as long as every
source still has blocks (``in_mix``). From the slot on at which the first source has none left, releases no longer
hold: what is left follows by deadline, so no slot is empty and no document is lost. Windows are worked out in whole
numbers from the weights themselves (36 bits of the largest), with no period and no rounding to one.

The schedule holds a number per block and is laid out on the driver. So that this is bounded, a block has
``block`` documents or a ``blocks``-th part of the table, whichever is more (32 documents up to 128 million rows).
One row per source (its count) reaches the driver too: the weights are a table of that size in any case.

The order within a source is that of the md5 of the id. Ranks come from a sort inside ranges of that md5, which
are as many as the table needs, plus the running sum of the ranges' counts; a range that repeated or null ids fill
is cut on by a hash of the whole row, so no task holds a whole source or all rows of an id.

Cases: a null source is a source of its own, apart from the empty one; null ids come first, repeated ids stand
side by side in the order of the other columns' hash; a source beyond the given weights is an error, one with a
weight and no documents ends the mix at its first slot; an empty table gives an empty result; columns of the same
names as the added ones are replaced by these.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import cut, packed, release, unpacked

#: Documents of a block at least; blocks of the schedule, about; documents of a range of md5s; ranges at most;
#: times that number in a range that is cut on.
BLOCK, BLOCKS, RANGE, RANGES, CROWDED = 32, 4_000_000, 500, 100_000, 8
#: Bits of the largest weight.
BITS = 36


def source_key(source_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit(""))


def whole(weights: dict[str, float]) -> dict[str, int]:
    """The weights as whole numbers, at least 1."""
    most = max(weights.values(), default=1.0)
    return {k: max(1, round(w / most * 2**BITS)) for k, w in weights.items()}


def schedule(parts: dict[str, int], blocks: dict[str, int]) -> tuple[dict[str, list[int]], int]:
    """Slot of each block by source, and the first slot at which a source has none left."""
    total = sum(parts.values())
    out: dict[str, list[int]] = {k: [] for k in parts}
    waiting = [(0, k, 0) for k in sorted(parts) if blocks.get(k)]
    released: list[tuple[int, str, int]] = []
    ended = 0 if len(waiting) < len(parts) else None
    due = lambda k, j: (-(-(j + 1) * total // parts[k]), k, j)
    for t in range(sum(blocks.values())):
        while waiting and (ended is not None or waiting[0][0] <= t):
            _, k, j = heapq.heappop(waiting)
            heapq.heappush(released, due(k, j))
        _, k, j = heapq.heappop(released)
        out[k].append(t)
        if j + 1 < blocks[k]:
            heapq.heappush(waiting, ((j + 1) * total // parts[k], k, j + 1))
        elif ended is None:
            ended = t + 1
    return out, ended or 0


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, source_col: str = "source", id_col: str = "doc_id", block: int = BLOCK, blocks: int = BLOCKS) -> DataFrame:
    """``docs`` with block, slot, position (slot * block size + place in the block) and in_mix.

    weights: target weight of each source; by default the square root of its number of documents, between the
    natural mix and an even one.
    """
    spark = docs.sparkSession
    key = source_key(source_col)
    counts = {r["k"]: r["n"] for r in docs.groupBy(key.alias("k")).agg(F.count("*").alias("n")).collect()}
    if weights is None:
        target = {k: math.sqrt(n) for k, n in counts.items()}
    else:
        target = {"" if k is None else f"s{k}": w for k, w in weights.items() if w > 0}
        if missing := sorted(set(counts) - set(target)):
            raise ValueError(f"sources without a weight: {missing[:5]}")
    total = sum(counts.values())
    block = max(block, -(-total // blocks))
    slots, horizon = schedule(whole(target), {k: -(-n // block) for k, n in counts.items()})
    ranges = min(RANGES, max(1, -(-total // RANGE)))

    names = [c for c in docs.columns if c not in ("block", "slot", "position", "in_mix")]
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = packed(docs, names, _key=key, _md5=digest, _id=F.col(id_col), _all=F.xxhash64(*(F.col(f"`{c}`") for c in names)))
    rows = rows.withColumn("_range", F.floor(_bits("_md5", 1, 8) * ranges / F.lit(2**32)).cast("int"))
    # a range that few ids fill is cut on by what follows in the order
    full = cut(rows.groupBy("_key", "_range").count().where(F.col("count") > CROWDED * RANGE).select("_key", "_range", F.lit(True).alias("_full")))
    if full.isEmpty():
        release(full)
        rows = rows.withColumn("_sub", F.lit(0).cast("long"))
    else:  # written before, so that Spark knows its size and does not shuffle the documents for this join too
        finer = _bits("_md5", 9, 4) * 2**16 + F.shiftrightunsigned(F.col("_all").bitwiseXOR(F.lit(-(2**63))), 48)
        rows = rows.join(full, ["_key", "_range"], "left").withColumn("_sub", F.when(F.col("_full"), finer).otherwise(0)).drop("_full")
    per_range = rows.groupBy("_key", "_range", "_sub").agg(F.count("*").alias("n"))
    before = Window.partitionBy("_key").orderBy("_range", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_range.select("_key", "_range", "_sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_key", "_range", "_sub").orderBy("_md5", "_id", "_all")
    rows = rows.withColumn("_rank", F.row_number().over(inside) - 1).join(starts, ["_key", "_range", "_sub"])

    plan = spark.createDataFrame([(k, slots[k]) for k in sorted(slots)], "_key string, _slots array<int>")
    rows = rows.join(F.broadcast(plan), "_key")  # a number for each of about ``blocks`` blocks
    index = F.col("_start") + F.col("_rank")
    number = F.floor(index / block)
    slot = F.element_at("_slots", (number + 1).cast("int"))
    out = rows.select("_doc", number.cast("long").alias("block"), slot.cast("long").alias("slot"), F.pmod(index, F.lit(block)).alias("_place"))
    return out.select(*unpacked(names), "block", "slot", (F.col("slot") * block + F.col("_place")).cast("long").alias("position"), (F.col("slot") < horizon).alias("in_mix"))


def _bits(hex_col: str, start: int, digits: int) -> Column:
    return F.conv(F.substring(hex_col, start, digits), 16, 10).cast("long")
