"""Whole documents to training batches: offsets, greedy packing, updates, epochs, cursors.

Greedy packing is a chain: where a batch ends depends on where it began. Offsets are cut into blocks of at
least one budget, so a batch that begins in a block ends before the block after the next. Each block is walked
by one task from every document that can begin its first batch, which tells where the next block's first batch
begins; these links are followed by doubling, and a second walk numbers the batches. No task sees more than a
block and one budget beyond it.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import next_labels
from ..functions.draws import draw
from ..tables import positions, running, stored

#: Budgets in a block.
SPAN = 64


def offsets(df: DataFrame, order: list[str], length: str) -> DataFrame:
    """``start``: what all earlier documents of the order add up to."""
    return running(df, [], order, {"start": F.col(length).cast("long"), "place": F.lit(1).cast("long")})


def oversized(df: DataFrame, length: str, budget: int) -> DataFrame:
    """Documents that no batch can hold; packing never truncates or skips, so callers refuse these."""
    return df.where(F.col(length) > budget)


def _ends(lengths: list[int], budget: int, i: int, sums: list[int]) -> int:
    """First document after a batch that begins at i."""
    return max(i + 1, bisect.bisect_right(sums, sums[i] + budget) - 1)


def pack(df: DataFrame, order: list[str], length: str, budget: int, close_after: bool = False) -> DataFrame:
    """``df`` with batch (from 0): the longest runs of the order that fit the budget. With ``close_after`` a
    group ends with the document by which it reaches the budget, as updates of whole batches do."""
    if budget < 1:
        raise ValueError("the budget must be positive")
    wide = [c for c in df.columns if c not in (*order, length)]
    if not wide:
        return _packed(df, order, length, budget, close_after)
    # what only goes along takes no part in the ordering: it is stored once and met at the end
    kept = stored(df.withColumn("_row", F.monotonically_increasing_id()))
    made = _packed(kept.select("_row", *order, length), order, length, budget, close_after)
    return kept.join(made.drop(*order, length), "_row").drop("_row")


def _packed(df: DataFrame, order: list[str], length: str, budget: int, close_after: bool) -> DataFrame:
    rows = stored(offsets(df, order, length))
    width = budget * SPAN
    if close_after:  # a group may pass the budget by a document
        width += int(rows.agg(F.coalesce(F.max(length), F.lit(0))).first()[0]) * SPAN
    reach = width // SPAN
    placed = rows.select("place", "start", F.col(length).cast("long").alias("size")).withColumn("block", F.floor(F.col("start") / width))
    # the documents just past a block's end are lent to the block before
    lent = placed.where((F.col("start") % width < reach) & (F.col("block") > 0)).withColumn("block", F.col("block") - 1)
    walked = stored(placed.withColumn("own", F.lit(True)).unionByName(lent.withColumn("own", F.lit(False))))

    def runs(pdf: pd.DataFrame) -> tuple[list[int], list[int], int, list[int]]:
        pdf = pdf.sort_values("place")
        sizes = pdf["size"].tolist()
        sums = [0]
        for s in sizes:
            sums.append(sums[-1] + s)
        after = []
        for i in range(len(sizes)):
            if close_after:
                after.append(min(bisect.bisect_left(sums, sums[i] + budget, lo=i + 1), len(sizes)))
            else:
                after.append(_ends(sizes, budget, i, sums))
        return pdf["place"].tolist(), after, int(pdf["own"].sum()), pdf["start"].tolist()

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        places, after, own, starts = runs(pdf)
        block = int(pdf["block"].iloc[0])
        out, leads_to = [], list(range(len(places)))
        for i in range(own - 1, -1, -1):
            j = after[i]
            leads_to[i] = leads_to[j] if j < own else j
        first = places[0]
        for i in range(own):
            if starts[i] - block * width <= reach or i == 0:
                j = leads_to[i]
                out.append((block, places[i], places[j] if j < len(places) else first + len(places)))
        return pd.DataFrame(out, columns=["block", "entry", "leaves"])

    edges = walked.groupBy("block").applyInPandas(links, "block long, entry long, leaves long")
    jump = stored(edges.select("entry", "leaves"))
    known = stored(df.sparkSession.createDataFrame([(0,)], "entry long"))
    for _ in range(64):
        more = known.join(jump, "entry").select(F.col("leaves").alias("entry")).join(jump.select("entry"), "entry", "left_semi").join(known, "entry", "left_anti").distinct()
        more = stored(more)
        if more.isEmpty():
            break
        known = stored(known.unionByName(more))
        beyond = jump.select(F.col("entry").alias("leaves"), F.col("leaves").alias("_on"))
        jump = stored(jump.join(beyond, "leaves", "left").select("entry", F.coalesce("_on", "leaves").alias("leaves")))
    begins = known.join(placed.select(F.col("place").alias("entry"), "block"), "entry").groupBy("block").agg(F.min("entry").alias("entry"))

    def numbered(pdf: pd.DataFrame) -> pd.DataFrame:
        places, after, own, _ = runs(pdf)
        entry = pdf["entry"].iloc[0]
        i = places.index(entry) if pd.notna(entry) and entry in places else own
        out = []
        while i < own:
            out.append((int(pdf["block"].iloc[0]), places[i]))
            i = after[i]
        return pd.DataFrame(out, columns=["block", "place"])

    heads = stored(walked.join(begins, "block", "left").groupBy("block").applyInPandas(numbered, "block long, place long"))
    marked = rows.join(heads.select("place", F.lit(1).cast("long").alias("_head")), "place", "left").withColumn("_head", F.coalesce("_head", F.lit(0)))
    counted = running(marked, [], ["place"], {"_earlier": F.col("_head")})
    return counted.withColumn("batch", F.col("_earlier") + F.col("_head") - 1).drop("_head", "_earlier")


def assemble(packed: DataFrame, tokens: str) -> DataFrame:
    """One row per batch: input_ids, labels shifted within documents, cu_seqlens, documents, tokens. A batch is
    bounded by the budget, so collecting it is."""
    docs = F.sort_array(F.collect_list(F.struct("place", F.col(tokens).alias("t"))))
    out = packed.groupBy("batch").agg(docs.alias("_docs"))
    sizes = F.transform("_docs", lambda d: F.size(d["t"]))
    ends = F.transform(F.sequence(F.lit(0), F.size("_docs")), lambda k: F.aggregate(F.slice(sizes, F.lit(1), k), F.lit(0), lambda a, x: a + x))
    return out.select(
        "batch",
        F.flatten(F.transform("_docs", lambda d: d["t"])).alias("input_ids"),
        F.flatten(F.transform("_docs", lambda d: next_labels(d["t"]))).alias("labels"),
        ends.alias("cu_seqlens"),
        F.size("_docs").alias("documents"),
    ).withColumn("tokens", F.size("input_ids"))


def epochs(df: DataFrame, key: str, seed: str, presentations: float, rows: int) -> DataFrame:
    """Each document once per epoch in the epoch's own order, ``presentations`` times the table in all, rounded
    down to a whole document; ``cursor`` numbers them, so a run resumes behind any cursor."""
    target = int(rows * presentations)
    many = -(-target // rows) if rows else 0
    spark = df.sparkSession
    numbers = spark.range(many).select(F.col("id").cast("int").alias("epoch"))
    shuffled = df.join(F.broadcast(numbers)).withColumn("_draw", draw(f"{seed}:packing:epoch", F.col("epoch"), F.col(key)))
    placed = positions(shuffled, ["_draw", key], "place_in_epoch", ["epoch"])
    return placed.withColumn("cursor", F.col("epoch") * F.lit(rows).cast("long") + F.col("place_in_epoch")).where(F.col("cursor") < target).drop("_draw")


def resumed(sequence: DataFrame, consumed: int) -> DataFrame:
    return sequence.where(F.col("cursor") >= consumed)


def label_totals(packed: DataFrame, length: str, by: str) -> DataFrame:
    """Tokens and labelled tokens (all but each document's last) per batch or update."""
    return packed.groupBy(by).agg(F.sum(length).cast("long").alias("tokens"), (F.sum(length) - F.count("*")).cast("long").alias("labelled"), F.count("*").alias("documents"))


def weighted_loss(loss: Column, weight: Column) -> Column:
    return F.sum(loss * weight) / F.sum(weight)
