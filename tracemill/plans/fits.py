"""Dictionary profiles: fit on full rows that are not held out, measure on both sides, one tier per size."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import draws
from ..functions.arrays import merge_segments
from ..functions.vocabulary import COMPOSITE, CONTROL
from ..operators import ngrams, profiles, sampling, segmentation
from ..tables import stored


def controls() -> Column:
    """The control tokens, which no composite may hold."""
    return F.array(*(F.lit(c) for c in CONTROL.values()))


def held_out(position: Column, fraction: float) -> Column:
    """Whether a position is kept from fitting; all rows of a position go the same way."""
    return draws.uniform("holdout", position) < fraction


def parts(rows: DataFrame, fraction: float, fit_split: str = "all", stride: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fitting, measured, held out) rows with position, presentation, split and atoms: fitting takes the full
    presentation of every ``stride``-th position that is not held out; measuring takes every presentation."""
    away = held_out(F.col("position"), fraction)
    if fit_split != "all":
        away = away | (F.col("split") != fit_split)
    apart = rows.where(away).select("position").distinct()
    kept = rows.join(apart, "position", "left_anti")
    full = kept.where("presentation = 'full'")
    if stride > 1:
        full = full.join(sampling.every_kth(full.select("position").distinct(), ["position"], stride), "position", "left_semi")
    return full, kept, rows.join(apart, "position", "left_semi")


def segments(rows: DataFrame) -> DataFrame:
    """The atoms of each row cut where no composite may cross."""
    return rows.select(F.explode(merge_segments(F.col("atoms"))).alias("atoms")).where(F.size("atoms") > 0)


def encoded(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``rows`` with n_atoms and the tokens of their segments, in order."""
    cut = rows.select("*", F.posexplode(merge_segments(F.col("atoms"))).alias("_k", "_s"))
    made = segmentation.encode(cut, "_s", dictionary, "_t")
    keys = ["doc_index"]
    joined = made.groupBy(*keys).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_k", "_t"))), lambda x: x["_t"])).alias("tokens"))
    return rows.join(joined, keys).withColumns({"n_atoms": F.size("atoms"), "length": F.size("tokens")})


def tiers(rows: DataFrame, sizes: list[int], fraction: float, min_count: int = ngrams.MIN_COUNT, limit: int = ngrams.LIMIT, stride: int = 1, sets: tuple[str, ...] = ("presentation", "split")) -> DataFrame:
    """(size, part, section, value, documents, tokens, atoms, ratio) for dictionaries of each vocabulary size. Runs
    are counted once; each size selects its own dictionary from them."""
    full, kept, apart = parts(rows, fraction, stride=stride)
    streams = stored(segments(full))
    pool = stored(ngrams.candidates(ngrams.count_windows(streams, "atoms", min_count=min_count, forbidden=controls()), limit))
    out = None
    for size in sizes:
        budget = size - COMPOSITE
        if budget < 0:
            raise ValueError(f"a vocabulary has at least {COMPOSITE} tokens")
        block = max(8, budget // 32)
        dictionary = segmentation.select_dictionary(streams, "atoms", pool, budget, block)
        for name, part in (("measured", kept), ("held_out", apart)):
            one = profiles.slices(encoded(part, dictionary), list(sets), "length", "n_atoms").select(F.lit(size).alias("size"), F.lit(name).alias("part"), "*")
            out = one if out is None else out.unionByName(one)
    return out


def top(rows: DataFrame, dictionary: DataFrame, n: int) -> DataFrame:
    """The ``n`` entries that save most where they were chosen."""
    used = segmentation.usage(rows, "tokens", dictionary)
    return used.withColumn("saved", F.col("n") * (F.size("atoms") - 1)).orderBy(F.desc("saved"), "id").limit(n)


def fitted(rows: DataFrame, settings: dict, path: str) -> DataFrame:
    """The dictionary of these settings: read back where it was stored under them, else fitted and stored. The
    settings name the input too; another input or other settings have another folder."""
    spark = rows.sparkSession
    name = hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:24]
    target = f"{path}/dictionary-{name}"
    try:
        return spark.read.schema("id int, atoms array<int>").parquet(target)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    streams = stored(segments(rows))
    pool = ngrams.candidates(ngrams.count_windows(streams, "atoms", min_count=settings.get("min_count", ngrams.MIN_COUNT), forbidden=controls()), settings.get("limit", ngrams.LIMIT))
    made = segmentation.select_dictionary(streams, "atoms", pool, settings["budget"], settings.get("block", 64))
    made.write.parquet(target)
    return spark.read.schema("id int, atoms array<int>").parquet(target)
