"""Archives and puzzles to one root pool, source after source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import draws
from ..functions import positions as P
from ..operators import dedup, games, sampling
from ..tables import positions, stored


def game_roots(parsed: DataFrame) -> DataFrame:
    found = games.pool(games.candidates(games.replay(parsed)))
    source = F.to_json(F.struct("game", "ply"))
    return found.select("root_id", "fen", "repetition", "turn", "position_key", "halfmove", source.alias("source"))


def puzzle_pool(puzzles: DataFrame) -> DataFrame:
    """Sound puzzle roots, the first row of each position in file order."""
    sound = games.puzzle_roots(puzzles).where("problem IS NULL")
    first = dedup.first_seen(sound, F.col("position_key"), ["file", "place"])
    return first.select("root_id", F.col("root_fen").alias("fen"), "repetition", "turn", "position_key", P.field(F.col("root_fen"), 4).cast("int").alias("halfmove"), "source")


def select(roots: DataFrame, sizes: dict[str, int], share: float, seed: str, taken: DataFrame | None = None) -> DataFrame:
    """A source's stratified sample without positions that earlier sources took; fails where a stratum is short."""
    fresh = roots if taken is None else dedup.excluding(roots, taken, ["position_key"])
    key = F.col("root_id")
    marked = fresh.withColumns({"split": draws.split_of(F.col("position_key")), "claimable": P.claimable(F.col("repetition"), F.col("halfmove")), "priority": draws.draw(seed, key, "pool")})
    chosen = stored(sampling.stratified_sample(marked, "split", "claimable", sizes, share, "priority", ["root_id"], draws.RANGE))
    short = sampling.undersupply(chosen, "split", "claimable", sizes, share).collect()  # a row per stratum
    if short:
        raise ValueError(f"too few roots: {[r.asDict() for r in short]}")
    return chosen.drop("priority")


def prepare(sources: list[tuple[DataFrame, dict[str, int], float]], seed: str) -> DataFrame:
    """The pool of all sources in its own seeded order (``place``)."""
    pool = None
    for roots, sizes, share in sources:
        one = select(roots, sizes, share, seed, pool)
        pool = one if pool is None else pool.unionByName(one)
    ordered = positions(pool.withColumn("_draw", draws.draw(seed, F.col("root_id"), "pool-order")), ["_draw", "root_id"], "place")
    return ordered.drop("_draw")
