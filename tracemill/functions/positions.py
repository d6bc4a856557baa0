"""Columns over positions written as six-field strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# When a draw may be claimed or ends the game; phases by move number.
CLAIM_HALFMOVE, CLAIM_REPETITION, FIVEFOLD = 100, 3, 5
PHASES = [("1-10", 1, 10), ("11-20", 11, 20), ("21-30", 21, 30), ("31-40", 31, 40), ("41-60", 41, 60), ("61-100", 61, 100), ("101+", 101, None)]
HALFMOVE_BUCKETS = [f"{k}-{k + 9}" for k in range(0, CLAIM_HALFMOVE, 10)] + [f"{CLAIM_HALFMOVE}+"]


def position_key(fen: Column) -> Column:
    """Placement, side, castling and en passant: what repeats when a position does."""
    return F.substring_index(fen, " ", 4)


def root_id(fen: Column, repetition: Column) -> Column:
    return F.concat_ws("|", fen, repetition.cast("string"))


def field(fen: Column, k: int) -> Column:
    return F.split(fen, " ")[k]


def turn(fen: Column) -> Column:
    return F.when(field(fen, 1) == "w", "white").otherwise("black")


def claimable(repetition: Column, halfmove: Column) -> Column:
    return (repetition >= CLAIM_REPETITION) | (halfmove >= CLAIM_HALFMOVE)


def halfmove_bucket(halfmove: Column) -> Column:
    low = F.floor(halfmove / 10).cast("long") * 10
    return F.when(halfmove >= CLAIM_HALFMOVE, HALFMOVE_BUCKETS[-1]).otherwise(F.concat_ws("-", low.cast("string"), (low + 9).cast("string")))


def fullmove_phase(fullmove: Column) -> Column:
    """Numbers below 1 belong to no phase and count as the last."""
    out = F.lit(PHASES[-1][0])
    for name, low, high in reversed(PHASES[:-1]):
        out = F.when(fullmove.between(low, high), name).otherwise(out)
    return out


def search_label(width: Column, depth: Column) -> Column:
    return F.concat(F.lit("W"), width.cast("string"), F.lit("/D"), depth.cast("string"))
