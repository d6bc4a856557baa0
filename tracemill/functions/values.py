"""Columns over evaluations: value bins, mates, bounds, per-mille outcomes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import START, literal

# Upper ends of the value bins (the last bin is open) and each bin's mean.
BOUNDS = [
    -0.9995, -0.9935, -0.9495, -0.7525, -0.4055, -0.1665, -0.0685, -0.0265, -0.0065, -0.0005,
    0.0045, 0.0185, 0.0485, 0.1125, 0.2795, 0.6245, 0.9145, 0.9915, 0.9995,
]
MEANS = [
    -1.0, -0.9975466656545338, -0.9778050997401598, -0.869374566711709, -0.5802287566316574, -0.27132291636100436, -0.11024468967970123,
    -0.0449997169102215, -0.014999041330398631, -0.0031977730105220144, 0.000901943418371388, 0.010669587162031527, 0.03184649072259998,
    0.07566960512966994, 0.18261132375456368, 0.4405164642839585, 0.7900643834679745, 0.9648939514177877, 0.997022958525894, 1.0,
]
WIN_MAX, LOSS_MAX = 28, 30


def value_bin(value: Column) -> Column:
    """Bin of a value in [-1, 1]: the first whose upper end is not below it. Null outside."""
    return F.when(value.between(-1, 1), F.size(F.filter(literal(BOUNDS), lambda b: b < value)))


def bin_value(number: Column) -> Column:
    return F.try_element_at(literal(MEANS), number.cast("int") + 1)


def capped_mate(distance: Column) -> Column:
    return F.greatest(F.lit(-LOSS_MAX), F.least(F.lit(WIN_MAX), distance))


def mate_token(distance: Column, win: Column) -> Column:
    return F.when(win, START["mate_win"] + F.least(distance, F.lit(WIN_MAX))).otherwise(START["mate_loss"] + F.least(distance, F.lit(LOSS_MAX)))


def token_value(token: Column) -> Column:
    """The value that a value or mate token stands for; null for others."""
    between = lambda name, size: token.between(START[name], START[name] + size - 1)
    return F.when(between("value", len(MEANS)), bin_value(token - START["value"])).when(between("mate_win", WIN_MAX + 1), 1.0).when(between("mate_loss", LOSS_MAX + 1), -1.0)


def is_mate(raw: Column, value_mate: Column, max_ply: Column) -> Column:
    return F.abs(raw) >= value_mate - max_ply


def mate_moves(raw: Column, value_mate: Column, max_ply: Column) -> Column:
    """Signed number of moves to mate; null where the score is none."""
    plies = value_mate - F.abs(raw)
    half = lambda x: F.floor(x / 2).cast("int")
    return F.when(is_mate(raw, value_mate, max_ply), F.when(raw > 0, half(plies + 1)).otherwise(-half(plies)))


def outcome_value(wdl: Column) -> Column:
    """Wins less losses of a per-mille triple."""
    return (wdl[0] - wdl[2]) / F.lit(1000.0)


def wdl_is_sound(wdl: Column) -> Column:
    inside = F.forall(wdl, lambda x: x.isNotNull() & x.between(0, 1000))
    return (F.size(wdl) == 3) & inside & (F.aggregate(wdl, F.lit(0).cast("bigint"), lambda a, x: a + x) == 1000)


def bound(raw: Column, alpha: Column, beta: Column) -> Column:
    return F.when(raw <= alpha, "upper").when(raw >= beta, "lower").otherwise("exact")


def root_view(value: Column, ply: Column) -> Column:
    """A value of the side to move ``ply`` half-moves below the root, as the root's side sees it."""
    return F.when(F.pmod(ply, F.lit(2)) == 1, -value).otherwise(value)


def score_key(cp: Column, mate: Column) -> Column:
    """Orders scores: mates against, then centipawns, then mates for; nearer mates further out."""
    sign = F.when(mate.isNull(), 0).when(mate > 0, 1).otherwise(-1)
    return F.struct(sign.alias("sign"), F.coalesce(-mate, cp).alias("score"))


def signed_text(value: Column) -> Column:
    return F.concat(F.lit("value:"), F.when(value >= 0, "+").otherwise(""), F.format_string("%.3f", value))


def warm_cosine(progress: Column, warmup: float, least: float) -> Column:
    """Learning-rate factor at a share of the run: a linear rise, then half a cosine down to ``least``."""
    share = (progress - warmup) / (1 - warmup)
    return F.when(progress < warmup, progress / warmup).otherwise(least + (1 - least) * (1 + F.cos(F.pi() * share)) / 2)


def percent(share: Column) -> Column:
    """A share as people read it, with two places; null is no measurement, not none."""
    return F.when(share.isNull(), "n/a").otherwise(F.format_string("%.2f%%", 100 * share))
