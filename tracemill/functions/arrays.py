"""Columns over token arrays: windows, pairs, labels, segments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import CONTROL

IGNORED = -100


def windows(tokens: Column, shortest: int = 2, longest: int = 8) -> Column:
    """All runs of ``shortest`` to ``longest`` neighbouring tokens, within the one array."""

    def of(length: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(tokens) - length + 1), lambda i: F.slice(tokens, i, length))

    lengths = F.filter(F.sequence(F.lit(shortest), F.lit(longest)), lambda n: n <= F.size(tokens))
    return F.flatten(F.transform(lengths, of))


def adjacent_pairs(tokens: Column) -> Column:
    """Structs (left, right) of neighbouring tokens."""
    n = F.size(tokens)
    return F.when(n > 1, F.zip_with(F.slice(tokens, F.lit(1), n - 1), F.slice(tokens, F.lit(2), n - 1), lambda a, b: F.struct(a.alias("left"), b.alias("right")))).otherwise(F.array().cast("array<struct<left:int,right:int>>"))


def next_labels(tokens: Column) -> Column:
    """The token after each one; nothing is predicted after the last."""
    n = F.size(tokens)
    return F.when(n > 0, F.concat(F.slice(tokens, F.lit(2), F.greatest(n - 1, F.lit(0))), F.array(F.lit(IGNORED)))).otherwise(tokens)


def merge_segments(tokens: Column, final: int = CONTROL["final"]) -> Column:
    """``tokens`` cut two places after each ``final``: no composite spans a decision."""
    n = F.size(tokens)
    cuts = F.filter(F.transform(tokens, lambda t, i: F.when(t == final, i + 2)), lambda i: i.isNotNull() & (i < n))
    ends = F.array_distinct(F.concat(cuts, F.array(n)))
    starts = F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.greatest(F.size(ends) - 1, F.lit(0))))
    return F.zip_with(starts, ends, lambda a, b: F.slice(tokens, a + 1, b - a))


def is_ragged_sound(tokens: Column, count: Column, limit: int) -> Column:
    """Whether an array has the stated length, at least one token, and only ids from 0 up to ``limit``."""
    return (F.size(tokens) == count) & (count >= 1) & F.forall(tokens, lambda t: t.isNotNull() & (t >= 0) & (t < limit))


def trajectory_shape(values: Column) -> Column:
    """How a list of values runs; nulls (mates) are left out."""
    kept = F.filter(values, lambda v: v.isNotNull())
    n = F.size(kept)
    steps = F.when(n > 1, F.zip_with(F.slice(kept, F.lit(2), n - 1), F.slice(kept, F.lit(1), n - 1), lambda b, a: F.signum(b - a))).otherwise(F.array().cast("array<double>"))
    up, down = F.exists(steps, lambda s: s > 0), F.exists(steps, lambda s: s < 0)
    return F.when(n == 0, "mate_only").when(~up & ~down, "flat").when(~down, "monotone_up").when(~up, "monotone_down").otherwise("mixed")


def scan(values: Column, zero: Column, step, emit=None, piece: int = 64, after: bool = False) -> Column:
    """What a running state says of each element: ``emit(state, x)`` (the state itself, if none) with the state that
    ``step(state, x)`` has reached before ``x``, from ``zero`` on; ``after``: with the state that it reaches by ``x``, which
    is worked out once. Null for a null array.

    An array cannot grow cheaply, so it is walked in pieces: once for the state at the start of each piece, and once
    inside every piece from there. Appending costs a piece's length and the number of pieces, not the array's length.
    """
    emit = emit or (lambda s, x: s)
    n = F.size(values)
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(n, F.lit(1)) - 1) / piece).cast("int")), lambda k: F.slice(values, k * piece + 1, F.lit(piece)))
    starts = F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(zero), lambda acc, p: F.concat(acc, F.array(F.aggregate(p, F.element_at(acc, -1), step))))

    def inside(part: Column, start: Column) -> Column:
        first = F.struct(start.alias("s"), F.filter(F.array(emit(zero, F.get(values, F.lit(0)))), lambda x: F.lit(False)).alias("o"))
        moved = lambda acc, x, s: F.struct(s.alias("s"), F.concat(acc["o"], F.array(emit(s if after else acc["s"], x))).alias("o"))
        # an array of one gives the next state a name
        walk = (lambda acc, x: F.get(F.transform(F.array(step(acc["s"], x)), lambda s: moved(acc, x, s)), F.lit(0))) if after else (lambda acc, x: moved(acc, x, step(acc["s"], x)))
        return F.aggregate(part, first, walk, lambda acc: acc["o"])

    walked = F.zip_with(parts, starts, inside)
    return F.when(values.isNotNull(), F.flatten(walked))
