"""Seeded draws: native ones from sha2, and Mersenne Twister ones for results made by Python programs."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values of a native draw: 60 bits.
RANGE = 1 << 60


def draw(*parts: str | Column) -> Column:
    """A whole number from 0 to RANGE - 1, the same for the same parts everywhere."""
    text = F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def uniform(*parts: str | Column) -> Column:
    return draw(*parts) / F.lit(float(RANGE))


def by_weight(roll: Column, weights: list[tuple[str, float]]) -> Column:
    """The entry in whose share of [0, 1) the roll falls, shares laid out in the order given; the last entry
    with a share above 0 takes what rounding leaves."""
    last = [k for k, p in weights if p > 0][-1]
    total, ends = 0.0, []
    for k, p in weights:
        total += p
        ends.append((k, total))
    out = F.lit(last)
    for k, end in reversed(ends):
        out = F.when(roll < end, k).otherwise(out)
    return out


def _mt(kind: str, make):
    @F.pandas_udf(kind)
    def f(seeds: pd.Series) -> pd.Series:
        return seeds.map(lambda s: make(random.Random(s)))

    return f


def mt_bits(seed: Column) -> Column:
    """64 random bits of Python's generator seeded with the string."""
    from decimal import Decimal

    return _mt("decimal(20,0)", lambda r: Decimal(r.getrandbits(64)))(seed)


def mt_uniform(seed: Column) -> Column:
    return _mt("double", lambda r: r.random())(seed)


def mt_below(seed: Column, n: int) -> Column:
    return _mt("long", lambda r: r.randrange(n))(seed)


#: One position in so many is held for validation.
VALIDATION_ONE_IN = 65


def split_of(key: Column, seed: str = "split") -> Column:
    return F.when(F.pmod(draw(seed, key), F.lit(VALIDATION_ONE_IN)) == 0, "val").otherwise("train")


def split_as_python(key: Column) -> Column:
    return F.when(mt_below(key, VALIDATION_ONE_IN) == 0, "val").otherwise("train")
