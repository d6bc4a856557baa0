"""What each token of a trace is for, told by the grammar's delimiters alone, and how tokens share in the roles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions import words
from ..functions.vocabulary import COMPOSITE, CONTROL, START, literal

# Numbers of the roles.
ROLES = ("pad", "board", "move", "eval", "control", "final_move", "refuted", "final_pv", "final_eval", "mixed")
ROLE = {name: k for k, name in enumerate(ROLES)}
#: Tokens that describe a board's state: side, castling, en passant, half moves, repetition, one each but four castlings.
METAS = 8
REFUSED = -1

#: Tokens that a task gives roles at a time.
PIECE = 1_000_000
_INTS = ArrayType(IntegerType())


def _roles(t: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Roles of streams that lie end to end. What a token may be follows from the last one before it that belongs to no
    board, from how many pieces and metadata came since, and from where the stream's first FINAL stands."""
    n, at = len(t), np.arange(len(t))
    row = np.repeat(np.arange(len(sizes)), sizes)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    final = np.full(len(sizes), n, np.int64)
    marks = np.flatnonzero(t == CONTROL["final"])[::-1]
    final[row[marks]] = marks
    final = final[row]
    low = t < START["move"]
    # the last token before each that is no board's; first - 1 where there is none
    before = np.concatenate([[-1], np.maximum.accumulate(np.where(low, -1, at))])[:n]
    opener = np.where(before >= first, before, first - 1)
    observing = (opener >= first) & (t[opener] == CONTROL["board"]) & (opener < final)
    piece, meta = low & (t < START["side"]), low & (t >= START["side"])
    pieces, metas = np.concatenate([[0], np.cumsum(piece)]), np.concatenate([[0], np.cumsum(meta)])
    since = lambda c, upto: c[upto] - c[opener + 1]
    fits = np.where(piece, since(metas, at) == 0, (since(pieces, at) > 0) & (since(metas, at + 1) <= METAS))
    misfits = np.concatenate([[0], np.cumsum(low & ~fits)])
    # up to here an observation without a fault that still lacks pieces or metadata
    short = lambda upto: observing & (since(misfits, upto) == 0) & (since(metas, upto) < METAS)
    move, value = (t >= START["move"]) & (t < START["value"]), (t >= START["value"]) & (t < CONTROL["pad"])
    control = lambda *names: np.isin(t, [CONTROL[c] for c in names])
    plain = np.select([move, value, control("final", "board", "back", "reset", "depth"), control("refuted")], [ROLE["move"], ROLE["eval"], ROLE["control"], ROLE["refuted"]], REFUSED)
    plain[short(at)] = REFUSED
    board = np.where(observing & (since(misfits, at + 1) == 0), ROLE["board"], REFUSED)
    suffix = np.select([control("end"), move, value], [ROLE["control"], ROLE["final_pv"], ROLE["final_eval"]], REFUSED)
    decision = np.where(move, ROLE["final_move"], REFUSED)
    out = np.select([at == final + 1, at > final, low], [decision, suffix, board], plain)
    last = (np.cumsum(sizes) - 1)[sizes > 0]
    ends_inside = np.where(low[last], short(at + 1)[last], t[last] == CONTROL["board"]) & (final[last] > last)
    out[last[ends_inside]] = REFUSED
    return out


@F.arrow_udf(_INTS)
def _roles_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for b in batches:
        tokens, sizes, there = words.flat(b)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        made = [_roles(tokens[ends[i] : ends[j]].astype(np.int64), sizes[i:j]) for i, j in words.rows_within(sizes, PIECE)]
        yield words.lists(np.concatenate([np.zeros(0, np.int64), *made]), sizes, there)


def roles(tokens: Column) -> Column:
    """The role of each atom; REFUSED where the grammar has no place for it, where an observation ends too early (the
    token after it), and for the last token of a stream that ends inside one. A null token has no place."""
    return _roles_of(F.transform(tokens.cast("array<int>"), lambda t: F.coalesce(t, F.lit(CONTROL["pad"]))))


def _composite(roles: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One role for each of ``counts`` stored tokens a stream."""
    first = np.repeat(np.cumsum(sizes) - sizes, counts)
    begin = np.cumsum(lengths) - lengths
    heads = np.repeat((np.cumsum(counts) - counts), counts)
    begin = first + begin - begin[heads]
    end = np.repeat(np.cumsum(sizes), counts)
    begin, end = np.minimum(begin, end), np.minimum(begin + lengths, end)
    decided = np.concatenate([[0], np.cumsum(roles == ROLE["final_move"])])
    changes = np.concatenate([[0, 0], np.cumsum(roles[1:] != roles[:-1])])[: len(roles) + 1]  # before each token and its follower
    there = end > begin
    same = there & (changes[end] == changes[np.minimum(begin + 1, len(roles))])
    own = np.append(roles, ROLE["mixed"])[np.where(there, begin, len(roles))]
    return np.select([decided[end] > decided[begin], same], [ROLE["final_move"], own], ROLE["mixed"])


@F.arrow_udf(_INTS)
def _composite_of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for of, lengths in batches:
        (own, sizes, _), (spans, counts, also) = words.flat(of), words.flat(lengths)
        made = _composite(own.astype(np.int64), sizes, spans.astype(np.int64), counts)
        yield words.lists(made, counts, also)


def composite_roles(atom_roles: Column, lengths: Column) -> Column:
    """One role for each stored token, which stands for so many atoms: theirs if they share one, else mixed; a token
    that holds the final decision has the decision's role."""
    return _composite_of(atom_roles.cast("array<int>"), lengths.cast("array<int>"))


def token_lengths(tokens: Column, entries: list[list[int]]) -> Column:
    """How many atoms each stored token stands for; ``entries`` are the dictionary's, in the order of their ids."""
    if not entries:
        return F.transform(tokens, lambda t: F.lit(1))
    sizes = literal([len(e) for e in entries])
    return F.transform(tokens, lambda t: F.when(t < COMPOSITE, 1).otherwise(F.get(sizes, t - COMPOSITE)))


def role_shares(df: DataFrame, role_col: str, keys: list[str]) -> DataFrame:
    """(keys, role, n, share): how many tokens of each group have the role; partial counts, so no group is large."""
    # outer, as a plain explode would have the roles worked out once more to tell whether there are any
    each = df.select(*keys, F.explode_outer(role_col).alias("_r")).where("_r IS NOT NULL")
    counts = each.groupBy(*keys, "_r").agg(F.count("*").alias("n"))
    name = F.when(F.col("_r") == REFUSED, "refused").otherwise(F.get(literal(ROLES), F.col("_r")))
    return counts.select(*keys, name.alias("role"), "n", (F.col("n") / F.sum("n").over(Window.partitionBy(*keys or [F.lit(0)]))).alias("share"))
