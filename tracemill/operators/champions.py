"""Champion records: the best move of every search round with its exact candidates, the rules they keep, and the audit
of a trace's steps, boundaries and label against them.

A root's record holds its rounds as an array; what is checked lies within one row, so the rules cost one scan and no
shuffle. Legality of moves is not checked here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.arrays import scan
from ..functions.vocabulary import CLAIM, CONTROL, SEGMENTS, START, literal, mirror_uci, moves
from ..functions.words import rows_within
from .rounds import boundary_champions

CANDIDATE = "struct<move: string, raw: int, wdl: array<int>, mate: int, value_token: int, `order`: int, draw: boolean>"
ROUND = f"struct<round: int, depth: int, move: string, raw: int, wdl: array<int>, mate: int, value_token: int, pv: array<string>, refutations: int, candidates: array<{CANDIDATE}>>"

# The highest raw at which a draw may be claimed, and when it may.
CLAIM_BOUND = 1
REPETITIONS, HALFMOVES = 3, 100


def nested(rounds: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """(key, rounds): flat rounds (key, round and the fields of ``ROUND`` but candidates) and candidates (key, round and
    the fields of ``CANDIDATE``) as one record per root; rounds by number, candidates by their order. A round without
    candidates has an empty list; candidates of a round that is not there are left out."""
    lists = candidates.groupBy(key, "round").agg(in_order().alias("candidates"))
    return of_rounds(rounds.join(lists, [key, "round"], "left"), key)


def in_order() -> Column:
    """The candidates of a group by their order."""
    entry = F.struct(*(F.col(f) for f in ("move", "raw", "wdl", "mate", "value_token", "order", "draw")))
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col("order").alias("_o"), F.col("move").alias("_m"), entry.alias("_e")))), lambda x: x["_e"])


def of_rounds(rounds: DataFrame, key: str) -> DataFrame:
    """(key, rounds) of rounds that have their candidates; those without any have a null."""
    whole = rounds.withColumn("candidates", F.coalesce("candidates", F.array().cast(f"array<{CANDIDATE}>")))
    one = F.struct("round", "depth", "move", "raw", "wdl", "mate", "value_token", "pv", "refutations", "candidates").cast(ROUND)
    return whole.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("round", one.alias("_r")))), lambda x: x["_r"]).alias("rounds"))


def mate_token_of(mate: Column) -> Column:
    """The token that a signed mate distance is written as."""
    return F.when(mate >= 0, START["mate_win"] + mate).otherwise(START["mate_loss"] - mate)


def value_token_of(wdl: Column) -> Column:
    return START["value"] + V.value_bin(V.outcome_value(wdl))


def _round_rules(r: Column, value_mate: Column, max_ply: Column) -> dict[str, Column]:
    own = F.filter(r["candidates"], lambda x: x["move"] == r["move"])
    claim, outcome = r["wdl"].isNull(), r["wdl"].isNotNull()
    return {
        "numbers": (r["round"] >= 1) & (r["depth"] >= 1),
        "variation": (F.size(r["pv"]) > 0) & F.forall(r["pv"], lambda m: m.isNotNull()) & (F.get(r["pv"], F.lit(0)) == r["move"]),
        "token_range": r["value_token"].between(START["value"], START["control"] - 1),
        "mate_claim": outcome | (r["mate"] != 0),
        "mate_token": outcome | (r["value_token"] == mate_token_of(r["mate"])),
        "mate_distance": outcome | (V.capped_mate(V.mate_moves(r["raw"], value_mate, max_ply)) == r["mate"]),
        "outcome": claim | (V.wdl_is_sound(r["wdl"]) & r["mate"].isNull()),
        "outcome_token": claim | (r["value_token"] == value_token_of(r["wdl"])),
        "has_candidates": F.size(r["candidates"]) > 0,
        "candidates_once": F.size(F.array_distinct(F.transform(r["candidates"], lambda x: x["move"]))) == F.size(r["candidates"]),
        "written": F.size(own) > 0,
        "own_raw": (F.size(own) == 0) | (F.get(own, F.lit(0))["raw"] == r["raw"]),
        "maximum": (F.size(own) == 0) | (F.array_max(F.transform(r["candidates"], lambda x: x["raw"])) == F.get(own, F.lit(0))["raw"]),
    }


def _candidate_rules(x: Column) -> dict[str, Column]:
    claim, outcome = x["wdl"].isNull(), x["wdl"].isNotNull()
    return {
        "candidate": x["move"].isNotNull() & (x["order"] >= 1) & x["raw"].isNotNull() & x["draw"].isNotNull(),
        "candidate_draw": ~x["draw"] | (claim & x["mate"].isNull() & (x["value_token"] == START["value"] + V.value_bin(F.lit(0.0)))),
        "candidate_mate": x["draw"] | outcome | (x["value_token"] == mate_token_of(x["mate"])),
        "candidate_outcome": x["draw"] | claim | (V.wdl_is_sound(x["wdl"]) & x["mate"].isNull()),
        "candidate_token": x["draw"] | claim | (x["value_token"] == value_token_of(x["wdl"])),
    }


def _broken(rules: dict[str, Column], detail: Column) -> Column:
    found = F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(name).alias("rule"), detail.alias("detail"))) for name, ok in rules.items()))
    return F.filter(found, lambda v: v.isNotNull())


def problems(champions: DataFrame, key: str, value_mate: Column, max_ply: Column) -> DataFrame:
    """(id, rule, detail) of records (key, rounds) that break a rule of rounds, of candidates or of their numbers. detail
    names the round, and the move for a candidate. A null list of rounds counts as none."""
    c = F.col
    rounds = F.coalesce("rounds", F.array().cast(f"array<{ROUND}>"))
    n = F.size(rounds)
    counted = F.when(n > 0, F.transform(rounds, lambda r: r["round"]) == F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(False)
    whole = _broken({"contiguous": counted}, F.lit(None).cast("string"))
    at = lambda r: F.coalesce(r["round"].cast("string"), F.lit("?"))
    of_round = lambda r: _broken(_round_rules(r, value_mate, max_ply), at(r))
    of_candidates = lambda r: F.flatten(F.transform(F.coalesce(r["candidates"], F.array().cast(f"array<{CANDIDATE}>")), lambda x: _broken(_candidate_rules(x), F.concat_ws("/", at(r), x["move"]))))
    # rounds are rows before their rules are looked at, so each expression is compiled over one round
    each = champions.select(c(key).alias("id"), F.explode(rounds).alias("r"))
    inner = each.select("id", F.inline(F.concat(of_round(c("r")), of_candidates(c("r")))))
    return champions.select(c(key).alias("id"), F.inline(whole)).unionByName(inner)


# Steps and boundaries ----------------------------------------------------------------------------------------


def scored_steps(steps: DataFrame, champions: DataFrame, key: str) -> DataFrame:
    """Steps (key, seq, kind: begin, exact, end or another; round, move) with raw and value: those of the champion's
    candidate of the same round and move for an exact step, those of the round itself, with its move, for an end. A step
    that meets none has nulls, and an exact one becomes of kind "other": it leaves the champion as it is."""
    c = F.col
    r = champions.select(key, F.explode("rounds").alias("r"))
    at_end = F.struct(F.lit("end").alias("kind"), F.lit(None).cast("string").alias("_at"), c("r.move").alias("_move"), c("r.raw").alias("raw"), c("r.value_token").alias("value"))
    # a candidate that is written twice counts once, as first written
    moves_of = F.transform("r.candidates", lambda x: x["move"])
    firsts = F.filter("r.candidates", lambda x, i: F.array_position(moves_of, x["move"]) == i + 1)
    exact = F.transform(firsts, lambda x: F.struct(F.lit("exact").alias("kind"), x["move"].alias("_at"), x["move"].alias("_move"), x["raw"].alias("raw"), x["value_token"].alias("value")))
    known = r.select(key, c("r.round").alias("round"), F.inline(F.concat(F.array(at_end), F.coalesce(exact, F.array()))))
    asked = steps.withColumn("_at", F.when(c("kind") == "exact", c("move")))
    left, right = asked.alias("s"), known.alias("k")
    same = (c(f"s.{key}") == c(f"k.{key}")) & (c("s.round") == c("k.round")) & (c("s.kind") == c("k.kind")) & c("s._at").eqNullSafe(c("k._at"))
    met = left.join(right, same, "left")
    kind = F.when((c("s.kind") == "exact") & c("k.raw").isNull(), "other").otherwise(c("s.kind"))
    return met.select(c(f"s.{key}"), c("s.seq"), kind.alias("kind"), c("s.round"), F.coalesce("k._move", "s.move").alias("move"), c("k.raw"), c("k.value"))


def expected_states(steps: DataFrame, champions: DataFrame, key: str) -> DataFrame:
    """(key, seq, best, value, round): the champion that each boundary of a trace must show."""
    return boundary_champions(scored_steps(steps, champions, key), key)


def state_problems(rows: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(id, rule, detail) of rows (key, state_best array of moves, state_value array) against the expected states: their
    count, or the first place, from 0, at which they differ. A champion not known yet is a null in both."""
    c = F.col
    listed = expected.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "best", "value"))).alias("_e"))
    met = rows.select(key, "state_best", "state_value").join(listed, key, "left")
    e = F.coalesce("_e", F.array().cast("array<struct<seq:bigint,best:string,value:double>>"))
    written = F.arrays_zip(F.col("state_best").alias("best"), F.col("state_value").cast("array<double>").alias("value"))
    differs = F.zip_with(written, e, lambda w, x: ~(w["best"].eqNullSafe(x["best"]) & w["value"].eqNullSafe(x["value"])))
    first = F.array_position(differs, True) - 1
    counted = (F.size("state_best") == F.size(e)) & (F.size("state_value") == F.size(e))
    rule = F.when(~F.coalesce(counted, F.lit(False)), F.struct(F.lit("state_count").alias("rule"), F.concat_ws("/", F.size("state_best").cast("string"), F.size(e).cast("string")).alias("detail")))
    rule = rule.when(first >= 0, F.struct(F.lit("state").alias("rule"), first.cast("string").alias("detail")))
    return met.select(c(key).alias("id"), rule.alias("_v")).where("_v IS NOT NULL").select("id", "_v.rule", "_v.detail")


# Two programs of one search ----------------------------------------------------------------------------------


def outside_spans(tokens: Column, opens, closes) -> Column:
    """The tokens that no span encloses, by a running count of spans open; a span's own two marks go with it. ``opens`` and
    ``closes`` say of a token whether it is such a mark. Marks may nest; a closing one without an opening one is a token
    like others. Null for a null array."""
    step = lambda open_, t: F.when(opens(t), open_ + 1).when(closes(t) & (open_ > 0), open_ - 1).otherwise(open_)
    kept = scan(tokens, F.lit(0), step, lambda open_, t: F.when(~((open_ > 0) | opens(t)), t))
    return F.filter(kept, lambda t: t.isNotNull())


#: Steps of the fuller program that a task compares at a time.
PIECE = 250_000


def _fields(steps: pa.Array) -> dict[str, pa.Array]:
    """The fields of all steps end to end; those of a step that is null are null."""
    inner = steps.flatten()
    return {f.name: x for f, x in zip(inner.type, inner.flatten(), strict=True)}


def _same(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Whether two values are equal, nulls among themselves."""
    out = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(a.is_null(), b.is_null()))
    if pa.types.is_floating(a.type) and pa.types.is_floating(b.type):
        out = pc.or_(out, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
    return out.to_numpy(zero_copy_only=False)


def _compared(tool: pa.Array, plain: pa.Array, inserted: str, suffix: list[str]) -> pa.Array:
    """What ``aligned`` adds, for many rows at a time."""
    t, p = _fields(tool), _fields(plain)
    sizes = [pc.fill_null(x.value_lengths(), 0).to_numpy().astype(np.int64) for x in (tool, plain)]
    there = [x.is_valid().to_numpy(zero_copy_only=False) for x in (tool, plain)]
    begins = [np.cumsum(n) - n for n in sizes]
    row = np.repeat(np.arange(len(tool)), sizes[0])
    ordinary = ~pc.fill_null(pc.equal(t["operation"], inserted), False).to_numpy(zero_copy_only=False)
    told = np.bincount(row[ordinary], minlength=len(tool))

    # a step's own plain step, or the one before an inserted step
    upto = np.cumsum(ordinary)
    k = upto - 1 - np.concatenate([[0], upto])[begins[0]][row]
    met = (k >= 0) & (k < sizes[1][row])
    plain_end = pc.fill_null(p["end"].take(pa.array(begins[1][row] + k, mask=~met)), 0)
    shown = ~pc.is_in(t["operation"], pa.array(suffix, pa.string())).to_numpy(zero_copy_only=False)
    at = row[shown]
    ends = [x.filter(pa.array(shown)) for x in (t["end"], plain_end)]
    a, b = (pc.fill_null(x, 0).to_numpy() for x in ends)
    valid = ends[0].is_valid().to_numpy(zero_copy_only=False)
    later = (at[1:] > at[:-1]) | (a[1:] > a[:-1]) | ((a[1:] == a[:-1]) & (b[1:] >= b[:-1]))
    if not (valid.all() and later.all()):
        order = pa.array(np.lexsort((b, a, valid, at)))
        ends = [x.take(order) for x in ends]
    pairs = pa.StructArray.from_arrays(ends, names=["tool_end", "plain_end"])
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(tool)))]).astype(np.int32))
    boundaries = pa.ListArray.from_arrays(offsets, pairs, mask=pa.array(~there[0]))

    problem = np.full(len(tool), None, object)
    both = there[0] & there[1]
    problem[both & (told != sizes[1])] = "operations"
    equal = both & (told == sizes[1])
    owner = np.repeat(np.arange(len(tool)), sizes[1])
    left, right = np.flatnonzero(ordinary & equal[row]), np.flatnonzero(equal[owner])
    agree = np.ones(len(left), bool)
    for f in ("position", "move", "value", "mate"):
        agree &= _same(t[f].take(pa.array(left)), p[f].take(pa.array(right)))
    differ = right[~agree]
    rows, first = np.unique(owner[differ], return_index=True)
    problem[rows] = [f"step {i}" for i in (differ[first] - begins[1][rows]).tolist()]
    return pa.StructArray.from_arrays([boundaries, pa.array(problem, pa.string())], names=["boundaries", "problem"])


def _in_pieces(batches: Iterator[tuple[pa.Array, pa.Array]], inserted: str, suffix: list[str]) -> Iterator[pa.Array]:
    for tool, plain in batches:
        for i, j in rows_within(pc.fill_null(tool.value_lengths(), 0).to_numpy(), PIECE):
            yield _compared(tool.slice(i, j - i), plain.slice(i, j - i), inserted, suffix)


def aligned(df: DataFrame, tool: str, plain: str, inserted: str, suffix: list[str]) -> DataFrame:
    """``df`` with boundaries (array of structs: end in ``tool``, end in ``plain``) and problem (null where the two agree).

    Both are arrays of steps (operation, position, move, value, mate, end) of one search. ``tool`` has further steps of the
    operation ``inserted``, which stand for the end of the plain step before them (0, if none); without these, step by
    step, the two must say the same. Steps of the operations in ``suffix`` are compared but are no boundaries. Whole
    batches of programs are compared by arrays.
    """
    kinds = [df.schema[c].dataType.elementType["end"].dataType.simpleString() for c in (tool, plain)]

    @F.arrow_udf(f"struct<boundaries: array<struct<tool_end: {kinds[0]}, plain_end: {kinds[1]}>>, problem: string>")
    def compared(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from _in_pieces(batches, inserted, suffix)

    met = df.withColumn("_aligned", compared(F.col(tool), F.col(plain)))
    return met.withColumns({c: F.col(f"_aligned.{c}") for c in ("boundaries", "problem")}).drop("_aligned")


def aligned_within(df: DataFrame, columns: list[str], programs, inserted: str, suffix: list[str], told, kind: str) -> DataFrame:
    """``df`` with the two columns of ``aligned`` for programs that are no columns: ``programs`` makes pairs of arrays of
    them, ``tool`` and ``plain``, from batches of ``columns``, in the order of the rows and as few rows at a time as it
    likes. ``told`` makes of an array of boundaries what the column boundaries holds, of type ``kind``. So neither the
    programs nor their boundaries leave the task, and what it holds of them does not grow with a batch's rows.
    """

    @F.arrow_udf(f"struct<boundaries: {kind}, problem: string>")
    def compared(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for found in _in_pieces(programs(batches), inserted, suffix):
            yield pa.StructArray.from_arrays([told(found.field("boundaries")), found.field("problem")], names=["boundaries", "problem"])

    met = df.withColumn("_aligned", compared(*map(F.col, columns)))
    return met.withColumns({c: F.col(f"_aligned.{c}") for c in ("boundaries", "problem")}).drop("_aligned")


# The label behind a trace ------------------------------------------------------------------------------------


def suffix_problems(rows: DataFrame, champions: DataFrame, key: str) -> DataFrame:
    """(id, rule, detail) of rows (key, presentation, tokens, final_start, final_move, mate_distance, repetition, halfmove,
    turn) whose label is not what the deepest round of the champion's record says. The label: the mark, the move's token, a
    value's token, a mate's where there is one, the variation's moves, the end mark; moves are written as the side to move
    sees them. Presentations of one root must have equal labels. Rows without a record are left to ``releases.unmatched``."""
    c = F.col
    deepest = champions.select(key, F.try_element_at("rounds", F.lit(-1)).alias("d"))
    met = rows.join(deepest, key)
    label = F.slice("tokens", c("final_start") + 1, F.greatest(F.size("tokens") - c("final_start"), F.lit(0)))
    met = met.withColumn("_label", label)
    token = lambda i: F.get("_label", F.lit(i))
    mate = token(3).between(START["mate_win"], START["control"] - 1)
    distance = F.when(mate, F.when(token(3) >= START["mate_loss"], START["mate_loss"] - token(3)).otherwise(token(3) - START["mate_win"]))
    first = F.when(mate, 5).otherwise(4)
    named = literal(moves())

    def move_of(t: Column) -> Column:
        name = F.get(named, F.when(t.between(START["move"], START["move"] + SEGMENTS["move"] - 1), t - START["move"]))
        return F.when(c("turn") == "black", mirror_uci(name)).otherwise(name)

    variation = F.transform(F.slice("_label", first, F.greatest(F.size("_label") - first, F.lit(0))), move_of)
    claims = c("final_move") == CLAIM
    told = F.when(claims, F.array().cast("array<string>")).otherwise(F.slice("d.pv", F.lit(2), F.greatest(F.size("d.pv") - 1, F.lit(0))))
    rules = {
        "label_marks": (token(0) == CONTROL["final"]) & (F.try_element_at("_label", F.lit(-1)) == CONTROL["end"]),
        "label_move": move_of(token(1)) == c("final_move"),
        "label_mate": c("mate_distance").eqNullSafe(distance),
        "claim_justified": ~claims | (((c("repetition") >= REPETITIONS) | (c("halfmove") >= HALFMOVES)) & (c("d.raw") <= CLAIM_BOUND)),
        "champion_move": claims | (c("final_move") == c("d.move")),
        "champion_mate": c("d.mate").eqNullSafe(distance),
        "champion_variation": variation.eqNullSafe(told),
    }
    own = met.select(c(key).alias("id"), F.inline(_broken(rules, c("presentation"))))
    digest = F.sha2(F.array_join("_label", ","), 256)
    apart = met.groupBy(c(key).alias("id")).agg(F.min(digest).alias("_a"), F.max(digest).alias("_b")).where("_a <> _b")
    return own.unionByName(apart.select("id", F.lit("label_differs").alias("rule"), F.lit(None).cast("string").alias("detail")))
