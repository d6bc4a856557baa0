"""Evaluation: grading moves against a table of scores, roll-ups of answers, accuracy by rating."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.vocabulary import CLAIM, CONTROL, START, literal, mirror_uci, moves
from ..tables import stored
from .profiles import nearest_rank

# Rating ranges of the puzzle report; error names of answers.
RATINGS = [("0-1200", 0, 1200), ("1200-1600", 1200, 1600), ("1600-2000", 1600, 2000), ("2000-1000000000", 2000, 10**9)]
RATES = ["final_found", "end_found", "format_valid", "move_legal", "pv_legal", "valid"]
QUALITIES = ["cp_loss", "expected_score_loss", "move_rank_fraction", "value_absolute_error", "value_bin_correct", "mate_distance_correct", "best_move"]


def with_claims(scores: DataFrame, roots: DataFrame) -> DataFrame:
    """``scores`` (position, move, cp, mate, value) and, where the root's draw can be claimed, the claim as a
    move of value 0."""
    claims = roots.where("claimable").select("position", F.lit(CLAIM).alias("move"), F.lit(0).alias("cp"), F.lit(None).cast("int").alias("mate"), F.lit(0.0).alias("value"))
    return scores.select("position", "move", "cp", "mate", "value").unionByName(claims)


def move_ranks(scores: DataFrame) -> DataFrame:
    """Rank of each move of a position (1 + the number of better ones), its fraction, losses against the best."""
    key = V.score_key(F.col("cp"), F.col("mate"))
    keyed = scores.withColumn("_key", key)
    w = Window.partitionBy("position")
    ranked = keyed.withColumns({"move_rank": F.rank().over(w.orderBy(F.desc("_key"))), "_n": F.count("*").over(w)})
    # of equal scores the first move by name is the best one, the claim coming last
    best = F.first(F.struct("cp", "value", "mate")).over(w.orderBy(F.desc("_key"), F.col("move").cast("string") == CLAIM, "move"))
    ranked = ranked.withColumn("_best", best)
    return ranked.select(
        "position",
        "move",
        "move_rank",
        ((F.col("move_rank") - 1) / F.greatest(F.col("_n") - 1, F.lit(1))).alias("move_rank_fraction"),
        (F.col("move_rank") == 1).alias("best_move"),
        (F.col("_best.cp") - F.col("cp")).alias("cp_loss"),
        ((F.col("_best.value") - F.col("value")) / 2).alias("expected_score_loss"),
    )


def root_values(scores: DataFrame) -> DataFrame:
    """(position, root_value, root_mate) of the best searched move; the claim is not searched."""
    key = V.score_key(F.col("cp"), F.col("mate"))
    best = F.min_by(F.struct("value", "mate"), F.struct(-key["sign"], -key["score"], F.col("move")))  # ties by name
    return scores.where(F.col("move").cast("string") != CLAIM).groupBy("position").agg(best.alias("_b")).select("position", F.col("_b.value").alias("root_value"), F.col("_b.mate").alias("root_mate"))


def graded(answers: DataFrame, scores: DataFrame, roots: DataFrame) -> DataFrame:
    """Valid answers (position, decision, value, value_bin, mate_distance) with the quality of their move and
    their value."""
    joined = answers.join(move_ranks(with_claims(scores, roots)).withColumnRenamed("move", "decision"), ["position", "decision"]).join(root_values(scores), "position")
    return joined.withColumns(
        {
            "value_absolute_error": F.abs(F.col("value") - F.col("root_value")),
            "value_bin_correct": F.col("value_bin") == V.value_bin(F.col("root_value")),
            "mate_distance_correct": F.when(F.col("root_mate").isNotNull(), F.coalesce(F.col("mate_distance") == V.capped_mate(F.col("root_mate")), F.lit(False))),
        }
    )


def summary(answers: DataFrame, by: list[str]) -> DataFrame:
    """Rates over all answers and (count, mean) of each quality over the answers that have it."""
    rates = [F.round(F.avg(F.col(c).cast("double")), 6).alias(f"{c}_rate") for c in RATES if c in answers.columns]
    means = [f for q in QUALITIES if q in answers.columns for f in (F.count(q).alias(f"{q}_count"), F.round(F.avg(F.col(q).cast("double")), 6).alias(f"{q}_mean"))]
    return answers.groupBy(*by).agg(F.count("*").alias("n"), *rates, *means)


def line_losses(lines: DataFrame, scores: DataFrame, plies: int) -> DataFrame:
    """(id, ply, move, root_player, cp_loss, best_move) of the first ``plies`` moves of each line.

    lines: id, pv (array of position, move, turn: the position that the move is played in and who plays it), root_turn.
    scores: position, move, cp, mate of all moves of a position. A line counts up to its first move that has no score;
    a loss is null where a mate is among the two. The scores are met by position and move, and each position's best
    comes from one row a position; a line is a short group by what it is.
    """
    key = V.score_key(F.col("cp"), F.col("mate"))
    scored = scores.select("position", "move", "cp", key.alias("_key"))
    best = scored.groupBy("position").agg(F.max("_key").alias("_top"), F.max_by("cp", "_key").alias("_best"))
    each = lines.select("id", "root_turn", F.posexplode(F.slice("pv", F.lit(1), F.lit(plies))).alias("ply", "_p")).select("id", "root_turn", "ply", "_p.*")
    met = each.join(scored, ["position", "move"], "left").join(best, "position", "left")
    upto = Window.partitionBy("id").orderBy("ply").rowsBetween(Window.unboundedPreceding, 0)
    kept = met.withColumn("_whole", F.bool_and(F.col("_key").isNotNull()).over(upto)).where("_whole")
    return kept.select("id", "ply", "move", (F.col("turn") == F.col("root_turn")).alias("root_player"), (F.col("_best") - F.col("cp")).alias("cp_loss"), (F.col("_key") == F.col("_top")).alias("best_move"))


def side_losses(losses: DataFrame, by: list[str]) -> DataFrame:
    """(by, root_player, plies, best, count, mean, median) of the losses of each side; those with a mate have none. The
    losses are stored, as totals, histogram and ranks each read them."""
    losses = stored(losses.select(*by, "root_player", "id", "ply", "cp_loss", "best_move"))
    totals = losses.groupBy(*by, "root_player").agg(F.count("*").alias("plies"), F.count_if("best_move").alias("best"), F.count("cp_loss").alias("count"), F.avg("cp_loss").alias("mean"))
    middle = nearest_rank(losses.where("cp_loss IS NOT NULL"), [*by, "root_player"], "cp_loss", ["id", "ply"], []).select(*by, "root_player", "median")
    return totals.join(middle, [*by, "root_player"], "left")


def medians(answers: DataFrame, by: list[str], quality: str, ties: list[str]) -> DataFrame:
    return nearest_rank(answers, by, quality, ties, []).select(*by, F.col("n").alias("n"), "median")


def error_counts(answers: DataFrame, by: list[str]) -> DataFrame:
    return answers.select(*by, F.explode("errors").alias("error")).groupBy(*by, "error").agg(F.count("*").alias("n"))


def rating_accuracy(rows: DataFrame, rating: str, first: str, whole: str, ratings=RATINGS) -> DataFrame:
    """First-move and whole-line accuracy per rating range and overall; null where a range has no rows."""
    spark = rows.sparkSession
    ranges = spark.createDataFrame([(i, *r) for i, r in enumerate(ratings)], "ordinal int, bucket string, low long, high long")
    sums = [F.count("*").alias("n"), F.sum(F.col(first).cast("long")).alias("first"), F.sum(F.col(whole).cast("long")).alias("whole")]
    inside = rows.join(F.broadcast(ranges), (F.col("low") <= F.col(rating)) & (F.col(rating) < F.col("high")))
    per_range = ranges.join(inside.groupBy("bucket").agg(*sums), "bucket", "left").select("bucket", "n", "first", "whole")
    every = rows.agg(*sums).select(F.lit("overall").alias("bucket"), "n", "first", "whole")
    out = per_range.unionByName(every).fillna(0, ["n", "first", "whole"])
    share = lambda c: F.round(F.try_divide(F.col(c).cast("double"), F.col("n")), 6)
    return out.withColumns({"first_accuracy": share("first"), "whole_accuracy": share("whole")})


def parse_answers(df: DataFrame, atoms: str, black: Column) -> DataFrame:
    """The format part of an answer as a struct ``answer``: what stands after FINAL, read token by token.

    Legality needs the board and is added by ``operators.games.checked_answers``; everything here is native.
    """
    a = F.col(atoms)
    is_ = lambda t, name, size: t.between(START[name], START[name] + size - 1)
    finals = F.size(F.filter(a, lambda t: t == CONTROL["final"]))
    after = F.slice(a, F.array_position(a, CONTROL["final"]).cast("int") + 1, F.size(a))
    ends = F.size(F.filter(after, lambda t: t == CONTROL["end"]))
    end_at = F.array_position(after, CONTROL["end"]).cast("int")
    staged = df.withColumns({"_finals": finals, "_after": F.when(finals == 1, after)})
    after = F.col("_after")
    ends = F.size(F.filter(after, lambda t: t == CONTROL["end"]))
    end_at = F.array_position(after, CONTROL["end"]).cast("int")
    staged = staged.withColumns({"_ends": ends, "_body": F.when(ends > 0, F.slice(after, F.lit(1), F.greatest(end_at - 1, F.lit(0)))).otherwise(after), "_last": F.try_element_at(after, F.lit(-1))})
    body = F.col("_body")
    first, second, third = (F.get(body, k) for k in range(3))
    decided = F.coalesce(is_(first, "move", len(moves())), F.lit(False))
    valued = decided & F.coalesce(is_(second, "value", 20), F.lit(False))
    mate = valued & F.coalesce(third.between(START["mate_win"], CONTROL["pad"] - 1), F.lit(False))
    name = lambda t: F.when(black, mirror_uci(F.element_at(literal(moves()), t - START["move"] + 1))).otherwise(F.element_at(literal(moves()), t - START["move"] + 1))
    line = F.when(valued, F.slice(body, F.when(mate, 4).otherwise(3), F.size(body))).otherwise(F.array().cast("array<int>"))
    claim_id = START["move"] + moves().index(CLAIM)
    bad = F.transform(line, lambda t: ~is_(t, "move", len(moves())) | (t == claim_id))
    first_bad = F.array_position(bad, True).cast("int")
    good = F.when(first_bad > 0, F.slice(line, F.lit(1), first_bad - 1)).otherwise(line)
    won = third < START["mate_loss"]
    reasons = [
        (F.col("_finals") == 0, "missing_final"),
        (F.col("_finals") > 1, "multiple_final"),
        ((F.col("_finals") == 1) & (F.col("_ends") == 0), "missing_end"),
        ((F.col("_ends") > 0) & ((F.col("_last") != CONTROL["end"]) | (F.col("_ends") > 1)), "trailing_after_end"),
        ((F.col("_finals") == 1) & ~decided, "missing_decision"),
        (decided & ~valued, "missing_value"),
        (mate & (second - START["value"] != F.when(won, 19).otherwise(0)), "mate_value_mismatch"),
        (first_bad > 0, "invalid_pv_token"),
        (decided & (first == claim_id) & (F.size(line) > 0) & (first_bad == 0), "claim_with_pv"),
    ]
    errors = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), e) for c, e in reasons)), lambda e: e.isNotNull())
    answer = F.struct(
        (F.col("_finals") > 0).alias("final_found"),
        F.array_contains(atoms, CONTROL["end"]).alias("end_found"),
        F.when(decided, name(first)).alias("decision"),
        F.when(valued, second - START["value"]).alias("value_bin"),
        F.when(valued, V.token_value(second)).alias("value"),
        F.when(mate, F.when(won, third - START["mate_win"]).otherwise(-(third - START["mate_loss"]))).alias("mate_distance"),
        F.transform(good, name).alias("pv"),
        errors.alias("errors"),
        (F.size(errors) == 0).alias("format_valid"),
    )
    return staged.withColumn("answer", answer).drop("_finals", "_after", "_ends", "_body", "_last")
