"""Games to positions, puzzles to roots, legality of answers: the rules run row by row, all else is relational."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import positions as P
from ..functions.vocabulary import CLAIM
from ..rules import START, Illegal, Position
from .dedup import keep_best, occurrences, upsert_counts


def replay(games: DataFrame) -> DataFrame:
    """(game, ply, position_key, halfmove, fullmove, terminal, illegal): the starting position (ply 0) and the
    one after each move; a game with an illegal move yields one row that says so."""

    def play(frames):
        for pdf in frames:
            out = []
            for game, san in zip(pdf["game"], pdf["san"], strict=True):
                p = Position(START)
                rows = [(game, 0, p.key(), p.half, p.full, False, False)]
                try:
                    for ply, text in enumerate(san, 1):
                        p = p.after(p.find_san(text))
                        rows.append((game, ply, p.key(), p.half, p.full, False, False))
                except Illegal:
                    rows = [(game, -1, "", 0, 0, False, True)]
                else:
                    if len(rows) > 1 and p.ending():
                        rows[-1] = (*rows[-1][:5], True, False)
                out += rows
            yield pd.DataFrame(out, columns=["game", "ply", "position_key", "halfmove", "fullmove", "terminal", "illegal"])

    kept = games.where("refused IS NULL").select("game", "san")
    return kept.mapInPandas(play, "game long, ply int, position_key string, halfmove int, fullmove int, terminal boolean, illegal boolean")


def candidates(plies: DataFrame) -> DataFrame:
    """Per game and position its last occurrence with the number of occurrences (the start counts as one but is
    no candidate by itself); a position in which a game ended is none."""
    sound = plies.where("NOT illegal")
    counted = occurrences(sound, ["game", "position_key"], ["ply"])
    last = counted.where("is_last AND ply > 0 AND NOT terminal")
    return last.select("game", "ply", "position_key", F.col("occurrence").alias("repetition"), "halfmove", "fullmove")


def pool(found: DataFrame) -> DataFrame:
    """One row per position over all games: the most repeated one, the first of ties. Fivefold repetitions are
    left out before, so another game can still supply the position."""
    best = keep_best(found.where(F.col("repetition") < P.FIVEFOLD), ["position_key"], "repetition", ["game", "ply"])
    fen = F.concat_ws(" ", "position_key", F.col("halfmove").cast("string"), F.col("fullmove").cast("string"))
    out = best.withColumn("fen", fen)
    return out.select(P.root_id(F.col("fen"), F.col("repetition")).alias("root_id"), "fen", "repetition", "position_key", P.turn(F.col("fen")).alias("turn"), "halfmove", "fullmove", "game", "ply")


def accounting(games: DataFrame, plies: DataFrame, found: DataFrame) -> DataFrame:
    """(name, n): what was read, skipped and why, and how positions met; the numbers add up."""
    refused = games.groupBy("refused").agg(F.count("*").alias("n")).select(F.coalesce(F.concat(F.lit("skipped_"), "refused"), F.lit("playable")).alias("name"), "n")
    per_game = plies.groupBy("game").agg(F.bool_or("illegal").alias("illegal"), F.max("ply").alias("plies"), F.bool_or("terminal").alias("terminal"))
    ends = per_game.agg(
        F.count_if("illegal").alias("skipped_illegal"),
        F.count_if(~F.col("illegal") & (F.col("plies") == 0)).alias("skipped_empty"),
        F.count_if(~F.col("illegal") & (F.col("plies") > 0)).alias("games_replayed"),
        F.count_if("terminal").alias("skipped_terminal"),
        F.coalesce(F.sum(F.when(~F.col("illegal"), F.col("plies"))), F.lit(0)).cast("long").alias("occurrences"),
    )
    kept = found.where(F.col("repetition") < P.FIVEFOLD)
    met = upsert_counts(kept, ["position_key"], "repetition", ["game", "ply"])
    sums = met.agg(F.count("*").alias("keys"), F.coalesce(F.sum("replacements"), F.lit(0)).alias("replacements"), F.coalesce(F.sum("duplicates"), F.lit(0)).alias("duplicates"))
    five = found.agg(F.count("*").alias("unique_per_game"), F.count_if(F.col("repetition") >= P.FIVEFOLD).alias("skipped_repetition"))
    out = refused
    for one in (ends, sums, five, games.agg(F.count("*").alias("games_read"))):
        out = out.unionByName(one.unpivot([], one.columns, "name", "n"))
    return out


def puzzle_roots(puzzles: DataFrame) -> DataFrame:
    """Puzzles after their setup move, with the row as provenance; ``problem`` names those that are no roots."""

    @F.pandas_udf("fen string, problem string")
    def setup(fens: pd.Series, moves: pd.Series) -> pd.DataFrame:
        out = []
        for fen, line in zip(fens, moves, strict=True):
            try:
                p = Position(fen).push_uci(line.split()[0])
                ending = p.ending()
                out.append((p.fen(), f"ends in {ending}" if ending else None))
            except (ValueError, IndexError, AttributeError) as e:
                out.append((None, f"illegal: {e}"))
        return pd.DataFrame(out, columns=["fen", "problem"])

    source = F.to_json(F.struct(*(c for c in puzzles.columns if c not in ("file", "place"))))
    made = puzzles.select("*", source.alias("source"), setup("FEN", "Moves").alias("_p"))
    keyed = made.withColumns({"root_fen": F.col("_p.fen"), "problem": F.col("_p.problem")}).drop("_p")
    return keyed.withColumns({"repetition": F.lit(1), "position_key": P.position_key(F.col("root_fen")), "root_id": P.root_id(F.col("root_fen"), F.lit(1)), "turn": P.turn(F.col("root_fen"))})


def legal_moves(df: DataFrame, fen: str, out: str = "legal") -> DataFrame:
    """The legal moves of each position, sorted; null for what is no position."""

    @F.pandas_udf("array<string>")
    def listed(fens: pd.Series) -> pd.Series:
        def one(f):
            try:
                return Position(f).uci_moves()
            except (ValueError, AttributeError):
                return None

        return fens.map(one)

    return df.withColumn(out, listed(fen))


def played(df: DataFrame, fen: str, line: str, out: str = "line") -> DataFrame:
    """A struct ``out``: the SAN of each move of a line of moves up to the first illegal one, how many are legal,
    the position reached and how it ended."""

    @F.pandas_udf("san array<string>, legal int, fen string, ending string")
    def walk(fens: pd.Series, lines: pd.Series) -> pd.DataFrame:
        rows = []
        for f, moves in zip(fens, lines, strict=True):
            san, p = [], None
            try:
                p = Position(f)
                for uci in moves if moves is not None else ():
                    m = next(x for x in p.legal() if _uci(x) == uci)
                    san.append(p.san(m))
                    p = p.after(m)
            except (ValueError, StopIteration):
                pass
            rows.append((san, len(san), p.fen() if p else None, p.ending() if p else None))
        return pd.DataFrame(rows, columns=["san", "legal", "fen", "ending"])

    return df.withColumn(out, walk(fen, line))


def _uci(move) -> str:
    from ..rules import name

    return name(move[0]) + name(move[1]) + move[2]


def checked_answers(df: DataFrame, fen: str, repetition: str) -> DataFrame:
    """``operators.evaluation.parse_answers`` completed: is the decision legal, how far is its line."""
    line = F.when(F.col("answer.decision").isNotNull() & (F.col("answer.decision") != CLAIM), F.concat(F.array("answer.decision"), "answer.pv")).otherwise(F.array().cast("array<string>"))
    walked = played(df.withColumn("_line", line), fen, "_line", "_walk")
    start = legal_moves(walked, fen, "_legal")
    claim = F.col("answer.decision") == CLAIM
    can = P.claimable(F.col(repetition), P.field(F.col(fen), 4).cast("int"))
    legal = F.coalesce((F.size("_legal") > 0) & (F.col(repetition) < P.FIVEFOLD) & F.when(claim, can).otherwise(F.col("_walk.legal") > 0), F.lit(False))
    plies = F.when(legal & ~claim, F.col("_walk.legal") - 1).otherwise(0)
    whole = F.when(claim, F.size("answer.pv") == 0).otherwise(plies == F.size("answer.pv"))
    done = start.withColumns({"move_legal": legal, "pv_legal": F.coalesce(legal & F.col("answer.format_valid") & whole, F.lit(False)), "legal_pv_plies": plies})
    return done.withColumn("valid", F.col("answer.format_valid") & F.col("move_legal") & F.col("pv_legal")).drop("_line", "_walk", "_legal")


def solve(puzzles: DataFrame, policy: str) -> DataFrame:
    """first_correct and whole_correct of a policy: a column of the moves it plays at the solver's turns. A move
    that mates is right whatever the puzzle says; the first wrong one ends the line."""

    @F.pandas_udf("first boolean, whole boolean")
    def judge(fens: pd.Series, lines: pd.Series, picks: pd.Series) -> pd.DataFrame:
        rows = []
        for fen, line, pick in zip(fens, lines, picks, strict=True):
            moves, right = line.split(), []
            p = Position(fen).push_uci(moves[0])
            for k, want in enumerate(moves[1::2]):
                try:
                    p = p.push_uci(pick[k])
                except (Illegal, IndexError, TypeError):
                    right.append(False)
                    break
                mate = p.ending() == "mate"
                right.append(mate or pick[k] == want)
                if mate or not right[-1] or 2 * k + 2 >= len(moves):
                    break
                p = p.push_uci(moves[2 * k + 2])
            rows.append((bool(right and right[0]), bool(right) and all(right)))
        return pd.DataFrame(rows, columns=["first", "whole"])

    judged = puzzles.withColumn("_j", judge("FEN", "Moves", policy))
    return judged.withColumns({"first_correct": F.col("_j.first"), "whole_correct": F.col("_j.whole")}).drop("_j")


def illegal_lines(events: DataFrame) -> DataFrame:
    """(id, rule, detail) of log rows whose path or line of play is not legal from the log's position."""
    from .references import violations

    fens = events.where("type = 'position'").select("root_id", F.col("fen").alias("_fen"))
    rows = events.where(F.col("type").isin("candidate", "frontier")).join(fens, "root_id")
    line = F.concat(F.col("path"), F.coalesce(F.slice("pv", F.lit(2), F.size("pv")), F.array().cast("array<string>")))
    walked = played(rows.withColumn("_whole", line), "_fen", "_whole", "_walk")
    return violations(walked, {"line_legal": F.col("_walk.legal") == F.size("_whole")}, "root_id", F.col("seq"))
