"""Root pools, event logs, evaluation inputs, histories and match logs, each with its schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = "root_id string, split string, fen string, repetition int, turn string, position_key string, source string"
WINDOW = "struct<alpha: int, beta: int>"
EVENT = (
    "root_id string, schema int, seq int, type string, engine string, value_mate int, max_ply int, options struct<threads: int, hash_mb: int, multipv: int>, fen string, depth int, multi_pv int, "
    f"round int, window {WINDOW}, root_order array<string>, attempt int, line int, raw int, cp int, wdl array<int>, bound string, path array<string>, ply int, move string, `order` int, call string, "
    "nodes_delta int, seldepth int, pv array<string>, rank array<struct<move: string, raw: int, cp: int, wdl: array<int>, pv: array<string>>>, "
    "counters struct<best_move_changes: int, seldepth: int, nodes: int>, bestmove string, ponder string, nodes int, _corrupt_record string"
)


def read_roots(spark: SparkSession, path: str) -> DataFrame:
    """A root pool from JSON lines; a line that is no object ends the read, blank ones are skipped."""
    return spark.read.schema(ROOT).option("mode", "FAILFAST").json(path)


def repeated_roots(roots: DataFrame) -> DataFrame:
    return roots.groupBy("root_id").agg(F.count("*").alias("n")).where("n > 1")


def unsound_roots(roots: DataFrame) -> DataFrame:
    """(id, rule, detail) of roots whose fields contradict each other."""
    from ..functions import positions as P
    from ..operators.references import violations

    c = F.col
    return violations(
        roots,
        {
            "split": c("split").isin("train", "val"),
            "fen_fields": F.size(F.split("fen", " ")) == 6,
            "repetition": c("repetition").between(1, 4),
            "turn": c("turn") == P.turn(c("fen")),
            "position_key": c("position_key") == P.position_key(c("fen")),
        },
        "root_id",
        c("fen"),
    )


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Search-event logs as JSON lines. Numbers with a fraction fit no field and land in _corrupt_record. Where
    lines carry no root_id, a log's file name is its root."""
    raw = spark.read.schema(EVENT).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.jsonl?)?(?:\.\w+)?$", 1)
    return raw.withColumn("root_id", F.coalesce("root_id", name))


def corrupt_events(events: DataFrame) -> DataFrame:
    return events.where("_corrupt_record IS NOT NULL").select("root_id", "_corrupt_record")


def read_evaluation_roots(spark: SparkSession, path: str) -> DataFrame:
    """Roots or puzzles from JSON lines, a JSON list or Parquet, by the name's ending."""
    if path.rstrip("/").endswith(".jsonl"):
        return spark.read.json(path)
    if path.rstrip("/").endswith(".json"):
        return spark.read.option("multiLine", True).json(path)
    return spark.read.parquet(path)


def read_champions(spark: SparkSession, path: str) -> DataFrame:
    """Champion records from JSON lines, a root each (root_id, rounds); a line that is none ends the read."""
    from ..operators.champions import ROUND

    return spark.read.schema(f"root_id string, rounds array<{ROUND}>").option("mode", "FAILFAST").json(path)


def match_result(text: Column) -> Column:
    """The last result block of a match log: games, wins, losses, draws, Elo difference and its interval (null
    where these are no finite numbers), and the score."""

    def last(pattern: str, kind: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), 1)
        return F.try_element_at(found, F.lit(-1)).try_cast(kind)

    def finite(x: Column) -> Column:
        return F.when(F.abs(x) < float("inf"), x)

    number = r"(-?[0-9.]+|-?inf|-?nan)"
    games, wins, losses, draws = (last(rf"{k}:\s*(\d+)", "int") for k in ("Games", "Wins", "Losses", "Draws"))
    elo, margin = finite(last(rf"Elo:\s*{number}", "double")), finite(last(rf"Elo:\s*{number} \+/- ".replace(number, "-?[0-9.infa]+") + number, "double"))
    score = F.try_divide(wins + 0.5 * draws, games)
    return F.when(wins + losses + draws == games, F.struct(games.alias("games"), wins.alias("wins"), losses.alias("losses"), draws.alias("draws"), elo.alias("elo"), margin.alias("margin"), score.alias("score")))
