"""Games, boards and puzzles: small samples of our own, and positions made from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boards, positions
from ..functions.vocabulary import PIECES, START, mirror_move_tokens, mirror_tokens, mirror_uci
from ..operators import evaluation, games
from ..sources.archives import parse_games, split_games
from ..tables import table
from . import samples
from .registry import registry

QUERIES, ORACLES, query = registry()


def _games(spark):
    return parse_games(split_games(spark.createDataFrame([("sample.pgn", samples.GAMES)], "file string, whole string"), "file", "whole"))


def _values(rows, columns):
    quoted = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {quoted}) t({columns})"


@query(_values([("games_read", 8), ("playable", 6), ("skipped_setup", 1), ("skipped_variant", 1), ("skipped_illegal", 1), ("skipped_empty", 1), ("games_replayed", 4), ("skipped_terminal", 1),
                ("occurrences", 24), ("keys", 15), ("replacements", 0), ("duplicates", 4), ("unique_per_game", 19), ("skipped_repetition", 0)], "name, n"))
def pgn_accounting(spark, sf_dir):
    """What became of the sample's eight games; the counts are worked out by hand."""
    parsed = _games(spark)
    plies = games.replay(parsed)
    return games.accounting(parsed, plies, games.candidates(plies)).select("name", F.col("n").cast("int").alias("n"))


@query(_values([(3, 0, 8), (2, 0, 5), (2, 0, 6), (2, 0, 7)], "repetition, game, ply"))
def pgn_repetitions(spark, sf_dir):
    """Positions that a game reaches more than once: the first game comes back to its start twice."""
    found = games.pool(games.candidates(games.replay(_games(spark))))
    return found.where("repetition > 1").select(F.col("repetition").cast("int").alias("repetition"), F.col("game").cast("int").alias("game"), "ply")


@query(_values([("repetition", "1", 11), ("repetition", "2", 3), ("repetition", "3", 1), ("repetition", "4", 0), ("claimable", "true", 1), ("claimable", "false", 14)], "section, bucket, n"))
def pool_profile(spark, sf_dir):
    from ..operators import profiles

    pool = games.pool(games.candidates(games.replay(_games(spark))))
    return profiles.pool_profile(pool).where(F.col("section").isin("repetition", "claimable")).select("section", "bucket", F.col("n").cast("int").alias("n"))


@query(_values([("a", None or "true", "true"), ("b", "false", "false"), ("c", "true", "true")], "id, first, whole"))
def puzzle_solving(spark, sf_dir):
    rows = spark.createDataFrame([(p[0], p[2], p[3], p[6]) for p in samples.PUZZLES[:3]], "id string, FEN string, Moves string, picks array<string>")
    out = games.solve(rows, "picks")
    return out.select("id", F.col("first_correct").cast("string").alias("first"), F.col("whole_correct").cast("string").alias("whole"))


@query()
def puzzle_roots(spark, sf_dir):
    rows = spark.createDataFrame([p[:6] for p in samples.PUZZLES], "PuzzleId string, GameId string, FEN string, Moves string, Rating long, Themes array<string>")
    return games.puzzle_roots(rows).select("PuzzleId", "root_id", "position_key", "turn", "problem")


@query(_values([(fen, min(r, 5)) for fen, r in samples.BOARDS[:3]] + [("8/8/4k3/8/8/8/4K3/8 b - - 100 1", 5)], "fen, repetition"))
def board_roundtrip(spark, sf_dir):
    rows = spark.createDataFrame(samples.BOARDS, "fen string, repetition int")
    back = boards.decode_board(boards.encode_board(F.col("fen"), F.col("repetition")))
    return rows.select(back.alias("b")).select("b.fen", "b.repetition")


def _made_fens(spark, sf_dir):
    """A pseudo position per document: its md5 and that of the digest give 64 cells, no rules obeyed."""
    digest = F.md5(F.col("doc_id").cast("string"))
    cells = F.translate(F.concat(digest, F.md5(digest)), "0123456789abcdef", PIECES + "1111")
    placement = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.substring(cells, r * 8 + 1, F.lit(8))), "/")
    side = F.when(F.col("doc_id") % 2 == 0, "w").otherwise("b")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", placement, side, F.lit("Kq"), F.lit("-"), (F.col("doc_id") % 150).cast("string"), F.lit("7")).alias("fen"))


_CELLS = f"c AS (SELECT doc_id, translate(md5(doc_id::VARCHAR) || md5(md5(doc_id::VARCHAR)), '0123456789abcdef', '{PIECES}....') AS cells FROM documents)"


@query(f"""
WITH {_CELLS}, p AS (SELECT doc_id, list_transform(range(0, 64), lambda s: instr('{PIECES}', cells[(7 - s // 8) * 8 + s % 8 + 1]) - 1 + 12 * s) AS t, list_transform(range(0, 64), lambda s: cells[(7 - s // 8) * 8 + s % 8 + 1] <> '.') AS k FROM c)
SELECT doc_id, array_to_string(list_concat(list_filter(t, lambda x, i: k[i]), [768 + doc_id % 2, 771, 772, 774, 777, 842, 843 + least(doc_id % 150, 100), 944]), ' ') AS tokens FROM p
""")
def board_encode(spark, sf_dir):
    return _made_fens(spark, sf_dir).select("doc_id", F.array_join(boards.encode_board(F.col("fen"), F.lit(1)), " ").alias("tokens"))


@query("SELECT doc_id, true AS same FROM documents")
def board_decode(spark, sf_dir):
    """Every position comes back from its tokens, whatever their order; clocks stop at 100."""
    back = boards.decode_board(F.reverse(boards.encode_board(F.col("fen"), F.lit(1))))
    out = _made_fens(spark, sf_dir).select("doc_id", "fen", back.alias("b"))
    # the made placement writes empty cells one by one
    merged = F.col("fen")
    runs = positions.field(merged, 0)
    for k in range(8, 1, -1):
        runs = F.replace(runs, F.lit("1" * k), F.lit(str(k)))
    clock = F.least(positions.field(merged, 4).cast("int"), F.lit(100)).cast("string")
    want = F.concat_ws(" ", runs, positions.field(merged, 1), positions.field(merged, 2), positions.field(merged, 3), clock, F.lit("1"))
    return out.select("doc_id", (F.col("b.fen") == want).alias("same"))


@query("""
SELECT id::INT AS id, (CASE WHEN id < 768 THEN xor(id // 12, 56) * 12 + (id % 12 + 6) % 12 WHEN id BETWEEN 770 AND 777 THEN 770 + 2 * xor((id - 770) // 2, 2) + id % 2 WHEN id BETWEEN 778 AND 841 THEN 778 + xor(id - 778, 56) ELSE id END)::INT AS mirrored,
  id::INT AS twice, CASE WHEN id BETWEEN 949 AND 2917 THEN 'move' ELSE 'other' END AS kind FROM (SELECT unnest(range(0, 3006)) AS id)
""")
def token_mirror(spark, sf_dir):
    """Every token as the other side sees it; moves mirrored twice are the same moves."""
    df = spark.range(3006).select(F.col("id").cast("int").alias("id"))
    twice = mirror_move_tokens(mirror_move_tokens(F.array("id")))[0]
    return df.select("id", mirror_tokens(F.array("id"))[0].alias("mirrored"), twice.alias("twice"), F.when(F.col("id").between(START["move"], START["value"] - 1), "move").otherwise("other").alias("kind"))


@query("SELECT e, translate(e, '12345678', '87654321') AS mirrored FROM (SELECT chr((97 + event_id % 8)::INT) || (1 + event_id % 7) || chr((97 + event_id % 5)::INT) || (1 + event_id % 8) AS e FROM events)")
def uci_mirror(spark, sf_dir):
    n = F.col("event_id")
    text = F.concat(F.char(97 + n % 8), (1 + n % 7).cast("string"), F.char(97 + n % 5), (1 + n % 8).cast("string"))
    return table(spark, sf_dir, "events").select(text.alias("e")).select("e", mirror_uci(F.col("e")).alias("mirrored"))


_M = {u: START["move"] + i for i, u in enumerate(__import__("tracemill.functions.vocabulary", fromlist=["moves"]).moves())}
_F, _END = START["control"] + 4, START["control"] + 7
_ANSWERS = [
    ("good", [5, _F, _M["e2e4"], START["value"] + 10, _M["e7e5"], _END]),
    ("no final", [5, _M["e2e4"]]),
    ("two finals", [_F, _F, _END]),
    ("no end", [_F, _M["e2e4"], START["value"] + 3]),
    ("no decision", [_F, START["value"], _END]),
    ("no value", [_F, _M["e2e4"], _END]),
    ("mate", [_F, _M["e2e4"], START["value"] + 19, START["mate_win"] + 3, _END]),
    ("wrong mate", [_F, _M["e2e4"], START["value"] + 4, START["mate_loss"] + 3, _END]),
    ("bad line", [_F, _M["e2e4"], START["value"] + 4, 7, _END]),
    ("illegal", [_F, _M["e2e5"], START["value"] + 4, _END]),
    ("illegal line", [_F, _M["e2e4"], START["value"] + 4, _M["e2e4"], _END]),
    ("claim", [_F, _M["<claim_draw>"], START["value"] + 9, _END]),
    ("after end", [_F, _M["e2e4"], START["value"] + 4, _END, 5]),
]


@query(_values([("good", "", "true"), ("no final", "missing_final", "false"), ("two finals", "multiple_final", "false"), ("no end", "missing_end", "false"), ("no decision", "missing_decision", "false"),
                ("no value", "missing_value", "false"), ("mate", "", "true"), ("wrong mate", "mate_value_mismatch", "false"), ("bad line", "invalid_pv_token", "false"), ("illegal", "", "false"),
                ("illegal line", "", "false"), ("claim", "", "false"), ("after end", "trailing_after_end", "false")], "id, errors, valid"))
def answer_parsing(spark, sf_dir):
    rows = spark.createDataFrame([(k, a, samples.BOARDS[0][0], 1) for k, a in _ANSWERS], "id string, atoms array<int>, fen string, repetition int")
    parsed = games.checked_answers(evaluation.parse_answers(rows, "atoms", F.lit(False)), "fen", "repetition")
    return parsed.select("id", F.array_join("answer.errors", ",").alias("errors"), F.col("valid").cast("string").alias("valid"))


_D, _V, _BACK, _R = START["control"] + 6, START["value"] + 10, START["control"] + 1, START["control"] + 5
_TRACES = [
    ("whole", [_D, _M["e2e4"], _V, _BACK, _M["d2d4"], _R, _BACK, _V, _F, _M["e2e4"], _V, _M["e7e5"], _END]),
    ("no reference", [_D, _M["e2e4"], _R, _F, _M["e2e4"], _V, _END]),
    ("illegal", [_D, _M["e2e5"], _F, _M["e2e4"], _V, _END]),
    ("open", [_D, _M["e2e4"]]),
    ("trailing", [_F, _M["e2e4"], _V, _END, _V]),
]


@query(_values([("whole", "ok", 12), ("no reference", "refuted_without_reference", 2), ("illegal", "illegal_move", 1), ("open", "missing_final", 0), ("trailing", "trailing_tokens", 3)], "id, error, steps"))
def trace_replay(spark, sf_dir):
    from ..operators import traces

    rows = spark.createDataFrame([(k, t, samples.BOARDS[0][0], 1, 1) for k, t in _TRACES], "id string, tokens array<int>, fen string, repetition int, width int")
    out = traces.replay(rows, "tokens", "fen", "repetition", "width")
    return out.select("id", F.coalesce("replay.error", F.lit("ok")).alias("error"), F.size("replay.steps").alias("steps"))
