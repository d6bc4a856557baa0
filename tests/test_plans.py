"""Sources, releases and streams end to end on small files."""

import io
import re
import zipfile

import pytest
import zstandard
from pyspark.sql import functions as F

from tracemill.operators import games
from tracemill.plans import prepare, releases, samples
from tracemill.sources import archives, roots
from tracemill.streaming import incremental


def test_archives_of_all_kinds_hold_the_same_games(spark, tmp_path):
    text = samples.GAMES.encode()
    for d in ("p", "s", "z"):
        (tmp_path / d).mkdir()
    (tmp_path / "p/a.pgn").write_bytes(text)
    (tmp_path / "s/a.pgn.zst").write_bytes(zstandard.compress(text))
    with zipfile.ZipFile(tmp_path / "z/a.zip", "w") as z:
        z.writestr("x/a.pgn", text)
    read = lambda df: [(r["game"], r["san"], r["refused"]) for r in archives.parse_games(df).orderBy("game").collect()]
    plain = read(archives.read_archives(spark, str(tmp_path / "p")))
    assert len(plain) == 8 and plain[1][1] == ["f3", "e5", "g4", "Qh4#"]
    assert read(archives.read_archives(spark, str(tmp_path / "s"))) == plain == read(archives.read_zipped(spark, str(tmp_path / "z")))
    bad = io.BytesIO()
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("a.txt", b"")
    (tmp_path / "z/b.zip").write_bytes(bad.getvalue())
    with pytest.raises(Exception, match="must hold one"):
        archives.read_zipped(spark, str(tmp_path / "z")).count()


def test_an_archive_is_walked_in_pieces(monkeypatch):
    text = "intro\r\n" + "".join(f'[Event "{k}"]\r\n\r\n1. e4 é{"x" * k} *\r\n\n' for k in range(40))
    whole = re.split(r"\n(?=\[Event )", "\n" + text.replace("\r", ""))
    for piece in (1, 2, 7, 64, 1 << 20):
        monkeypatch.setattr(archives, "PIECE", piece)
        assert list(archives._games(io.BytesIO(text.encode()))) == whole
    assert list(archives._games(io.BytesIO(b""))) == ["\n"]


def test_prepare_takes_each_position_once(spark):
    parsed = archives.parse_games(archives.split_games(spark.createDataFrame([("f", samples.GAMES)], "file string, whole string"), "file", "whole"))
    puzzles = spark.createDataFrame([(*p[:6], "f", i) for i, p in enumerate(samples.PUZZLES)], "PuzzleId string, GameId string, FEN string, Moves string, Rating long, Themes array<string>, file string, place long")
    pool = prepare.prepare([(prepare.game_roots(parsed), {"train": 3}, 0.0), (prepare.puzzle_pool(puzzles), {"train": 2}, 0.0), (prepare.game_roots(parsed), {"train": 3}, 0.0)], "7")
    got = pool.collect()
    assert len({r["position_key"] for r in got}) == len(got) == 8 and sorted(r["place"] for r in got) == list(range(8))
    with pytest.raises(ValueError, match="too few"):
        prepare.select(prepare.game_roots(parsed), {"train": 1000}, 0.0, "7")
    walked = games.played(spark.createDataFrame([(samples.BOARDS[0][0], ["e2e4", "e7e5", "e1e3"])], "fen string, moves array<string>"), "fen", "moves").first()["line"]
    assert (walked["san"], walked["legal"]) == (["e4", "e5"], 2)


ROW = "root_id string, split string, fen string, presentation string, repetition short, turn string, teacher_depth short, teacher_width short, trace_text string, final_move string, final_value float, mate_distance short, source string, trace_atom_ids array<int>, trace_atom_count int, state_best array<int>, state_value array<int>"


def test_releases(spark, tmp_path):
    fen = samples.BOARDS[0][0]
    rows = spark.createDataFrame([(f"r{i}", "val" if i == 3 else "train", fen, "full", 1, "white", 4, 1, "t", "e2e4", 0.1, None, "{}", [1, 2], 2, [1], [2]) for i in range(8)], ROW)
    path = str(tmp_path / "release")
    releases.publish(rows, path, 3)
    releases.publish(rows.where("root_id = 'r1'"), str(tmp_path / "other"), 3)
    back = spark.read.parquet(path)
    assert releases.manifest(spark, path, {"seed": 1})["rows"] == 8
    selected, none = rows.select("root_id", "fen", "split"), rows.limit(0).select("root_id")
    assert releases.problems(back, selected, none).count() == 0
    wrong = back.withColumn("trace_atom_count", F.when(F.col("root_id") == "r2", 5).otherwise(F.col("trace_atom_count"))).where("root_id != 'r5'")
    assert {(r["id"], r["rule"]) for r in releases.problems(wrong, selected, none).collect()} == {("r2", "atoms"), ("r5", "missing")}
    assert {r["root_id"] for r in releases.unpublished(selected, back.where("root_id < 'r4'"), selected.where("root_id = 'r7'")).collect()} == {"r4", "r5", "r6"}
    assert releases.statistics(back).first()["p50"] == 2.0
    releases.export(back, str(tmp_path / "export"))
    out = spark.read.parquet(str(tmp_path / "export"))
    assert set(out.columns) == {*releases.SHARED, "split"} and out.where("split = 'validation'").count() == 1
    state = spark.createDataFrame([("a", "failed"), ("a", "done"), ("b", "failed"), *[("c", "failed")] * 3], "root_id string, outcome string")
    assert {r["root_id"]: r["next"] for r in releases.attempts(state).collect()} == {"a": "done", "b": "retry", "c": "drop"}


def test_logs_with_fractions_are_corrupt(spark, tmp_path):
    (tmp_path / "r1.jsonl").write_text('{"type":"attempt","seq":0,"raw":1}\n{"type":"attempt","seq":1,"raw":1.5}\n')
    events = roots.read_events(spark, str(tmp_path)).cache()
    assert {r["root_id"] for r in events.collect()} == {"r1"} and roots.corrupt_events(events).count() == 1
    log = "Elo: 3.0 +/- 2.0\nGames: 2, Wins: 1, Losses: 1, Draws: 0\nElo: -719.74 +/- nan\nGames: 4, Wins: 1, Losses: 2, Draws: 1\n"
    r = spark.createDataFrame([(log,)], "t string").select(roots.match_result(F.col("t")).alias("m")).first()["m"]
    assert (r["games"], r["score"], r["elo"], r["margin"]) == (4, 0.375, -719.74, None)


def test_streams(spark, tmp_path):
    ids = spark.range(10).select(F.concat(F.lit("r"), "id").alias("root_id"))
    ids.write.parquet(str(tmp_path / "in"))
    run = lambda: incremental.curate(incremental.read_stream(spark, str(tmp_path / "in"), "root_id string"), lambda df: df.withColumn("made", F.lit(1)), "root_id", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    ids.unionByName(spark.createDataFrame([("new",)], "root_id string")).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 11
    events = spark.sql("SELECT timestamp '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id,0) AS ts, id % 2 AS k, id FROM range(60)")
    events.write.parquet(str(tmp_path / "ev"))
    stream = incremental.read_stream(spark, str(tmp_path / "ev"), "ts timestamp, k long, id long")
    counts = incremental.windowed_counts(stream, "ts", ["k"], "id", "10 minutes", "0 seconds")
    q = counts.writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").count() >= 8 and {r["n"] for r in spark.table("w").collect()} == {5}
    first = incremental.first_wins(stream, "k", "id", "ts", "0 seconds").writeStream.format("memory").queryName("f").outputMode("append").trigger(availableNow=True).start()
    first.awaitTermination()
    assert {r["id"] for r in spark.table("f").collect()} <= {0, 1}


def test_keys_are_forgotten_behind_the_watermark(spark, tmp_path):
    rows = spark.sql("SELECT cast(id % 5 as string) AS root_id, timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id) AS ts FROM range(20)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = incremental.read_stream(spark, str(tmp_path / "in"), "root_id string, ts timestamp")
    incremental.curate(stream, lambda df: df, "root_id", str(tmp_path / "out"), str(tmp_path / "cp"), "ts", "1 hour").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_digests_and_first_games(spark, tmp_path):
    import hashlib

    for name, content in (("a.pgn", b"[Event one"), ("b.pgn", b"y"), ("c.txt", b"x"), ("e.pgn", b"")):
        (tmp_path / name).write_bytes(content)
    found = archives.digests(spark, str(tmp_path))
    assert {(r["file"], r["bytes"]) for r in found.collect()} == {("a.pgn", 10), ("b.pgn", 1), ("c.txt", 1)}
    expected = spark.createDataFrame([("a.pgn", hashlib.sha256(b"[Event one").hexdigest().upper()), ("b.pgn", "00"), ("d.pgn", "11")], "file string, sha256 string")
    assert {(r["id"], r["rule"]) for r in archives.digest_problems(found, expected).collect()} == {("b.pgn", "changed"), ("c.txt", "unexpected"), ("d.pgn", "missing")}
    games = spark.createDataFrame([("b", 0, 1), ("a", 5, 0), ("a", 0, 9), ("c", 0, 0)], "file string, at long, place long")
    assert [tuple(r) for r in archives.first_games(games, 2).collect()] == [("a", 0, 9), ("a", 5, 0)]
