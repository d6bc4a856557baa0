"""Outputs that are there whole or not at all, read back and held against what was written."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tracemill.operators import references
from tracemill.plans import commits, outputs
from tracemill.sources import roots as R


def test_pool_keeps_its_order(spark, tmp_path):
    path = f"file://{tmp_path}/pool"
    pool = spark.range(500).select((F.lit(499) - F.col("id")).alias("place"), F.col("id").cast("string").alias("root_id"), F.when(F.col("id") % 10 == 0, "val").otherwise("train").alias("split"), F.lit(None).cast("string").alias("source"))
    made = outputs.write_pool(pool.repartition(5), path, {"seed": "s"})
    assert made["splits"] == {"train": 450, "val": 50} and outputs.manifest(spark, path)["settings"] == {"seed": "s"}
    back = outputs.read_pool(spark, path)
    assert back.count() == 500 and back.where("line <> place").count() == 0 and set(back.columns) == {*pool.columns, "line"}
    assert outputs.check(spark, path) == {}


def test_an_output_is_written_once(spark, tmp_path):
    path = f"file://{tmp_path}/once"
    df = spark.range(3).select(F.col("id").alias("x"), F.when(F.col("id") > 0, F.array("id")).alias("list"))
    outputs.publish({"a": df}, path, {})
    with pytest.raises(commits.Conflict):
        outputs.publish({"a": df.limit(1)}, path, {})
    assert len([p for p in (tmp_path / "once").iterdir() if p.name.startswith("a-")]) == 1
    assert sorted(map(tuple, outputs.read(spark, path, "a").collect())) == [(0, None), (1, [1]), (2, [2])]
    (folder,) = [p for p in (tmp_path / "once").iterdir() if p.name.startswith("a-")]
    for f in folder.glob("part-*"):
        f.unlink()
    assert outputs.check(spark, path) == {"a": "rows"}


def test_empty_output(spark, tmp_path):
    path = f"file://{tmp_path}/empty"
    outputs.publish({"a": spark.range(0)}, path, {})
    assert outputs.read(spark, path, "a").count() == 0 and outputs.check(spark, path) == {}


def test_unfit_roots(spark):
    good = "8/K7/8/8/8/8/k7/8 w - - 0 1"
    rows = [("a", good, None), ("b", good, 5), ("c", good.replace(" 0 1", " 150 1"), 1), ("d", "", 1), ("e", None, 1), ("f", good.replace("k", "K"), 2), ("g", good, 0)]
    df = spark.createDataFrame(rows, "id string, fen string, repetition int")
    found = {(r["id"], r["rule"]) for r in outputs.unfit_roots(df, "id").collect()}
    assert {k for k in found if k[0] in "abcfg"} == {("b", "over"), ("c", "over"), ("f", "kings"), ("g", "repetition")}
    assert {("d", "fields"), ("e", "fields")} <= found
    fit = df.where("id = 'a'")
    assert outputs.evaluation_roots(fit, "id", 3, "s").count() == 1
    with pytest.raises(ValueError, match="cannot be evaluated"):
        outputs.evaluation_roots(df.where("id = 'b'"), "id")


def test_profile_text(spark, tmp_path):
    path = f"file://{tmp_path}/profile"
    curve = spark.createDataFrame([(3100, "measured", "all", None, 2, 5, 10, 0.5), (3100, "held_out", "all", None, 0, 0, 0, None)], "size int, part string, section string, value string, documents long, tokens long, atoms long, ratio double")
    lines = outputs.write_profile(curve, path, "Curve", {})["text"].splitlines()
    assert lines[0] == "# Curve" and lines[4:] == ["| 3100 | held_out | all | None | 0 | 0 | 0 | n/a |", "| 3100 | measured | all | None | 2 | 5 | 10 | 50.00% |"]


def test_teacher_problems(spark):
    session = lambda r, **k: {"root_id": r, "type": "session", "engine": "x", "value_mate": 32000, "max_ply": 246, "options": {"threads": 1, "hash_mb": 16, "multipv": 1}} | k
    log = lambda r, asked=3, reached=3, **k: [session(r, **k), {"root_id": r, "type": "search_start", "depth": asked, "multi_pv": 1}, {"root_id": r, "type": "search_end", "depth": reached}]
    lines = [*log("ok"), *log("deep", 2, 1), *log("threads", options={"threads": 2, "hash_mb": 8, "multipv": 1}), *log("engine", engine="y", value_mate=1), *log("unset"), *log("wide")]
    events = spark.createDataFrame(lines, "root_id string, type string, engine string, value_mate int, max_ply int, options struct<threads: int, hash_mb: int, multipv: int>, depth int, multi_pv int")
    roots = spark.createDataFrame([(r, 3, 1) for r in ("ok", "deep", "threads", "engine", "lost")] + [("unset", None, 1), ("wide", 3, 2)], "root_id string, depth int, teacher_width int")
    found = {(r["id"], r["rule"]) for r in references.teacher_problems(events, roots, "x", 16, 32000, 246).collect()}
    assert found == {("deep", "depth_asked"), ("deep", "depth_reached"), ("threads", "one_thread"), ("threads", "hash_size"), ("engine", "engine_name"), ("engine", "engine_constants"), ("lost", "has_log"), ("unset", "root_settings"), ("wide", "width_asked")}


def test_champions_are_read(spark, tmp_path):
    candidate = {"move": "a", "raw": 1, "wdl": None, "mate": 3, "value_token": 9, "order": 1, "draw": False}
    record = {"root_id": "r", "rounds": [{"round": 1, "depth": 1, "move": "a", "raw": 1, "wdl": [1, 2, 3], "mate": None, "value_token": 9, "pv": ["a"], "refutations": 0, "candidates": [candidate]}]}
    Path(tmp_path / "champions.jsonl").write_text(json.dumps(record) + "\n\n")
    (row,) = R.read_champions(spark, f"file://{tmp_path}/champions.jsonl").collect()
    assert row.asDict(recursive=True) == record
    Path(tmp_path / "broken.jsonl").write_text('{"root_id": "r", "rounds": 3}\n')
    with pytest.raises(Exception, match="MALFORMED"):
        R.read_champions(spark, f"file://{tmp_path}/broken.jsonl").collect()
