"""Packed documents: what is written in order is read back by ranges."""

import json
from pathlib import Path

import pytest

from tracemill.sources import packed


def table(spark, docs):
    return spark.createDataFrame(list(enumerate(docs)), "doc_id long, tokens array<int>").repartition(5)


@pytest.mark.parametrize("size", [40, 1 << 24])
def test_round_trip_by_ranges(spark, tmp_path, size):
    docs = [[(i * 31 + j) % 65536 for j in range(i % 9)] for i in range(200)]
    path = f"file://{tmp_path}/p"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    packed.write_packed(table(spark, docs), ["doc_id"], path)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    df = packed.read_packed(spark, path, size)
    got = sorted(df.collect())
    starts = [sum(map(len, docs[:i])) for i in range(200)]
    assert [(r["place"], r["start"], r["tokens"]) for r in got] == [(i, starts[i], d) for i, d in enumerate(docs)]
    assert df.rdd.getNumPartitions() >= min(200, sum(map(len, docs)) // size)
    head = packed.manifest(path)
    assert (head["documents"], head["tokens"]) == (200, sum(map(len, docs))) and len(head["parts"]) > 1


def test_long_documents_and_empty_tables(spark, tmp_path):
    docs = [[1] * (packed.BATCH + 5), [], [2] * 3]
    packed.write_packed(table(spark, docs), ["doc_id"], f"file://{tmp_path}/p")
    assert [len(r["tokens"]) for r in sorted(packed.read_packed(spark, f"file://{tmp_path}/p").collect())] == [packed.BATCH + 5, 0, 3]
    packed.write_packed(table(spark, docs).limit(0), ["doc_id"], f"file://{tmp_path}/e")
    assert packed.read_packed(spark, f"file://{tmp_path}/e").count() == 0


def test_failed_writes_leave_nothing(spark, tmp_path):
    path = tmp_path / "p"
    with pytest.raises(Exception, match="16 bits"):
        packed.write_packed(table(spark, [[1], [2], [70_000], *[[3]] * 40]), ["doc_id"], f"file://{path}")
    assert not (path / packed.MANIFEST).exists()
    packed.write_packed(table(spark, [[1], [2]]), ["doc_id"], f"file://{path}")
    with pytest.raises(Exception, match="exist"):
        packed.write_packed(table(spark, [[9]]), ["doc_id"], f"file://{path}")
    packed.write_packed(table(spark, [[9]]), ["doc_id"], f"file://{path}", mode="overwrite")
    assert [r["tokens"] for r in packed.read_packed(spark, f"file://{path}").collect()] == [[9]]
    head = json.loads(Path(path / packed.MANIFEST).read_text())
    assert {p["name"] for p in head["parts"]} <= {f.name.split(".")[0] for f in path.iterdir()}
    head["format_version"] = 99
    Path(path / packed.MANIFEST).write_text(json.dumps(head))
    with pytest.raises(ValueError, match="unknown format"):
        packed.manifest(f"file://{path}")
