"""Releases by several writers: nothing is lost or doubled, whoever races, dies or comes again."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from tracemill.plans import commits

IDENTITY = {"seed": 1}


def rows(spark, shards, tag="a", n=5):
    data = [(f"{tag}{s}-{i}", "train", s, i) for s in shards for i in range(n)]
    return spark.createDataFrame(data, "root_id string, split string, shard int, atoms int")


def covers(*shards):
    return [("train", s) for s in shards]


def found(spark, path):
    return sorted(r["root_id"] for r in commits.read(spark, path).collect())


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/release"


def publish(spark, path, shards, **kw):
    return commits.publish(rows(spark, shards, kw.pop("tag", "a"), kw.pop("n", 5)), path, covers(*shards), kw.pop("identity", IDENTITY), ["root_id"], **kw)


def test_disjoint_writers_at_once_lose_and_double_nothing(spark, path):
    barrier, errors = threading.Barrier(4), []

    def work(k):
        try:
            staged = commits.stage(rows(spark, [2 * k, 2 * k + 1]), path, covers(2 * k, 2 * k + 1), IDENTITY, ["root_id"])
            barrier.wait(timeout=120)
            commits.commit(spark, path, staged)
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and commits.registry(spark, path)["version"] == 4
    assert found(spark, path) == sorted(f"a{s}-{i}" for s in range(8) for i in range(5))


def test_one_shard_has_one_owner(spark, path):
    first = commits.stage(rows(spark, [0]), path, covers(0), IDENTITY, ["root_id"])
    second = commits.stage(rows(spark, [0], "b"), path, covers(0), IDENTITY, ["root_id"])
    commits.commit(spark, path, first)
    with pytest.raises(commits.Conflict, match="train/0"):
        commits.commit(spark, path, second)
    assert found(spark, path) == [f"a0-{i}" for i in range(5)] and commits.recover(spark, path) == {}
    assert commits.commit(spark, path, first) == 1  # once more changes nothing
    with pytest.raises(commits.Conflict, match="identity"):
        publish(spark, path, [1], identity={"seed": 2})


def test_a_replaced_shard_keeps_no_stale_rows(spark, path):
    publish(spark, path, [0, 1])
    publish(spark, path, [1], n=0, replace=True)
    assert found(spark, path) == [f"a0-{i}" for i in range(5)] and commits.registry(spark, path)["shards"]["train/1"]["rows"] == 0
    one = commits.stage(rows(spark, [0], "b"), path, covers(0), IDENTITY, ["root_id"], replace=True)
    publish(spark, path, [0], tag="c", replace=True)
    with pytest.raises(commits.Conflict):
        commits.commit(spark, path, one)  # it had not seen the newer one
    assert found(spark, path) == [f"c0-{i}" for i in range(5)]


def test_killed_writers_are_recovered_or_left_out(spark, path, tmp_path):
    publish(spark, path, [0])
    whole = commits.stage(rows(spark, [1]), path, covers(1), IDENTITY, ["root_id"])
    twice = commits.stage(rows(spark, [0], "b"), path, covers(0), IDENTITY, ["root_id"])
    spoilt = commits.stage(rows(spark, [2]), path, covers(2), IDENTITY, ["root_id"])
    half = commits.stage(rows(spark, [3]), path, covers(3), IDENTITY, ["root_id"])
    data = tmp_path / "release/data"
    (data / f"writer={half}.facts.json").unlink()
    rows(spark, [2], "x", 1).drop("split", "shard").write.mode("append").parquet(f"file://{data}/writer={spoilt}/split=train/shard=2")
    assert found(spark, path) == [f"a0-{i}" for i in range(5)]
    assert commits.recover(spark, path, discard=True) == {whole: "committed", twice: "refused", spoilt: "changed", half: "unfinished"}
    assert found(spark, path) == sorted(f"a{s}-{i}" for s in (0, 1) for i in range(5)) and commits.recover(spark, path) == {}


def test_rows_of_other_shards_are_refused(spark, path):
    with pytest.raises(ValueError, match="does not cover"):
        commits.publish(rows(spark, [0, 1]), path, covers(0), IDENTITY, ["root_id"])
    assert commits.read(spark, path).count() == 0


def test_the_roll_up_is_that_of_a_scan(spark, path, tmp_path):
    totals = {"atoms": F.sum("atoms"), "longest": F.max("atoms"), "odd": F.count_if(F.col("atoms") % 2 == 1)}
    publish(spark, path, [0, 1], totals={k: v for k, v in totals.items() if k != "longest"})
    publish(spark, path, [2], totals={k: v for k, v in totals.items() if k != "longest"})
    out = commits.write_validation(spark, path)
    scan = commits.read(spark, path).agg(F.count("*").alias("n_rows"), F.sum("atoms").alias("atoms"), F.count_if(F.col("atoms") % 2 == 1).alias("odd")).first().asDict()
    assert out["totals"] == scan and out["complete"] and out["rows"] == scan["n_rows"]
    assert out["shards"] == {f"{r['split']}/{r['shard']}": r["count"] for r in commits.read(spark, path).groupBy("split", "shard").count().collect()}
    assert json.loads((tmp_path / "release/validation/000000000002.json").read_text()) == out
    publish(spark, path, [0], replace=True)
    assert not commits.validation(spark, path)["complete"]
