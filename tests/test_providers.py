"""Providers of logs: a root's rows in order, and roots and logs one to one."""

from hashlib import md5

from tracemill.operators import providers


def test_each_root_gets_its_rows_in_order(spark):
    data = [(r, s, f"t{s % 3}") for r in range(5) for s in range(r * 10)]
    df = spark.createDataFrame(data, "root_id long, seq long, type string").repartition(4)
    got = {r["root_id"]: r for r in providers.provided(df, "root_id", ["seq"]).collect()}
    assert set(got) == {1, 2, 3, 4}
    for k, r in got.items():
        assert (r["lines"], r["first"], r["last"]) == (k * 10, "t0", f"t{(k * 10 - 1) % 3}")
        assert r["digest"] == md5(",".join(f"t{s % 3}:{s}" for s in range(k * 10)).encode()).hexdigest()


def test_both_missing_sides_are_named(spark):
    roots = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (3, "d")], "root_id long, x string")
    logs = spark.createDataFrame([(1, 5), (3, 6), (4, 7), (2, 8), (2, 9)], "root_id long, n int")
    joined, problems = providers.matched(roots, logs, "root_id")
    assert {(r["id"], r["rule"]) for r in problems.collect()} == {(2, "log_twice"), (3, "root_twice"), (4, "no_root")}
    assert joined.where("root_id = 1").count() == 1
