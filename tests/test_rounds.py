"""Rounds, presentations and release rules on small data."""

from pyspark.sql import functions as F

from tracemill.operators import evaluation, rounds
from tracemill.plans import releases


def test_champion_at_each_boundary(spark):
    steps = [("begin", 1, None, 0, 0), ("exact", 1, "a", 5, 50), ("exact", 1, "b", 5, 51), ("exact", 1, "b", 7, 52), ("exact", 1, "b", 4, 53), ("end", 1, "b", 5, 60)]
    steps += [("begin", 2, None, 0, 0), ("exact", 2, "c", 1, 70), ("end", 2, "c", 2, 71)]
    df = spark.createDataFrame([("r", i, k, n, m, float(x), float(v)) for i, (k, n, m, x, v) in enumerate(steps)], "root string, seq long, kind string, round long, move string, raw double, value double")
    got = [(r["best"], r["value"]) for r in rounds.boundary_champions(df, "root").orderBy("seq").collect()]
    # equal scores leave the first; a renewed score counts; the end renews the value and takes over on a gain only
    assert got == [(None, None), ("a", 50), ("a", 50), ("b", 52), ("a", 50), ("a", 60), ("a", 60), ("c", 70), ("c", 71)]


def test_root_facts_and_summary(spark):
    data = [(1, 1, "a", 1.0, 0), (1, 2, "b", 2.0, 1), (1, 3, "b", 3.0, 2), (2, 1, "a", None, 0)]
    df = spark.createDataFrame(data, "root long, round long, champion string, value double, refutations long")
    facts = {r["root"]: r for r in rounds.root_facts(df, "root").collect()}
    assert (facts[1]["overturned_rounds"], facts[1]["converged_depth"], facts[1]["value_shape"], facts[1]["first_is_last"]) == (1, 2, "monotone_up", False)
    assert (facts[2]["rounds"], facts[2]["converged_depth"], facts[2]["value_shape"]) == (1, 1, "mate_only")
    one = rounds.release_summary(rounds.root_facts(df, "root")).first()
    assert (one["roots"], one["rounds"], one["overturn_rate"], one["refutations"]) == (2, 4, 0.5, 3)
    assert rounds.release_summary(rounds.root_facts(df.limit(0), "root")).first()["overturn_rate"] == 0


def test_presentations_end_at_boundaries(spark):
    df = spark.createDataFrame([(0.0, [1, 3004, 2, 3, 9, 9], [2, 4], 4), (0.99, [1, 2, 3, 3004, 9], [1, 4], 4)], "u double, trace array<int>, ends array<int>, final_start int")
    got = {(r["u"], r["presentation"]): r for r in rounds.presentations(df, "trace", "ends", F.col("u"), 0.3, 0.6).collect()}
    assert got[0.0, "zero"]["tokens"] == [9, 9] and got[0.0, "full"]["tokens"] == [1, 3004, 2, 3, 9, 9]
    assert got[0.0, "random"]["cut"] == 2 and got[0.0, "random"]["shown"] == 1 and got[0.0, "random"]["depth"] == 1
    assert got[0.99, "random"]["cut"] == 4 and got[0.99, "random"]["tokens"] == [1, 2, 3, 3004, 9]


def test_best_move_of_ties_is_the_first_by_name(spark):
    scores = spark.createDataFrame([("p", "c2c4", 10, None, 0.1), ("p", "b2b4", 10, None, 0.3), ("p", "a2a4", 5, None, 0.2)], "position string, move string, cp int, mate int, value double")
    got = {r["move"]: r for r in evaluation.move_ranks(scores).collect()}
    assert got["a2a4"]["expected_score_loss"] == (0.3 - 0.2) / 2 and got["c2c4"]["best_move"] and got["b2b4"]["best_move"]
    assert evaluation.root_values(scores).first()["root_value"] == 0.3


def test_rows_and_champions_go_one_to_one(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "root_id string")
    got = {(r["id"], r["rule"]) for r in releases.unmatched(rows, spark.createDataFrame([("b",), ("c",)], "root_id string")).collect()}
    assert got == {("a", "no_champion"), ("c", "no_row")}
