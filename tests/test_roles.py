"""Roles of tokens against a walk by hand; scans over arrays of any length."""

import random

import pytest
from pyspark.sql import functions as F

from tracemill.functions.arrays import scan
from tracemill.functions.vocabulary import COMPOSITE, CONTROL, START
from tracemill.operators import roles
from tracemill.operators.roles import REFUSED, ROLE

C, M, V = CONTROL, START["move"], START["value"]
BOARD = [5, 700, START["side"], *(START["castling"] + k for k in (0, 2, 4, 6)), START["en_passant"], START["halfmove"], START["repetition"]]
NAMED = {
    "thought and suffix": ([C["depth"], M, V, C["refuted"], C["back"], C["reset"], C["final"], M + 1, V + 3, M + 2, M + 3, C["end"]], "control move eval refuted control control control final_move final_eval final_pv final_pv control"),
    "observation": ([M, C["board"], *BOARD, M], "move control " + "board " * 10 + "move"),
    "two observations": ([C["board"], *BOARD, C["board"], *BOARD, C["final"], M, V, C["end"]], "control " + "board " * 10 + "control " + "board " * 10 + "control final_move final_eval control"),
    "one meta too few": ([C["board"], *BOARD[:-1], M, V], "control " + "board " * 9 + "refused eval"),
    "one meta too many": ([C["board"], *BOARD, START["side"], M], "control " + "board " * 10 + "refused move"),
    "no piece": ([C["board"], *BOARD[2:], M], "control " + "refused " * 8 + "move"),
    "piece after meta": ([C["board"], *BOARD[:3], 4, *BOARD[3:], M], "control " + "board " * 3 + "refused " * 8 + "move"),
    "no observation": ([C["board"], M], "control refused"),
    "ends inside": ([M, C["board"], *BOARD[:4]], "move control board board board refused"),
    "piece in the thought": ([5, START["side"], M], "refused refused move"),
    "decision missing": ([C["final"], V, M, C["back"], 7], "control refused final_pv refused refused"),
    "final at the end": ([M, C["final"]], "move control"),
    "empty": ([], ""),
}


@pytest.mark.parametrize("case", NAMED)
def test_roles_by_the_grammar(spark, case):
    tokens, want = NAMED[case]
    got = spark.createDataFrame([(tokens,)], "t array<int>").select(roles.roles(F.col("t")).alias("r")).first()["r"]
    assert got == [REFUSED if w == "refused" else ROLE[w] for w in want.split()]


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_scans_of_any_length(spark, n):
    values = [(i * 7) % 13 for i in range(n)]
    df = spark.createDataFrame([(values,), (None,)], "v array<int>")
    got = df.select(scan(F.col("v"), F.lit(0), lambda s, x: (s + x).cast("int")).alias("s"), scan(F.col("v"), F.lit(0), lambda s, x: ((s * 3 + x) % 101).cast("int"), lambda s, x: (s - x).cast("int")).alias("e")).collect()
    sums, mixed, s, e = [], [], 0, 0
    for v in values:
        sums.append(s)
        mixed.append(e - v)
        s, e = s + v, (e * 3 + v) % 101
    assert (got[0]["s"], got[0]["e"]) == (sums, mixed) and got[1]["s"] is None


def test_composites_share_mix_or_decide(spark):
    r = [ROLE["move"], ROLE["move"], ROLE["eval"], ROLE["control"], ROLE["final_move"], ROLE["final_eval"], ROLE["control"]]
    df = spark.createDataFrame([(r, [2, 1, 2, 2]), (r, [1, 2, 3, 1])], "r array<int>, n array<int>")
    got = [x["c"] for x in df.select(roles.composite_roles(F.col("r"), F.col("n")).alias("c")).collect()]
    assert got == [[ROLE["move"], ROLE["eval"], ROLE["final_move"], ROLE["mixed"]], [ROLE["move"], ROLE["mixed"], ROLE["final_move"], ROLE["control"]]]
    sizes = spark.createDataFrame([([3, COMPOSITE + 1, COMPOSITE],)], "t array<int>")
    assert sizes.select(roles.token_lengths(F.col("t"), [[1, 2], [1, 2, 3]]).alias("n")).first()["n"] == [1, 3, 2]
    assert sizes.select(roles.token_lengths(F.col("t"), []).alias("n")).first()["n"] == [1, 1, 1]


def test_shares_add_up(spark):
    random.seed(4)
    df = spark.createDataFrame([("a", [random.choice([2, 3, -1]) for _ in range(50)]) for _ in range(4)] + [("b", []), ("c", [1])], "k string, r array<int>")
    got = {(x["k"], x["role"]): x for x in roles.role_shares(df, "r", ["k"]).collect()}
    assert {r for k, r in got if k == "a"} == {"move", "eval", "refused"} and abs(sum(x["share"] for (k, _), x in got.items() if k == "a") - 1) < 1e-12
    assert sum(x["n"] for x in roles.role_shares(df, "r", []).collect()) == 201


def test_a_query_makes_each_word_a_number_once(spark):
    """A word's number is made once, not at each place of the step that asks for it, nor at each use of the tokens."""
    from tracemill.plans import role_queries

    for name in ("trace_roles", "role_shares", "composite_role_shares"):
        plan = role_queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("lambdafunction(CASE WHEN ((cast(") == 1, name
