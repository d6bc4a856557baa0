"""Champion records, boundaries and labels against a plain walk over the same rows."""

import random

from tracemill.functions.vocabulary import CONTROL, START, move_ids
from tracemill.operators import champions as C
from tracemill.functions import values as V

VM, MP = 32000, 246


def _candidate(move, raw, order, **k):
    w = min(max(500 + raw, 0), 1000)
    return {"move": move, "raw": raw, "wdl": [w, 0, 1000 - w], "mate": None, "value_token": START["value"] + _bin((2 * w - 1000) / 1000), "order": order, "draw": False} | k


def _bin(v):
    return sum(b < v for b in V.BOUNDS)


def _round(n, candidates, **k):
    best = max(candidates, key=lambda x: x["raw"])
    own = {f: best[f] for f in ("move", "raw", "wdl", "mate", "value_token")}
    return own | {"round": n, "depth": n, "pv": [best["move"], "e7e5"], "refutations": 0, "candidates": candidates} | k


def _records(spark, rows):
    return spark.createDataFrame(rows, f"root_id string, rounds array<{C.ROUND}>")


def test_rules_of_records(spark):
    from pyspark.sql import functions as F

    one = [_candidate("e2e4", 30, 1), _candidate("d2d4", 10, 2)]
    drawn = _candidate("d2d4", 0, 2, wdl=None, draw=True, value_token=START["value"] + _bin(0.0))
    won = _candidate("e2e4", VM - 5, 1, wdl=None, mate=3, value_token=START["mate_win"] + 3)
    lost = _candidate("e2e4", -VM + 4, 1, wdl=None, mate=-2, value_token=START["mate_loss"] + 2)
    own = {f: one[0][f] for f in ("move", "raw", "wdl", "value_token")}
    cases = [
        ([_round(1, one), _round(2, one)], []),
        ([_round(2, one)], [("contiguous", None)]),
        ([], [("contiguous", None)]),
        (None, [("contiguous", None)]),
        ([_round(1, one, pv=["d2d4"])], [("variation", "1")]),
        ([_round(1, one, pv=None)], [("variation", "1")]),
        ([_round(1, one, raw=31)], [("own_raw", "1")]),
        ([_round(1, [*one, _candidate("a2a3", 40, 3)], **own, pv=["e2e4"])], [("maximum", "1")]),
        ([_round(1, one, move="h2h4", pv=["h2h4"])], [("written", "1")]),
        ([_round(1, one, value_token=START["value"])], [("outcome_token", "1")]),
        ([_round(1, [*one, one[0]])], [("candidates_once", "1")]),
        ([_round(1, [one[0], _candidate("d2d4", 10, 2, wdl=[1, 2, 3])])], [("candidate_outcome", "1/d2d4"), ("candidate_token", "1/d2d4")]),
        ([_round(1, [one[0], drawn])], []),
        ([_round(1, [one[0], drawn | {"mate": 3}])], [("candidate_draw", "1/d2d4")]),
        ([_round(1, [won])], []),
        ([_round(1, [won], mate=2)], [("mate_distance", "1"), ("mate_token", "1")]),
        ([_round(1, [lost])], []),
        ([_round(1, one) | {"candidates": []}], [("has_candidates", "1"), ("written", "1")]),
        ([_round(1, one) | {"candidates": None}], [("candidates_once", "1"), ("has_candidates", "1"), ("maximum", "1"), ("own_raw", "1"), ("written", "1")]),
    ]
    records = _records(spark, [(str(k), rounds) for k, (rounds, _) in enumerate(cases)])
    found = C.problems(records, "root_id", F.lit(VM), F.lit(MP)).collect()
    for k, (_, expected) in enumerate(cases):
        assert sorted((r["rule"], r["detail"]) for r in found if r["id"] == str(k)) == expected, k


def _walk(steps, record):
    """What each boundary shows, step by step."""
    entries = {e["round"]: e for e in record}
    out, number, latest, previous, current = [], 0, {}, None, None
    for kind, round_, move in steps:
        e = entries.get(round_)
        if kind == "begin":
            latest, current = {}, previous
        elif kind == "exact":
            x = next((x for x in e["candidates"] if x["move"] == move), None) if e else None
            if x:
                latest.setdefault(move, len(latest))
                best = max(latest, key=lambda m: (next(x["raw"] for x in e["candidates"] if x["move"] == m), -latest[m]))
                b = next(x for x in e["candidates"] if x["move"] == best)
                current = (best, b["value_token"], b["raw"])
        elif kind == "end":
            if e:
                current = (e["move"] if current is None or e["raw"] > current[2] else current[0], e["value_token"], e["raw"])
            previous = current
        out.append(current[:2] if current else (None, None))
    return out


def test_states_agree_with_a_walk(spark):
    rng = random.Random(7)
    records, steps, plain = [], [], {}
    for k in range(40):
        rounds = [_round(n, [_candidate(m, rng.randint(-3, 3), i + 1) for i, m in enumerate(rng.sample("abcd", rng.randint(1, 4)))]) for n in range(1, 5) if rng.random() < 0.8]
        walk = []
        for n in range(1, 5):
            walk.append(("begin", n, None))
            walk += [(rng.choice(["exact", "exact", "reply"]), n, rng.choice("abcde")) for _ in range(rng.randint(0, 5))]
            walk.append(("end", n, None))
        records.append((f"r{k}", rounds))
        steps += [(f"r{k}", i, *s) for i, s in enumerate(walk)]
        plain[f"r{k}"] = _walk(walk, rounds)
    asked = spark.createDataFrame(steps, "root_id string, seq long, kind string, round int, move string")
    states = C.expected_states(asked, _records(spark, records), "root_id")
    found = {}
    for r in states.orderBy("root_id", "seq").collect():
        found.setdefault(r["root_id"], []).append((r["best"], None if r["value"] is None else int(r["value"])))
    assert found == plain

    rows = [(k, [s[0] for s in v], [s[1] for s in v]) for k, v in plain.items()]
    rows[3] = (rows[3][0], rows[3][1][:-1], rows[3][2])
    rows[5][2][2] = 1
    written = spark.createDataFrame(rows, "root_id string, state_best array<string>, state_value array<int>")
    wrong = {(r["id"], r["rule"]): r["detail"] for r in C.state_problems(written, states, "root_id").collect()}
    assert wrong == {(rows[3][0], "state_count"): f"{len(rows[3][1])}/{len(rows[3][2])}", (rows[5][0], "state"): "2"}


def test_records_from_flat_tables(spark):
    one = [_candidate("b", 1, 2), _candidate("a", 3, 1)]
    rounds = spark.createDataFrame([("r", n, n, "a", 3, [503, 0, 497], None, 1, ["a"], 0) for n in (2, 1)], "root_id string, round int, depth int, move string, raw int, wdl array<int>, mate int, value_token int, pv array<string>, refutations int")
    flat = spark.createDataFrame([("r", 1, *(x[f] for f in ("move", "raw", "wdl", "mate", "value_token", "order", "draw"))) for x in one], "root_id string, round int, move string, raw int, wdl array<int>, mate int, value_token int, `order` int, draw boolean")
    (row,) = C.nested(rounds, flat, "root_id").collect()
    assert [(r["round"], [x["move"] for x in r["candidates"]]) for r in row["rounds"]] == [(1, ["a", "b"]), (2, [])]
    assert C.nested(rounds.limit(0), flat, "root_id").count() == 0


def test_alignment(spark):
    from pyspark.sql import functions as F

    step = "array<struct<operation: string, position: int, move: string, value: int, mate: int, end: int>>"
    say = lambda of, p, end, move="m", value=1: (of, p, move, value, None, end)
    plain = [say("depth", 0, 1), say("evaluate", 1, 3), say("final", 2, 5)]
    tool = [say("board", 0, 4), say("depth", 0, 5), say("board", 7, 9), say("evaluate", 1, 11), say("final", 2, 13)]
    other = [*tool[:3], say("evaluate", 1, 11, "x"), tool[4]]
    df = spark.createDataFrame([("same", tool, plain), ("other", other, plain), ("fewer", tool[:-1], plain), ("none", [], [])], f"root_id string, tool {step}, plain {step}")
    got = {r["root_id"]: r for r in C.aligned(df, "tool", "plain", "board", ["final"]).collect()}
    assert [tuple(b) for b in got["same"]["boundaries"]] == [(4, 0), (5, 1), (9, 1), (11, 3)]
    assert {k: v["problem"] for k, v in got.items()} == {"same": None, "other": "step 1", "fewer": "operations", "none": None}
    spans = spark.createDataFrame([([1, 8, 2, 8, 3, 9, 4, 9, 5, 9],), ([],), (None,)], "t array<int>")
    assert [r[0] for r in spans.select(C.outside_spans(F.col("t"), lambda t: t == 8, lambda t: t == 9)).collect()] == [[1, 5, 9], [], None]


def test_labels(spark):
    ids = move_ids()
    one = [_candidate("e2e4", 30, 1)]
    record = [("r", [_round(1, one, pv=["e2e4", "e7e5"])]), ("b", [_round(1, one, pv=["e2e4", "e7e5"])])]
    label = [CONTROL["final"], ids["e2e4"], one[0]["value_token"], ids["e7e5"], CONTROL["end"]]
    seen = [CONTROL["final"], ids["e7e5"], one[0]["value_token"], ids["e2e4"], CONTROL["end"]]
    claim = [CONTROL["final"], ids["<claim_draw>"], one[0]["value_token"], CONTROL["end"]]
    rows = [
        ("r", "zero", label, 0, "e2e4", None, 1, 0, "white"),
        ("r", "full", [5, 6, *label], 2, "e2e4", None, 1, 0, "white"),
        ("b", "zero", seen, 0, "e2e4", None, 1, 0, "black"),
    ]
    schema = "root_id string, presentation string, tokens array<int>, final_start int, final_move string, mate_distance int, repetition int, halfmove int, turn string"
    run = lambda rows: sorted((r["id"], r["rule"], r["detail"]) for r in C.suffix_problems(spark.createDataFrame(rows, schema), _records(spark, record), "root_id").collect())
    assert run(rows) == []
    assert run([rows[0], (*rows[1][:2], [5, 6, *label[:3], ids["a7a6"], label[4]], *rows[1][3:])]) == [("r", "champion_variation", "full"), ("r", "label_differs", None)]
    assert run([("r", "zero", claim, 0, "<claim_draw>", None, 3, 0, "white")]) == [("r", "claim_justified", "zero")]  # raw 30 is above the bound
    assert run([("r", "zero", label, 0, "d2d4", None, 1, 0, "white")]) == [("r", "champion_move", "zero"), ("r", "label_move", "zero")]
    mated = [*label[:3], START["mate_win"] + 2, *label[3:]]
    assert run([("r", "zero", mated, 0, "e2e4", 2, 1, 0, "white")]) == [("r", "champion_mate", "zero")]
    assert run([("r", "zero", [], 0, "e2e4", None, 1, 0, "white")]) == [(*k, "zero") for k in (("r", "champion_variation"), ("r", "label_marks"), ("r", "label_move"))]


def test_alignment_of_whole_batches(spark, monkeypatch):
    """programs are compared by arrays, many rows at a time, with nulls as they were compared step by step."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(C, "PIECE", 40)
    rng = random.Random(14)
    step = lambda ops: (rng.choice(ops), rng.choice([0, 1, None]), "m", None, rng.choice([None, 3]), rng.choice([None, 1, 5, 9]))
    rows = [(0, None, []), (1, [], None), (2, None, None), (3, [("depth", 0, "m", 1, None, 4), None], [("depth", 0, "m", 1, None, 2), None])]
    for k in range(4, 80):
        plain = [step(["depth", "final", None]) for _ in range(rng.randint(0, 6))]
        tool = [x for s in plain for x in ([step(["board"])] if rng.random() < 0.4 else []) + [(*s[:5], rng.choice([None, 2, 7]))]]
        if plain and rng.random() < 0.3:
            plain[-1] = (*plain[-1][:2], "x", *plain[-1][3:])
        rows.append((k, tool, plain[: None if rng.random() < 0.8 else 1]))

    def expected(tool, plain):
        if tool is None:
            return None, None
        told, ends = [s for s in tool if s is None or s[0] != "board"], []
        n = 0
        for s in tool:
            inserted = s is not None and s[0] == "board"
            k = n - inserted
            met = plain[k] if plain is not None and 0 <= k < len(plain) else None
            if s is None or s[0] != "final":
                ends.append((s and s[5], met[5] if met and met[5] is not None else 0))
            n += not inserted
        ends.sort(key=lambda e: (e[0] is not None, e[0] or 0, e[1]))
        if plain is None:
            return ends, None
        if len(told) != len(plain):
            return ends, "operations"
        said = lambda s: s and s[1:5]
        return ends, next((f"step {i}" for i, (a, b) in enumerate(zip(told, plain, strict=True)) if said(a) != said(b)), None)

    kind = "array<struct<operation: string, position: int, move: string, value: int, mate: int, end: int>>"
    df = spark.createDataFrame(rows, f"k int, tool {kind}, plain {kind}").repartition(2)
    out = C.aligned(df, "tool", "plain", "board", ["final"])
    assert out.columns == ["k", "tool", "plain", "boundaries", "problem"]
    assert "lambda" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["k"]: (r["boundaries"] and [tuple(b) for b in r["boundaries"]], r["problem"]) for r in out.collect()}
    want = {k: expected(t, p) for k, t, p in rows}
    assert {k: (b or [] if b is not None else None, p) for k, (b, p) in got.items()} == {k: (b, p) for k, (b, p) in want.items()}
    assert out.where("k < 0").select(F.size("boundaries")).count() == 0


def test_records_read_their_tables_once(spark):
    """Orders and lines are dealt by order once, for the candidates of a round and its best alike."""
    from tracemill.plans import champion_queries as Q

    plan = Q._alone(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().collectLeaves()
    assert plan.size() == 2
    lines = spark.createDataFrame([(7, 1, None, 5), (7, 2, 1, 3), (7, 3, 2, 9), (7, 4, 3, 9)], "k long, line long, p long, q long")
    orders = spark.createDataFrame([(2, 7, 1, 1), (2, 8, 2, 2)], "root long, k long, n long, round int")
    (row,) = Q._records(orders, lines).collect()
    assert [(r["round"], r["move"], r["raw"], len(r["candidates"])) for r in row["rounds"]] == [(1, "m3", 9, 4), (2, None, None, 0)]


def test_programs_are_made_and_compared_in_one_task(spark, monkeypatch):
    """neither programs nor boundaries leave the task, which holds those of a piece of some rows, not of a batch."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from tracemill.plans import champion_queries as Q

    plan = Q.aligned_programs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1
    assert "tool" not in plan

    texts = [b"a b c", None, b"", *(b" ".join(b"w%d" % (i * k % 97) for i in range(k)) for k in range(3, 60))]
    monkeypatch.setattr(C, "PIECE", 100)
    batch = lambda: iter([(pa.array(texts, pa.binary()), pa.array(range(len(texts))))])
    programs = list(Q._programs(batch()))
    assert len(programs) > 10
    assert all(len(plain) == 1 or len(plain.flatten()) <= C.PIECE + len(plain) for _, plain in programs)
    pieces = list(C._in_pieces(iter(programs), "board", ["final"]))
    found = [r for x in pieces for r in x.to_pylist()]

    steps = "array<struct<operation: string, position: int, move: int, value: int, mate: int, end: int>>"
    rows = [(k, *p) for k, p in enumerate((t, p) for tool, plain in programs for t, p in zip(tool.to_pylist(), plain.to_pylist(), strict=True))]
    whole = C.aligned(spark.createDataFrame([(k, [tuple(s.values()) for s in t], [tuple(s.values()) for s in p]) for k, t, p in rows], f"k int, tool {steps}, plain {steps}"), "tool", "plain", "board", ["final"])
    assert [([tuple(b.values()) for b in r["boundaries"]], r["problem"]) for r in found] == [([tuple(b) for b in r["boundaries"]], r["problem"]) for r in whole.orderBy("k").collect()]
    within = C.aligned_within(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t binary").repartition(3), ["t", "k"], Q._programs, "board", ["final"], Q._pairs_digest, "struct<n: bigint, md5: string>")
    assert [(r["n"], r["problem"]) for r in within.select("k", F.col("boundaries.n").alias("n"), "problem").orderBy("k").collect()] == [(len(r["boundaries"]), r["problem"]) for r in found]
