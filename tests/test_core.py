"""The core operators against plain versions of them on small data."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.functions import arrays, draws, values, vocabulary
from tracemill.operators import dedup, games, ngrams, packing, profiles, references, sampling, segmentation
from tracemill.rules import Position, perft
from tracemill.tables import positions, running


def streams(spark, *lists):
    return spark.createDataFrame(list(enumerate(map(list, lists))), "id int, t array<int>")


def counts(spark, lists, **options):
    return {tuple(r["atoms"]): r["n"] for r in ngrams.count_windows(streams(spark, *lists), "t", min_count=1, **options).collect()}


def test_windows_stay_inside_a_stream(spark):
    assert counts(spark, [[1, 2, 1, 2]]) == {(1, 2): 2, (2, 1): 1, (1, 2, 1): 1, (2, 1, 2): 1, (1, 2, 1, 2): 1}
    assert counts(spark, [[1, 2], [2, 1], [], [5]]) == {(1, 2): 1, (2, 1): 1}
    got = counts(spark, [[1, 3, 1, 3, 2, 3]], forbidden=F.lit([2]))
    assert got == {(1, 3): 2, (3, 1): 1, (1, 3, 1): 1, (3, 1, 3): 1, (1, 3, 1, 3): 1}


def test_fewest_tokens():
    base = vocabulary.COMPOSITE
    assert segmentation.fewest_tokens([0, 0, 0, 0], {(0, 0): base, (0, 0, 0): base + 1}, 3) == [0, base + 1]
    three = {(1, 2, 3, 4): base, (3, 4, 5, 6, 7): base + 1, (5, 6, 7): base + 2}
    assert segmentation.fewest_tokens([1, 2, 3, 4, 5, 6, 7], three, 5) == [base, base + 2]
    rng = random.Random(5)
    for _ in range(200):
        entries = {tuple(rng.choices([1, 2, 3], k=rng.randint(2, 4))): base + i for i in range(6)}
        stream = rng.choices([1, 2, 3], k=rng.randint(0, 9))
        of = {i: list(a) for a, i in entries.items()}
        got = segmentation.fewest_tokens(stream, entries, 4)
        assert [x for t in got for x in of.get(t, [t])] == stream
        best = min((len(c) for c in cuts(stream, entries)), default=0)
        assert len(got) == best


def cuts(stream, entries):
    if not stream:
        yield []
    for n in range(1, len(stream) + 1):
        if n == 1 or tuple(stream[:n]) in entries:
            yield from ([n, *rest] for rest in cuts(stream[n:], entries))


def test_selection_grows_and_drops(spark):
    df = streams(spark, [1, 2, 3, 4] * 5, [1, 2, 9, 9, 9], [])
    pool = ngrams.count_windows(df, "t", min_count=2)
    got = [tuple(r["atoms"]) for r in segmentation.select_dictionary(df, "t", pool, budget=3, block=1).orderBy("id").collect()]
    assert 1 <= len(got) <= 3 and len(set(got)) == len(got)
    table = segmentation._numbered(spark, [list(a) for a in got])
    encoded = segmentation.encode(df, "t", table)
    assert all(r["n"] > 0 for r in segmentation.usage(encoded, "encoded", table).collect())
    assert all(r["t"] == r["decoded"] for r in segmentation.decode(encoded, "encoded", table).collect())
    bad = segmentation._numbered(spark, [[1], [1, 2], [1, 2], [1, 4000], [1, 2998], [1, 3005], [1, 2997]])
    assert sorted(r["reason"] for r in segmentation.unsound_entries(bad).collect()) == ["atom"] * 3 + ["length", "repeated", "repeated"]


def test_encoder_of_many_streams_matches_one_at_a_time():
    rng = random.Random(3)
    entries = {}
    while len(entries) < 30:
        entries.setdefault(tuple(rng.randrange(4) for _ in range(rng.randrange(2, 9))), 3006 + len(entries))
    streams = [[rng.randrange(4) if rng.random() < 0.9 else 9 for _ in range(rng.randrange(0, 60))] for _ in range(200)] + [[]]
    encoder = segmentation.Encoder(entries)
    want = [segmentation.fewest_tokens(s, entries, 8) for s in streams]
    assert encoder.encode([np.array(s) for s in streams]) == want == encoder.encode([np.array(s) for s in streams])
    assert segmentation.Encoder({}).encode([np.array([1, 2])]) == [[1, 2]]


def test_runs_of_eight_tokens_are_counted_like_short_ones(spark):
    rng = random.Random(4)
    lists = [[rng.choice([0, 1, 65535, 3000]) for _ in range(rng.randrange(0, 30))] for _ in range(20)]
    want = {}
    for x in lists:
        for n in range(1, 9):
            for i in range(len(x) - n + 1):
                want[tuple(x[i : i + n])] = want.get(tuple(x[i : i + n]), 0) + 1
    assert counts(spark, lists, shortest=1, longest=8) == want


@pytest.mark.parametrize("span", [2, 64])
def test_packing_is_greedy(spark, monkeypatch, span):
    monkeypatch.setattr(packing, "SPAN", span)
    rng = random.Random(1)
    sizes = [rng.randint(1, 10) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(sizes)), "d int, n int").repartition(5)
    batch, fill, want = 0, 0, []
    for s in sizes:
        if fill and fill + s > 12:
            batch, fill = batch + 1, 0
        want.append(batch)
        fill += s
    assert [r["batch"] for r in packing.pack(df, ["d"], "n", 12).orderBy("d").collect()] == want
    batch, fill, want = 0, 0, []
    for s in sizes:
        if fill >= 12:
            batch, fill = batch + 1, 0
        want.append(batch)
        fill += s
    assert [r["batch"] for r in packing.pack(df, ["d"], "n", 12, close_after=True).orderBy("d").collect()] == want
    assert packing.pack(df.limit(0), ["d"], "n", 12).count() == 0


def test_batches_shift_labels_within_documents(spark):
    df = streams(spark, [1, 2, 3], [4], [5, 6]).withColumn("n", F.size("t"))
    r = packing.assemble(packing.pack(df, ["id"], "n", 10), "t").first()
    assert (r["input_ids"], r["labels"], r["cu_seqlens"]) == ([1, 2, 3, 4, 5, 6], [2, 3, -100, -100, 6, -100], [0, 3, 4, 6])


def test_running_sums_need_no_whole_group(spark):
    rows = [("a" if i % 3 else None, i, i % 7) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(7)
    seen: dict = {}
    want = []
    for k, i, v in rows:
        want.append((i, seen.get(k, 0)))
        seen[k] = seen.get(k, 0) + v
    assert sorted((r["i"], r["s"]) for r in running(df, ["k"], ["i"], {"s": "v"}).collect()) == want
    assert sorted(r["p"] for r in positions(df, ["i"], "p").collect()) == list(range(500))


def test_samples_are_nested_and_whole(spark):
    df = spark.range(2000).select(F.col("id"), draws.draw("s", F.col("id")).alias("p"), (F.col("id") % 3 == 0).alias("f"))
    few = sampling.bottom_k(df, ["f"], "p", F.lit(50), ["id"], draws.RANGE)
    many = sampling.bottom_k(df, ["f"], "p", F.lit(80), ["id"], draws.RANGE)
    key = lambda x: {(r["f"], r["id"]) for r in x.collect()}
    assert len(key(few)) == 100 and key(few) < key(many)
    plain = sorted((r["f"], r["p"], r["id"]) for r in df.collect())
    assert key(few) == {(f, i) for g, rows in itertools.groupby(plain, key=lambda r: r[0]) for f, _, i in list(rows)[:50]}


def test_draws_of_python_programs(spark):
    r = spark.range(1).select(draws.mt_bits(F.lit("1:a:pool")).alias("b"), draws.mt_uniform(F.lit("x")).alias("u")).first()
    assert int(r["b"]) == random.Random("1:a:pool").getrandbits(64) and r["u"] == random.Random("x").random()


def test_upserts(spark):
    rows = [("k", i, s) for i, s in enumerate([1, 2, 2, 1, 4, 3, 4])] + [("m", 9, 1)]
    df = spark.createDataFrame(rows, "k string, i int, s int")
    got = {r["k"]: (r["occurrences"], r["replacements"], r["duplicates"]) for r in dedup.upsert_counts(df, ["k"], "s", ["i"]).collect()}
    assert got == {"k": (7, 2, 4), "m": (1, 0, 0)}
    assert {r["k"]: r["i"] for r in dedup.keep_best(df, ["k"], "s", ["i"]).collect()} == {"k": 4, "m": 9}


def test_percentiles_of_two_kinds(spark):
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate([5.0, 1.0, 4.0, 2.0, None])], "g string, i int, v double")
    r = profiles.nearest_rank(df, ["g"], "v", ["i"], [10, 90]).first()
    assert (r["n"], r["p10"], r["p90"], r["median"], r["min"], r["max"]) == (4, 1.0, 5.0, 3.0, 1.0, 5.0)
    assert abs(profiles.interpolated(df, ["g"], "v", ["i"], [50]).first()["p50"] - 3.0) < 1e-12


def test_values(spark):
    df = spark.createDataFrame([(-1.0,), (-0.9995,), (0.0,), (0.0045,), (1.0,), (1.5,)], "v double")
    assert [r[0] for r in df.select(values.value_bin(F.col("v"))).collect()] == [0, 0, 10, 10, 19, None]
    shape = lambda *v: spark.createDataFrame([(list(v),)], "a array<double>").select(arrays.trajectory_shape(F.col("a"))).first()[0]
    assert [shape(None), shape(1.0), shape(1.0, None, 2.0), shape(2.0, 1.0), shape(1.0, 2.0, 1.0)] == ["mate_only", "flat", "monotone_up", "monotone_down", "mixed"]
    cut = streams(spark, [7, vocabulary.CONTROL["final"], 8, 9, 10]).select(arrays.merge_segments(F.col("t"))).first()[0]
    assert cut == [[7, vocabulary.CONTROL["final"], 8], [9, 10]]


def test_vocabulary():
    assert vocabulary.COMPOSITE == 3006 == len(vocabulary.names()) and len(vocabulary.moves()) == 1969 and len(vocabulary.mirror_table()) == 3006
    twice = [vocabulary.mirror_table()[vocabulary.mirror_table()[t]] for t in range(3006)]
    assert twice == list(range(3006)) and vocabulary.moves()[0] == vocabulary.CLAIM
    moves = vocabulary.move_mirror_table()
    assert [moves[moves[t]] for t in range(3006)] == list(range(3006)) and moves[vocabulary.move_ids()["e2e4"]] == vocabulary.move_ids()["e7e5"]


def test_rules():
    assert [perft(Position(), d) for d in (1, 2, 3)] == [20, 400, 8902]
    busy = Position("r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq - 0 1")
    assert [perft(busy, d) for d in (1, 2)] == [48, 2039]
    rng, p = random.Random(3), Position()
    for _ in range(120):
        moves = p.legal()
        if not moves:
            break
        assert all(p.find_san(p.san(m)) == m for m in moves)
        p = p.after(rng.choice(moves))
        assert Position(p.fen()).fen() == p.fen()


def test_log_rules_find_what_is_wrong(spark):
    schema = (
        "root_id string, schema int, seq int, type string, engine string, value_mate int, max_ply int, options struct<threads:int,hash_mb:int,multipv:int>, fen string, depth int, multi_pv int, round int, "
        "window struct<alpha:int,beta:int>, root_order array<string>, attempt int, line int, raw int, cp int, wdl array<int>, bound string, path array<string>, ply int, move string, `order` int, call string, nodes_delta int, "
        "seldepth int, pv array<string>, rank array<struct<move:string,raw:int,cp:int,wdl:array<int>,pv:array<string>>>, bestmove string, nodes int"
    )
    names = [f.split()[0].strip("`") for f in schema.split(", ")]
    wide = {"alpha": -100, "beta": 100}
    log = [
        {"type": "session", "engine": "e", "value_mate": 32000, "max_ply": 246, "options": {"threads": 1, "hash_mb": 1, "multipv": 1}},
        {"type": "position", "fen": "x"},
        {"type": "search_start", "depth": 1, "multi_pv": 1},
        {"type": "round_start", "round": 1, "depth": 1, "window": wide, "root_order": ["e2e4"]},
        {"type": "candidate", "round": 1, "attempt": 0, "path": ["e2e4"], "ply": 1, "move": "e2e4", "order": 1, "call": "first", "depth": 1, "window": wide, "raw": -5, "cp": -5, "wdl": [100, 800, 100], "bound": "exact", "nodes_delta": 1, "seldepth": 1, "pv": ["e2e4"]},
        {"type": "attempt", "round": 1, "attempt": 0, "window": wide, "raw": 5, "cp": 5, "wdl": [100, 800, 100], "bound": "exact"},
        {"type": "round_end", "round": 1, "depth": 1, "attempt": 0, "rank": [{"move": "e2e4", "raw": 5, "cp": 5, "wdl": [100, 800, 100], "pv": ["e2e4"]}]},
        {"type": "search_end", "bestmove": "e2e4", "nodes": 1, "seldepth": 1, "depth": 1},
    ]

    def check(change):
        rows = [{**dict.fromkeys(names), "root_id": "r", "schema": 3, "seq": i, **e} for i, e in enumerate(log)]
        change(rows)
        df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)
        return {r["rule"] for r in references.log_violations(df).collect()}

    assert check(lambda rows: None) == set()
    assert "score_fields" in check(lambda rows: rows[5].update(wdl=[1, 2, 3]))
    assert "rank_established" in check(lambda rows: rows[4].update(raw=-6))
    entry = log[6]["rank"][0]
    assert check(lambda rows: rows[6].update(rank=[{**entry, "cp": 6}])) == {"rank_top_cp"}
    assert check(lambda rows: rows[6].update(rank=[{**entry, "wdl": [101, 798, 101]}])) == {"rank_top_wdl"}
    assert check(lambda rows: rows[6].update(rank=[{**entry, "wdl": [1, 2, 3]}])) == {"rank_score", "rank_top_wdl"}
    assert "bestmove" in check(lambda rows: rows[7].update(bestmove="d2d4"))
    assert {"seq_is_line"} <= check(lambda rows: rows[3].update(seq=9))
    assert "candidate_attempt" in check(lambda rows: rows[4].update(attempt=3))


def test_games_of_the_sample(spark):
    from tracemill.plans import game_queries

    plies = games.replay(game_queries._games(spark))
    assert {r["game"] for r in plies.where("illegal").collect()} == {5}
    assert {r["game"] for r in plies.where("terminal").collect()} == {1}


def test_entry_module():
    import __spark_entry__ as e

    names = set(e.queries())
    assert set(e.oracle_sql()) <= names and len(names) > 60


def test_the_squares_of_a_board_are_made_once(spark):
    from tracemill.functions import boards

    fens = spark.createDataFrame([("8/8/8/8/8/8/8/K6k w - - 0 1",)], "fen string").repartition(1)
    plan = fens.select(boards.encode_board(F.col("fen"), F.lit(1)).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("reverse(") == 1


def test_contiguous_groups_of_any_size(spark):
    from tracemill.operators import references

    groups = {1: [1, 2, 3], 2: [1, 1, 3], 3: [2, 3], 4: [1, 3], 5: [1, None, 3], 6: [None], 7: list(range(1, 101)), 8: [*range(1, 99), 98, 100], None: [*range(1, 70), 69, 71], 9: list(range(1, 63)), 10: list(range(1, 64)), 11: [1, 65]}
    df = spark.createDataFrame([(k, n) for k, ns in groups.items() for n in ns], "k int, n int").repartition(3)
    got = {(r["id"], r["detail"]) for r in references.contiguous(df, ["k"], "n", "k", "rule", 1).collect()}
    assert got == {(2, "1-3"), (3, "2-3"), (4, "1-3"), (5, "1-3"), (6, ""), (8, "1-100"), (None, "1-71"), (11, "1-65")}
    plan = references.contiguous(df.where("k < 7"), ["k"], "n", "k", "rule", 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan  # no row for each distinct number


def test_scan_after_each_element_works_its_state_out_once(spark):
    from tracemill.functions.arrays import scan

    df = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 5, 64, 65, 200)] + [(None,)], "a array<int>")
    add = lambda s, x: s + x
    for after in (False, True):
        emit = (lambda s, x: s) if after else add
        got = df.select("a", scan(F.col("a"), F.lit(0), add, emit, after=after).alias("s")).collect()
        assert all(r["s"] == (None if r["a"] is None else [sum(r["a"][: i + 1]) for i in range(len(r["a"]))]) for r in got)


def test_losses_of_sides_are_worked_out_once(spark):
    from tracemill.operators import evaluation

    losses = spark.range(9).selectExpr("id", "0 AS ply", "id % 2 = 0 AS root_player", "cast(id AS int) AS cp_loss", "id < 3 AS best_move")
    seen = spark.sparkContext.accumulator(0)
    counted = losses.withColumn("cp_loss", F.udf(lambda x: seen.add(1) or x, "int").asNondeterministic()("cp_loss"))
    got = {r["root_player"]: (r["plies"], r["best"], r["count"], r["median"]) for r in evaluation.side_losses(counted, []).collect()}
    assert got == {True: (5, 2, 5, 4.0), False: (4, 1, 4, 4.0)} and seen.value == 9


def test_what_goes_along_is_not_ordered_with_the_documents(spark, monkeypatch):
    """packing orders ids and lengths alone; further columns are met at the end, whatever they are."""
    ordered = []
    was = packing.running
    monkeypatch.setattr(packing, "running", lambda df, *a: ordered.append(df.columns) or was(df, *a))
    lists = [[k] * (k % 4 + 1) for k in range(30)]
    df = spark.createDataFrame([(k // 2, k, len(t), t) for k, t in enumerate(lists)], "a int, b int, n int, t array<int>").repartition(3)
    out = packing.pack(df, ["a", "b"], "n", 10)
    assert sorted(out.columns) == ["a", "b", "batch", "n", "place", "start", "t"]
    assert ordered and not any("t" in c for c in ordered)
    rows = out.orderBy("a", "b").collect()
    batch, fill, at = 0, 0, 0
    for r, t in zip(rows, lists, strict=True):
        batch, fill = (batch + 1, len(t)) if fill + len(t) > 10 else (batch, fill + len(t))
        assert (r["t"], r["start"], r["place"], r["batch"]) == (t, at, r["b"], batch)
        at += len(t)
