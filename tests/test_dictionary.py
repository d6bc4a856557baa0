"""Counting through sieves and growing dictionaries by differences, against the plain ways."""

import random
from collections import Counter

import pytest

from tracemill.functions.vocabulary import COMPOSITE
from tracemill.operators import ngrams, segmentation


def streams(spark, lists):
    return spark.createDataFrame([(x,) for x in lists], "t array<int>").repartition(3)


def plain_counts(lists, shortest, longest, least):
    n = Counter(tuple(x[i : i + k]) for x in lists if x for k in range(shortest, longest + 1) for i in range(len(x) - k + 1))
    return {a: c for a, c in n.items() if c >= least}


def corpus(seed, n=120, atoms=6, top=65536):
    rng = random.Random(seed)
    runs = [[rng.randrange(atoms) for _ in range(rng.randrange(2, 7))] for _ in range(8)]
    return [[t for _ in range(rng.randrange(0, 6)) for t in (rng.choice(runs) if rng.random() < 0.7 else [rng.randrange(top)])] for _ in range(n)] + [[], [top - 1, 0, top - 1, 0]]


@pytest.mark.parametrize(("shortest", "longest", "least"), [(2, 8, 3), (1, 8, 2), (2, 2, 2), (3, 4, 2), (4, 8, 2), (5, 7, 2), (2, 8, 1), (8, 8, 2)])
@pytest.mark.parametrize("cells", [64, 1 << 20])
def test_sieved_counts_are_all_counts(spark, monkeypatch, shortest, longest, least, cells):
    monkeypatch.setattr(ngrams, "CELLS", cells)
    lists = corpus(shortest * 10 + longest)
    got = ngrams.count_windows(streams(spark, [*lists, None]), "t", shortest, longest, least).collect()
    assert {tuple(r["atoms"]): r["n"] for r in got} == plain_counts(lists, shortest, longest, least)
    assert all(r["length"] == len(r["atoms"]) for r in got) and len(got) == len({tuple(r["atoms"]) for r in got})


def test_batches_are_cut_by_tokens(spark, monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([[1] * 5, [], None, [2] * 30, [3], [4] * 4], pa.list_(pa.int32()))], names=["t"])
    assert [b.num_rows for b in ngrams._pieces([batch], 8)] == [3, 1, 2]


def full_selection(lists, pool, budget, block):
    """Every round encodes everything."""
    lists, entries = [x for x in lists if x], []
    while True:
        ids = {a: COMPOSITE + k for k, a in enumerate(entries)}
        made = [[entries[t - COMPOSITE] if t >= COMPOSITE else (t,) for t in segmentation.fewest_tokens(x, ids, 8)] for x in lists]
        used = {t for x in made for t in x}
        entries = [e for e in entries if e in used]
        joint = Counter(a + b for x in made for a, b in zip(x, x[1:], strict=False))
        new = sorted((a for a in joint if a in pool and a not in entries), key=lambda a: (-joint[a], a))[: max(0, min(block, budget - len(entries)))]
        if not new:
            return entries
        entries += new


@pytest.mark.parametrize(("budget", "block", "seed"), [(3, 1, 1), (12, 3, 2), (40, 7, 3), (200, 64, 4)])
def test_selection_equals_the_full_loop(spark, budget, block, seed):
    lists = corpus(seed, top=COMPOSITE)
    pool = plain_counts(lists, 2, 8, 2)
    table = spark.createDataFrame([(list(a),) for a in pool], "atoms array<int>")
    got = segmentation.select_dictionary(streams(spark, [*lists, None]), "t", table, budget, block).orderBy("id").collect()
    assert [tuple(r["atoms"]) for r in got] == full_selection(lists, pool, budget, block)
    assert [r["id"] for r in got] == list(range(COMPOSITE, COMPOSITE + len(got)))


def test_selection_of_nothing(spark):
    empty = spark.createDataFrame([], "atoms array<int>")
    assert segmentation.select_dictionary(streams(spark, [[1, 2]]), "t", empty, 5).count() == 0
    assert segmentation.select_dictionary(streams(spark, [[1, 2]]).limit(0), "t", spark.createDataFrame([([1, 2],)], "atoms array<int>"), 5).count() == 0


def test_decoding_by_place(spark):
    table = spark.createDataFrame([(COMPOSITE, [1, 2]), (COMPOSITE + 3, [4, 5, 6])], "id int, atoms array<int>")
    df = streams(spark, [[7, COMPOSITE, COMPOSITE + 3], [COMPOSITE + 1], [COMPOSITE + 9], []])
    got = sorted((r["decoded"] for r in segmentation.decode(df, "t", table).collect()), key=repr)
    assert got == sorted([[7, 1, 2, 4, 5, 6], None, None, []], key=repr)


def test_one_token_a_place_side_by_side_and_alone():
    """Runs walked side by side, and long ones walked alone, have the shortest path's tokens; no list per token is made."""
    import numpy as np

    rng = random.Random(11)
    for alone, short in ((0, 1), (2, 8), (32, 64)):
        entries = {tuple(rng.randrange(3) for _ in range(rng.randrange(2, 9))): COMPOSITE + k for k in range(12)}
        lists = [[rng.randrange(3) for _ in range(rng.choice([0, 1, 5, 30, 200]))] for _ in range(40)]
        encoder = segmentation.Encoder(entries)
        encoder.ALONE, encoder.SHORT = alone, short
        sizes = np.array([len(x) for x in lists])
        tokens, made = encoder.encode_flat(np.array([t for x in lists for t in x]), sizes)
        want = [segmentation.fewest_tokens(x, entries, 8) for x in lists]
        assert tokens.tolist() == [t for x in want for t in x] and made.tolist() == [len(x) for x in want]


def test_words_are_numbered_as_sql_numbers_them(spark):
    from hashlib import md5

    from pyspark.sql import functions as F

    from tracemill.functions.words import numbers

    texts = ["", None, " ", "a b  a", "é ü\ta", " lead trail ", "x " * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(2)
    got = {r["i"]: (r["n"], r["m"]) for r in df.select("i", numbers(F.col("t")).alias("n"), numbers(F.col("t"), 7).alias("m")).collect()}
    for i, t in enumerate(texts):
        want = [int(md5(w.encode()).hexdigest()[:7], 16) for w in (t or "").split(" ") if w]
        assert got[i] == (want, [n % 7 for n in want])


@pytest.mark.parametrize("bucket", [2, 1 << 40])
def test_runs_are_counted_before_the_shuffle(spark, monkeypatch, bucket):
    """tasks send distinct runs as arrays by bucket, whatever the batches and the number of buckets."""
    import pyarrow as pa

    monkeypatch.setattr(ngrams, "BUCKET", bucket)
    lists = corpus(15)
    got = ngrams.count_windows(streams(spark, [*lists, None]), "t", 2, 8, 3).collect()
    assert {tuple(r["atoms"]): r["n"] for r in got} == plain_counts(lists, 2, 8, 3) and len(got) == len({tuple(r["atoms"]) for r in got})

    monkeypatch.setattr(ngrams, "PIECE", 50)
    batches = [pa.RecordBatch.from_arrays([pa.array(lists[i : i + 7], pa.list_(pa.int32()))], names=["t"]) for i in range(0, len(lists), 7)]
    found, rows = Counter(), 0
    for b in ngrams._runs(2, 5, None, 4)(batches):
        for length, k, of, k1, k2, n in zip(*(b.column(c).to_pylist() for c in ("length", "bucket", "length", "k1", "k2", "n")), strict=True):
            assert 0 <= k < 4 and (k2 is None) == (length <= 4) and len(k1) == len(n) == len(set(zip(k1, k2 or k1, strict=True)))
            found[of] += sum(n)
            rows += 1
    assert found == Counter(len(a) for a, n in plain_counts(lists, 2, 5, 1).items() for _ in range(n))
    assert rows <= 4 * 4 * (2 + sum(len(x) for x in lists) // 25)


def test_streams_of_a_batch_are_cut_at_once():
    """F16: a batch's streams are cut together, and an entry across two of them spans no place."""
    import numpy as np
    import pyarrow as pa

    pool = segmentation._Pool([(1, 2, 3, 4), (5, 6), (6, 7)])
    assert segmentation.Encoder(pool.number).cuts(np.array([1, 2, 3, 4]), np.array([2, 4])).tolist() == [True] * 4
    batch = pa.RecordBatch.from_arrays([pa.array([[1, 2], [3, 4, 5, 6, 7, 8], [], None, [9, 1, 2, 3, 4, 1, 2]], pa.list_(pa.int32()))], names=["t"])
    assert [x for made in pool.segments([batch]) for x in made.to_pylist()] == [[5, 6, 7], [1, 2, 3, 4]]
