"""Product codes against plain assignment of every part to every entry."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, q string, code string"


def plain(rows, parts, entries, rounds, scale=256):
    """(codes by row, errors, codebooks) with no bounds at all."""
    q = np.array([[int(np.floor(np.float64(np.float32(x)) * scale)) for x in v] for _, v in rows], object)
    width = q.shape[1] // parts
    order = sorted(range(len(rows)), key=lambda k: rows[k][0])[:entries]
    books = [[q[k][p * width : (p + 1) * width] for k in order] for p in range(parts)]
    cut = [[r[p * width : (p + 1) * width] for p in range(parts)] for r in q]
    gap = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    for last in range(rounds + 1):
        best = [[min(range(len(books[p])), key=lambda k: (gap(x[p], books[p][k]), k)) for p in range(parts)] for x in cut]
        if last == rounds:
            break
        for p in range(parts):
            for k in range(len(books[p])):
                own = [x[p] for x, b in zip(cut, best, strict=True) if b[p] == k]
                if own:
                    books[p][k] = [sum(v) // len(own) for v in zip(*own, strict=True)]
    errors = [sum(gap(x[p], books[p][b[p]]) for p in range(parts)) for x, b in zip(cut, best, strict=True)]
    return best, errors, [[list(map(int, c)) for c in b] for b in books]


def sample(n, dim, seed=1, size=0.3, whole=False):
    r = np.random.default_rng(seed)
    x = r.normal(0, size, (n, dim))
    return [(i * 7 % n, (np.round(v * 8) / 256 if whole else v).astype(np.float32).tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize(("dim", "parts", "entries", "rounds", "whole"), [(8, 4, 5, 2, False), (8, 2, 16, 4, True), (6, 6, 8, 3, True), (4, 1, 1, 2, False), (32, 16, 64, 2, False)])
def test_codes_match_plain_assignment(spark, dim, parts, entries, rounds, whole):
    rows = sample(120, dim, whole=whole)
    df = spark.createDataFrame([(i, v, i % 3 or None, "x", "y") for i, v in rows], SCHEMA).repartition(3)
    out, books = vc.vector_codes(df, keep=("label", "q"), parts=parts, entries=entries, rounds=rounds)
    got = {r["vec_id"]: r for r in out.collect()}
    best, errors, want = plain(rows, parts, entries, rounds)
    assert books.tolist() == want
    for (i, _), b, e in zip(rows, best, errors, strict=True):
        assert (list(got[i]["code"]), got[i]["error"], got[i]["q"]) == (b, e, "x")


def test_bounds_spare_scans_and_change_nothing():
    r = np.random.default_rng(3)
    centres = r.integers(-200, 200, (12, 4))
    q = centres[r.integers(0, 12, 5000)] + r.integers(-9, 10, (5000, 4))
    old = q[:12].copy()
    entry, upper, lower, scan = vc.assigned(q, old)
    assert len(scan) == len(q)
    for _ in range(5):
        new = np.array([q[entry == k].sum(0) // max(1, (entry == k).sum()) if (entry == k).any() else old[k] for k in range(12)])
        entry, upper, lower, scan = vc.assigned(q, new, vc.Moves(old, new), entry, upper, lower)
        d = vc.distances(q, new)
        ordered = np.sort(d, axis=1)
        assert (entry == d.argmin(1)).all()
        assert (upper.astype(float) ** 2 >= d.min(1) * (1 - 1e-9)).all() and (lower.astype(float) ** 2 <= ordered[:, 1] * (1 + 1e-9)).all()
        old = new
    assert len(scan) < len(q) / 4


def test_equal_distances_take_the_lower_index():
    book = np.array([[0, 0], [2, 0], [2, 0], [0, 2]])
    q = np.array([[1, 0], [2, 0], [0, 1], [1, 1]])
    first = vc.assigned(q, book)
    assert first[0].tolist() == [0, 1, 0, 0]
    assert vc.assigned(q, book, vc.Moves(book, book), *first[:3])[0].tolist() == [0, 1, 0, 0]
    swapped = book[[3, 1, 2, 0]]
    assert vc.assigned(q, swapped, vc.Moves(book, swapped), *first[:3])[0].tolist() == [1, 1, 0, 0]


def test_exact_integers_beyond_floating_point():
    big = 2**vc.LIMIT - 1
    q, book = np.array([[big, -big], [big - 1, 3]]), np.array([[-big, big], [big, big]])
    assert vc.distances(q, book).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, c, strict=True)) for c in book] for x in q]


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [1.0, -0.001, 0.5, 2.0]
    rows = [(5, good, 1), (5, good, 1), (None, good, None), (1, None, 1), (2, [1.0, None, 0.0, 0.0], 1), (3, [nan, 0.0, 0.0, 0.0], 1), (4, [inf, 0.0, 0.0, 0.0], 2), (6, [1.0, 2.0], 2), (7, [1e30, 0.0, 0.0, 0.0], None), (8, [], 1)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    out, books = vc.vector_codes(df, keep=("label",), parts=2, entries=2)
    got = sorted(((r["vec_id"], r["code"] and r["code"].hex(), r["error"], r["label"]) for r in out.collect()), key=repr)
    assert got == sorted([(5, "0000", 0, 1), (5, "0000", 0, 1), (None, "0000", 0, None), (6, None, None, 2), (7, None, None, None), (8, None, None, 1)], key=repr)
    assert books.tolist() == [[[256, -1], [256, -1]], [[128, 512], [128, 512]]]
    totals = {(r["vec_id"], r["label_error"]) for r in vc.with_group_error(out, "label").collect()}
    assert totals == {(5, 0), (None, 0), (6, None), (7, 0), (8, 0)}
    none, books = vc.vector_codes(df.limit(0))
    assert none.count() == 0 and books.size == 0
    odd, books = vc.vector_codes(df.where("vec_id = 5"), parts=3)
    assert [r["code"] for r in odd.collect()] == [None, None] and books.size == 0


def test_decoded_vectors_are_near(spark):
    rows = sample(200, 8)
    out, books = vc.vector_codes(spark.createDataFrame([(i, v, 0, "", "") for i, v in rows], SCHEMA), parts=4, entries=64)
    by_id = dict(rows)
    gaps = [np.abs(vc.decoded(r["code"], books) - np.array(by_id[r["vec_id"]])).mean() for r in out.where(F.col("error").isNotNull()).collect()]
    assert len(gaps) == 200 and np.mean(gaps) < 0.1
