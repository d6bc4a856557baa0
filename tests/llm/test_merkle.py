"""The Merkle manifest against trees folded by hand."""

from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tracemill.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, hash string, level int, path string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([h(*row[k : k + 2]) for k in range(0, len(row), 2)])
    return levels


def beside(levels, k):
    out = []
    for row in levels[:-1]:
        run = row[k // 2 * 2 : k // 2 * 2 + 2]
        out.append(([x for j, x in enumerate(run) if j != k % 2], k % 2))
        k //= 2
    return out


def climb(node, siblings):
    for others, at in siblings:
        node = h(*others[:at], node, *others[at:])
    return node


def by_hand(rows):
    groups = {}
    for r in rows:
        groups.setdefault("" if r[2] is None else "s" + r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    trees = {g: tree([x[2] for x in sorted(rs, key=lambda x: x[:3])]) for g, rs in groups.items()}
    names = sorted(trees, key=str.encode)
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for g, rs in groups.items():
        for k, (_, _, own, r) in enumerate(sorted(rs, key=lambda x: x[:3])):
            proof = beside(trees[g], k) + beside(top, names.index(g))
            start = own
            if r[0] is not None and r[3] is not None and crc32(str(r[0]).encode()) % 7 == 0:
                start = leaf((*r[:3], r[3] + 1, r[4]))
            end = climb(start, proof)
            out.append((r[0], own, trees[g][-1][0], top[-1][0], h(*(x for others, _ in proof for x in others)), end, end == top[-1][0]))
    return out


def manifest(df):
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, merkle.leaf_hash(*(F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS)))
    out = merkle.manifest(df, "lang", "doc_id", FIELDS, carry=tampered)
    again = merkle.folded(F.coalesce("carried", "leaf"), F.col("proof"))
    return out.select("id", "leaf", "subroot", "root", merkle.siblings_hash(F.col("proof")), again, again == F.col("root"))


ROWS = [(i, f"s{i % 3}", ["de", "en", "en", "en", None, "ß", "Z"][i % 7], i * 5 if i % 11 else None, "é" * (i % 4) if i % 5 else None) for i in range(150)]
ROWS += [(7, "s", "en", 3, "twice")] * 3 + [(7, "s", "en", 3, "other"), (None, "s", "en", 3, "no id"), (None, None, None, None, None), (500, "", "xx", 0, "long " * 100_000)]


@pytest.mark.parametrize("step", [2, 10])
def test_manifest_matches_trees_by_hand(spark, monkeypatch, step):
    monkeypatch.setattr(merkle, "STEP", step)
    key = lambda r: tuple(map(repr, r))
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in ROWS], SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in manifest(df).collect()), key=key)
    assert got == sorted(by_hand(ROWS), key=key)
    assert 0 < sum(not r[-1] for r in got) < len(got)


@pytest.mark.parametrize("n", [0, 1, 2, 5, 8])
def test_small_tables(spark, monkeypatch, n):
    monkeypatch.setattr(merkle, "STEP", 1)
    rows = [(i, None, "en", None, "") for i in range(n)]
    got = manifest(spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)).collect()
    assert sorted(map(tuple, got)) == sorted(by_hand(rows))


def test_the_store_is_read_by_level(spark):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in ROWS], SCHEMA)
    store = merkle.build(df.select(merkle.group_key(F.col("lang")).alias("g"), F.col("doc_id").alias("id"), merkle.leaf_hash(F.col("text")).alias("hash")))
    assert "PartitionFilters: [isnotnull(level" in store.levels(2, 2)._jdf.queryExecution().toString()
    counts = {(r["g"], r["level"]): r["count"] for r in store.nodes().groupBy("g", "level").count().collect()}
    n = counts["sen", 0]
    assert [counts["sen", k] for k in range(1, 7)] == [-(-n // 2**k) for k in range(1, 7)]
