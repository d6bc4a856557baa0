"""The pipeline's stages against plain versions of them, and on awkward tables."""

import re

import pytest

import corpus_pipeline as P
from tests.llm.test_operators import SF, brute_components, brute_leaks
from tracemill.llm import queries, surrogates, toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_match_plain_versions(spark, docs):
    scored = toxicity.toxicity(docs, queries.label_categories(spark, SF), ["low_quality", "toxic"]).collect()
    clean = P.drop_toxic(spark, docs, SF)
    assert clean.columns == docs.columns
    assert ids(clean) == sorted(r["doc_id"] for r in scored if r["p_toxic"] < queries.TOXIC)

    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    alone = P.drop_near_copies(spark, docs, SF)
    assert alone.columns == docs.columns
    assert ids(alone) == sorted(d for d, _, c in brute_components(texts, 5) if d == c)

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    unleaked = P.drop_leaks(spark, docs, SF)
    norm = lambda t: " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()))
    windows = {w for _, t in items for w in ([norm(t)] if len(norm(t).split()) < 10 else [" ".join(norm(t).split()[k : k + 10]) for k in range(len(norm(t).split()) - 9)]) if w}
    assert ids(unleaked) == sorted(d for d, t in texts if not any(f" {w} " in f" {norm(t)} " for w in windows))
    leaked = [t for d, t in texts if d not in set(ids(unleaked))]
    assert leaked and all(brute_leaks(t, items)[1] for t in leaked[:2])

    private = P.replace_personal_data(spark, docs, SF)
    assert private.columns == docs.columns
    made = {r["doc_id"]: r for r in private.collect()}
    assert all(made[d]["text"] == (surrogates.replaced(queries.KEY, t)[0] if t else t) for d, t in texts)

    mix = P.mix_sources(spark, docs, SF)
    assert ids(mix) == ids(docs) and mix.select("position").distinct().count() == docs.count()


def test_run_keeps_what_every_stage_keeps(spark, docs):
    got = P.run(spark, SF)
    now = docs
    for _, stage in P.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, SF).collect(), docs.schema)
    assert ids(got) == ids(now)
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "mixing"]


def test_stages_on_awkward_tables(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(None, long, "en", None, 1), (3, long, "en", "a", 1), (2, long + " end", None, "a", 1), (None, None, None, None, None), (None, "", "en", "b", 0), (5, "x y", "en", "b", 3), (5, "x y", "en", "b", 3)]
    table = spark.createDataFrame(rows, COLUMNS)
    kept = P.drop_near_copies(spark, table, SF).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == [(0, ""), (0, ""), (2, long + " end"), (5, "x y")]
    for _, stage in P.STAGES:
        assert stage(spark, table.limit(0), SF).count() == 0
    assert P.mix_sources(spark, table, SF).count() == len(rows)


def test_stages_keep_clashing_columns_and_long_texts(spark):
    long = " ".join(f"w{i % 4999}x{i}" for i in range(40_000))
    rows = [(1, long, "en", "a", 1, 77), (2, long + " tail", "en", "a", 1, 88), (3, "short one", "en", "b", 1, 99)]
    table = spark.createDataFrame(rows, COLUMNS + ", _row int")
    clash = table.selectExpr("*", "doc_id AS _id", "1 AS pii", "2 AS leak", "3 AS _masked", "4 AS _text", "5 AS p_toxic0")
    for _, stage in P.STAGES:
        got = stage(spark, clash, SF)
        assert set(clash.columns) <= set(got.columns)
        kept = {r["doc_id"]: r for r in got.collect()}
        assert 1 in kept and 3 in kept and kept[1]["_row"] == 77 and kept[3]["_row"] == 99 and kept[1]["_text"] == 4
        assert len(kept[1]["text"]) == len(long)


def test_the_sieve_of_wanted_sets_stays_packed(spark):
    """The pipeline's near copies: the driver holds an eighth of a byte for each bit of the sieve."""
    import numpy as np

    from tracemill.llm import near_dup

    digests = [bytes([0, 0, 0, 9, 1]), bytes([1, 2, 3, 4, 5]), bytes([255] * 5)]
    got = near_dup.sieve(spark.createDataFrame([(bytearray(d),) for d in digests], "digest binary"))
    assert got.nbytes == near_dup.SIEVE // 8
    want = sorted({int.from_bytes(d[:4], "big") & (near_dup.SIEVE - 1) for d in digests})
    assert np.flatnonzero(np.unpackbits(got, bitorder="little")).tolist() == want
