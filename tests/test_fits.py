"""Dictionary profiles: positions stay whole, tiers shrink streams, fits are reused."""

from tracemill.functions.vocabulary import COMPOSITE, CONTROL
from tracemill.plans import fits

FINAL = CONTROL["final"]


def rows(spark):
    stream = [1, 2, 3, 1, 2, 3, FINAL, 1, 2, 3, 1, 2]
    data = [(i, f"p{i // 2}", "full" if i % 2 else "zero", "train", stream if i % 2 else stream[6:]) for i in range(60)]
    return spark.createDataFrame(data, "doc_index long, position string, presentation string, split string, atoms array<int>")


def test_parts_keep_positions_whole(spark):
    full, kept, apart = fits.parts(rows(spark), 0.3)
    inside, outside = ({r["position"] for r in x.collect()} for x in (kept, apart))
    assert inside and outside and not inside & outside and kept.count() + apart.count() == 60
    assert {r["presentation"] for r in full.collect()} == {"full"}


def test_tiers_and_reuse(spark, tmp_path):
    got = {(r["size"], r["part"], r["section"], r["value"]): r for r in fits.tiers(rows(spark), [COMPOSITE, COMPOSITE + 4], 0.3, min_count=2).collect()}
    plain, merged = (got[s, "held_out", "all", None] for s in (COMPOSITE, COMPOSITE + 4))
    assert plain["ratio"] == 1.0 and merged["ratio"] < 0.8 and merged["atoms"] == plain["atoms"]
    settings = {"input": "sample", "budget": 4, "min_count": 2}
    first = [tuple(r["atoms"]) for r in fits.fitted(rows(spark), settings, f"file://{tmp_path}").orderBy("id").collect()]
    again = [tuple(r["atoms"]) for r in fits.fitted(rows(spark).limit(0), settings, f"file://{tmp_path}").orderBy("id").collect()]
    assert first == again and first
    table = fits.fitted(rows(spark), settings, f"file://{tmp_path}")
    encoded = fits.encoded(rows(spark), table)
    assert fits.top(encoded, table, 2).count() <= 2 and encoded.count() == 60
