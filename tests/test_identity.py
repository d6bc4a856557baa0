"""Identities against their contract, one broken thing at a time."""

import json

import pytest

from tracemill.plans import identity
from tracemill.plans.identity_queries import _BREAKS, _SOUND


def found(spark, *texts):
    df = spark.createDataFrame([(i, t, 20) for i, t in enumerate(texts)], "id int, d string, n int")
    out = {i: set() for i in range(len(texts))}
    for r in identity.violations(df, "id", "d", "n").collect():
        out[r["id"]].add(r["rule"] + (f":{r['detail']}" if r["detail"] else ""))
    return [out[i] for i in range(len(texts))]


def changed(path, value):
    d = json.loads(_SOUND)
    *up, last = path.split(".")
    at = d
    for k in up:
        at = at[k]
    if value is None:
        del at[last]
    else:
        at[last] = value
    return json.dumps(d)


CASES = {
    "sound": (_SOUND, set()),
    "null": (None, {"no_identity"}),
    "broken text": ("{", {"no_identity"}),
    "a list": ("[1]", {"no_identity"}),
    "unknown field": (changed("engine.build", 1), {"engine_fields", "unknown_key:engine.build"}),
    "boolean for a number": (changed("search.hash_mb", True), {"search_limits"}),
    "text for a number": (changed("teacher.max_ply", "128"), {"teacher_mates"}),
    "share above one": (changed("board.board_frontier_p", 2), {"board_probabilities"}),
    "missing field": (changed("synthesis.claim_draw", None), {"synthesis_fields", "claim_draw", "missing_key:synthesis.claim_draw"}),
    "missing part": (changed("board", None), {"missing_part:board", "board_fields", "board_probabilities"}),
    "optional field": (changed("root_selection.source_counts", {"train": 1, "val": 2}), set()),
    "other counts": (changed("root_selection.counts.val", 5), {"counts_are_rows"}),
    "probe limit": (changed("search.syzygy_probe_limit", 9), {"probe_limit"}),
}


def test_contract(spark):
    got = found(spark, *(t for t, _ in CASES.values()))
    assert dict(zip(CASES, got, strict=True)) == {k: want for k, (_, want) in CASES.items()}
    assert all(_SOUND.replace(a, b) != _SOUND for a, b in _BREAKS)


@pytest.mark.parametrize(("value", "ok"), [(0, True), (1, True), (0.5, True), (-0.1, False), ("0.5", False), (True, False)])
def test_probabilities(spark, value, ok):
    assert (found(spark, changed("board.board_frontier_p", value))[0] == set()) == ok


def test_a_text_is_parsed_once_in_one_scan(spark):
    df = spark.createDataFrame([(1, _SOUND, 20)], "id int, d string, n int")
    plan = identity.violations(df, "id", "d", "n")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") <= 1 and plan.count("Union") == 0 and plan.count("explode(") == 1
