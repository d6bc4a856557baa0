"""Reference checks over tables and search-event logs: every rule a query of (id, rule, detail) rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..tables import stored


def violations(df: DataFrame, rules: dict[str, Column], key: str, detail: Column) -> DataFrame:
    """A row for each rule (a column that is true for sound rows) and each row that breaks it, in one scan."""
    broken = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items())), lambda r: r.isNotNull())
    return df.select(F.col(key).alias("id"), detail.cast("string").alias("detail"), F.explode(broken).alias("rule")).select("id", "rule", "detail")


def dangling(df: DataFrame, parent: DataFrame, keys: list[str], key: str, rule: str) -> DataFrame:
    """Rows that refer to no row of ``parent``."""
    lost = df.join(parent.select(*keys).distinct(), keys, "left_anti")
    return lost.select(F.col(key).alias("id"), F.lit(rule).alias("rule"), F.concat_ws("/", *(F.col(k).cast("string") for k in keys)).alias("detail"))


def contiguous(df: DataFrame, keys: list[str], number: str, key: str, rule: str, start: int = 0) -> DataFrame:
    """Groups whose distinct numbers are not start, start + 1, ... without a gap: min, max and count tell."""
    # bits of the numbers: a row a group on the map side already, where distinct numbers would be a row each
    bits = F.expr(f"bit_or(shiftleft(1L, cast(`{number}` - {start} as int)))")
    found = df.groupBy(*keys).agg(F.min(number).alias("_lo"), F.max(number).alias("_hi"), F.count("*").alias("_rows"), bits.alias("_bits"))
    off = F.coalesce((F.col("_lo") != start) | (F.col("_hi") != start + F.col("_rows") - 1), F.lit(True))
    large = F.col("_rows") > 62
    gaps = F.coalesce(F.col("_bits"), F.lit(0).cast("long")) != F.expr("shiftleft(1L, cast(_rows as int)) - 1")
    found = stored(found.withColumn("_off", off).where(F.col("_off") | large | gaps))
    # groups too large for the bits have their numbers counted
    asked = found.where(~F.col("_off") & large).select(*(F.col(k).alias(f"_k_{k}") for k in keys))
    bad = found.where(F.col("_off") | ~large).select(*keys, "_lo", "_hi")
    if asked.isEmpty():
        return _ends_of(bad, key, rule)
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys))
    counted = df.join(asked, same, "left_semi").groupBy(*keys).agg(F.min(number).alias("_lo"), F.max(number).alias("_hi"), F.count_distinct(number).alias("_n"), F.count("*").alias("_rows"))
    return _ends_of(bad.unionByName(counted.where("_n != _rows").select(*keys, "_lo", "_hi")), key, rule)


def _ends_of(bad: DataFrame, key: str, rule: str) -> DataFrame:
    return bad.select(F.col(key).alias("id"), F.lit(rule).alias("rule"), F.concat_ws("-", "_lo", "_hi").alias("detail"))


def exactly(df: DataFrame, keys: list[str], when: Column, times: int, key: str, rule: str) -> DataFrame:
    found = df.groupBy(*keys).agg(F.count_if(when).alias("_n"))
    return found.where(F.col("_n") != times).select(F.col(key).alias("id"), F.lit(rule).alias("rule"), F.col("_n").cast("string").alias("detail"))


def never_rises(df: DataFrame, keys: list[str], order: str, value: str, key: str, rule: str) -> DataFrame:
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_before", before).where(F.col("_before") < F.col(value)).select(F.col(key).alias("id"), F.lit(rule).alias("rule"), F.col(order).cast("string").alias("detail"))


# Event logs --------------------------------------------------------------------------------------------------

SCORED = ("attempt", "candidate", "frontier")


def _session_values(events: DataFrame) -> DataFrame:
    one = events.groupBy("root_id").agg(
        F.first(F.when(F.col("type") == "session", F.struct("value_mate", "max_ply")), ignorenulls=True).alias("_s"),
        F.first(F.when(F.col("type") == "search_start", F.struct("depth", "multi_pv")), ignorenulls=True).alias("_q"),
        F.max("seq").alias("_last"),
        F.first(F.when(F.col("type") == "search_end", F.struct("bestmove", "depth")), ignorenulls=True).alias("_e"),
    )
    return one.select("root_id", F.col("_s.value_mate").alias("_vm"), F.col("_s.max_ply").alias("_mp"), F.col("_q.depth").alias("_asked"), F.col("_q.multi_pv").alias("_width"), "_last", "_e")


def _line_rules(width: int) -> dict[str, Column]:
    c, of = F.col, lambda t: F.col("type") == t
    unless = lambda t, ok: ~of(t) | ok
    scored = c("type").isin(*SCORED)
    mate = F.abs(c("raw")) >= c("_vm") - c("_mp")
    return {
        "known_type": c("type").isin("session", "position", "search_start", "round_start", "attempt", "candidate", "frontier", "round_end", "search_end"),
        "schema": c("schema") == (3 if width == 1 else 4),
        "session_first": of("session") == (c("seq") == 0),
        "end_last": of("search_end") == (c("seq") == c("_last")),
        "session_options": unless("session", (c("options.threads") == 1) & (c("options.hash_mb") >= 1) & (c("options.multipv") == width) & (c("value_mate") >= 1) & (c("max_ply") >= 1) & (F.length("engine") > 0)),
        "search_depth": unless("search_start", (c("depth") >= 1) & (c("multi_pv").between(1, width))),
        "round_depth": unless("round_start", (c("depth") == c("round")) & (c("window.alpha") < c("window.beta")) & F.forall("root_order", lambda m: F.length(m) > 0)),
        "attempt_line": unless("attempt", c("line").isNull() if width == 1 else c("line").between(0, c("_width") - 1)),
        "score_fields": ~scored | F.when(mate, c("cp").isNull() & c("wdl").isNull()).otherwise(c("cp").isNotNull() & F.coalesce(V.wdl_is_sound(c("wdl")), F.lit(False))),
        "attempt_bound": unless("attempt", c("bound") == V.bound(c("raw"), c("window.alpha"), c("window.beta"))),
        "candidate_bound": unless("candidate", c("bound") == V.bound(c("raw"), c("window.alpha"), c("window.beta"))),
        "path_length": ~c("type").isin("candidate", "frontier") | (F.size("path") == c("ply")),
        "candidate_move": unless("candidate", (F.element_at("path", -1) == c("move")) & (c("order") >= 1)),
        "candidate_call": unless("candidate", c("call").isin("first", "probe", "rescore", "promote")),
        "narrow_window": unless("candidate", ~c("call").isin("probe", "rescore") | (c("window.beta") - c("window.alpha") == 1)),
        "line_of_play": unless("candidate", F.when((c("ply") == 1) & c("call").isin("first", "promote"), F.size(F.coalesce("pv", F.array().cast("array<string>"))) > 0).otherwise(c("pv").isNull())),
        "frontier_bound": unless("frontier", c("bound").isin("exact", "upper", "lower")),
        "work": ~c("type").isin("candidate", "frontier") | ((c("nodes_delta") >= 0) & (c("seldepth") >= 0)),
        "rank_width": unless("round_end", F.size("rank") == c("_width")),
        "rank_line": unless("round_end", F.forall("rank", lambda r: r["pv"][0] == r["move"])),
        "end_work": unless("search_end", (c("nodes") >= 0) & (c("seldepth") >= 0)),
        "not_deeper": unless("round_end", c("depth") <= c("_asked")),
    }


def accepted_attempts(attempts: DataFrame, ends: DataFrame, width: int) -> tuple[DataFrame, list[DataFrame]]:
    """(root_id, round, attempt, raw, cp, wdl) of what a round accepts, and the violations of how it got there. One
    line: the only exact attempt, which the round's end names. Several: each line's last attempt, its only exact one;
    lines run from 0 to the effective width, and the round's end names how many attempts there were."""
    c = F.col
    if width == 1:
        exact = attempts.where(c("bound") == "exact")
        met = exact.groupBy("root_id", "round").agg(F.count("*").alias("n"), F.max("attempt").alias("accepted"))
        joined = ends.select("root_id", "round", "attempt").join(met, ["root_id", "round"], "left")
        return exact, [violations(joined, {"one_exact_attempt": (c("n") == 1) & (c("accepted") == c("attempt"))}, "root_id", c("round"))]
    lines = attempts.groupBy("root_id", "round", "line").agg(
        F.count_if(c("bound") == "exact").alias("exact"), F.max("attempt").alias("last"), F.max(F.when(c("bound") == "exact", c("attempt"))).alias("accepted")
    )
    rounds = lines.groupBy("root_id", "round").agg(F.count("*").alias("lines"), F.max("line").alias("top"))
    many = attempts.groupBy("root_id", "round").agg(F.count("*").alias("n"))
    joined = ends.select("root_id", "round", "attempt", "_width").join(rounds, ["root_id", "round"], "left").join(many, ["root_id", "round"], "left")
    out = [
        violations(lines, {"line_exact_once": (c("exact") == 1) & (c("accepted") == c("last"))}, "root_id", F.concat_ws("/", "round", "line")),
        violations(joined, {"lines_complete": (c("lines") == c("_width")) & (c("top") == c("lines") - 1), "attempts_counted": c("attempt") == c("n")}, "root_id", c("round")),
    ]
    kept = attempts.join(lines.select("root_id", "round", c("accepted").alias("attempt")), ["root_id", "round", "attempt"], "left_semi")
    return kept, out


def log_violations(events: DataFrame, width: int = 1) -> DataFrame:
    """(id, rule, detail) of everything that is wrong with the logs of searches of the given width; rules that need
    the board are not among them. The log is read once and kept by type."""
    c = F.col
    known = stored(events.join(_session_values(events), "root_id", "left"))
    of = lambda t: known.where(c("type") == t)
    starts, ends, attempts, candidates, frontiers = (stored(of(t)) for t in ("round_start", "round_end", "attempt", "candidate", "frontier"))
    out = [
        violations(known, _line_rules(width), "root_id", c("seq")),
        contiguous(known, ["root_id"], "seq", "root_id", "seq_is_line"),
        contiguous(starts, ["root_id"], "round", "root_id", "rounds_contiguous", 1),
        contiguous(attempts, ["root_id", "round"], "attempt", "root_id", "attempts_contiguous"),
        *(exactly(known, ["root_id"], c("type") == t, 1, "root_id", f"one_{t}") for t in ("session", "position", "search_start", "search_end")),
        dangling(attempts, starts, ["root_id", "round"], "root_id", "attempt_round"),
        dangling(starts, attempts, ["root_id", "round"], "root_id", "round_attempt"),
        dangling(ends, starts, ["root_id", "round", "depth"], "root_id", "round_end_start"),
        dangling(starts, ends, ["root_id", "round", "depth"], "root_id", "round_start_end"),
        *(dangling(x, attempts, ["root_id", "round", "attempt"], "root_id", f"{n}_attempt") for x, n in ((candidates, "candidate"), (frontiers, "frontier"))),
    ]
    opening = candidates.where(c("call").isin("first", "promote")).select("root_id", "round", "attempt", "path", "raw", "bound").distinct()
    out.append(dangling(frontiers, opening, ["root_id", "round", "attempt", "path", "raw", "bound"], "root_id", "frontier_opening").withColumn("detail", F.lit(None).cast("string")))
    out.append(
        frontiers.groupBy("root_id", "round", "attempt", "path").agg(F.count("*").alias("n")).where("n > 1").select(c("root_id").alias("id"), F.lit("frontier_once").alias("rule"), F.array_join("path", " ").alias("detail"))
    )
    rank = ends.select("root_id", "round", "attempt", "seq", "_vm", "_mp", F.posexplode("rank").alias("place", "r")).select("root_id", "round", "attempt", "seq", "place", c("r.move").alias("move"), c("r.raw").alias("rank_raw"), c("r.pv").alias("rank_pv"), c("r.cp").alias("rank_cp"), c("r.wdl").alias("rank_wdl"), "_vm", "_mp")
    out.append(never_rises(rank, ["root_id", "seq"], "place", "rank_raw", "root_id", "rank_order"))
    out.append(violations(rank, {"rank_score": F.when(V.is_mate(c("rank_raw"), c("_vm"), c("_mp")), c("rank_cp").isNull() & c("rank_wdl").isNull()).otherwise(c("rank_cp").isNotNull() & F.coalesce(V.wdl_is_sound(c("rank_wdl")), F.lit(False)))}, "root_id", F.concat_ws("/", "seq", "place")))
    accepted, broken = accepted_attempts(attempts, ends, width)
    out += broken
    # the first of the rank is the best of what the round accepted
    # (of equal ones the first line's); what that attempt says of cp and wdl, the rank says too
    first = F.struct("raw", -F.coalesce("line", F.lit(0)), -c("seq"))
    top = accepted.groupBy("root_id", "round").agg(F.max("raw").alias("_best"), F.max_by(F.struct("cp", "wdl"), first).alias("_said"))
    led = rank.where("place = 0").join(top, ["root_id", "round"], "left")
    said = lambda name: c(f"_said.{name}").isNull() | (c(f"rank_{name}") == c(f"_said.{name}"))
    out.append(violations(led, {"rank_top": c("rank_raw") == c("_best"), "rank_top_cp": said("cp"), "rank_top_wdl": said("wdl")}, "root_id", c("round")))
    # the last exact opening call of a ranked move in what was accepted has its score, negated, and its line
    inside = candidates.where(c("ply") == 1).join(accepted.select("root_id", "round", "attempt").distinct(), ["root_id", "round", "attempt"], "left_semi")
    exact = inside.where(c("call").isin("first", "promote") & (c("bound") == "exact"))
    last = exact.groupBy("root_id", "round", "move").agg(F.max_by(F.struct("raw", "pv"), "seq").alias("call"))
    met = rank.join(last, ["root_id", "round", "move"], "left")
    out.append(violations(met, {"rank_established": (c("call.raw") == -c("rank_raw")) & (c("call.pv") == c("rank_pv"))}, "root_id", F.concat_ws("/", "round", "move")))
    # a scout that fails high for the mover needs an exact call of the move in its attempt
    scouts = inside.where(c("call").isin("probe", "rescore")).groupBy("root_id", "round", "attempt", "move").agg(F.max_by("bound", "seq").alias("bound")).where(c("bound") == "upper")
    out.append(dangling(scouts, exact, ["root_id", "round", "attempt", "move"], "root_id", "fail_high"))
    late = known.where(c("type").isin(*SCORED)).join(ends.select("root_id", "round", c("seq").alias("_end")), ["root_id", "round"]).where(c("seq") > c("_end"))
    out.append(late.select(c("root_id").alias("id"), F.lit("after_round_end").alias("rule"), c("seq").cast("string").alias("detail")))
    best = ends.groupBy("root_id").agg(F.max_by(F.col("rank")[0]["move"], F.struct("round", "seq")).alias("_top"), F.max("depth").alias("_deep"))
    closing = known.where(c("type") == "search_end").join(best, "root_id", "left")
    out.append(violations(closing, {"bestmove": c("bestmove") == c("_top"), "end_depth": c("depth") == c("_deep")}, "root_id", c("bestmove")))
    total = out[0]
    for x in out[1:]:
        total = total.unionByName(x)
    return total


def teacher_problems(events: DataFrame, roots: DataFrame, engine: str, hash_mb: int, value_mate: int, max_ply: int) -> DataFrame:
    """(id, rule, detail) of searches that were not what their roots (root_id, depth, teacher_width) asked for: the
    engine and its constants, one thread, the hash size, and depth and width asked for and reached. A root whose own
    settings are none is named for that alone; one without a log for its lack."""
    c = F.col
    first = lambda t, *fields: F.first(F.when(c("type") == t, F.struct(*fields)), ignorenulls=True)
    logs = events.groupBy("root_id").agg(
        first("session", "engine", "value_mate", "max_ply", "options").alias("s"), first("search_start", "depth", "multi_pv").alias("q"), first("search_end", "depth").alias("e")
    )
    met = roots.select("root_id", "depth", "teacher_width").join(logs.withColumn("_log", F.lit(True)), "root_id", "left")
    own = F.coalesce((c("depth") >= 1) & (c("teacher_width") >= 1), F.lit(False))
    ready = own & c("_log").isNotNull()
    unless = lambda ok: ~ready | ok
    rules = {
        "root_settings": own,
        "has_log": ~own | c("_log").isNotNull(),
        "engine_name": unless(c("s.engine") == engine),
        "engine_constants": unless((c("s.value_mate") == value_mate) & (c("s.max_ply") == max_ply)),
        "one_thread": unless(c("s.options.threads") == 1),
        "hash_size": unless(c("s.options.hash_mb") == hash_mb),
        "depth_asked": unless(c("q.depth") == c("depth")),
        "depth_reached": unless(c("e.depth") == c("depth")),
        "width_asked": unless(c("s.options.multipv") == c("teacher_width")),
    }
    return violations(met, rules, "root_id", F.concat_ws("/", "depth", "teacher_width"))


def candidate_groups(events: DataFrame) -> DataFrame:
    """Per round, attempt, parent and move: the last exact opening call; else the last refutation; and the order
    of narration (order, first call)."""
    c = F.col
    calls = events.where(c("type") == "candidate").withColumn("parent", F.slice("path", F.lit(1), F.size("path") - 1))
    exact = c("call").isin("first", "promote") & (c("bound") == "exact")
    refuted = c("call").isin("probe", "rescore") & (c("bound") == "lower")
    last = lambda when: F.max_by(F.when(when, F.struct("raw", "pv", "seq")), F.when(when, c("seq")))
    out = calls.groupBy("root_id", "round", "attempt", "parent", "move").agg(F.min("seq").alias("first_seq"), F.min_by("order", "seq").alias("order"), last(exact).alias("exact"), last(refuted).alias("refuted"))
    return out.withColumn("refuted", F.when(c("exact").isNull(), c("refuted")))


def accepts(check: Callable[[], DataFrame]) -> bool:
    return check().isEmpty()
