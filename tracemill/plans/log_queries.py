"""The log rules over logs that are made up from ``events``: a user's events are a search's lines, in order.

Fields follow from the event's number alone, so that every rule is kept by many lines and broken by some; the same
expressions make the log here and in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import references
from ..tables import table
from .registry import registry

QUERIES, ORACLES, query = registry()

_BASE = "SELECT user_id AS root_id, event_id AS e, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, count(*) OVER (PARTITION BY user_id) AS m FROM events"
_STEPS: list[dict[str, str]] = [
    {"q": "CAST((e - e % 9) / 9 AS BIGINT)"},
    {
        "type": "CASE WHEN seq = 0 THEN 'session' WHEN seq = m - 1 THEN 'search_end' WHEN seq = 1 THEN 'position' WHEN seq = 2 THEN 'search_start' WHEN e % 101 = 0 THEN 'other' WHEN e % 9 = 0 THEN 'round_start' WHEN e % 9 < 4 THEN 'attempt' WHEN e % 9 < 7 THEN 'candidate' WHEN e % 9 = 7 THEN 'frontier' ELSE 'round_end' END",
        "round": "1 + q % 3",
        "attempt": "CASE WHEN e % 9 = 8 THEN q % 3 ELSE CAST((q - q % 3) / 3 AS BIGINT) % 2 END",
        "raw": "CASE WHEN e % 13 = 0 THEN 31990 ELSE (e * 37) % 41 - 20 END",
        "alpha": "-5",
        "beta": "CASE WHEN e % 2 = 0 THEN -4 ELSE 15 END",
        "ply": "1 + q % 2",
        "call": "CASE q % 4 WHEN 0 THEN 'first' WHEN 1 THEN 'probe' WHEN 2 THEN 'rescore' ELSE 'promote' END",
        "own": "'m' || CAST(q % 3 AS STRING)",
    },
    {
        "schema": "CASE WHEN e % 53 = 0 THEN 9 ELSE {schema} END",
        "depth": "CASE WHEN type = 'round_start' AND e % 17 = 0 THEN round + 1 WHEN type LIKE 'round%' THEN round WHEN type = 'search_start' AND e % 7 = 0 THEN 0 ELSE 3 END",
        "line": "CASE WHEN {width} > 1 OR e % 61 = 0 THEN CAST((q - q % 2) / 2 AS BIGINT) % 2 END",
        "cp": "CASE WHEN e % 13 = 0 AND e % 2 = 0 OR e % 19 = 0 THEN NULL ELSE raw END",
        "bound": "CASE WHEN e % 29 = 0 THEN 'exact' WHEN raw <= alpha THEN 'upper' WHEN raw >= beta THEN 'lower' ELSE 'exact' END",
        "path": "CASE WHEN ply = 2 THEN 'x ' || own ELSE own END",
        "said": "CASE WHEN e % 31 = 0 THEN ply + 1 ELSE ply END",
        "move": "CASE WHEN e % 37 = 0 THEN 'zz' ELSE own END",
        "r1": "'m' || CAST(e % 3 AS STRING)",
        "r2": "'m' || CAST((e + 1) % 3 AS STRING)",
        "s1": "(e * 7) % 30",
        "s2": "(e * 11) % 30",
    },
    {
        "w3": "CASE WHEN cp IS NULL THEN NULL WHEN e % 23 = 0 THEN 101 ELSE 100 END",
        "pv": "CASE WHEN said = 1 AND call IN ('first', 'promote') AND e % 47 <> 0 THEN move END",
        "line2": "'m' || CAST((e + 1 + CASE WHEN e % 7 = 0 THEN 1 ELSE 0 END) % 3 AS STRING)",
    },
]


def _log_sql(width: int) -> str:
    """The flat log as common table expressions, the last being ``g``."""
    out, before = f"g0 AS ({_BASE})", "g0"
    for k, step in enumerate(_STEPS, 1):
        name = "g" if k == len(_STEPS) else f"g{k}"
        columns = ", ".join(f"{v.format(width=width, schema=3 if width == 1 else 4).replace('STRING', 'VARCHAR')} AS {c}" for c, v in step.items())
        out, before = f"{out},\n{name} AS (SELECT *, {columns} FROM {before})", name
    return out


def logs(spark: SparkSession, sf_dir: str, width: int) -> DataFrame:
    events = table(spark, sf_dir, "events").selectExpr("user_id", "event_id", "ts")
    df = events.selectExpr("user_id AS root_id", "event_id AS e", "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq", "count(*) OVER (PARTITION BY user_id) AS m")
    for step in _STEPS:
        df = df.selectExpr("*", *(f"{v.format(width=width, schema=3 if width == 1 else 4)} AS {c}" for c, v in step.items()))
    c, when = F.col, lambda kinds, x: F.when(F.col("type").isin(*kinds), x)
    entry = lambda k, line: F.struct(c(f"r{k}").alias("move"), c(f"s{k}").alias("raw"), F.array(line).alias("pv"), F.when(c("e") % 71 != 0, c(f"s{k}")).alias("cp"), F.array(F.lit(100), F.lit(800), F.when(c("e") % 67 == 0, 101).otherwise(100)).alias("wdl"))
    return df.select(
        "root_id", "seq", "type", "schema", "round", "attempt", "raw", "cp", "bound", "depth", "line", "move", "call",
        F.when(c("w3").isNotNull(), F.array(F.lit(100), F.lit(800), c("w3"))).alias("wdl"),
        F.struct(c("alpha"), c("beta")).alias("window"),
        F.split("path", " ").alias("path"),
        c("said").alias("ply"),
        F.when(c("e") % 41 == 0, 0).otherwise(1).alias("order"),
        F.when(c("e") % 43 == 0, -1).otherwise(5).alias("nodes_delta"),
        F.lit(3).alias("seldepth"),
        F.when(c("pv").isNotNull(), F.array("pv")).alias("pv"),
        F.array(F.lit("a"), F.when(c("e") % 59 == 0, "").otherwise("b")).alias("root_order"),
        when(["round_end"], F.when(c("e") % 5 == 0, F.array(entry(1, c("r1")))).otherwise(F.array(entry(1, c("r1")), entry(2, c("line2"))))).alias("rank"),
        when(["session"], F.lit("x")).alias("engine"),
        when(["session"], F.lit(32000)).alias("value_mate"),
        when(["session"], F.lit(246)).alias("max_ply"),
        F.struct(F.when(c("e") % 6 == 0, 2).otherwise(1).alias("threads"), F.lit(16).alias("hash_mb"), F.lit(width).alias("multipv")).alias("options"),
        when(["search_start"], F.lit(width)).alias("multi_pv"),
        when(["search_end"], c("r1")).alias("bestmove"),
        F.when(c("e") % 4 == 0, -1).otherwise(9).alias("nodes"),
    )


def _rules(spark, sf_dir, width: int, names: list[str]) -> DataFrame:
    out = references.log_violations(logs(spark, sf_dir, width), width)
    return out.where(F.col("rule").isin(*names)).select("id", "rule", F.coalesce("detail", F.lit("")).alias("detail"))


_SESSIONS = "sv AS (SELECT root_id, max(seq) AS last, max(CASE WHEN type = 'search_start' THEN depth END) AS asked, max(CASE WHEN type = 'search_start' THEN {width} END) AS width FROM g GROUP BY root_id), k AS (SELECT g.*, sv.last, sv.asked, sv.width FROM g JOIN sv USING (root_id))"
_SCORED = "type IN ('attempt', 'candidate', 'frontier')"

#: Rule to what holds for a line that keeps it.
_LINES = {
    "known_type": "type <> 'other'",
    "schema": "schema = {schema}",
    "session_first": "(type = 'session') = (seq = 0)",
    "end_last": "(type = 'search_end') = (seq = last)",
    "session_options": "type <> 'session' OR e % 6 <> 0",
    "search_depth": "type <> 'search_start' OR depth >= 1",
    "round_depth": "type <> 'round_start' OR depth = round AND alpha < beta AND e % 59 <> 0",
    "attempt_line": "type <> 'attempt' OR {line}",
    "score_fields": f"NOT ({_SCORED}) OR CASE WHEN abs(raw) >= 32000 - 246 THEN cp IS NULL AND w3 IS NULL ELSE cp IS NOT NULL AND w3 = 100 END",
    "attempt_bound": "type <> 'attempt' OR bound = CASE WHEN raw <= alpha THEN 'upper' WHEN raw >= beta THEN 'lower' ELSE 'exact' END",
    "candidate_bound": "type <> 'candidate' OR bound = CASE WHEN raw <= alpha THEN 'upper' WHEN raw >= beta THEN 'lower' ELSE 'exact' END",
    "path_length": "type NOT IN ('candidate', 'frontier') OR ply = said",
    "candidate_move": "type <> 'candidate' OR own = move AND e % 41 <> 0",
    "narrow_window": "type <> 'candidate' OR call NOT IN ('probe', 'rescore') OR beta - alpha = 1",
    "line_of_play": "type <> 'candidate' OR CASE WHEN said = 1 AND call IN ('first', 'promote') THEN pv IS NOT NULL ELSE pv IS NULL END",
    "work": "type NOT IN ('candidate', 'frontier') OR e % 43 <> 0",
    "rank_width": "type <> 'round_end' OR CASE WHEN e % 5 = 0 THEN 1 ELSE 2 END = width",
    "rank_line": "type <> 'round_end' OR e % 5 = 0 OR line2 = r2",
    "end_work": "type <> 'search_end' OR e % 4 <> 0",
    "not_deeper": "type <> 'round_end' OR depth <= asked",
}


def _lines_sql(width: int) -> str:
    rules = {k: v.format(schema=3 if width == 1 else 4, line="line IS NULL" if width == 1 else "line BETWEEN 0 AND width - 1") for k, v in _LINES.items()}
    cases = ", ".join(f"CASE WHEN NOT coalesce({v}, false) THEN '{k}' END" for k, v in rules.items())
    return f"WITH {_log_sql(width)}, {_SESSIONS.format(width=width)} SELECT root_id AS id, rule, seq::VARCHAR AS detail FROM (SELECT root_id, seq, unnest([{cases}]) AS rule FROM k) WHERE rule IS NOT NULL"


@query(_lines_sql(1))
def log_line_rules(spark, sf_dir):
    return _rules(spark, sf_dir, 1, list(_LINES))


@query(_lines_sql(2))
def log_line_rules_wide(spark, sf_dir):
    return _rules(spark, sf_dir, 2, list(_LINES))


_OF = "rs AS (SELECT * FROM k WHERE type = 'round_start'), re AS (SELECT * FROM k WHERE type = 'round_end'), att AS (SELECT * FROM k WHERE type = 'attempt'), cand AS (SELECT * FROM k WHERE type = 'candidate'), fr AS (SELECT * FROM k WHERE type = 'frontier')"
_FRAME = ["seq_is_line", "rounds_contiguous", "attempts_contiguous", "one_session", "one_position", "one_search_start", "one_search_end", "attempt_round", "round_attempt", "round_end_start", "round_start_end", "after_round_end"]


def _gaps(name: str, source: str, keys: str, number: str, start: int) -> str:
    return f"""SELECT root_id AS id, '{name}' AS rule, lo || '-' || hi AS detail FROM (SELECT root_id, min({number}) AS lo, max({number}) AS hi, count(DISTINCT {number}) AS d, count(*) AS n FROM {source} GROUP BY {keys})
WHERE lo <> {start} OR hi <> {start} + d - 1 OR d <> n"""


def _lost(name: str, rows: str, parent: str, keys: list[str]) -> str:
    same = " AND ".join(f"p.{x} = x.{x}" for x in keys)
    detail = " || '/' || ".join(f"x.{x}::VARCHAR" for x in keys)
    return f"SELECT root_id AS id, '{name}' AS rule, {detail} AS detail FROM {rows} x WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE {same})"


@query(
    f"WITH {_log_sql(1)}, {_SESSIONS.format(width=1)}, {_OF}\n"
    + "\nUNION ALL ".join(
        [
            _gaps("seq_is_line", "k", "root_id", "seq", 0),
            _gaps("rounds_contiguous", "rs", "root_id", "round", 1),
            _gaps("attempts_contiguous", "att", "root_id, round", "attempt", 0),
            *(f"SELECT root_id, 'one_{t}', n::VARCHAR FROM (SELECT root_id, count(*) FILTER (WHERE type = '{t}') AS n FROM k GROUP BY root_id) WHERE n <> 1" for t in ("session", "position", "search_start", "search_end")),
            _lost("attempt_round", "att", "rs", ["root_id", "round"]),
            _lost("round_attempt", "rs", "att", ["root_id", "round"]),
            _lost("round_end_start", "re", "rs", ["root_id", "round", "depth"]),
            _lost("round_start_end", "rs", "re", ["root_id", "round", "depth"]),
            f"SELECT k.root_id, 'after_round_end', k.seq::VARCHAR FROM k JOIN re ON k.root_id = re.root_id AND k.round = re.round WHERE k.{_SCORED} AND k.seq > re.seq",
        ]
    )
)
def log_frame_rules(spark, sf_dir):
    """Frame, rounds and order of lines."""
    return _rules(spark, sf_dir, 1, _FRAME)


_KEPT = {
    1: "kept AS (SELECT * FROM att WHERE bound = 'exact')",
    2: "lines AS (SELECT root_id, round, line, count(*) FILTER (WHERE bound = 'exact') AS exact, max(attempt) AS final, max(attempt) FILTER (WHERE bound = 'exact') AS accepted FROM att GROUP BY ALL), kept AS (SELECT * FROM att WHERE EXISTS (SELECT 1 FROM lines l WHERE l.root_id = att.root_id AND l.round = att.round AND l.accepted = att.attempt))",
}
_RANK = "ranks AS (SELECT root_id, round, attempt, seq, 0 AS place, r1 AS move, s1 AS score, r1 AS pv FROM re UNION ALL SELECT root_id, round, attempt, seq, 1, r2, s2, line2 FROM re WHERE e % 5 <> 0)"


def _with(width: int) -> str:
    return f"WITH {_log_sql(width)}, {_SESSIONS.format(width=width)}, {_OF}, {_KEPT[width]}, {_RANK}\n"


_REFER = ["candidate_attempt", "frontier_attempt", "frontier_opening", "frontier_once"]


@query(
    _with(1)
    + "\nUNION ALL ".join(
        [
            *(_lost(f"{n}_attempt", x, "att", ["root_id", "round", "attempt"]) for x, n in (("cand", "candidate"), ("fr", "frontier"))),
            "SELECT root_id, 'frontier_opening', '' FROM fr WHERE NOT EXISTS (SELECT 1 FROM cand c WHERE c.call IN ('first', 'promote') AND c.root_id = fr.root_id AND c.round = fr.round AND c.attempt = fr.attempt AND c.path = fr.path AND c.raw = fr.raw AND c.bound = fr.bound)",
            "SELECT root_id, 'frontier_once', path FROM fr GROUP BY root_id, round, attempt, path HAVING count(*) > 1",
        ]
    )
)
def log_reference_rules(spark, sf_dir):
    """What candidates and frontiers refer to."""
    return _rules(spark, sf_dir, 1, _REFER)


_INSIDE = "inside AS (SELECT * FROM cand c WHERE said = 1 AND EXISTS (SELECT 1 FROM kept a WHERE a.root_id = c.root_id AND a.round = c.round AND a.attempt = c.attempt)), opened AS (SELECT * FROM inside WHERE call IN ('first', 'promote') AND bound = 'exact')"
_CALLED = "calls AS (SELECT root_id, round, move, arg_max(raw, seq) AS raw, arg_max(coalesce(pv, 'none'), seq) AS pv FROM opened GROUP BY ALL)"
_SCOUT = "scouts AS (SELECT root_id, round, attempt, move, arg_max(bound, seq) AS bound FROM inside WHERE call IN ('probe', 'rescore') GROUP BY ALL)"


def _accept_sql(width: int) -> str:
    own = {
        1: ["SELECT re.root_id AS id, 'one_exact_attempt' AS rule, re.round::VARCHAR AS detail FROM re LEFT JOIN (SELECT root_id, round, count(*) AS n, max(attempt) AS a FROM kept GROUP BY ALL) x USING (root_id, round) WHERE NOT coalesce(x.n = 1 AND x.a = re.attempt, false)"],
        2: [
            "SELECT root_id AS id, 'line_exact_once' AS rule, round || '/' || line AS detail FROM lines WHERE NOT coalesce(exact = 1 AND accepted = final, false)",
            "SELECT re.root_id, 'lines_complete', re.round::VARCHAR FROM re LEFT JOIN (SELECT root_id, round, count(*) AS n, max(line) AS top FROM lines GROUP BY ALL) x USING (root_id, round) WHERE NOT coalesce(x.n = re.width AND x.top = x.n - 1, false)",
            "SELECT re.root_id, 'attempts_counted', re.round::VARCHAR FROM re LEFT JOIN (SELECT root_id, round, count(*) AS n FROM att GROUP BY ALL) x USING (root_id, round) WHERE NOT coalesce(re.attempt = x.n, false)",
        ],
    }[width]
    rest = [
        "SELECT r.root_id, 'rank_top', r.round::VARCHAR FROM ranks r LEFT JOIN (SELECT root_id, round, max(raw) AS best FROM kept GROUP BY ALL) x USING (root_id, round) WHERE r.place = 0 AND NOT coalesce(r.score = x.best, false)",
        "SELECT r.root_id, 'rank_established', r.round || '/' || r.move FROM ranks r LEFT JOIN calls c USING (root_id, round, move) WHERE NOT coalesce(c.raw = -r.score AND c.pv = r.pv, false)",
        _lost("fail_high", "(SELECT * FROM scouts WHERE bound = 'upper')", "opened", ["root_id", "round", "attempt", "move"]),
    ]
    return _with(width).rstrip() + f", {_INSIDE}, {_CALLED}, {_SCOUT}\n" + "\nUNION ALL ".join([*own, *rest])


_ACCEPT = ["rank_top", "rank_established", "fail_high"]


@query(_accept_sql(1))
def log_acceptance_rules(spark, sf_dir):
    return _rules(spark, sf_dir, 1, ["one_exact_attempt", *_ACCEPT])


@query(_accept_sql(2))
def log_acceptance_rules_wide(spark, sf_dir):
    return _rules(spark, sf_dir, 2, ["line_exact_once", "lines_complete", "attempts_counted", *_ACCEPT])


@query(
    _with(2)
    + """SELECT root_id AS id, 'rank_order' AS rule, place::VARCHAR AS detail FROM (SELECT *, lag(score) OVER (PARTITION BY root_id, seq ORDER BY place) AS before FROM ranks) WHERE before < score
UNION ALL SELECT k.root_id, u.rule, k.r1 FROM k LEFT JOIN (SELECT root_id, arg_max(r1, (round, seq)) AS top, max(depth) AS deep FROM re GROUP BY root_id) b USING (root_id),
  (VALUES ('bestmove'), ('end_depth')) u(rule) WHERE k.type = 'search_end' AND NOT coalesce(CASE u.rule WHEN 'bestmove' THEN k.r1 = b.top ELSE k.depth = b.deep END, false)"""
)
def log_end_rules(spark, sf_dir):
    """How ranks fall, and what the end of a search says of its last round."""
    return _rules(spark, sf_dir, 2, ["rank_order", "bestmove", "end_depth"])


@query(
    _with(2).rstrip()
    + """, said AS (SELECT root_id, round, arg_max({'cp': cp, 'w3': w3}, (raw, -coalesce(line, 0), -seq)) AS a FROM kept GROUP BY ALL),
m AS (SELECT re.root_id, re.round, said.a, CASE WHEN e % 71 <> 0 THEN s1 END AS cp, CASE WHEN e % 67 = 0 THEN 101 ELSE 100 END AS w3 FROM re LEFT JOIN said USING (root_id, round))
SELECT root_id AS id, 'rank_score' AS rule, seq || '/' || place AS detail FROM re, (VALUES (0), (1)) p(place) WHERE (place = 0 OR e % 5 <> 0) AND (e % 71 = 0 OR e % 67 = 0)
UNION ALL SELECT root_id, 'rank_top_cp', round::VARCHAR FROM m WHERE a.cp IS NOT NULL AND NOT coalesce(cp = a.cp, false)
UNION ALL SELECT root_id, 'rank_top_wdl', round::VARCHAR FROM m WHERE a.w3 IS NOT NULL AND w3 <> a.w3"""
)
def log_rank_scores(spark, sf_dir):
    """The scores of a rank, and its first against what the round accepted."""
    return _rules(spark, sf_dir, 2, ["rank_score", "rank_top_cp", "rank_top_wdl"])


@query(
    f"WITH {_log_sql(1)}, c AS (SELECT *, CASE WHEN ply = 2 THEN 'x' ELSE '' END AS parent FROM g WHERE type = 'candidate') "
    "SELECT root_id, round, attempt, parent, move, min(seq) AS first_seq, arg_min(CASE WHEN e % 41 = 0 THEN 0 ELSE 1 END, seq)::INT AS \"order\", "
    "max(seq) FILTER (WHERE call IN ('first', 'promote') AND bound = 'exact') AS exact_seq, "
    "CASE WHEN count(*) FILTER (WHERE call IN ('first', 'promote') AND bound = 'exact') = 0 THEN max(seq) FILTER (WHERE call IN ('probe', 'rescore') AND bound = 'lower') END AS refuted_seq FROM c GROUP BY ALL"
)
def log_candidate_groups(spark, sf_dir):
    """What narration takes from each group of a round's candidates, and its order."""
    out = references.candidate_groups(logs(spark, sf_dir, 1))
    return out.select("root_id", "round", "attempt", F.array_join("parent", " ").alias("parent"), "move", "first_seq", "order", F.col("exact.seq").alias("exact_seq"), F.col("refuted.seq").alias("refuted_seq"))


@query(f"""
WITH {_log_sql(1)},
lg AS (SELECT root_id, max(CASE WHEN type = 'session' THEN CASE WHEN e % 6 = 0 THEN 2 ELSE 1 END END) AS threads, max(CASE WHEN type = 'search_start' THEN depth END) AS asked, max(CASE WHEN type = 'search_end' THEN depth END) AS reached, bool_or(type = 'session') AS opened FROM g GROUP BY root_id),
r AS (SELECT c_custkey AS root_id, c_custkey % 4 AS depth, CASE WHEN c_custkey % 9 = 0 THEN 2 ELSE 1 END AS width FROM customer),
m AS (SELECT r.*, lg.* EXCLUDE (root_id), lg.root_id IS NOT NULL AS known FROM r LEFT JOIN lg USING (root_id)),
v AS (SELECT root_id, depth || '/' || width AS detail, unnest(CASE WHEN depth < 1 THEN ['root_settings'] WHEN NOT known THEN ['has_log'] ELSE [
  CASE WHEN NOT opened THEN 'engine_name' END, CASE WHEN NOT opened THEN 'engine_constants' END, CASE WHEN NOT coalesce(threads = 1, false) THEN 'one_thread' END, CASE WHEN NOT opened THEN 'hash_size' END,
  CASE WHEN NOT coalesce(asked = depth, false) THEN 'depth_asked' END, CASE WHEN NOT coalesce(reached = depth, false) THEN 'depth_reached' END, CASE WHEN NOT opened OR width <> 1 THEN 'width_asked' END] END) AS rule FROM m)
SELECT root_id AS id, rule, detail FROM v WHERE rule IS NOT NULL
""")
def teacher_problems(spark, sf_dir):
    """Customers as roots that ask for a depth and a width; their logs are those of the users of the same number."""
    k = F.col("c_custkey")
    roots = table(spark, sf_dir, "customer").select(k.alias("root_id"), (k % 4).alias("depth"), F.when(k % 9 == 0, 2).otherwise(1).alias("teacher_width"))
    return references.teacher_problems(logs(spark, sf_dir, 1), roots, "x", 16, 32000, 246)
