"""Rounds, releases and presentations over tables made from ``events`` and ``documents``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import draws, positions
from ..functions import values as V
from ..functions.vocabulary import CONTROL, names, token_name
from ..operators import asof, providers, rounds, sampling
from ..tables import table
from . import releases
from .corpus_queries import _DOCS, _draw_sql, _stream
from .registry import registry

QUERIES, ORACLES, query = registry()

_SEQ = "s AS (SELECT user_id, event_id, event_type, floor(value / 10)::BIGINT AS raw, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events WHERE value IS NOT NULL)"
_KIND = "CASE WHEN seq % 6 = 0 THEN 'begin' WHEN seq % 6 = 5 THEN 'end' ELSE 'exact' END"


def _steps(spark, sf_dir):
    """A user's events as steps, six to a round: its begin, four exact scores of moves, its end."""
    df = table(spark, sf_dir, "events").where("value IS NOT NULL")
    df = df.selectExpr("user_id", "event_id", "event_type AS move", "cast(floor(value / 10) as bigint) AS raw", "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq")
    return df.select("*", F.expr(_KIND).alias("kind"), F.expr("cast(1 + floor(seq / 6) as bigint)").alias("round"), F.col("event_id").alias("value"))


@query(f"""
WITH RECURSIVE {_SEQ}, k AS (SELECT *, {_KIND} AS kind, (1 + seq // 6)::BIGINT AS round FROM s),
x AS (SELECT a.user_id, a.round, a.seq, b.event_type AS move, arg_max(b.raw, b.seq) AS raw, arg_max(b.event_id, b.seq) AS value, min(b.seq) AS first FROM k a JOIN k b ON a.user_id = b.user_id AND a.round = b.round AND b.seq <= a.seq WHERE a.kind = 'exact' AND b.kind = 'exact' GROUP BY ALL),
led AS (SELECT user_id, round, seq, arg_max({{'m': move, 'v': value, 'r': raw}}, (raw, -first)) AS c FROM x GROUP BY ALL),
e AS (SELECT k.user_id, k.round, k.seq, k.event_type AS move, k.raw, k.event_id AS value, last_in.c AS c FROM k LEFT JOIN (SELECT user_id, round, arg_max(c, seq) AS c FROM led GROUP BY ALL) last_in USING (user_id, round) WHERE k.kind = 'end'),
done AS (SELECT user_id, round, CASE WHEN raw > c.r THEN move ELSE c.m END AS best, value FROM e)
SELECT k.user_id, k.seq, CASE k.kind WHEN 'exact' THEN led.c.m WHEN 'end' THEN now.best ELSE was.best END AS best, CASE k.kind WHEN 'exact' THEN led.c.v WHEN 'end' THEN now.value ELSE was.value END::DOUBLE AS value, k.round
FROM k LEFT JOIN led USING (user_id, round, seq) LEFT JOIN done now ON now.user_id = k.user_id AND now.round = k.round LEFT JOIN done was ON was.user_id = k.user_id AND was.round = k.round - 1
""")
def boundary_champions(spark, sf_dir):
    """What a trace shows at each of its boundaries."""
    return rounds.boundary_champions(_steps(spark, sf_dir), "user_id")


_ROUNDS = "r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS round, event_type AS champion, floor(value / 100)::BIGINT AS value, event_id % 4 AS refutations FROM events)"
_FACTS = """c AS (SELECT *, coalesce(lag(champion) OVER w <> champion, false) AS changed FROM r WINDOW w AS (PARTITION BY user_id ORDER BY round)),
d AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY round) AS d FROM r WHERE value IS NOT NULL),
shape AS (SELECT user_id, CASE WHEN coalesce(min(d), 0) >= 0 AND coalesce(max(d), 0) <= 0 THEN 'flat' WHEN coalesce(min(d), 0) >= 0 THEN 'monotone_up' WHEN coalesce(max(d), 0) <= 0 THEN 'monotone_down' ELSE 'mixed' END AS shape FROM d GROUP BY user_id),
f AS (SELECT user_id, count(*) AS rounds, count(*) FILTER (WHERE changed) AS overturned_rounds, coalesce(max(round) FILTER (WHERE changed), 1) AS converged_depth, arg_min(champion, round) = arg_max(champion, round) AS first_is_last,
  sum(refutations)::BIGINT AS refutations FROM c GROUP BY user_id),
g AS (SELECT f.*, coalesce(shape, 'mate_only') AS value_shape FROM f LEFT JOIN shape USING (user_id))"""


def _rounds(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(
        "user_id", "cast(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) as bigint) AS round", "event_type AS champion", "cast(floor(value / 100) as bigint) AS value", "event_id % 4 AS refutations"
    )


@query(f"WITH {_ROUNDS}, {_FACTS} SELECT user_id, rounds, overturned_rounds, converged_depth, first_is_last, refutations, value_shape FROM g")
def release_root_facts(spark, sf_dir):
    return rounds.root_facts(_rounds(spark, sf_dir), "user_id")


@query(f"""
WITH {_ROUNDS}, {_FACTS} SELECT count(*) AS roots, sum(rounds)::BIGINT AS rounds, sum(overturned_rounds)::BIGINT AS overturned_rounds, round(sum(overturned_rounds) / sum(greatest(rounds - 1, 0)), 9) AS overturn_rate,
  count(*) FILTER (WHERE overturned_rounds > 0) AS roots_with_overturn, sum(refutations)::BIGINT AS refutations, round(sum(refutations) / sum(rounds), 9) AS refutations_per_round, count(*) FILTER (WHERE first_is_last) AS first_round_matches_final FROM g
""")
def release_summary(spark, sf_dir):
    out = rounds.release_summary(rounds.root_facts(_rounds(spark, sf_dir), "user_id"))
    return out.withColumns({c: F.round(c, 9) for c in ("overturn_rate", "refutations_per_round")})


@query(f"""
WITH {_ROUNDS}, {_FACTS} SELECT 'rounds' AS section, rounds::VARCHAR AS value, count(*) AS n FROM g GROUP BY ALL UNION ALL SELECT 'converged_depth', converged_depth::VARCHAR, count(*) FROM g GROUP BY ALL
UNION ALL SELECT 'value_shape', value_shape, count(*) FROM g GROUP BY ALL UNION ALL SELECT 'refutations_per_round', refutations::VARCHAR, count(*) FROM r GROUP BY ALL
""")
def release_histograms(spark, sf_dir):
    df = _rounds(spark, sf_dir)
    return rounds.release_histograms(rounds.root_facts(df, "user_id"), df)


_U = f"{_draw_sql(chr(39) + '640' + chr(39), 'doc_id', chr(39) + 'random' + chr(39))} / {float(1 << 60)!r}"


@query(f"""
WITH {_DOCS}, t AS (SELECT doc_id, list_concat(list_transform(atoms, lambda x: CASE WHEN x % 10 = 0 THEN {CONTROL["depth"]} ELSE x END), [{CONTROL["final"]}, 1, 2]) AS tokens, len(atoms) AS n, {_U} AS u FROM a WHERE len(atoms) > 0),
b AS (SELECT *, list_distinct(list_append(list_filter(range(1, n), lambda i: tokens[i] % 3 = 0), n)) AS unsorted, greatest(1, least(ceil(0.1 * n), n)) AS lo FROM t),
e AS (SELECT *, list_sort(unsorted) AS ends, greatest(lo, least(floor(0.9 * n), n)) AS hi FROM b),
g AS (SELECT *, (lo + floor(u * (hi - lo + 1)))::INT AS target FROM e),
p AS (
  SELECT *, 'zero' AS presentation, 0::BIGINT AS cut FROM g UNION ALL SELECT *, 'full', n FROM g
  UNION ALL SELECT *, 'random', coalesce(list_min(list_filter(ends, lambda x: x >= target)), ends[-1]) FROM g
)
SELECT doc_id, presentation, cut::INT AS cut, (CASE presentation WHEN 'full' THEN len(ends) WHEN 'zero' THEN 0 ELSE len(list_filter(ends, lambda x: x <= cut)) END)::INT AS shown,
  len(list_filter(tokens[1:cut], lambda x: x = {CONTROL["depth"]}))::INT AS depth, md5(array_to_string(list_concat(tokens[1:cut], tokens[n + 1:]), ' ')) AS tokens_md5 FROM p
""")
def presentation_rows(spark, sf_dir):
    """A document's words as a trace, its label behind it, with a boundary behind every third token."""
    df = _stream(spark, sf_dir).where(F.size("atoms") > 0)
    label = F.array(*(F.lit(x) for x in (CONTROL["final"], 1, 2)))
    df = df.select("doc_id", F.size("atoms").alias("final_start"), F.concat(F.transform("atoms", lambda t: F.when(t % 10 == 0, CONTROL["depth"]).otherwise(t)), label).alias("trace"))
    inner = F.filter(F.sequence(F.lit(1), F.col("final_start")), lambda i: (F.element_at("trace", i) % 3 == 0) | (i == F.col("final_start")))
    out = rounds.presentations(df.withColumn("ends", inner), "trace", "ends", draws.uniform("640", F.col("doc_id"), "random"), 0.1, 0.9)
    return out.select("doc_id", "presentation", "cut", "shown", "depth", F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


_MATE = "abs(raw) >= 32000 - 246"


@query(f"""
WITH v AS (SELECT event_id, event_id % 22 - 1 AS bin, CASE event_id % 3 WHEN 0 THEN 32000 - event_id % 260 WHEN 1 THEN -32000 + event_id % 260 ELSE event_id % 500 END AS raw, event_id % 1001 AS w, event_id * 7 % 1001 AS d FROM events)
SELECT event_id, bin, CASE WHEN bin BETWEEN 0 AND 19 THEN ([{", ".join(map(repr, V.MEANS))}]::DOUBLE[])[bin + 1] END AS mean, {_MATE} AS is_mate,
  (CASE WHEN {_MATE} THEN CASE WHEN raw > 0 THEN (32000 - raw + 1) // 2 ELSE -((32000 + raw) // 2) END END)::INT AS moves, round((w - (1000 - w - d)) / 1000.0, 9) AS outcome, 1000 - w - d BETWEEN 0 AND 1000 AND w BETWEEN 0 AND 1000 AND d BETWEEN 0 AND 1000 AS sound FROM v
""")
def value_tables(spark, sf_dir):
    """Means of bins, mates from raw scores, outcomes from per-mille triples."""
    e = F.col("event_id")
    raw = F.when(e % 3 == 0, 32000 - e % 260).when(e % 3 == 1, -32000 + e % 260).otherwise(e % 500)
    w, d = e % 1001, e * 7 % 1001
    triple = F.array(w, d, 1000 - w - d)
    df = table(spark, sf_dir, "events").select("event_id", (e % 22 - 1).alias("bin"), raw.alias("raw"), triple.alias("wdl"))
    vm, mp = F.lit(32000), F.lit(246)
    number = F.when(F.col("bin") >= 0, F.col("bin"))
    return df.select("event_id", "bin", V.bin_value(number).alias("mean"), V.is_mate(F.col("raw"), vm, mp).alias("is_mate"), V.mate_moves(F.col("raw"), vm, mp).alias("moves"), F.round(V.outcome_value(F.col("wdl")), 9).alias("outcome"), V.wdl_is_sound(F.col("wdl")).alias("sound"))


_FEN = "'8/8/' || (event_id % 7)::VARCHAR || ' ' || CASE WHEN event_id % 2 = 0 THEN 'w' ELSE 'b' END || ' KQ - ' || (event_id % 120)::VARCHAR || ' ' || (event_id % 90 + 1)::VARCHAR"


@query(f"""
WITH f AS (SELECT event_id, {_FEN} AS fen, 1 + event_id % 4 AS rep FROM events)
SELECT event_id, array_to_string(string_split(fen, ' ')[1:4], ' ') AS position_key, fen || '|' || rep AS root_id, CASE WHEN string_split(fen, ' ')[2] = 'w' THEN 'white' ELSE 'black' END AS turn, string_split(fen, ' ')[6] AS fullmove, 'W' || rep || '/D' || event_id % 30 AS search FROM f
""")
def position_fields(spark, sf_dir):
    e = F.col("event_id")
    fen = F.concat(F.lit("8/8/"), (e % 7).cast("string"), F.when(e % 2 == 0, " w").otherwise(" b"), F.lit(" KQ - "), (e % 120).cast("string"), F.lit(" "), (e % 90 + 1).cast("string"))
    df = table(spark, sf_dir, "events").select("event_id", fen.alias("fen"), (1 + e % 4).alias("rep"))
    f = F.col("fen")
    return df.select(
        "event_id", positions.position_key(f).alias("position_key"), positions.root_id(f, F.col("rep")).alias("root_id"), positions.turn(f).alias("turn"), positions.field(f, 5).alias("fullmove"), positions.search_label(F.col("rep"), e % 30).alias("search")
    )


@query("SELECT event_id, [" + ", ".join(f"'{n}'" for n in names()) + "][event_id % 3100 + 1] AS name FROM events")
def token_names(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", token_name((F.col("event_id") % 3100).cast("int")).alias("name"))


@query("""
WITH c AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'click'), o AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase')
SELECT c.event_id, strftime(max(o.ts), '%Y-%m-%d %H:%M:%S.%f') AS last_at FROM c LEFT JOIN o ON c.user_id = o.user_id AND o.ts <= c.ts GROUP BY c.event_id
""")
def last_boundary_before(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    side = lambda kind: df.where(F.col("event_type") == kind).select("user_id", "event_id", "ts")
    out = asof.last_at_or_before(side("click"), side("purchase").select("user_id", "ts"), ["user_id"], "ts")
    return out.select("event_id", F.date_format("found", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_at"))


@query("""
WITH a AS (SELECT event_id // 4 AS root_id, CASE WHEN event_type = 'purchase' THEN 'done' WHEN event_type = 'click' THEN 'running' ELSE 'failed' END AS outcome FROM events)
SELECT root_id, CASE WHEN count(*) FILTER (WHERE outcome = 'done') > 0 THEN 'done' WHEN count(*) FILTER (WHERE outcome = 'failed') >= 3 THEN 'drop' ELSE 'retry' END AS next FROM a GROUP BY root_id
""")
def root_attempts(spark, sf_dir):
    """What a run does with each root after the attempts so far."""
    outcome = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "click", "running").otherwise("failed")
    return releases.attempts(table(spark, sf_dir, "events").select(F.expr("event_id div 4").alias("root_id"), outcome.alias("outcome")))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_nationkey <> 7")
def unpublished_roots(spark, sf_dir):
    """Roots that are neither in a release nor given up, in whole tables."""
    roots = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("root_id"))
    published = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("root_id"))
    dropped = table(spark, sf_dir, "customer").where("c_nationkey = 7").select(F.col("c_custkey").alias("root_id"))
    return releases.unpublished(roots, published, dropped).select(F.col("root_id").alias("c_custkey"))


@query(f"""
WITH p AS (SELECT DISTINCT coalesce(source, '') AS source FROM documents), r AS (SELECT source, row_number() OVER (ORDER BY {_draw_sql("'640'", 'source')}, source) AS r FROM p)
SELECT doc_id, source FROM documents JOIN r ON coalesce(documents.source, '') = r.source WHERE r <= 5
""".replace("SELECT doc_id, source FROM", "SELECT doc_id, documents.source FROM"))
def subsampled_roots(spark, sf_dir):
    """All rows of the few positions that a draw picks: the operator's own limit."""
    df = table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("source", F.lit("")).alias("_p"))
    picked = sampling.smallest(df.select("_p").distinct().withColumn("_d", draws.draw("640", F.col("_p"))), 5, "_d", "_p")
    return df.join(picked.select("_p"), "_p", "left_semi").select("doc_id", "source")


_ROW = """rel AS (SELECT o_orderkey AS root_id, 'b ' || CASE WHEN o_custkey % 2 = 0 THEN 'w' ELSE 'b' END || ' - - 0 1' AS fen, CASE WHEN o_custkey % 14 < 12 THEN CASE WHEN o_custkey % 2 = 0 THEN 'white' ELSE 'black' END ELSE 'white' END AS turn,
  o_custkey % 6 AS repetition, CASE o_orderstatus WHEN 'F' THEN 'full' WHEN 'O' THEN 'zero' ELSE 'part' END AS presentation, (o_totalprice / 300000 - 0.3)::DOUBLE AS final_value, 1 + o_custkey % 4 AS n, 1 + o_custkey % 5 AS stated, CASE WHEN o_custkey % 11 = 0 THEN 3006 ELSE 5 END AS token,
  o_custkey % 3 AS states, o_custkey % 7 % 3 AS state_values, CASE WHEN o_custkey % 10 = 0 THEN 'val' ELSE 'train' END AS split FROM orders)"""


def _release(spark, sf_dir):
    c = F.col("o_custkey")
    side = F.when(c % 2 == 0, "w").otherwise("b")
    color = F.when(c % 2 == 0, "white").otherwise("black")
    filled = lambda x, n: F.array_repeat(F.lit(x), n.cast("int"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("root_id"),
        F.concat(F.lit("b "), side, F.lit(" - - 0 1")).alias("fen"),
        F.when(c % 14 < 12, color).otherwise("white").alias("turn"),
        (c % 6).alias("repetition"),
        F.when(F.col("o_orderstatus") == "F", "full").when(F.col("o_orderstatus") == "O", "zero").otherwise("part").alias("presentation"),
        (F.col("o_totalprice") / 300000 - 0.3).cast("double").alias("final_value"),
        F.array_repeat(F.when(c % 11 == 0, 3006).otherwise(5), (1 + c % 4).cast("int")).alias("trace_atom_ids"),
        (1 + c % 5).alias("trace_atom_count"),
        filled(1, c % 3).alias("state_best"),
        filled(1, c % 7 % 3).alias("state_value"),
        F.when(c % 10 == 0, "val").otherwise("train").alias("split"),
    )


@query(f"""
WITH {_ROW}, roots AS (SELECT o_orderkey AS root_id, 'b w - - 0 1' AS fen, CASE WHEN o_custkey % 10 = 0 THEN 'val' ELSE 'train' END AS split FROM orders WHERE o_orderpriority <> '1-URGENT'),
rules AS (SELECT root_id, presentation, unnest([
  CASE WHEN NOT (n = stated AND token < 3006) THEN 'atoms' END, CASE WHEN states <> state_values THEN 'states' END, CASE WHEN repetition NOT BETWEEN 1 AND 4 THEN 'repetition' END,
  CASE WHEN turn <> CASE WHEN fen LIKE 'b w%' THEN 'white' ELSE 'black' END THEN 'turn' END, CASE WHEN final_value NOT BETWEEN -1 AND 1 THEN 'final_value' END, CASE WHEN presentation = 'part' THEN 'presentation' END]) AS rule FROM rel)
SELECT root_id AS id, rule, presentation AS detail FROM rules WHERE rule IS NOT NULL
UNION ALL SELECT root_id, 'dropped_and_published', '' FROM rel WHERE presentation = 'part'
UNION ALL SELECT root_id, CASE WHEN r.fen IS NULL THEN 'unselected' ELSE 'changed' END, '' FROM rel LEFT JOIN roots r USING (root_id) WHERE r.fen IS NULL OR r.fen <> rel.fen OR r.split <> rel.split
""")
def release_problems(spark, sf_dir):
    """A release of orders against roots that lack the urgent ones, orders in progress being given up."""
    rows = _release(spark, sf_dir)
    orders = table(spark, sf_dir, "orders")
    roots = orders.where("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("root_id"), F.lit("b w - - 0 1").alias("fen"), F.when(F.col("o_custkey") % 10 == 0, "val").otherwise("train").alias("split"))
    dropped = rows.where("presentation = 'part'").select("root_id")
    out = releases.problems(rows, roots, dropped)
    return out.select("id", "rule", F.coalesce("detail", F.lit("")).alias("detail"))


@query(f"""
WITH {_ROW}, champ AS (SELECT l_orderkey AS root_id, max(l_linenumber) AS depth FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_orderkey),
m AS (SELECT root_id, split, presentation, CASE WHEN u < 0.1 THEN 'zero' WHEN u < 0.6 THEN 'full' ELSE 'random' END AS drawn FROM (SELECT *, {_draw_sql("'640'", 'root_id', "'presentation'")} / {float(1 << 60)!r} AS u FROM rel))
SELECT root_id AS id, 'presentation_drawn' AS rule, drawn AS detail FROM m WHERE presentation <> drawn
UNION ALL SELECT root_id, 'split_drawn', split FROM m WHERE split <> CASE WHEN {_draw_sql("'split'", 'root_id')} % 65 = 0 THEN 'val' ELSE 'train' END
UNION ALL SELECT coalesce(m.root_id, champ.root_id), CASE WHEN m.root_id IS NULL THEN 'no_row' ELSE 'no_champion' END, '' FROM m FULL JOIN champ ON m.root_id = champ.root_id WHERE m.root_id IS NULL OR champ.root_id IS NULL
""")
def release_settings(spark, sf_dir):
    """Settings that follow from the seed, worked out again, and rows against champions one to one."""
    rows = _release(spark, sf_dir)
    champions = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("root_id")).agg(F.max("l_linenumber").alias("depth"))
    return releases.settings_problems(rows, "640", [("zero", 0.1), ("full", 0.5), ("random", 0.4)]).unionByName(releases.unmatched(rows, champions))


_SEARCHES = [(1, 6, 0.25), (4, 8, 0.25), ("full", 3, 0.5)]
_ROLL = f"{_draw_sql(chr(39) + '640' + chr(39), 'root_id', chr(39) + 'search' + chr(39))} / {float(1 << 60)!r}"
_DRAWN = f"""t AS (SELECT o_orderkey AS root_id, 1 + o_custkey % 40 AS legal, o_custkey AS c FROM orders), u AS (SELECT *, {_ROLL} AS u, {_ROLL.replace("'search'", "'presentation'")} AS v FROM t),
w AS (SELECT *, CASE WHEN u < 0.25 THEN 1 WHEN u < 0.5 THEN 4 ELSE legal END AS width, CASE WHEN u < 0.25 THEN 6 WHEN u < 0.5 THEN 8 ELSE 3 END AS depth, CASE WHEN v < 0.1 THEN 'zero' WHEN v < 0.6 THEN 'full' ELSE 'random' END AS presentation FROM u)"""
_MIX = [("zero", 0.1), ("full", 0.5), ("random", 0.4)]


def _settings(spark, sf_dir):
    roots = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("root_id"), (1 + F.col("o_custkey") % 40).cast("int").alias("legal_width"), F.col("o_custkey").alias("c"))
    return releases.root_settings(roots, "640", _SEARCHES, _MIX)


@query(f"WITH {_DRAWN} SELECT root_id, depth, width AS teacher_width, least(width, legal) AS effective_width, presentation FROM w")
def root_settings(spark, sf_dir):
    """What is drawn for each root: how wide and deep to search it, and how to show it."""
    return _settings(spark, sf_dir).select("root_id", "depth", "teacher_width", "effective_width", "presentation")


@query(f"""
WITH {_DRAWN} SELECT root_id AS id, 'width_drawn' AS rule, width::VARCHAR AS detail FROM w WHERE c % 11 = 0 AND width <> 1 UNION ALL SELECT root_id, 'depth_drawn', depth::VARCHAR FROM w WHERE c % 13 = 0
UNION ALL SELECT root_id, 'presentation_drawn', presentation FROM w WHERE c % 17 = 0 AND presentation <> 'zero'
""")
def search_settings(spark, sf_dir):
    """Rows whose width, depth or presentation is another than was drawn."""
    c = F.col("c")
    kept = {"teacher_width": F.when(c % 11 == 0, 1).otherwise(F.col("teacher_width")), "teacher_depth": F.when(c % 13 == 0, 9).otherwise(F.col("depth")), "presentation": F.when(c % 17 == 0, "zero").otherwise(F.col("presentation"))}
    rows = _settings(spark, sf_dir).withColumns(kept | {"split": draws.split_of(F.col("root_id"))})
    return releases.settings_problems(rows, "640", _MIX, _SEARCHES)


_OWN = f"SELECT doc_id, CASE WHEN {_draw_sql(chr(39) + 'split' + chr(39), 'doc_id')} % 65 = 0 THEN 'val' ELSE 'train' END AS split, ({_draw_sql(chr(39) + 'shard' + chr(39), 'doc_id')} % 8)::INT AS shard, n_chars FROM documents"


def _published(spark, sf_dir):
    """Documents published by three writers: two at their own shards, one that replaces a shard of the first with
    what is there and is refused another time; a fourth one is killed before its commit and recovered."""
    from ..tables import shared_folder
    from . import commits

    path = f"{shared_folder(spark)}/release-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars", draws.split_of(F.col("doc_id")).alias("split"), (draws.draw("shard", F.col("doc_id")) % 8).cast("int").alias("shard"))
    every = [(s, k) for s in ("train", "val") for k in range(8)]
    totals = {"n_chars": F.sum("n_chars"), "long": F.count_if(F.col("n_chars") >= 1000)}

    def own(covers):
        return rows.where(F.concat_ws("/", "split", "shard").isin([f"{s}/{k}" for s, k in covers]))

    staged = [commits.stage(own(c), path, c, {"seed": 640}, ["doc_id"], totals) for c in (every[:6], every[6:12], every[:2])]
    commits.stage(own(every[12:]), path, every[12:], {"seed": 640}, ["doc_id"], totals)  # killed here
    for writer in staged[:2]:
        commits.commit(spark, path, writer)
    try:
        commits.commit(spark, path, staged[2])
    except commits.Conflict:  # the shards have an owner
        pass
    commits.recover(spark, path)
    return commits, path


@query(_OWN)
def published_release(spark, sf_dir):
    """What readers of the newest version see."""
    commits, path = _published(spark, sf_dir)
    return commits.read(spark, path).select("doc_id", "split", "shard", "n_chars")


@query(f"""
WITH r AS ({_OWN}), s AS (SELECT split || '/' || shard AS what, count(*) AS n FROM r GROUP BY ALL)
SELECT 'shard' AS section, w.split || '/' || k AS what, coalesce(n, 0)::BIGINT AS n FROM (VALUES ('train'), ('val')) w(split), range(8) x(k) LEFT JOIN s ON s.what = w.split || '/' || k
UNION ALL SELECT 'total', 'n_rows', count(*) FROM r UNION ALL SELECT 'total', 'n_chars', sum(n_chars)::BIGINT FROM r UNION ALL SELECT 'total', 'long', count(*) FILTER (WHERE n_chars >= 1000) FROM r
""")
def release_validation(spark, sf_dir):
    """The roll-up that the writers gathered on their way, stored and read back; SQL scans for it."""
    commits, path = _published(spark, sf_dir)
    commits.write_validation(spark, path)
    back = spark.read.json(f"{path}/validation", schema="shards map<string,long>, totals map<string,long>")
    return back.select(F.lit("shard").alias("section"), F.explode("shards").alias("what", "n")).unionByName(back.select(F.lit("total").alias("section"), F.explode("totals").alias("what", "n")))


_LOGS = "l AS (SELECT user_id AS root_id, count(*) AS lines, arg_min(event_type, (ts, event_id)) AS \"first\", arg_max(event_type, (ts, event_id)) AS \"last\", md5(string_agg(event_type || ':' || event_id, ',' ORDER BY ts, event_id)) AS digest FROM events WHERE user_id % 11 <> 0 GROUP BY user_id), r AS (SELECT DISTINCT user_id AS root_id FROM events WHERE user_id % 7 <> 0)"


def _provided(spark, sf_dir):
    """Users as roots but for every seventh; a provider makes their logs but for every eleventh."""
    events = table(spark, sf_dir, "events")
    rows = events.where("user_id % 11 <> 0").selectExpr("user_id AS root_id", "ts", "event_id AS seq", "event_type AS type")
    logs = providers.provided(rows, "root_id", ["ts", "seq"])
    return providers.matched(events.where("user_id % 7 <> 0").select(F.col("user_id").alias("root_id")).distinct(), logs, "root_id")


@query(f"WITH {_LOGS} SELECT l.* FROM l JOIN r USING (root_id)")
def provided_logs(spark, sf_dir):
    return _provided(spark, sf_dir)[0]


@query(f"WITH {_LOGS} SELECT root_id AS id, CASE WHEN l.lines IS NULL THEN 'no_log' ELSE 'no_root' END AS rule FROM r FULL JOIN (SELECT root_id, lines FROM l) l USING (root_id) LEFT JOIN r r2 USING (root_id) WHERE l.lines IS NULL OR r2.root_id IS NULL")
def provider_problems(spark, sf_dir):
    return _provided(spark, sf_dir)[1]
