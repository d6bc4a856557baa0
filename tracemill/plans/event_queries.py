"""Keyed deduplication, running champions, order statistics and logs over ``events`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import dedup, profiles, references
from ..tables import table
from .registry import registry

QUERIES, ORACLES, query = registry()

PERCENTS = [10, 90, 99]


def _events(spark, sf_dir):
    """Events with their value as a score of ten steps and as one in [-1, 1]."""
    df = table(spark, sf_dir, "events")
    return df.select("*", F.floor(F.col("value") / 10).cast("long").alias("score"), (F.col("value") - F.floor(F.col("value") / 2) * 2 - 1).alias("unit"))


_E = "e AS (SELECT *, floor(value / 10)::BIGINT AS score, value - floor(value / 2) * 2 - 1 AS unit FROM events)"


@query(f"""
WITH {_E}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY score DESC, ts, event_id) AS r FROM e)
SELECT user_id, event_type, score, event_id FROM r WHERE r = 1
""")
def keyed_dedup_best(spark, sf_dir):
    df = _events(spark, sf_dir).select("user_id", "event_type", "score", "ts", "event_id")
    return dedup.keep_best(df, ["user_id", "event_type"], "score", ["ts", "event_id"]).select("user_id", "event_type", "score", "event_id")


@query(f"""
WITH {_E}, m AS (SELECT *, max(score) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM e)
SELECT user_id, count(*) AS occurrences, count(*) FILTER (WHERE score > best) AS replacements, count(*) FILTER (WHERE score <= best) AS duplicates FROM m GROUP BY user_id
""")
def upsert_accounting(spark, sf_dir):
    return dedup.upsert_counts(_events(spark, sf_dir), ["user_id"], "score", ["ts", "event_id"])


@query("""
WITH r AS (SELECT event_id, row_number() OVER w AS occurrence, lead(1) OVER w IS NULL AS is_last FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
SELECT * FROM r WHERE occurrence < 5
""")
def running_occurrence(spark, sf_dir):
    """Occurrences of a key within its group; from the fifth on they are left out, before any merge of groups."""
    out = dedup.occurrences(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"])
    return out.where("occurrence < 5").select("event_id", F.col("occurrence").cast("long").alias("occurrence"), "is_last")


@query("""
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS k FROM events WHERE value IS NOT NULL)
SELECT user_id, count(*) AS n, min(value) AS min, max(value) FILTER (WHERE pos = k * 10 // 100) AS p10, max(value) FILTER (WHERE pos = k * 90 // 100) AS p90, max(value) FILTER (WHERE pos = k * 99 // 100) AS p99,
  (max(value) FILTER (WHERE pos = (k - 1) // 2) + max(value) FILTER (WHERE pos = k // 2)) / 2 AS median, max(value) AS max FROM r GROUP BY user_id
""")
def nearest_rank_percentiles(spark, sf_dir):
    return profiles.nearest_rank(table(spark, sf_dir, "events"), ["user_id"], "value", ["event_id"], PERCENTS).drop("mean")


@query("SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type")
def interp_percentiles(spark, sf_dir):
    out = profiles.interpolated(table(spark, sf_dir, "events"), ["event_type"], "value", ["event_id"], [10, 50, 90])
    return out.select("event_type", "n", *(F.round(p, 6).alias(p) for p in ("p10", "p50", "p90")))


@query(f"""
WITH {_E}, s AS (SELECT user_id, event_type, score - lag(score) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS d FROM e WHERE score IS NOT NULL)
SELECT user_id, event_type, CASE WHEN coalesce(min(d), 0) >= 0 AND coalesce(max(d), 0) <= 0 THEN 'flat' WHEN coalesce(min(d), 0) >= 0 THEN 'monotone_up' WHEN coalesce(max(d), 0) <= 0 THEN 'monotone_down' ELSE 'mixed' END AS shape
FROM s GROUP BY user_id, event_type
""")
def trajectory_shape(spark, sf_dir):
    df = _events(spark, sf_dir).where("score IS NOT NULL").withColumn("score", F.col("score").cast("double"))
    return profiles.shapes(df, ["user_id", "event_type"], ["ts", "event_id"], "score")


@query(f"""
WITH {_E}, n AS (SELECT *, row_number() OVER w AS k FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT *, arg_max(event_type, (score, -k)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS champion FROM n)
SELECT event_id, champion, coalesce(champion <> lag(champion) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS changed FROM c
""")
def champion_running(spark, sf_dir):
    out = profiles.running_champion(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "score", "event_type")
    return out.select("event_id", "champion", "changed")


@query("""
WITH n AS (SELECT user_id, event_type, row_number() OVER w AS k, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT user_id, count(*) AS rounds, count(DISTINCT event_type) AS champions, count(*) FILTER (WHERE event_type <> before) AS overturned, coalesce(max(k) FILTER (WHERE event_type <> before), 1) AS stable_since, arg_min(event_type, k) = arg_max(event_type, k) AS first_is_last FROM n GROUP BY user_id)
SELECT user_id, rounds, champions, overturned, stable_since, rounds - stable_since + 1 AS stable_tail, first_is_last FROM g
""")
def round_audit(spark, sf_dir):
    from pyspark.sql import Window

    df = table(spark, sf_dir, "events").withColumn("at", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return profiles.round_audit(df, ["user_id"], "at", "event_type")


@query("""
WITH g AS (SELECT conv_id, min(turn) AS lo, max(turn) AS hi, count(DISTINCT turn) AS k, count(*) AS n FROM conversations GROUP BY conv_id),
r AS (
  SELECT conv_id AS id, 'turns_contiguous' AS rule, lo || '-' || hi AS detail FROM g WHERE lo <> 0 OR hi <> k - 1 OR k <> n
  UNION ALL SELECT conv_id, 'role_known', turn::VARCHAR FROM conversations WHERE NOT coalesce(role IN ('user', 'assistant', 'system'), false)
  UNION ALL SELECT conv_id, 'text_present', turn::VARCHAR FROM conversations WHERE NOT coalesce(length(text) > 0, false)
  UNION ALL SELECT conv_id, 'text_short', turn::VARCHAR FROM conversations WHERE NOT coalesce(length(text) <= 200, false)
  UNION ALL SELECT conv_id, 'one_opening', n::VARCHAR FROM (SELECT conv_id, count(*) FILTER (WHERE turn = 0) AS n FROM conversations GROUP BY conv_id) WHERE n <> 1
)
SELECT * FROM r
""")
def conversation_rules(spark, sf_dir):
    """The log rules' building blocks over conversations: a row per rule broken."""
    df = table(spark, sf_dir, "conversations")
    rules = {"role_known": F.col("role").isin("user", "assistant", "system"), "text_present": F.length("text") > 0, "text_short": F.length("text") <= 200}
    out = references.violations(df, rules, "conv_id", F.col("turn"))
    return out.unionByName(references.contiguous(df, ["conv_id"], "turn", "conv_id", "turns_contiguous")).unionByName(references.exactly(df, ["conv_id"], F.col("turn") == 0, 1, "conv_id", "one_opening"))


@query("SELECT event_id, CASE WHEN unit BETWEEN -1 AND 1 THEN len(list_filter([" + ", ".join(map(repr, V.BOUNDS)) + f"], lambda b: b < unit)) END::INT AS bin FROM ({'WITH ' + _E + ' SELECT * FROM e'})")
def value_bin(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", V.value_bin(F.col("unit")).alias("bin"))


@query(f"WITH {_E} SELECT event_id, least(28, greatest(-30, score - 40))::BIGINT AS capped, CASE WHEN score >= 40 THEN 2938 + least(score - 40, 28) ELSE 2967 + least(40 - score, 30) END::BIGINT AS token FROM e")
def mate_tokens(spark, sf_dir):
    d = F.col("score") - 40
    return _events(spark, sf_dir).select("event_id", V.capped_mate(d).alias("capped"), V.mate_token(F.abs(d), d >= 0).cast("long").alias("token"))


@query(f"""
WITH {_E} SELECT event_id, CASE WHEN event_id % 3 = 1 THEN -unit ELSE unit END AS seen, CASE WHEN unit <= -0.5 THEN 'upper' WHEN unit >= 0.5 THEN 'lower' ELSE 'exact' END AS bound,
  'value:' || CASE WHEN unit >= 0 THEN '+' ELSE '' END || printf('%.3f', unit) AS written FROM e
""")
def value_views(spark, sf_dir):
    df = _events(spark, sf_dir)
    return df.select("event_id", V.root_view(F.col("unit"), F.col("event_id") % 3).alias("seen"), V.bound(F.col("unit"), F.lit(-0.5), F.lit(0.5)).alias("bound"), V.signed_text(F.col("unit")).alias("written"))


@query(f"""
WITH {_E}, b AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY score DESC) AS r, count(*) OVER (PARTITION BY user_id) AS n, max(score) OVER (PARTITION BY user_id) AS best FROM e)
SELECT event_id, r AS move_rank, round((r - 1) / greatest(n - 1, 1), 9) AS fraction, r = 1 AS best_move, best - score AS cp_loss FROM b
""")
def move_rank(spark, sf_dir):
    from ..operators import evaluation

    df = _events(spark, sf_dir).select(F.col("user_id").alias("position"), F.col("event_id").alias("move"), F.col("score").alias("cp"), F.lit(None).cast("long").alias("mate"), F.col("unit").alias("value"))
    out = evaluation.move_ranks(df)
    return out.select(F.col("move").alias("event_id"), F.col("move_rank").cast("long").alias("move_rank"), F.round("move_rank_fraction", 9).alias("fraction"), "best_move", "cp_loss")


_PROPS = "SELECT event_id, json_keys(props::JSON) AS k, props::JSON AS j FROM events WHERE props IS NOT NULL"


@query(f"SELECT event_id, array_to_string(list_transform(list_sort(k), lambda x: x || '=' || coalesce(json_extract_string(j, x), 'null')), ';') AS pairs FROM ({_PROPS})")
def json_provenance(spark, sf_dir):
    """A JSON object's fields by key, as provenance is stored: parsed, sorted, written again."""
    df = table(spark, sf_dir, "events").where("props IS NOT NULL")
    entries = F.array_sort(F.map_entries(F.from_json("props", "map<string,string>")))
    return df.select("event_id", F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], F.coalesce(e["value"], F.lit("null")))), ";").alias("pairs"))


@query("""
WITH c AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'click'), o AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase')
SELECT c.event_id, strftime(min(o.ts), '%Y-%m-%d %H:%M:%S.%f') AS next_at FROM c LEFT JOIN o ON c.user_id = o.user_id AND o.ts >= c.ts GROUP BY c.event_id
""")
def first_boundary_after(spark, sf_dir):
    """As-of, forward: each click's first purchase at or after it, by one window over both kinds of rows."""
    from ..operators.asof import first_at_or_after

    df = table(spark, sf_dir, "events")
    side = lambda kind: df.where(F.col("event_type") == kind).select("user_id", "event_id", "ts")
    out = first_at_or_after(side("click"), side("purchase").select("user_id", "ts"), ["user_id"], "ts")
    return out.select("event_id", F.date_format("found", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("next_at"))
