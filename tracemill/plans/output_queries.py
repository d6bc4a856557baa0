"""Outputs written and read back: pools, evaluations, profiles, from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import draws
from ..operators.profiles import slices
from ..tables import positions, shared_folder, table
from . import outputs
from .corpus_queries import _SPLIT_SQL, _draw_sql
from .registry import registry

QUERIES, ORACLES, query = registry()


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/output-{uuid.uuid4().hex}"


@query(f"SELECT doc_id, lang, {_SPLIT_SQL} AS split, row_number() OVER (ORDER BY {_draw_sql(chr(39) + '640' + chr(39), 'doc_id', chr(39) + 'pool-order' + chr(39))}, doc_id) - 1 AS line FROM documents")
def pool_output(spark, sf_dir):
    """Documents as a pool in its seeded order, by the lines of the files that were written."""
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(d, "lang", draws.split_of(d).alias("split"), draws.draw("640", d, "pool-order").alias("_draw"))
    path = _folder(spark)
    outputs.write_pool(positions(rows, ["_draw", "doc_id"], "place").drop("_draw"), path, {"seed": "640"})
    if wrong := outputs.check(spark, path):
        raise ValueError(f"not what was written: {wrong}")
    return outputs.read_pool(spark, path).select("doc_id", "lang", "split", "line")


@query("""
WITH a AS (SELECT lang, b AS budget, (n_chars <= b)::INT AS end_found, coalesce(quality, 0) AS valid, CASE WHEN quality = 1 THEN n_chars - b END AS cp_loss FROM documents LEFT JOIN labels USING (doc_id), (SELECT unnest([512, 2048, 8192]) AS b)),
g AS (SELECT lang, budget::VARCHAR AS budget, * EXCLUDE (lang, budget) FROM a UNION ALL SELECT 'overall', 'overall', * EXCLUDE (lang, budget) FROM a)
SELECT lang, budget, count(*) AS n, round(avg(end_found), 6) AS end_found_rate, round(avg(valid), 6) AS valid_rate, count(cp_loss) AS cp_loss_count, round(avg(cp_loss), 6) AS cp_loss_mean FROM g GROUP BY lang, budget
""")
def evaluation_output(spark, sf_dir):
    """The summary that stands beside the written answers: overall, and by language and budget."""
    budgets = F.explode(F.array(F.lit(512), F.lit(2048), F.lit(8192))).alias("budget")
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("*", budgets)
    answers = rows.select("doc_id", "lang", "budget", (F.col("n_chars") <= F.col("budget")).cast("int").alias("end_found"), F.coalesce("quality", F.lit(0)).alias("valid"), F.when(F.col("quality") == 1, F.col("n_chars") - F.col("budget")).alias("cp_loss"))
    path = _folder(spark)
    outputs.write_evaluation(answers, path, ["lang", "budget"], {"budgets": [512, 2048, 8192]})
    if wrong := outputs.check(spark, path):
        raise ValueError(f"not what was written: {wrong}")
    return outputs.read(spark, path, "summary")


@query("""
WITH f AS (SELECT user_id, CASE WHEN event_id % 17 = 0 THEN '8/8/8 w' ELSE CASE WHEN event_id % 5 = 0 THEN '8/K7/8/8/8/8/8/8' ELSE '8/K7/8/8/8/8/k7/8' END || CASE WHEN event_id % 7 = 0 THEN ' x' ELSE ' w' END || ' - - ' || (event_id % 160) || CASE WHEN event_id % 13 = 0 THEN ' -1' ELSE ' 1' END END AS fen,
  event_id, event_id % 17 = 0 AS short, event_id % 7 AS rep FROM events),
v AS (SELECT event_id, fen, unnest([CASE WHEN short THEN 'fields' END, CASE WHEN NOT short AND event_id % 7 = 0 THEN 'side' END, CASE WHEN short OR event_id % 13 = 0 THEN 'counters' END, CASE WHEN short OR event_id % 5 = 0 THEN 'kings' END,
  CASE WHEN rep = 0 THEN 'repetition' END, CASE WHEN rep >= 5 OR (NOT short AND event_id % 160 >= 150) THEN 'over' END]) AS rule FROM f)
SELECT event_id AS id, rule, fen AS detail FROM v WHERE rule IS NOT NULL
""")
def unfit_roots(spark, sf_dir):
    """Positions that no evaluation takes, by their fields alone."""
    e = F.col("event_id")
    board = F.when(e % 5 == 0, "8/K7/8/8/8/8/8/8").otherwise("8/K7/8/8/8/8/k7/8")
    whole = F.concat(board, F.when(e % 7 == 0, " x").otherwise(" w"), F.lit(" - - "), (e % 160).cast("string"), F.when(e % 13 == 0, " -1").otherwise(" 1"))
    rows = table(spark, sf_dir, "events").select("event_id", F.when(e % 17 == 0, "8/8/8 w").otherwise(whole).alias("fen"), (e % 7).alias("repetition"))
    return outputs.unfit_roots(rows, "event_id")


_CURVE = """t AS (SELECT lang, source, n_chars, length(regexp_replace(text, '[^ ]', '', 'g')) + 1 AS words FROM documents WHERE text IS NOT NULL),
g AS (SELECT 'all' AS section, NULL AS value, n_chars, words FROM t UNION ALL SELECT 'lang', lang, n_chars, words FROM t UNION ALL SELECT 'source', source, n_chars, words FROM t)"""


@query(f"WITH {_CURVE} SELECT section, value, count(*) AS documents, sum(words)::BIGINT AS tokens, sum(n_chars)::BIGINT AS atoms, printf('%.2f%%', 100 * round(sum(words) / sum(n_chars), 6)) AS percent FROM g GROUP BY section, value")
def profile_output(spark, sf_dir):
    """The curve of a profile as it was stored: words to characters, by language and source."""
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("lang", "source", "n_chars", (F.length(F.regexp_replace("text", "[^ ]", "")) + 1).alias("words"))
    curve = slices(rows, ["lang", "source"], "words", "n_chars").select(F.lit(0).alias("size"), F.lit("measured").alias("part"), "*")
    path = _folder(spark)
    outputs.write_profile(curve, path, "Words", {})
    return outputs.read(spark, path, "curve").select("section", "value", "documents", "tokens", "atoms", "percent")
