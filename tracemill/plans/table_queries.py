"""Joins, buckets, set operations and roll-ups over the star schema, and over documents with their labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import positions as P
from ..functions import values as V
from ..operators import dedup, evaluation, profiles, references
from ..tables import table
from .registry import registry

QUERIES, ORACLES, query = registry()


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def exclude_selected(spark, sf_dir):
    chosen = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return dedup.excluding(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), chosen, ["o_custkey"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def keep_selected(spark, sf_dir):
    chosen = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return dedup.keeping(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), chosen, ["o_custkey"])


def _zero_filled(bucket: str, names: list[str], source: str) -> str:
    values = ", ".join(f"({i}, '{n}')" for i, n in enumerate(names))
    return f"SELECT b.i::INT AS ordinal, b.name AS bucket, count(x.b) AS n, round(count(x.b) / (SELECT count(*) FROM {source}), 6) AS share FROM (VALUES {values}) b(i, name) LEFT JOIN (SELECT {bucket} AS b FROM {source}) x ON x.b = b.name GROUP BY ALL"


@query(_zero_filled("CASE WHEN l_quantity * 2 >= 100 THEN '100+' ELSE (floor(l_quantity * 2 / 10) * 10)::INT || '-' || ((floor(l_quantity * 2 / 10) * 10)::INT + 9) END", P.HALFMOVE_BUCKETS, "lineitem"))
def bucket_profile(spark, sf_dir):
    """The profile of clocks over quantities: ten buckets and an open one, empty ones included."""
    return profiles.bucket_counts(table(spark, sf_dir, "lineitem"), P.halfmove_bucket(F.col("l_quantity") * 2), P.HALFMOVE_BUCKETS)


_PHASES = "CASE WHEN l_linenumber * 15 - 14 <= 10 THEN '1-10' WHEN l_linenumber * 15 - 14 <= 20 THEN '11-20' WHEN l_linenumber * 15 - 14 <= 30 THEN '21-30' WHEN l_linenumber * 15 - 14 <= 40 THEN '31-40' WHEN l_linenumber * 15 - 14 <= 60 THEN '41-60' WHEN l_linenumber * 15 - 14 <= 100 THEN '61-100' ELSE '101+' END"


@query(_zero_filled(_PHASES, [p[0] for p in P.PHASES], "lineitem"))
def phase_profile(spark, sf_dir):
    return profiles.bucket_counts(table(spark, sf_dir, "lineitem"), P.fullmove_phase(F.col("l_linenumber") * 15 - 14), [p[0] for p in P.PHASES])


@query("SELECT l_orderkey, l_linenumber, l_linenumber >= 3 OR l_quantity * 2 >= 100 AS claimable FROM lineitem")
def claimable(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", P.claimable(F.col("l_linenumber"), F.col("l_quantity") * 2).alias("claimable"))


_RANGES = [("small", 0.0, 50_000.0), ("middle", 50_000.0, 200_000.0), ("large", 200_000.0, 1e9)]


@query("SELECT o_orderkey, name FROM orders LEFT JOIN (VALUES " + ", ".join(f"('{n}', {a}, {b})" for n, a, b in _RANGES) + ") r(name, low, high) ON low <= o_totalprice AND o_totalprice < high")
def range_buckets(spark, sf_dir):
    ranges = spark.createDataFrame(_RANGES, "name string, low double, high double")
    return profiles.range_buckets(table(spark, sf_dir, "orders"), "o_totalprice", ranges).select("o_orderkey", "name")


@query("""
SELECT l_orderkey AS id, 'order_known' AS rule, l_orderkey::VARCHAR AS detail FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 97 <> 5)
UNION ALL SELECT l_orderkey, 'quantity', l_linenumber::VARCHAR FROM lineitem WHERE NOT coalesce(l_quantity BETWEEN 1 AND 48, false)
UNION ALL SELECT l_orderkey, 'lines_contiguous', min(l_linenumber) || '-' || max(l_linenumber) FROM lineitem GROUP BY l_orderkey HAVING min(l_linenumber) <> 1 OR max(l_linenumber) <> count(DISTINCT l_linenumber) OR count(*) <> count(DISTINCT l_linenumber)
""")
def event_rules(spark, sf_dir):
    """Referential, range and numbering rules, each broken by some rows (orders of one residue are left out)."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").where("o_orderkey % 97 != 5")
    parent = orders.select(F.col("o_orderkey").alias("l_orderkey"))
    out = references.dangling(lines, parent, ["l_orderkey"], "l_orderkey", "order_known")
    out = out.unionByName(references.violations(lines, {"quantity": F.col("l_quantity").between(1, 48)}, "l_orderkey", F.col("l_linenumber")))
    return out.unionByName(references.contiguous(lines, ["l_orderkey"], "l_linenumber", "l_orderkey", "lines_contiguous", 1))


@query("""
WITH x AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'F'), y AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 1000)
SELECT 'left' AS side, * FROM (SELECT * FROM x EXCEPT ALL SELECT * FROM y) UNION ALL SELECT 'right', * FROM (SELECT * FROM y EXCEPT ALL SELECT * FROM x)
""")
def release_set_equality(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return dedup.differences(orders.where("o_orderstatus != 'F'").select("o_orderkey", "o_custkey"), orders.where("o_totalprice > 1000").select("o_orderkey", "o_custkey"))


@query("SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return dedup.duplicated(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_suppkey"])


@query("""
WITH cache AS (SELECT c_custkey AS custkey, c_acctbal AS score FROM customer WHERE c_custkey % 2 = 0), made AS (SELECT o_custkey AS custkey, round(max(o_totalprice), 2) AS score FROM orders GROUP BY o_custkey)
SELECT * FROM cache UNION ALL SELECT * FROM made WHERE custkey NOT IN (SELECT custkey FROM cache)
""")
def cache_fill(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "custkey")
    cache = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("custkey"), F.col("c_acctbal").alias("score"))
    made = orders.groupBy("custkey").agg(F.round(F.max("o_totalprice"), 2).alias("score"))
    return dedup.fill_missing(cache, orders, ["custkey"], made)


@query("""
WITH r AS (SELECT n_chars AS rating, quality AS first, toxic AS whole FROM documents JOIN labels USING (doc_id)),
b AS (SELECT * FROM (VALUES ('0-1200', 0, 1200), ('1200-1600', 1200, 1600), ('1600-2000', 1600, 2000), ('2000-1000000000', 2000, 1000000000)) b(bucket, low, high)),
g AS (SELECT bucket, count(rating) AS n, coalesce(sum(first), 0)::BIGINT AS first, coalesce(sum(whole), 0)::BIGINT AS whole FROM b LEFT JOIN r ON low <= rating AND rating < high GROUP BY bucket
  UNION ALL SELECT 'overall', count(*), coalesce(sum(first), 0)::BIGINT, coalesce(sum(whole), 0)::BIGINT FROM r)
SELECT *, round(CASE WHEN n > 0 THEN first / n END, 6) AS first_accuracy, round(CASE WHEN n > 0 THEN whole / n END, 6) AS whole_accuracy FROM g
""")
def rating_accuracy(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("rating")).join(table(spark, sf_dir, "labels"), "doc_id")
    return evaluation.rating_accuracy(rows, "rating", "quality", "toxic")


@query("""
SELECT lang, b AS budget, count(*) AS n, round(avg((n_chars <= b)::INT), 6) AS end_found_rate, round(avg(coalesce(quality, 0)), 6) AS valid_rate,
  count(CASE WHEN quality = 1 THEN n_chars - b END) AS cp_loss_count, round(avg(CASE WHEN quality = 1 THEN n_chars - b END), 6) AS cp_loss_mean
FROM documents LEFT JOIN labels USING (doc_id), (SELECT unnest([512, 2048, 8192]) AS b) GROUP BY lang, b
""")
def eval_summary(spark, sf_dir):
    """Every document under every budget (a short list, so the product is bounded), then rates and means."""
    budgets = spark.createDataFrame([(512,), (2048,), (8192,)], "budget int")
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left").join(F.broadcast(budgets))
    answers = rows.select("lang", "budget", (F.col("n_chars") <= F.col("budget")).cast("int").alias("end_found"), F.coalesce("quality", F.lit(0)).alias("valid"), F.when(F.col("quality") == 1, F.col("n_chars") - F.col("budget")).alias("cp_loss"))
    return evaluation.summary(answers, ["lang", "budget"])


@query("SELECT lang, error, count(*) AS n FROM (SELECT lang, unnest(list_filter([CASE WHEN length(text) IS NULL OR length(text) = 0 THEN 'missing_final' END, CASE WHEN n_chars > 2048 THEN 'missing_end' END, CASE WHEN toxic = 1 THEN 'illegal_pv' END], lambda e: e IS NOT NULL)) AS error FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY lang, error")
def error_histogram(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    marks = [F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, "missing_final"), F.when(F.col("n_chars") > 2048, "missing_end"), F.when(F.col("toxic") == 1, "illegal_pv")]
    return evaluation.error_counts(rows.select("lang", F.filter(F.array(*marks), lambda e: e.isNotNull()).alias("errors")), ["lang"])


@query("SELECT lang, count(quality) AS n, median(n_chars) AS median FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def quality_medians(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return evaluation.medians(rows, ["lang"], "n_chars", ["doc_id"])


@query("SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS loss FROM lineitem GROUP BY ALL")
def weighted_loss(spark, sf_dir):
    from ..operators.packing import weighted_loss as loss

    price = F.col("l_extendedprice").cast("decimal(18,2)")
    weight = F.col("l_quantity").cast("decimal(10,0)")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(loss(price, weight).cast("double"), 4).alias("loss"))


@query("SELECT doc_id, n_chars, CASE WHEN quality IS NOT NULL THEN 'train' ELSE 'validation' END AS split, CASE WHEN quality IS NOT NULL THEN ((quality - toxic) / 1000)::FLOAT END AS final_value FROM documents LEFT JOIN labels USING (doc_id)")
def hf_projection(spark, sf_dir):
    """The shared columns of a release, its value as a 32-bit number, its split by the export's names."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    value = V.outcome_value(F.array("quality", F.lit(0), "toxic")).cast("float")
    return rows.select("doc_id", "n_chars", F.when(F.col("quality").isNotNull(), "train").otherwise("validation").alias("split"), value.alias("final_value"))


@query("SELECT k AS \"update\", round(CASE WHEN k / 1000 < 0.05 THEN k / 1000 / 0.05 ELSE 0.1 + 0.9 * (1 + cos(pi() * (k / 1000 - 0.05) / 0.95)) / 2 END, 9) AS scale FROM (SELECT unnest(range(0, 1001)) AS k)")
def lr_schedule(spark, sf_dir):
    return spark.range(1001).select(F.col("id").alias("update"), F.round(V.warm_cosine(F.col("id") / 1000, 0.05, 0.1), 9).alias("scale"))


@query("SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey DESC) AS r FROM customer WHERE c_custkey <= 1000) WHERE r <= 3")
def checkpoint_retention(spark, sf_dir):
    """The last three snapshots of each run up to an update: the number kept is the operator's parameter."""
    from ..operators.history import retained

    rows = table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey")
    return retained(rows, ["c_mktsegment"], "c_custkey", 1000, 3)


_BINNED = f"CASE WHEN root_value BETWEEN -1 AND 1 THEN len(list_filter([{', '.join(map(repr, V.BOUNDS))}], lambda b: b < root_value)) END"


@query(f"""
WITH s AS (SELECT l_orderkey AS position, 'm' || l_linenumber AS move, l_quantity::INT AS cp, CASE WHEN l_linenumber % 5 = 0 THEN l_quantity::INT % 7 - 3 END AS mate, (l_discount * 10 - 0.5)::DOUBLE AS value FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity, max(l_discount) AS l_discount FROM lineitem GROUP BY ALL)),
c AS (SELECT * FROM s UNION ALL SELECT o_orderkey, '{evaluation.CLAIM}', 0, NULL, 0.0 FROM orders WHERE o_custkey % 4 = 0),
k AS (SELECT *, CASE WHEN mate IS NULL THEN 0 WHEN mate > 0 THEN 1 ELSE -1 END AS sign, coalesce(-mate, cp) AS score FROM c),
r AS (SELECT *, rank() OVER (PARTITION BY position ORDER BY sign DESC, score DESC) AS move_rank, count(*) OVER (PARTITION BY position) AS n, first(value) OVER w AS best_value, first(cp) OVER w AS best_cp FROM k WINDOW w AS (PARTITION BY position ORDER BY sign DESC, score DESC, move = '{evaluation.CLAIM}', move)),
root AS (SELECT position, value AS root_value, mate AS root_mate FROM (SELECT *, row_number() OVER (PARTITION BY position ORDER BY sign DESC, score DESC, move) AS place FROM k WHERE move <> '{evaluation.CLAIM}') WHERE place = 1)
SELECT r.position, move_rank, round((move_rank - 1) / greatest(n - 1, 1), 9) AS fraction, best_cp - cp AS cp_loss, round((best_value - r.value) / 2, 9) AS value_loss, round(abs(0.25 - root_value), 9) AS value_error, 9 = {_BINNED} AS bin_correct,
  CASE WHEN root_mate IS NOT NULL THEN 2 = greatest(-30, least(28, root_mate)) END AS mate_correct
FROM r JOIN root USING (position) WHERE move = 'm1'
""")
def graded_answers(spark, sf_dir):
    """One answer per order, the line m1, against the scores of its lines."""
    c = F.col
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"), F.max("l_discount").alias("l_discount"))
    mate = F.when(c("l_linenumber") % 5 == 0, c("l_quantity").cast("int") % 7 - 3)
    scores = lines.select(c("l_orderkey").alias("position"), F.concat(F.lit("m"), c("l_linenumber").cast("string")).alias("move"), c("l_quantity").cast("int").alias("cp"), mate.alias("mate"), (c("l_discount") * 10 - 0.5).cast("double").alias("value"))
    roots = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("position"), (c("o_custkey") % 4 == 0).alias("claimable"))
    answers = roots.select("position", F.lit("m1").alias("decision"), F.lit(0.25).alias("value"), F.lit(9).alias("value_bin"), F.lit(2).alias("mate_distance"))
    out = evaluation.graded(answers, scores, roots)
    return out.select(
        "position", c("move_rank").cast("long").alias("move_rank"), F.round("move_rank_fraction", 9).alias("fraction"), "cp_loss", F.round("expected_score_loss", 9).alias("value_loss"), F.round("value_absolute_error", 9).alias("value_error"), c("value_bin_correct").alias("bin_correct"), c("mate_distance_correct").alias("mate_correct")
    )


_LINES = """
n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS ply FROM lineitem),
s AS (SELECT l_partkey AS position, 'm' || l_suppkey % 10 AS move, CASE WHEN l_suppkey % 11 <> 0 THEN max(l_quantity)::INT END AS cp, CASE WHEN l_suppkey % 11 = 0 THEN max(l_quantity)::INT % 9 - 4 END AS mate FROM lineitem WHERE l_linenumber <> 5 GROUP BY l_partkey, l_suppkey),
u AS (SELECT position, move, CASE WHEN max(mate) IS NULL THEN max(cp) END AS cp, max(mate) AS mate FROM s GROUP BY position, move),
k AS (SELECT *, CASE WHEN mate IS NULL THEN 0 WHEN mate > 0 THEN 1 ELSE -1 END AS sign, coalesce(-mate, cp) AS score FROM u),
b AS (SELECT position, sign AS top_sign, score AS top_score, cp AS best FROM (SELECT *, row_number() OVER (PARTITION BY position ORDER BY sign DESC, score DESC, cp DESC NULLS LAST) AS r FROM k) WHERE r = 1),
m AS (SELECT l_orderkey AS id, ply, 'm' || l_suppkey % 10 AS move, ply % 2 = 0 AS root_player, l_partkey AS position FROM n WHERE ply < 5),
j AS (SELECT m.*, best - cp AS cp_loss, sign = top_sign AND score = top_score AS best_move, k.position IS NOT NULL AS found FROM m LEFT JOIN k ON m.position = k.position AND m.move = k.move LEFT JOIN b ON m.position = b.position),
l AS (SELECT * FROM (SELECT *, bool_and(found) OVER (PARTITION BY id ORDER BY ply) AS whole FROM j) WHERE whole)
"""


def _losses(spark, sf_dir):
    """An order's items as a line of moves: the part is the position, the supplier the move, sides take turns."""
    c = F.col
    items = table(spark, sf_dir, "lineitem")
    move = F.concat(F.lit("m"), (c("l_suppkey") % 10).cast("string"))
    own = items.where("l_linenumber <> 5").groupBy(c("l_partkey").alias("position"), "l_suppkey").agg(F.max("l_quantity").cast("int").alias("q"))
    mated = c("l_suppkey") % 11 == 0
    own = own.select("position", move.alias("move"), F.when(~mated, c("q")).alias("cp"), F.when(mated, c("q") % 9 - 4).alias("mate"))
    scores = own.groupBy("position", "move").agg(F.max("cp").alias("cp"), F.max("mate").alias("mate")).withColumn("cp", F.when(c("mate").isNull(), c("cp")))
    placed = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    lines = items.groupBy(c("l_orderkey").alias("id")).agg(placed.alias("items"))
    pv = F.transform("items", lambda x, i: F.struct(x["l_partkey"].alias("position"), F.concat(F.lit("m"), (x["l_suppkey"] % 10).cast("string")).alias("move"), (i % 2).alias("turn")))
    return evaluation.line_losses(lines.select("id", pv.alias("pv"), F.lit(0).alias("root_turn")), scores, 5)


@query(f"WITH {_LINES} SELECT id, ply::INT AS ply, move, root_player, cp_loss, best_move FROM l")
def line_losses(spark, sf_dir):
    """The first five moves: the limit of a line's plies is the operator's parameter."""
    return _losses(spark, sf_dir)


@query(f"""
WITH {_LINES}, r AS (SELECT *, count(*) OVER (PARTITION BY root_player) AS n, row_number() OVER (PARTITION BY root_player ORDER BY cp_loss, id, ply) AS place FROM l WHERE cp_loss IS NOT NULL),
h AS (SELECT root_player, median(cp_loss) AS median FROM r GROUP BY root_player)
SELECT root_player, count(*) AS plies, count(*) FILTER (WHERE best_move) AS best, count(cp_loss) AS "count", round(avg(cp_loss), 6) AS mean, any_value(median)::DOUBLE AS median FROM l LEFT JOIN h USING (root_player) GROUP BY root_player
""")
def side_losses(spark, sf_dir):
    out = evaluation.side_losses(_losses(spark, sf_dir), [])
    return out.withColumns({"mean": F.round("mean", 6), "median": F.col("median").cast("double")})
