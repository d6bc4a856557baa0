"""Roles of trace tokens over streams made from ``documents``: each word becomes a step of a trace."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.vocabulary import CONTROL, START
from ..functions.words import numbers
from ..operators import roles
from .corpus_queries import _SPLIT, documents
from .registry import registry

QUERIES, ORACLES, query = registry()

_MOVES, _VALUES, _METAS = START["value"] - START["move"], CONTROL["pad"] - START["value"], START["move"] - START["side"]
_STEPS = ("back", "reset", "depth", "refuted")


def _number(w: Column) -> Column:
    return F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("long")


def _traces(spark, sf_dir):
    """Thought, decision, value, line and end; every fifth document also has words that the grammar refuses."""
    h = lambda n: n.cast("long")
    int_array = lambda *xs: F.array(*(x.cast("int") for x in xs))

    def step(n):
        metas = [h(n) % 181 + k for k in range(8)]
        board = int_array(F.lit(CONTROL["board"]), h(n) % 768, F.floor(h(n) / 7) % 768, *(START["side"] + m % _METAS for m in metas))
        move = int_array(START["move"] + h(n) % _MOVES)
        kind = h(n) % 8
        out = F.when(kind == 0, board).when(kind == 4, int_array(START["value"] + h(n) % _VALUES))
        for k, name in enumerate(_STEPS):
            out = out.when((kind == 5) & (F.floor(h(n) / 8) % 4 == k), int_array(F.lit(CONTROL[name])))
        return out.when((kind == 7) & (F.col("doc_id") % 5 == 0), int_array(h(n) % 3000)).otherwise(move)

    last = _number(F.col("doc_id").cast("string"))
    suffix = int_array(F.lit(CONTROL["final"]), START["move"] + last % _MOVES, START["value"] + last % _VALUES, START["move"] + F.floor(last / 3) % _MOVES, F.lit(CONTROL["end"]))
    tokens = F.concat(F.flatten(F.transform("numbers", step)), suffix)
    rows = documents(spark, sf_dir).select("doc_id", "lang", numbers(F.col("text")).alias("numbers"))
    # rows of an array of one, as a plain column would be written into each place that names it and made again there
    return rows.select("doc_id", "lang", F.explode(F.array(tokens)).alias("tokens"))


_H = "('0x' || substr(md5({0}), 1, 7))::BIGINT"
_STEP = f"""CASE WHEN h % 8 = 0 THEN list_concat([{CONTROL["board"]}, h % 768, (h // 7) % 768], list_transform(range(8), lambda k: {START["side"]} + (h % 181 + k) % {_METAS}))
  WHEN h % 8 = 4 THEN [{START["value"]} + h % {_VALUES}]
  WHEN h % 8 = 5 THEN [([{", ".join(str(CONTROL[s]) for s in _STEPS)}])[(h // 8) % 4 + 1]]
  WHEN h % 8 = 7 AND doc_id % 5 = 0 THEN [h % 3000] ELSE [{START["move"]} + h % {_MOVES}] END"""
_TRACES = f"""
w AS (SELECT doc_id, lang, list_transform({_SPLIT}, lambda x: {_H.format("x")}) AS hs, {_H.format("doc_id::VARCHAR")} AS last FROM documents),
t AS (SELECT doc_id, lang, list_concat(flatten(list_transform(hs, lambda h: {_STEP})), [{CONTROL["final"]}, {START["move"]} + last % {_MOVES}, {START["value"]} + last % {_VALUES}, {START["move"]} + (last // 3) % {_MOVES}, {CONTROL["end"]}])::BIGINT[] AS tokens FROM w),
tok AS (SELECT doc_id, lang, i, tokens[i] AS t, len(tokens) AS n FROM (SELECT *, unnest(range(1, len(tokens) + 1)) AS i FROM t)),
m AS (
  SELECT *, coalesce(min(CASE WHEN t = {CONTROL["final"]} THEN i END) OVER (PARTITION BY doc_id), n + 1) AS fin,
    coalesce(max(CASE WHEN t >= {START["move"]} THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS op FROM tok
),
o AS (SELECT *, coalesce(lag(t, 1) OVER (PARTITION BY doc_id ORDER BY i), 0) AS prev FROM m),
b AS (SELECT m.doc_id, m.i, p.t = {CONTROL["board"]} AS seen FROM m JOIN tok p ON m.doc_id = p.doc_id AND m.op = p.i WHERE m.i < m.fin),
obs AS (
  SELECT m.doc_id, m.i, m.op, m.t, coalesce(seen, false) AS seen,
    count(*) FILTER (WHERE m.t < {START["side"]}) OVER w AS pieces, count(*) FILTER (WHERE m.t BETWEEN {START["side"]} AND {START["move"] - 1}) OVER w AS metas
  FROM m LEFT JOIN b USING (doc_id, i) WHERE m.i < m.fin AND m.t < {START["move"]} WINDOW w AS (PARTITION BY m.doc_id, m.op ORDER BY m.i)
),
fits AS (SELECT *, seen AND CASE WHEN t < {START["side"]} THEN metas = 0 ELSE pieces > 0 AND metas <= 8 END AS fit FROM obs),
ok AS (SELECT *, bool_and(fit) OVER (PARTITION BY doc_id, op ORDER BY i) AS sound FROM fits),
closed AS (SELECT doc_id, op, bool_and(sound) AS sound, max(metas) AS metas FROM ok GROUP BY doc_id, op),
r AS (
  SELECT o.doc_id, o.lang, o.i, CASE
    WHEN o.i > o.fin THEN CASE WHEN o.i = o.fin + 1 THEN CASE WHEN o.t BETWEEN {START["move"]} AND {START["value"] - 1} THEN 5 ELSE -1 END
      WHEN o.t = {CONTROL["end"]} THEN 4 WHEN o.t BETWEEN {START["move"]} AND {START["value"] - 1} THEN 7 WHEN o.t BETWEEN {START["value"]} AND {CONTROL["pad"] - 1} THEN 8 ELSE -1 END
    WHEN o.t < {START["move"]} THEN CASE WHEN ok.sound THEN 1 ELSE -1 END
    WHEN p.t = {CONTROL["board"]} AND (c.op IS NULL OR (c.sound AND c.metas < 8)) THEN -1
    WHEN o.t IN ({", ".join(str(CONTROL[c]) for c in ("final", "board", "back", "reset", "depth"))}) THEN 4 WHEN o.t = {CONTROL["refuted"]} THEN 6
    WHEN o.t < {START["value"]} THEN 2 WHEN o.t < {CONTROL["pad"]} THEN 3 ELSE -1 END AS role
  FROM o LEFT JOIN ok USING (doc_id, i) LEFT JOIN tok p ON p.doc_id = o.doc_id AND p.i = o.op LEFT JOIN closed c ON c.doc_id = o.doc_id AND c.op = o.op
)
"""
_NAMED = "CASE role " + " ".join(f"WHEN {k} THEN '{n}'" for n, k in [*roles.ROLE.items(), ("refused", -1)]) + " END"


@query(f"WITH {_TRACES} SELECT doc_id, md5(string_agg(role::VARCHAR, ' ' ORDER BY i)) AS roles_md5, count(*) FILTER (WHERE role = -1) AS refused FROM r GROUP BY doc_id")
def trace_roles(spark, sf_dir):
    """Each atom's role in its place."""
    df = _traces(spark, sf_dir).select("doc_id", roles.roles(F.col("tokens")).alias("r"))
    return df.select("doc_id", F.md5(F.array_join("r", " ")).alias("roles_md5"), F.size(F.filter("r", lambda x: x == roles.REFUSED)).cast("long").alias("refused"))


@query(f"WITH {_TRACES}, c AS (SELECT lang, role, count(*) AS n FROM r GROUP BY ALL) SELECT lang, {_NAMED} AS role, n, round(n / sum(n) OVER (PARTITION BY lang), 9) AS share FROM c")
def role_shares(spark, sf_dir):
    df = _traces(spark, sf_dir).select("lang", roles.roles(F.col("tokens")).alias("r"))
    return roles.role_shares(df, "r", ["lang"]).withColumn("share", F.round("share", 9))


@query(f"""
WITH {_TRACES}, k AS (SELECT *, 3 * ((i - 1) // 6) + CASE (i - 1) % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 2 END AS token FROM r),
g AS (SELECT doc_id, lang, CASE WHEN bool_or(role = 5) THEN 5 WHEN min(role) = max(role) THEN min(role) ELSE 9 END AS role FROM k GROUP BY doc_id, lang, token),
c AS (SELECT lang, role, count(*) AS n FROM g GROUP BY ALL)
SELECT lang, {_NAMED} AS role, n, round(n / sum(n) OVER (PARTITION BY lang), 9) AS share FROM c
""")
def composite_role_shares(spark, sf_dir):
    """The same over stored tokens that stand for one, two and three atoms in turn."""
    n = F.size("tokens")
    sizes = F.transform(F.sequence(F.lit(0), 3 * F.ceil(n / 6).cast("int") - 1), lambda i: (i % 3 + 1).cast("int"))
    starts = F.transform(F.sequence(F.lit(0), F.size(sizes) - 1), lambda i: (6 * F.floor(i / 3) + F.get(F.array(F.lit(0), F.lit(1), F.lit(3)), (i % 3).cast("int"))).cast("int"))
    lengths = F.filter(F.zip_with(sizes, starts, lambda s, a: F.least(s, n - a)), lambda s: s > 0)
    df = _traces(spark, sf_dir).select("lang", roles.roles(F.col("tokens")).alias("of"), lengths.alias("sizes"))
    df = df.select("lang", roles.composite_roles(F.col("of"), F.col("sizes")).alias("r"))
    return roles.role_shares(df, "r", ["lang"]).withColumn("share", F.round("share", 9))
