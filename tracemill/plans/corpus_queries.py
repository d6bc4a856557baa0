"""Sampling, counting, encoding and packing over ``documents``; a word's atom comes from its md5."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, draws
from ..functions.vocabulary import COMPOSITE, CONTROL
from ..functions.words import numbers
from ..operators import dedup, ngrams, packing, profiles, sampling, segmentation
from ..sources import packed
from ..tables import release, shared_folder, stored, table
from .registry import registry

QUERIES, ORACLES, query = registry()

#: Ids that words map to: those of atoms that are no control tokens.
ATOMS = CONTROL["pad"]
#: No document of the tables is longer than the budget.
SEED, BUDGET, CAP = "640", 20_480, 2048

_SPLIT = "list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '')"
_DOCS = f"w AS (SELECT *, {_SPLIT} AS words FROM documents), a AS (SELECT *, list_transform(words, lambda x: (('0x' || substr(md5(x), 1, 7))::BIGINT % {ATOMS})::INT) AS atoms FROM w)"


def _draw_sql(*parts: str) -> str:
    return f"('0x' || substr(sha256({' || chr(58) || '.join(parts)}), 1, 15))::BIGINT"


_SPLIT_SQL = f"CASE WHEN {_draw_sql(chr(39) + 'split' + chr(39), 'doc_id')} % 65 = 0 THEN 'val' ELSE 'train' END"


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda x: x != "")


def atoms(text: Column) -> Column:
    return numbers(text, ATOMS)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(f"SELECT doc_id, {_draw_sql(chr(39) + 'split' + chr(39), 'doc_id')} AS draw, {_SPLIT_SQL} AS split FROM documents")
def split_hash_draw(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", draws.draw("split", F.col("doc_id")).alias("draw"), draws.split_of(F.col("doc_id")).alias("split"))


def _strata(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", draws.split_of(F.col("doc_id")).alias("split"), (F.col("n_chars") >= 1000).alias("long_text"), draws.draw(SEED, F.col("doc_id"), "pool").alias("priority"))


_SIZES, _SHARE = {"train": 325, "val": 5}, 0.3


@query(f"""
WITH s AS (SELECT doc_id, {_SPLIT_SQL} AS split, n_chars >= 1000 AS long_text, {_draw_sql("'640'", 'doc_id', "'pool'")} AS priority FROM documents),
q AS (SELECT *, row_number() OVER (PARTITION BY split, long_text ORDER BY priority, doc_id) AS r, CASE split WHEN 'train' THEN 325 ELSE 5 END AS size FROM s)
SELECT doc_id, split, long_text, priority FROM q WHERE r <= CASE WHEN long_text THEN round_even(size * 0.3, 0) ELSE size - round_even(size * 0.3, 0) END
""")
def stratified_bottom_k(spark, sf_dir):
    return sampling.stratified_sample(_strata(spark, sf_dir), "split", "long_text", _SIZES, _SHARE, "priority", ["doc_id"], draws.RANGE)


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {_draw_sql(chr(39) + SEED + chr(39), 'doc_id', chr(39) + 'pool-order' + chr(39))}, doc_id) - 1 AS place FROM documents")
def pool_order(spark, sf_dir):
    from ..tables import positions

    df = documents(spark, sf_dir).select("doc_id", draws.draw(SEED, F.col("doc_id"), "pool-order").alias("d"))
    return positions(df, ["d", "doc_id"], "place").select("doc_id", "place")


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(coalesce('t' || text, ''))")
def first_seen_dedup(spark, sf_dir):
    df = documents(spark, sf_dir).select("doc_id", F.sha2(F.coalesce(F.concat(F.lit("t"), "text"), F.lit("")), 256).alias("key"))
    return dedup.first_seen(df, F.col("key"), ["doc_id"]).select("doc_id", "copies")


@query(f"SELECT doc_id FROM documents ORDER BY sha256('{SEED}' || ':' || doc_id), doc_id LIMIT 128")
def hash_sample(spark, sf_dir):
    """The bounded evaluation sample: its size is the operator's parameter."""
    df = documents(spark, sf_dir).select("doc_id", F.sha2(F.concat_ws(":", F.lit(SEED), "doc_id"), 256).alias("h"))
    return sampling.smallest(df, 128, "h", "doc_id").select("doc_id")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents) WHERE r % 7 = 0")
def every_kth(spark, sf_dir):
    """The stride of the dictionary's fitting set: the operator's own feature."""
    return sampling.every_kth(documents(spark, sf_dir).select("doc_id"), ["doc_id"], 7)


@query(f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY {_draw_sql(chr(39) + SEED + ':packing:subsets' + chr(39), 'doc_id')}, doc_id) AS r FROM documents) WHERE r <= 500")
def nested_subset(spark, sf_dir):
    df = documents(spark, sf_dir).select("doc_id", draws.draw(f"{SEED}:packing:subsets", F.col("doc_id")).alias("d"))
    return sampling.subset(df, ["d", "doc_id"], 500).select("doc_id")


@query(f"""
SELECT doc_id, u, CASE WHEN u < 0.1 THEN 'zero' WHEN u < 0.6 THEN 'full' ELSE 'random' END AS presentation
FROM (SELECT doc_id, {_draw_sql("'640'", 'doc_id', "'presentation'")} / {float(1 << 60)!r} AS u FROM documents)
""")
def presentation_draw(spark, sf_dir):
    df = documents(spark, sf_dir).select("doc_id", draws.uniform(SEED, F.col("doc_id"), "presentation").alias("u"))
    return df.withColumn("presentation", draws.by_weight(F.col("u"), [("zero", 0.1), ("full", 0.5), ("random", 0.4)]))


def _stream(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", "lang", "source", atoms(F.col("text")).alias("atoms"))


@query(f"""
WITH {_DOCS}, l AS (SELECT unnest(range(2, 9)) AS n),
g AS (SELECT unnest(list_transform(range(1, len(atoms) - n + 2), lambda i: array_to_string(atoms[i:i + n - 1], ' '))) AS gram, n FROM a, l WHERE len(atoms) >= n)
SELECT gram, n::INT AS length, count(*) AS n FROM g GROUP BY gram, length HAVING count(*) >= 8
""")
def ngram_counts(spark, sf_dir):
    out = ngrams.count_windows(_stream(spark, sf_dir), "atoms", 2, 8)
    return out.select(F.array_join("atoms", " ").alias("gram"), "length", "n")


@query(f"""
WITH {_DOCS}, l AS (SELECT unnest(range(2, 9)) AS n),
g AS (SELECT unnest(list_transform(range(1, len(atoms) - n + 2), lambda i: atoms[i:i + n - 1])) AS gram, n FROM a, l WHERE len(atoms) >= n),
c AS (SELECT gram, n AS length, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 8),
r AS (SELECT *, row_number() OVER (PARTITION BY length ORDER BY n DESC, gram) AS r FROM c)
SELECT array_to_string(gram, ' ') AS gram, length::INT AS length, n, n * (length - 1) AS savings FROM r WHERE r <= 100
""")
def merge_candidates(spark, sf_dir):
    out = ngrams.candidates(ngrams.count_windows(_stream(spark, sf_dir), "atoms"), limit=100)
    return out.select(F.array_join("atoms", " ").alias("gram"), "length", "n", "savings")


@query(f"""
WITH {_DOCS}, p AS (SELECT unnest(list_transform(range(1, len(atoms)), lambda i: [atoms[i], atoms[i + 1]])) AS p FROM a WHERE len(atoms) > 1)
SELECT p[1] AS "left", p[2] AS "right", count(*) AS n FROM p GROUP BY ALL
""")
def adjacent_pairs(spark, sf_dir):
    return ngrams.pair_counts(_stream(spark, sf_dir), "atoms")


_HELD: dict[tuple[str, str], list[list[int]]] = {}


def _fixed_dictionary(spark, sf_dir) -> DataFrame:
    """The 64 most frequent pairs and triples, a dictionary to encode with; worked out once for an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _HELD:
        top = ngrams.candidates(ngrams.count_windows(_stream(spark, sf_dir), "atoms", 2, 3), limit=32).orderBy("length", F.desc("n"), "atoms").limit(64).collect()
        _HELD[key] = [list(r["atoms"]) for r in top]
    return segmentation._numbered(spark, _HELD[key])


#: The dictionary above, and the shortest path by position: a, b, c are the costs one, two and three places back, t the
#: sizes taken; then the sizes are followed from the end.
_ENCODED = f"""
{_DOCS}, l AS (SELECT unnest([2, 3]) AS n),
g AS (SELECT unnest(list_transform(range(1, len(atoms) - n + 2), lambda i: atoms[i:i + n - 1])) AS gram, n FROM a, l WHERE len(atoms) >= n),
c AS (SELECT gram, n AS length, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 8),
r AS (SELECT *, row_number() OVER (PARTITION BY length ORDER BY n DESC, gram) AS r FROM c),
dict AS (SELECT array_to_string(gram, ' ') AS k, ({COMPOSITE - 1} + row_number() OVER (ORDER BY length, n DESC, gram))::INT AS id FROM r WHERE r <= 32),
mp AS (SELECT map(list(k), list(id)) AS m FROM dict),
p AS (
  SELECT doc_id, atoms, m, list_transform(range(1, len(atoms) + 1), lambda i: {{'a': CASE WHEN i > 1 AND map_contains(m, array_to_string(atoms[i - 1:i], ' ')) THEN 1 ELSE 0 END,
    'b': CASE WHEN i > 2 AND map_contains(m, array_to_string(atoms[i - 2:i], ' ')) THEN 1 ELSE 0 END, 'c': 0, 't': []::INT[]}}) AS s FROM a, mp
),
f AS (
  SELECT doc_id, atoms, m, list_reduce(s, lambda x, y: {{
    'a': CASE WHEN y.b = 1 AND x.c < (CASE WHEN y.a = 1 AND x.b < x.a + 1 THEN x.b + 1 ELSE x.a + 1 END) THEN x.c + 1 WHEN y.a = 1 AND x.b < x.a + 1 THEN x.b + 1 ELSE x.a + 1 END,
    'b': x.a, 'c': x.b,
    't': list_append(x.t, CASE WHEN y.b = 1 AND x.c < (CASE WHEN y.a = 1 AND x.b < x.a + 1 THEN x.b + 1 ELSE x.a + 1 END) THEN 3 WHEN y.a = 1 AND x.b < x.a + 1 THEN 2 ELSE 1 END)
  }}, {{'a': 0, 'b': 1000000, 'c': 1000000, 't': []::INT[]}}).t AS t FROM p
),
w2 AS (
  SELECT doc_id, atoms, m, list_reduce(list_transform(range(len(t), 0, -1), lambda i: {{'a': t[i], 'b': i::INT, 't': []::INT[]}}), lambda x, y: {{
    'a': CASE WHEN x.a > 0 THEN x.a - 1 ELSE y.a - 1 END, 'b': 0, 't': CASE WHEN x.a > 0 THEN x.t ELSE list_append(x.t, y.b * 4 + y.a) END
  }}, {{'a': 0, 'b': 0, 't': []::INT[]}}).t AS back FROM f
),
enc AS (SELECT doc_id, atoms, list_transform(list_reverse(back), lambda z: CASE WHEN z % 4 = 1 THEN atoms[z // 4] ELSE m[array_to_string(atoms[z // 4 - z % 4 + 1:z // 4], ' ')] END) AS encoded FROM w2)
"""


@query(f"WITH {_ENCODED} SELECT doc_id, len(atoms)::INT AS n_atoms, len(encoded)::INT AS n_tokens, md5(array_to_string(encoded, ' ')) AS encoded_md5 FROM enc")
def min_token_encode(spark, sf_dir):
    df = segmentation.encode(_stream(spark, sf_dir), "atoms", _fixed_dictionary(spark, sf_dir))
    return df.select("doc_id", F.size("atoms").alias("n_atoms"), F.size("encoded").alias("n_tokens"), F.md5(F.array_join("encoded", " ")).alias("encoded_md5"))


@query(f"""
WITH {_ENCODED}, t AS (SELECT doc_id, list_concat([(doc_id % 768)::INT, 768], encoded) AS tokens FROM enc)
SELECT doc_id, len(tokens)::INT AS length, row_number() OVER (ORDER BY doc_id) - 1 AS place, (coalesce(sum(len(tokens)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start, md5(array_to_string(tokens, ' ')) AS tokens_md5 FROM t
""")
def encoded_documents(spark, sf_dir):
    """A release as training documents: a prefix, the encoded words, and where each stands in the whole."""
    from . import releases

    rows = _stream(spark, sf_dir).select("doc_id", F.array((F.col("doc_id") % 768).cast("int"), F.lit(768)).alias("board"), "atoms")
    out = releases.encode_documents(rows, ["doc_id"], "board", "atoms", _fixed_dictionary(spark, sf_dir), 131_072)
    return out.select("doc_id", "length", "place", "start", F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


@query(f"WITH {_DOCS} SELECT doc_id, md5(array_to_string(atoms, ' ')) AS decoded_md5, len(atoms)::INT AS n_atoms FROM a")
def decode_roundtrip(spark, sf_dir):
    dictionary = _fixed_dictionary(spark, sf_dir)
    df = segmentation.decode(segmentation.encode(_stream(spark, sf_dir), "atoms", dictionary), "encoded", dictionary)
    return df.select("doc_id", F.md5(F.array_join("decoded", " ")).alias("decoded_md5"), F.size("decoded").alias("n_atoms"))


@query(f"WITH {_ENCODED}, u AS (SELECT unnest(encoded) AS id FROM enc) SELECT dict.id, k AS gram, count(u.id) AS n FROM dict LEFT JOIN u USING (id) GROUP BY ALL")
def merge_usage(spark, sf_dir):
    dictionary = _fixed_dictionary(spark, sf_dir)
    return segmentation.usage(segmentation.encode(_stream(spark, sf_dir), "atoms", dictionary), "encoded", dictionary).select("id", F.array_join("atoms", " ").alias("gram"), "n")


_BEST = {
    2: "CASE WHEN y.b = 1 AND x.b < x.a + 1 THEN x.b + 1 ELSE x.a + 1 END",
}
_BEST[3] = f"CASE WHEN y.c = 1 AND x.c < {_BEST[2]} THEN x.c + 1 ELSE {_BEST[2]} END"
_BEST[4] = f"CASE WHEN y.d = 1 AND x.d < {_BEST[3]} THEN x.d + 1 ELSE {_BEST[3]} END"
_KEY = {n: "(" + " + ".join(f"(atoms[i - {n - 1 - j}] + 1) * {4096 ** (n - 1 - j)}::BIGINT" for j in range(n)) + ")" for n in (2, 3, 4)}
_KEYS = ", ".join(f"list_transform(range(1, len(atoms) + 1), lambda i: CASE WHEN i >= {n} THEN {_KEY[n]} END) AS k{n}" for n in (2, 3, 4))
_HOLDS = "CASE WHEN list_contains(e, k{0}[i]) THEN 1 ELSE 0 END"


#: Round by round every document is encoded anew and every pair counted: what the incremental rounds must equal. A run is
#: a number with 12 bits a token; each part is worked out in its own place.
@query(f"""
WITH RECURSIVE {_DOCS}, l AS (SELECT unnest([2, 3, 4]) AS n),
g AS (SELECT unnest(list_transform(range(1, len(atoms) - n + 2), lambda i: atoms[i:i + n - 1])) AS gram, n FROM a, l WHERE len(atoms) >= n),
c AS (SELECT gram, n AS length, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 8),
pool AS MATERIALIZED (SELECT gram, list_reduce(list_prepend(0::HUGEINT, gram), lambda x, y: x * 4096 + y + 1) AS k FROM (SELECT *, row_number() OVER (PARTITION BY length ORDER BY n DESC, gram) AS r FROM c) WHERE r <= 500),
ak AS MATERIALIZED (SELECT atoms, {_KEYS} FROM a),
sel AS (
  SELECT []::BIGINT[] AS e, true AS more
  UNION ALL
  SELECT * FROM (
    WITH p AS (
      SELECT atoms, k2, k3, k4, e, list_transform(range(1, len(atoms) + 1), lambda i: {{'a': 0, 'b': {_HOLDS.format(2)}, 'c': {_HOLDS.format(3)}, 'd': {_HOLDS.format(4)}, 't': []::INT[]}}) AS s FROM sel, ak WHERE more
    ),
    f AS (
      SELECT atoms, k2, k3, k4, e, list_reduce(s, lambda x, y: {{'a': {_BEST[4]}, 'b': x.a, 'c': x.b, 'd': x.c,
        't': list_append(x.t, CASE WHEN y.d = 1 AND x.d < {_BEST[3]} THEN 4 WHEN y.c = 1 AND x.c < {_BEST[2]} THEN 3 WHEN y.b = 1 AND x.b < x.a + 1 THEN 2 ELSE 1 END)
      }}, {{'a': 0, 'b': 1000000, 'c': 1000000, 'd': 1000000, 't': []::INT[]}}).t AS t FROM p
    ),
    w2 AS (
      SELECT atoms, k2, k3, k4, e, list_reduce(list_transform(range(len(t), 0, -1), lambda i: {{'a': t[i], 'b': i::INT, 't': []::INT[]}}), lambda x, y: {{
        'a': CASE WHEN x.a > 0 THEN x.a - 1 ELSE y.a - 1 END, 'b': 0, 't': CASE WHEN x.a > 0 THEN x.t ELSE list_append(x.t, y.b * 8 + y.a) END
      }}, {{'a': 0, 'b': 0, 't': []::INT[]}}).t AS back FROM f
    ),
    enc AS MATERIALIZED (SELECT e, list_transform(list_reverse(back), lambda z: CASE z % 8 WHEN 1 THEN atoms[z // 8] + 1 WHEN 2 THEN k2[z // 8] WHEN 3 THEN k3[z // 8] ELSE k4[z // 8] END) AS t FROM w2),
    seen AS (SELECT list(DISTINCT u) AS us FROM (SELECT unnest(t) AS u FROM enc)),
    used AS (SELECT list_filter(e, lambda k: list_contains(us, k)) AS kept FROM (SELECT any_value(e) AS e FROM enc HAVING count(*) > 0), (SELECT coalesce(us, []) AS us FROM seen)),
    pairs AS (
      SELECT x * (CASE WHEN y < 4096 THEN 4096 WHEN y < {4096**2} THEN {4096**2} WHEN y < {4096**3} THEN {4096**3} ELSE {4096**4} END)::HUGEINT + y AS k, sum(m) AS n
      FROM (SELECT p.x AS x, p.y AS y, count(*) AS m FROM (SELECT unnest(list_transform(range(1, len(t)), lambda i: {{'x': t[i]::HUGEINT, 'y': t[i + 1]::HUGEINT}})) AS p FROM enc) GROUP BY ALL) GROUP BY k
    ),
    best AS (SELECT k::BIGINT AS k, row_number() OVER (ORDER BY n DESC, gram) AS r FROM pairs JOIN pool USING (k), used WHERE NOT list_contains(kept, k::BIGINT)),
    added AS (SELECT coalesce(list(k ORDER BY r), []) AS new FROM best, used WHERE r <= least(16, 48 - len(kept)))
    SELECT list_concat(kept, new) AS e, len(new) > 0 AS more FROM used, added
  )
)
SELECT ({COMPOSITE} + i - 1)::INT AS id, array_to_string(gram, ' ') AS gram FROM (SELECT i, e[i]::HUGEINT AS k FROM (SELECT e, unnest(range(1, len(e) + 1)) AS i FROM sel WHERE NOT more)) JOIN pool USING (k)
""")
def merge_select(spark, sf_dir):
    df = stored(_stream(spark, sf_dir).select("atoms"))
    pool = ngrams.candidates(ngrams.count_windows(df, "atoms", 2, 4), limit=500)
    chosen = segmentation.select_dictionary(df, "atoms", pool, budget=48, block=16)
    release(df)
    return chosen.select("id", F.array_join("atoms", " ").alias("gram"))


def _lengths(spark, sf_dir) -> DataFrame:
    """Documents with their tokens (words) and whether they fit a batch."""
    return documents(spark, sf_dir).select("doc_id", "lang", "source", "n_chars", F.size(words(F.col("text"))).alias("length"))


_LENGTHS = f"n AS (SELECT doc_id, lang, source, n_chars, len({_SPLIT})::BIGINT AS length FROM documents)"


@query(f"WITH {_LENGTHS} SELECT doc_id, length::INT AS length, (coalesce(sum(length) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM n")
def doc_offsets(spark, sf_dir):
    return packing.offsets(_lengths(spark, sf_dir).select("doc_id", "length"), ["doc_id"], "length")


_PACK = f"""
WITH RECURSIVE {_LENGTHS}, o AS (SELECT doc_id, length, row_number() OVER (ORDER BY doc_id) AS r FROM n WHERE length <= {BUDGET}),
p AS (
  SELECT r, doc_id, length, 0::BIGINT AS batch, length AS fill FROM o WHERE r = 1
  UNION ALL
  SELECT o.r, o.doc_id, o.length, CASE WHEN {{full}} THEN batch + 1 ELSE batch END, CASE WHEN {{full}} THEN o.length ELSE fill + o.length END FROM p JOIN o ON o.r = p.r + 1
)
"""


@query(_PACK.format(full=f"fill > 0 AND fill + o.length > {BUDGET}") + "SELECT doc_id, length::INT AS length, batch FROM p")
def pack_batches(spark, sf_dir):
    """Documents longer than the budget are no input of packing (``packing.oversized`` names them)."""
    fit = _lengths(spark, sf_dir).where(F.col("length") <= BUDGET).select("doc_id", "length")
    return packing.pack(fit, ["doc_id"], "length", BUDGET).select("doc_id", "length", "batch")


@query(_PACK.format(full=f"fill >= {BUDGET}") + "SELECT batch AS \"update\", sum(length)::BIGINT AS tokens, (sum(length) - count(*))::BIGINT AS labelled, count(*) AS documents FROM p GROUP BY batch")
def update_groups(spark, sf_dir):
    fit = _lengths(spark, sf_dir).where(F.col("length") <= BUDGET).select("doc_id", "length")
    packed = packing.pack(fit, ["doc_id"], "length", BUDGET, close_after=True).withColumnRenamed("batch", "update")
    return packing.label_totals(packed, "length", "update")


@query(f"""
WITH {_DOCS} SELECT row_number() OVER (ORDER BY doc_id) - 1 AS place, (coalesce(sum(len(atoms)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start, len(atoms)::INT AS length,
  md5(array_to_string(atoms, ' ')) AS tokens_md5 FROM a
""")
def packed_documents(spark, sf_dir):
    """All documents written through the data source of packed tokens and read back by ranges."""
    path = f"{shared_folder(spark)}/packed-{uuid.uuid4().hex}"
    packed.write_packed(_stream(spark, sf_dir), ["doc_id"], path, "atoms")
    back = packed.read_packed(spark, path, 1 << 20)
    return back.select("place", "start", F.size("tokens").alias("length"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


@query(f"WITH {_LENGTHS} SELECT doc_id, length::INT AS length FROM n WHERE length > 1000")
def oversized_documents(spark, sf_dir):
    return packing.oversized(_lengths(spark, sf_dir), "length", 1000).select("doc_id", "length")


@query(f"WITH {_DOCS} SELECT doc_id, md5(array_to_string(CASE WHEN len(atoms) > 0 THEN list_append(atoms[2:], -100) ELSE atoms END, ' ')) AS labels_md5 FROM a")
def next_token_labels(spark, sf_dir):
    return _stream(spark, sf_dir).select("doc_id", F.md5(F.array_join(arrays.next_labels(F.col("atoms")), " ")).alias("labels_md5"))


_EPOCH_SQL = _draw_sql("'640:packing:epoch'", "e", "doc_id")


@query(f"""
WITH c AS (SELECT count(*) AS n FROM documents), e AS (SELECT unnest(range(0, 2)) AS e),
s AS (SELECT doc_id, e, row_number() OVER (PARTITION BY e ORDER BY {_EPOCH_SQL}, doc_id) - 1 AS p FROM documents, e)
SELECT e::INT AS epoch, doc_id, p AS place_in_epoch, e * n + p AS "cursor" FROM s, c WHERE e * n + p < floor(n * 1.5) AND e * n + p >= 100
""")
def epoch_cursor(spark, sf_dir):
    df = documents(spark, sf_dir).select("doc_id")
    sequence = packing.epochs(df, "doc_id", SEED, 1.5, df.count())
    return packing.resumed(sequence, 100).select("epoch", "doc_id", "place_in_epoch", "cursor")


@query(f"""
WITH {_LENGTHS}, r AS (SELECT *, row_number() OVER (ORDER BY length, doc_id) - 1 AS pos, count(*) OVER () AS k FROM n)
SELECT count(*) AS documents, sum(length)::BIGINT AS tokens, round(sum(length) / sum(n_chars), 6) AS ratio, count(*) FILTER (WHERE length <= {CAP}) AS eligible, count(*) FILTER (WHERE length > {CAP}) AS ineligible,
  max(length) FILTER (WHERE pos = k * 50 // 100)::INT AS p50, max(length) FILTER (WHERE pos = k * 90 // 100)::INT AS p90, max(length) FILTER (WHERE pos = k * 95 // 100)::INT AS p95, max(length) FILTER (WHERE pos = k * 99 // 100)::INT AS p99, max(length)::INT AS "max"
FROM r
""")
def encode_stats(spark, sf_dir):
    return profiles.encode_stats(_lengths(spark, sf_dir), "length", "n_chars", CAP, ["doc_id"])


_BUCKET = "CASE WHEN length < 100 THEN 'short' WHEN length < 1000 THEN 'medium' ELSE 'long' END"


@query(f"""
WITH {_LENGTHS}, b AS (SELECT *, {_BUCKET} AS bucket FROM n),
g AS (SELECT lang, source, bucket, grouping(lang) AS gl, grouping(source) AS gs, grouping(bucket) AS gb, count(*) AS documents, sum(length)::BIGINT AS tokens, sum(n_chars)::BIGINT AS atoms FROM b GROUP BY GROUPING SETS ((lang), (source), (bucket), ()))
SELECT CASE WHEN gl = 0 THEN 'lang' WHEN gs = 0 THEN 'source' WHEN gb = 0 THEN 'bucket' ELSE 'all' END AS section, CASE WHEN gl = 0 THEN lang WHEN gs = 0 THEN source WHEN gb = 0 THEN bucket END AS value,
  documents, tokens, atoms, round(tokens / atoms, 6) AS ratio FROM g
""")
def compression_slices(spark, sf_dir):
    bucket = F.when(F.col("length") < 100, "short").when(F.col("length") < 1000, "medium").otherwise("long")
    return profiles.slices(_lengths(spark, sf_dir).withColumn("bucket", bucket), ["lang", "source", "bucket"], "length", "n_chars")


@query(f"""
WITH {_DOCS} SELECT count(*) AS documents, coalesce(sum(len(atoms)), 0)::BIGINT AS atoms, (SELECT count(DISTINCT source) FROM documents) AS positions, (SELECT count(DISTINCT t) FROM (SELECT unnest(atoms) AS t FROM a)) AS distinct_atoms FROM a
""")
def corpus_summary(spark, sf_dir):
    return profiles.corpus_summary(_stream(spark, sf_dir), "source", "atoms")


@query(f"""
WITH {_DOCS}, f AS (SELECT doc_id, atoms, list_position(atoms, atoms[1]) AS x, list_filter(range(2, len(atoms)), lambda i: atoms[i - 1] = atoms[1]) AS cuts FROM a)
SELECT doc_id, (len(cuts) + (len(atoms) > 0 AND NOT list_contains(cuts, len(atoms)))::INT)::INT AS segments FROM f
""")
def segment_cuts(spark, sf_dir):
    """Documents cut behind each occurrence of a token that takes the place of FINAL here: their first word."""
    df = _stream(spark, sf_dir)
    parts = arrays.merge_segments(F.transform("atoms", lambda t: F.when(t == F.col("atoms")[0], CONTROL["final"]).otherwise(t)))
    return df.select("doc_id", F.size(F.filter(parts, lambda p: F.size(p) > 0)).alias("segments"))


@query(
    "WITH RECURSIVE "
    + _DOCS
    + ", "
    + _PACK.split("WITH RECURSIVE", 1)[1].format(full=f"fill > 0 AND fill + o.length > {BUDGET}").strip()
    + """, d AS (SELECT batch, doc_id, atoms, list_append(atoms[2:], -100) AS labels, sum(len(atoms)) OVER (PARTITION BY batch ORDER BY doc_id)::BIGINT AS upto FROM p JOIN a USING (doc_id) WHERE len(atoms) > 0)
SELECT batch, count(*)::INT AS documents, sum(len(atoms))::INT AS tokens, md5(array_to_string(flatten(list(atoms ORDER BY doc_id)), ' ')) AS input_md5, md5(array_to_string(flatten(list(labels ORDER BY doc_id)), ' ')) AS labels_md5,
  '0 ' || string_agg(upto::VARCHAR, ' ' ORDER BY doc_id) AS ends FROM d GROUP BY batch"""
)
def assembled_batches(spark, sf_dir):
    # stored before its lengths are asked for, so that the words are numbered once
    df = stored(_stream(spark, sf_dir).select("doc_id", "atoms")).withColumn("length", F.size("atoms")).where(F.col("length").between(1, BUDGET))
    out = packing.assemble(packing.pack(df, ["doc_id"], "length", BUDGET), "atoms")
    return out.select("batch", "documents", "tokens", F.md5(F.array_join("input_ids", " ")).alias("input_md5"), F.md5(F.array_join("labels", " ")).alias("labels_md5"), F.array_join("cu_seqlens", " ").alias("ends"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = sampling.stratified_sample(_strata(spark, sf_dir), "split", "long_text", {"train": 120, "val": 2}, _SHARE, "priority", ["doc_id"], draws.RANGE)
    chosen = dedup.keeping(_stream(spark, sf_dir), sample, ["doc_id"])
    top = ngrams.candidates(ngrams.count_windows(chosen, "atoms", 2, 4, min_count=4), limit=64).orderBy(F.desc("savings"), "atoms").limit(64).collect()
    encoded = segmentation.encode(chosen, "atoms", segmentation._numbered(spark, [list(r["atoms"]) for r in top]))
    sized = encoded.withColumn("length", F.size("encoded")).where(F.col("length").between(1, 1 << 16))
    packed = packing.pack(sized.select("doc_id", "lang", "length"), ["doc_id"], "length", 1 << 16)
    return packed.groupBy("batch").agg(F.count("*").alias("documents"), F.sum("length").alias("tokens"))


assert COMPOSITE > ATOMS
