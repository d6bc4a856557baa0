"""DuckDB SQL for the queries of this subpackage that SQL can express on whole tables."""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: An exact self-join of the two-word shingles, and what each document reaches by its links.
OP2 = f"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, r, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM d),
e AS (SELECT r, len(s) AS n, unnest(s) AS s FROM sets),
links AS (
  SELECT a.r AS x, b.r AS y FROM e a JOIN e b ON a.s = b.s AND a.r < b.r AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
),
ends AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x, y FROM ends UNION SELECT reach.x, ends.y FROM reach JOIN ends ON reach.y = ends.x),
least_of AS (SELECT reach.x AS r, min(sets.doc_id) AS least FROM reach JOIN sets ON reach.y = sets.r GROUP BY reach.x)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, least) AS component_id, coalesce(doc_id <= least, true) AS kept
FROM sets LEFT JOIN least_of USING (r)
"""

OP3 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT item_id, least(len(w), 10) AS l, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS s
  FROM b WHERE len(w) > 0
),
lens AS (SELECT DISTINCT l FROM win),
dw AS (
  SELECT doc_id, l, unnest(range(1, len(w) - l + 2)) AS i, unnest(list_transform(range(1, len(w) - l + 2), lambda i: array_to_string(w[i:i + l - 1], ' '))) AS s
  FROM d, lens WHERE len(w) >= l
),
hits AS (SELECT doc_id, i, l, item_id FROM dw JOIN win USING (l, s)),
per_word AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + l)) AS k FROM hits) GROUP BY doc_id),
per_item AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN per_word USING (doc_id) LEFT JOIN per_item USING (doc_id)
"""

#: Slot by slot the released block with the earliest deadline, ties by name; releases hold until a source ends.
OP4 = """
WITH RECURSIVE n AS (SELECT coalesce('s' || source, '') AS k, count(*) AS n FROM documents GROUP BY 1),
parts AS (SELECT k, (n + 31) // 32 AS b, greatest(1, round_even(sqrt(n) / (SELECT max(sqrt(n)) FROM n) * 68719476736, 0)::HUGEINT) AS a, row_number() OVER (ORDER BY k) AS i FROM n),
l AS (SELECT list(a ORDER BY i) AS a, list(b ORDER BY i) AS b, sum(a)::HUGEINT AS q, sum(b) AS total FROM parts),
edf AS (
  SELECT 0::BIGINT AS t, list_transform(b, lambda y: 0::BIGINT) AS done, false AS ended, 0::BIGINT AS pick FROM l
  UNION ALL
  SELECT t + 1, list_transform(done, lambda y, j: y + (j = p)::BIGINT), ended OR done[p] + 1 = b[p], p
  FROM (
    SELECT t, done, ended, b, list_sort(list_filter(list_transform(range(1, len(a) + 1), lambda j: CASE WHEN done[j] < b[j] AND (ended OR done[j] * q // a[j] <= t)
      THEN {'d': ((done[j] + 1) * q + a[j] - 1) // a[j], 'j': j} END), lambda y: y IS NOT NULL))[1].j AS p
    FROM edf, l WHERE t < total
  )
),
slots AS (SELECT k, done[i] - 1 AS j, t - 1 AS s FROM edf JOIN parts ON i = pick),
horizon AS (SELECT min(t) AS h FROM edf WHERE ended),
d AS (SELECT doc_id, source, coalesce('s' || source, '') AS k, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS r FROM documents)
SELECT doc_id, source, (r // 32)::BIGINT AS block, s::BIGINT AS slot, (s * 32 + r % 32)::BIGINT AS position, s < h AS in_mix
FROM d JOIN slots ON d.k = slots.k AND slots.j = r // 32, horizon
"""

#: All pairs of vectors, and what each reaches by its links.
OP10 = """
WITH RECURSIVE v AS (SELECT vec_id, row_number() OVER () AS r, embedding::DOUBLE[] AS x FROM embeddings),
sound AS (SELECT r, x, len(x) AS d FROM v WHERE len(x) > 0 AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND list_max(list_transform(x, lambda e: abs(e))) > 0),
links AS (SELECT a.r AS x, b.r AS y FROM sound a JOIN sound b ON a.d = b.d AND a.r <> b.r WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
reach AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
least_of AS (SELECT reach.x AS r, min(v.vec_id) AS least FROM reach JOIN v ON reach.y = v.r GROUP BY reach.x),
n AS (SELECT x AS r, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, least) AS component_id, coalesce(vec_id <= least, true) AS kept FROM v LEFT JOIN least_of USING (r) LEFT JOIN n USING (r)
"""

#: The field of a leaf: its count of bytes in UTF-8, a colon and the value.
_FIELD = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR, '-')"
_LEAF = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))

#: Lists of hashes halved level by level, every row's siblings in them, and the hashes folded with these.
OP12 = f"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))
),
d AS (
  SELECT doc_id, coalesce('s' || lang, '') AS g, sha256({_LEAF}) AS leaf,
    CASE WHEN xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0
      THEN sha256({_LEAF.replace("n_chars", "(n_chars + 1)")}) END AS other
  FROM documents, crc
),
p AS (SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
lv AS (
  SELECT g, 0 AS level, list(leaf ORDER BY pos) AS h FROM p GROUP BY g
  UNION ALL SELECT g, level + 1, list_transform(range(1, len(h) + 1, 2), lambda i: sha256(h[i] || coalesce(h[i + 1], ''))) FROM lv WHERE len(h) > 1
),
tops AS (SELECT g, h[1] AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos FROM lv WHERE len(h) = 1),
up AS (
  SELECT 0 AS level, list(subroot ORDER BY pos) AS h FROM tops
  UNION ALL SELECT level + 1, list_transform(range(1, len(h) + 1, 2), lambda i: sha256(h[i] || coalesce(h[i + 1], ''))) FROM up WHERE len(h) > 1
),
beside AS (
  SELECT r, level, pos >> level AS k, h FROM p JOIN lv USING (g) WHERE len(h) > 1
  UNION ALL SELECT r, 100 + level, tops.pos >> level, h FROM p JOIN tops USING (g), up WHERE len(h) > 1
),
proofs AS (SELECT r, list(CASE WHEN k % 2 = 1 THEN 'L' || h[k] ELSE coalesce('R' || h[k + 2], '') END ORDER BY level) AS e FROM beside GROUP BY r)
SELECT doc_id, leaf, subroot, up.h[1] AS root, sha256(array_to_string(list_transform(coalesce(e, []), lambda x: x[2:]), '')) AS proof_sha256,
  list_reduce(list_prepend(coalesce(other, leaf), coalesce(e, [])), lambda h, x: sha256(CASE WHEN x[1] = 'L' THEN x[2:] || h ELSE h || x[2:] END)) AS folded_root, folded_root = root AS verified
FROM p JOIN tops USING (g) LEFT JOIN proofs USING (r), up WHERE len(up.h) = 1
"""

_NEAREST = """SELECT part, vec_id, any_value(label) AS label, any_value(x) AS x, min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT * 256 + entry) AS best
  FROM p JOIN {0} USING (part) GROUP BY part, vec_id"""
_MEANS = """SELECT part, entry, coalesce(m, c) AS c FROM {0} LEFT JOIN (
    SELECT part, entry, list(s - ((s % n) + n) % n ORDER BY k) AS f, any_value(n) AS n, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY k) AS m
    FROM (SELECT part, best % 256 AS entry, k, sum(x[k])::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT *, unnest(range(1, len(x) + 1)) AS k FROM {1}) GROUP BY ALL) GROUP BY part, entry
  ) USING (part, entry)"""

#: Every part against every entry, three times.
OP13 = f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda e: floor(e::DOUBLE * 256)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
),
p AS (SELECT vec_id, label, k AS part, q[k * len(q) // 16 + 1 : (k + 1) * len(q) // 16] AS x FROM v, range(16) r(k)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v QUALIFY entry < 64),
c0 AS (SELECT part, entry, x AS c FROM p JOIN first USING (vec_id)),
d0 AS ({_NEAREST.format("c0")}), c1 AS ({_MEANS.format("c0", "d0")}),
d1 AS ({_NEAREST.format("c1")}), c2 AS ({_MEANS.format("c1", "d1")}),
d2 AS ({_NEAREST.format("c2")}),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c2),
codes AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', (best % 256)::INT), '' ORDER BY part) AS code, sum(best // 256)::BIGINT AS error FROM d2 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM codes, books
"""

ORACLES: dict[str, str] = {"op13_vector_codes": OP13, "op12_merkle_manifest": OP12, "op10_vector_dedup": OP10, "op2_near_duplicates": OP2, "op3_decontamination": OP3, "op4_source_mix": OP4}
