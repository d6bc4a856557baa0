"""Identities of releases made from ``events``: each event breaks one thing of a sound document, or nothing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..tables import table
from . import identity
from .registry import registry

QUERIES, ORACLES, query = registry()

_SOUND = (
    '{"teacher":{"schema_version":3,"value_mate":32000,"max_ply":128},"engine":{"name":"engine"},"search":{"hash_mb":16,"timeout_seconds":1.5,"syzygy_probe_limit":6,"syzygy_tables":null},'
    '"board":{"board_descent_hazard":0.1,"board_frontier_p":1},"presentation":{"zero":0.1,"full":0.5,"random":0.4,"last_root":0,"random_min_fraction":0.2,"random_max_fraction":0.8},'
    '"synthesis":{"confirmatory_repetition":"faithful","claim_draw":true},"root_selection":{"source":"games","algorithm":"draw","seed":7,"requested":20,"counts":{"train":19,"val":1}},"recipe":{"joint":[]}}'
)
#: What an event's k does to the document: text and what takes its place.
_BREAKS = [
    ('"schema_version":3', '"schema_version":5'), ('"value_mate":32000', '"value_mate":"32000"'), ('"name":"engine"', '"name":""'), ('"engine":{', '"engine":{"version":1,'), ('"hash_mb":16', '"hash_mb":true'),
    ('"syzygy_probe_limit":6', '"syzygy_probe_limit":8'), ('"board_frontier_p":1', '"board_frontier_p":1.25'), ('"full":0.5', '"full":0.25'), ('"random_min_fraction":0.2', '"random_min_fraction":0.9'), ('"last_root":0,', ""),
    ("faithful", "other"), ('"claim_draw":true', '"claim_draw":1'), ('"seed":7', '"seed":7.5'), ('"val":1', '"val":2'), ('"val":1', '"test":1'), ('"recipe":{"joint":[]}', '"other":1'), ('"board":{', '"boards":{'), ('"counts":', '"source_counts":{},"counts":'),
    ("{", "["), (_SOUND, "[]"), (_SOUND, '"text"'),
]


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_K = "(CAST(json_extract_string(props, '$.k') AS BIGINT) + event_id) % 24"
_DOCUMENT = "CASE " + " ".join(f"WHEN k = {i} THEN replace({_quoted(_SOUND)}, {_quoted(a)}, {_quoted(b)})" for i, (a, b) in enumerate(_BREAKS)) + f" ELSE {_quoted(_SOUND)} END"


def _type(path: str) -> str:
    return f"coalesce(json_type(d, '$.{path}'), '')"


def _sql_keys(part: str, wanted: list[str], optional: list[str] = ()) -> str:
    own = f"list_sort(json_keys(d, '$.{part}'))"
    lists = [sorted(wanted), *([sorted([*wanted, *optional])] if optional else [])]
    return f"({_type(part)} = 'OBJECT' AND (" + " OR ".join(f"{own} = [{', '.join(map(_quoted, x))}]" for x in lists) + "))"


def _sql_int(path: str, least: int | None = None, most: int | None = None) -> str:
    out = f"{_type(path)} IN ('UBIGINT', 'BIGINT')"
    value = f"TRY_CAST(json_extract_string(d, '$.{path}') AS BIGINT)"
    return "(" + out + (f" AND coalesce({value} >= {least}, false)" if least is not None else "") + (f" AND coalesce({value} <= {most}, false)" if most is not None else "") + ")"


def _sql_number(path: str) -> str:
    return f"(CASE WHEN {_type(path)} IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN TRY_CAST(json_extract_string(d, '$.{path}') AS DOUBLE) END)"


def _sql_share(*paths: str) -> str:
    return "(" + " AND ".join(f"coalesce({_sql_number(p)} BETWEEN 0 AND 1, false)" for p in paths) + ")"


_P = "presentation."
_RULES = {f"{p}_fields": _sql_keys(p, w, identity.OPTIONAL.get(p, [])) for p, w in identity.PARTS.items() if w} | {
    "teacher_schema": f"coalesce({_sql_number('teacher.schema_version')} IN (3, 4), false)",
    "teacher_mates": f"{_sql_int('teacher.value_mate', 1)} AND {_sql_int('teacher.max_ply', 1)}",
    "engine_name": f"{_type('engine.name')} = 'VARCHAR' AND len(json_extract_string(d, '$.engine.name')) > 0",
    "search_limits": _sql_int("search.hash_mb", 1),
    "probe_limit": _sql_int("search.syzygy_probe_limit", 0, 7),
    "board_probabilities": _sql_share("board.board_descent_hazard", "board.board_frontier_p"),
    "fractions": _sql_share(*(_P + n for n in identity.FRACTIONS)),
    "fractions_sum": "coalesce(abs(" + " + ".join(_sql_number(_P + n) for n in identity.FRACTIONS) + " - 1) <= 1e-9, false)",
    "cut_interval": f"{_sql_share(_P + 'random_min_fraction', _P + 'random_max_fraction')} AND coalesce({_sql_number(_P + 'random_min_fraction')} < {_sql_number(_P + 'random_max_fraction')}, false)",
    "faithful": "coalesce(json_extract_string(d, '$.synthesis.confirmatory_repetition') = 'faithful', false)",
    "claim_draw": f"{_type('synthesis.claim_draw')} = 'BOOLEAN'",
    "selection_types": f"{_type('root_selection.source')} = 'VARCHAR' AND {_type('root_selection.algorithm')} = 'VARCHAR' AND {_sql_int('root_selection.seed')} AND {_sql_int('root_selection.requested', 1)}",
    "selection_counts": f"{_sql_keys('root_selection.counts', ['train', 'val'])} AND {_sql_int('root_selection.counts.train', 0)} AND {_sql_int('root_selection.counts.val', 0)}",
    "counts_are_rows": f"coalesce({_sql_number('root_selection.counts.train')} + {_sql_number('root_selection.counts.val')} = 20, false)",
}
_WANTED = ", ".join(f"({_quoted(p)}, {_quoted(f)}, {str(o).lower()})" for p, w in identity.PARTS.items() if w for f, o in [*((x, False) for x in w), *((x, True) for x in identity.OPTIONAL.get(p, []))])


@query(f"""
WITH e AS (SELECT event_id, {_K} AS k FROM events), t AS (SELECT event_id, {_DOCUMENT} AS x FROM e),
j AS (SELECT event_id, CASE WHEN json_valid(x) THEN x::JSON END AS d FROM t),
o AS (SELECT * FROM j WHERE json_type(d) = 'OBJECT'),
wanted(part, field, optional) AS (VALUES {_WANTED}),
parts AS (SELECT DISTINCT event_id, part, json_extract(d, '$.' || part) AS p FROM o, (SELECT DISTINCT part FROM wanted)),
own AS (SELECT event_id, part, unnest(CASE WHEN json_type(p) = 'OBJECT' THEN json_keys(p) ELSE [] END) AS field FROM parts WHERE p IS NOT NULL)
SELECT event_id AS id, 'no_identity' AS rule, '' AS detail FROM j WHERE d IS NULL OR json_type(d) <> 'OBJECT'
UNION ALL SELECT event_id, unnest(list_filter([{", ".join(f"CASE WHEN NOT ({ok}) THEN '{name}' END" for name, ok in _RULES.items())}], lambda x: x IS NOT NULL)), '' FROM o
UNION ALL SELECT event_id, 'missing_part', unnest(list_filter([{", ".join(map(_quoted, identity.PARTS))}], lambda x: NOT list_contains(json_keys(d), x))) FROM o
UNION ALL SELECT event_id, 'missing_key', part || '.' || field FROM parts JOIN wanted USING (part) ANTI JOIN own USING (event_id, part, field) WHERE p IS NOT NULL AND NOT optional
UNION ALL SELECT event_id, 'unknown_key', part || '.' || field FROM own ANTI JOIN wanted USING (part, field)
""")
def identity_problems(spark, sf_dir):
    k = (F.get_json_object("props", "$.k").cast("long") + F.col("event_id")) % 24
    document = F.lit(_SOUND)
    for i, (a, b) in enumerate(_BREAKS):
        document = F.when(F.col("k") == i, F.lit(_SOUND.replace(a, b))).otherwise(document)
    rows = table(spark, sf_dir, "events").select("event_id", k.alias("k")).select("event_id", document.alias("d"), F.lit(20).alias("n"))
    return identity.violations(rows, "event_id", "d", "n")
