"""The identity of a release, held as JSON, against its contract: nested keys, types and ranges through VARIANT."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The parts of an identity and their fields; the header's versions.
PARTS = {
    "teacher": ["max_ply", "schema_version", "value_mate"],
    "engine": ["name"],
    "search": ["hash_mb", "syzygy_probe_limit", "syzygy_tables", "timeout_seconds"],
    "board": ["board_descent_hazard", "board_frontier_p"],
    "presentation": ["full", "last_root", "random", "random_max_fraction", "random_min_fraction", "zero"],
    "synthesis": ["claim_draw", "confirmatory_repetition"],
    "root_selection": ["algorithm", "counts", "requested", "seed", "source"],
    "recipe": None,
}
OPTIONAL = {"root_selection": ["source_counts"]}
SCHEMAS = (3, 4)
FRACTIONS = ("zero", "full", "random", "last_root")


class Reading:
    """A document (a variant) of which each thing that rules ask for is read once, as a column of its own: ``held`` has
    their names and what they are."""

    def __init__(self, v: Column):
        self.v, self.held = v, {}

    def _once(self, what: str, path: str, made: Callable[[], Column]) -> Column:
        name = f"_{what}_{path.replace('.', '__')}"
        if name not in self.held:
            self.held[name] = made()
        return F.col(name)

    def at(self, path: str) -> Column:
        """What the document has at a path (a variant), null where there is nothing."""
        return F.try_variant_get(self.v, f"$.{path}", "variant") if path else self.v

    def kind(self, path: str = "") -> Column:
        """Its type's name: OBJECT, STRING, BIGINT, DOUBLE, DECIMAL, BOOLEAN, VOID and the like, without parameters."""
        return self._once("kind", path, lambda: F.regexp_extract(F.schema_of_variant(self.at(path)), "^[A-Z]+", 0))

    def text(self, path: str) -> Column:
        return self._value(path, "string")

    def _value(self, path: str, kind: str) -> Column:
        return self._once(kind, path, lambda: F.try_variant_get(self.v, f"$.{path}", kind))

    def is_int(self, path: str, least: int | None = None, most: int | None = None) -> Column:
        value = self._value(path, "bigint")
        ok = F.coalesce(self.kind(path) == "BIGINT", F.lit(False))
        ok &= F.coalesce(value >= least, F.lit(False)) if least is not None else F.lit(True)
        return ok & F.coalesce(value <= most, F.lit(False)) if most is not None else ok

    def number(self, path: str) -> Column:
        """The number there as a double; null for anything else."""
        return F.when(self.kind(path).isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), self._value(path, "double"))

    def is_probability(self, path: str) -> Column:
        return F.coalesce(self.number(path).between(0, 1), F.lit(False))

    def is_text(self, path: str) -> Column:
        return F.coalesce(self.kind(path) == "STRING", F.lit(False))

    def keys(self, path: str = "") -> Column:
        """The keys of an object in order; null where there is none."""
        read = lambda: F.sort_array(F.json_object_keys(F.to_json(self.at(path))))
        is_object = F.regexp_extract(F.schema_of_variant(self.at(path)), "^[A-Z]+", 0) == "OBJECT"
        return self._once("keys", path, lambda: F.when(is_object, read()))

    def has_keys(self, path: str, wanted: list[str], optional: list[str] = ()) -> Column:
        found = self.keys(path)
        right = found == F.array(*map(F.lit, sorted(wanted)))
        if optional:
            right |= found == F.array(*map(F.lit, sorted([*wanted, *optional])))
        return F.coalesce(right, F.lit(False))

    def key_problems(self, path: str, wanted: list[str], optional: list[str] = ()) -> Column:
        """Structs (rule, detail): each wanted key that an object lacks and each that nobody knows, by name; none where
        the path is not there."""
        found = F.coalesce(self.keys(path), F.array().cast("array<string>"))
        there = self._once("there", path, lambda: self.at(path).isNotNull())
        lacks = F.array_except(F.array(*map(F.lit, wanted)), found)
        others = F.array_except(found, F.array(*map(F.lit, [*wanted, *optional])))
        lead = F.lit(path + "." if path else "")
        return F.when(there, F.concat(_named("missing_key", lacks, lead), _named("unknown_key", others, lead))).otherwise(_NONE())


def _named(rule: str, details: Column, lead: Column) -> Column:
    return F.transform(details, lambda k: F.struct(F.lit(rule).alias("rule"), F.concat(lead, k).alias("detail")))


def _NONE() -> Column:
    return F.array().cast("array<struct<rule:string,detail:string>>")


def rules(v: Reading, rows: Column) -> dict[str, Column]:
    """Name to what must hold; a part that lacks fields breaks its first rule and those of the fields."""
    fields = {f"{p}_fields": v.has_keys(p, wanted, OPTIONAL.get(p, [])) for p, wanted in PARTS.items() if wanted}
    counts = [v.number(f"root_selection.counts.{s}") for s in ("train", "val")]
    fractions = [v.number(f"presentation.{n}") for n in FRACTIONS]
    lowest, highest = (v.number(f"presentation.random_{n}_fraction") for n in ("min", "max"))
    true: Callable[[Column], Column] = lambda c: F.coalesce(c, F.lit(False))
    return fields | {
        "teacher_schema": true(v.number("teacher.schema_version").isin(*SCHEMAS)),
        "teacher_mates": v.is_int("teacher.value_mate", 1) & v.is_int("teacher.max_ply", 1),
        "engine_name": v.is_text("engine.name") & true(F.length(v.text("engine.name")) > 0),
        "search_limits": v.is_int("search.hash_mb", 1),
        "probe_limit": v.is_int("search.syzygy_probe_limit", 0, 7),
        "board_probabilities": v.is_probability("board.board_descent_hazard") & v.is_probability("board.board_frontier_p"),
        "fractions": v.is_probability("presentation.zero") & v.is_probability("presentation.full") & v.is_probability("presentation.random") & v.is_probability("presentation.last_root"),
        "fractions_sum": true(F.abs(sum(fractions[1:], fractions[0]) - 1) <= 1e-9),
        "cut_interval": v.is_probability("presentation.random_min_fraction") & v.is_probability("presentation.random_max_fraction") & true(lowest < highest),
        "faithful": true(v.text("synthesis.confirmatory_repetition") == "faithful"),
        "claim_draw": true(v.kind("synthesis.claim_draw") == "BOOLEAN"),
        "selection_types": v.is_text("root_selection.source") & v.is_text("root_selection.algorithm") & v.is_int("root_selection.seed") & v.is_int("root_selection.requested", 1),
        "selection_counts": v.has_keys("root_selection.counts", ["train", "val"]) & v.is_int("root_selection.counts.train", 0) & v.is_int("root_selection.counts.val", 0),
        "counts_are_rows": true(counts[0] + counts[1] == rows),
    }


def violations(df: DataFrame, key: str, document: str, rows: str) -> DataFrame:
    """(id, rule, detail) of identities (a JSON text each, and how many roots its release has): what is no JSON object,
    missing parts, missing or unknown fields by name, and broken rules. One scan: a text is parsed once, and each of its
    fields is looked at once for all rules."""
    v = Reading(F.col("_v"))
    checks = F.array_compact(F.array(*(F.when(~ok, F.lit(name)) for name, ok in rules(v, F.col("_n")).items())))
    lacking = F.array_except(F.array(*map(F.lit, PARTS)), v.keys())
    broken = F.transform(checks, lambda name: F.struct(name.alias("rule"), F.lit("").alias("detail")))
    fields = [v.key_problems(p, wanted, OPTIONAL.get(p, [])) for p, wanted in PARTS.items() if wanted]
    found = F.concat(broken, _named("missing_part", lacking, F.lit("")), *fields)
    none = F.array(F.struct(F.lit("no_identity").alias("rule"), F.lit("").alias("detail")))
    is_object = F.coalesce(v.kind() == "OBJECT", F.lit(False))
    # rows of an array of one, as a plain column would be written into each place that names it and parsed there
    read = df.select(F.col(key).alias("id"), F.col(rows).alias("_n"), F.explode(F.array(F.try_parse_json(document))).alias("_v"))
    # outer, as a plain inline would have all rules worked out once more, from the text, to tell whether any is broken
    looked = read.select("id", "_n", *(made.alias(name) for name, made in v.held.items()))
    return looked.select("id", F.when(is_object, found).otherwise(none).alias("_p")).select("id", F.inline_outer("_p")).where("rule IS NOT NULL")
