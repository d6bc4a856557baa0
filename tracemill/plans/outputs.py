"""Outputs of a run that are there whole or not at all: root pools, evaluations, profiles.

    path/<part>-<run>/     the rows of a part, by one Spark job
    path/manifest.json     names the folders, with counts and digests; created last, only if no one else has

A run that dies leaves folders that no manifest names, and its successor starts over. Counts and digests are gathered
while the rows are written, at no scan of their own; ``check`` holds what is there against them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import draws
from ..functions.values import percent
from ..operators import evaluation, sampling
from ..operators.references import violations
from ..tables import positions
from .commits import Conflict, _Folder

MANIFEST = "manifest.json"


def _digest(df: DataFrame) -> Column:
    """A number of all rows that their order does not change; null fields count as such."""
    return F.coalesce(F.sum(F.xxhash64(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).cast("decimal(38,0)")), F.lit(0)).cast("string")


def _written(df: DataFrame, path: str, name: str, order: list[str]) -> dict:
    """Write a part as JSON lines, in files that follow ``order`` where one is given; what was written."""
    spark, folder = df.sparkSession, f"{name}-{uuid.uuid4().hex}"
    seen = Observation(folder)
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    watched = rows.observe(seen, F.count(F.lit(1)).alias("rows"), _digest(df).alias("digest"))
    watched.write.option("ignoreNullFields", "false").option("compression", "gzip").json(_Folder(spark, path).at(folder).toString())
    return {"folder": folder, "schema": df.schema.json(), "rows": 0, "digest": "0"} | seen.get


def publish(parts: dict[str, DataFrame], path: str, facts: dict, order: dict[str, list[str]] | None = None) -> dict:
    """Write all parts and then the manifest: ``facts`` and what each part holds. An output that is there already is an
    error, and then what this run wrote is deleted."""
    spark = next(iter(parts.values())).sparkSession
    made = {name: _written(df, path, name, (order or {}).get(name, [])) for name, df in parts.items()}
    return _named(spark, path, facts, made)


def _named(spark: SparkSession, path: str, facts: dict, made: dict[str, dict]) -> dict:
    folder, content = _Folder(spark, path), facts | {"parts": made}
    if not folder.create(content, MANIFEST):
        for part in made.values():
            folder.delete(part["folder"])
        raise Conflict(f"{path} has an output already")
    return content


def manifest(spark: SparkSession, path: str) -> dict:
    return _Folder(spark, path).read(MANIFEST)


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    part = manifest(spark, path)["parts"][name]
    return _part(spark, path, part)


def _part(spark: SparkSession, path: str, part: dict) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(part["schema"]))
    return spark.read.schema(schema).option("mode", "FAILFAST").json(_Folder(spark, path).at(part["folder"]).toString())


def check(spark: SparkSession, path: str) -> dict[str, str]:
    """Each part that is not what its manifest says, and why: rows or content."""
    out = {}
    for name, part in manifest(spark, path)["parts"].items():
        df = _part(spark, path, part)
        found = df.agg(F.count(F.lit(1)).alias("rows"), _digest(df).alias("digest")).first()
        if found["rows"] != part["rows"]:
            out[name] = "rows"
        elif found["digest"] != part["digest"]:
            out[name] = "content"
    return out


# Root pools --------------------------------------------------------------------------------------------------


def write_pool(pool: DataFrame, path: str, settings: dict) -> dict:
    """A pool (``prepare.prepare``: place and the roots' fields) in its own order, with what it was drawn by and how many
    roots each split has."""
    counts = {r["split"]: r["count"] for r in pool.groupBy("split").count().collect()}  # a row a split
    return publish({"roots": pool}, path, {"settings": settings, "splits": counts}, {"roots": ["place"]})


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    """The roots with ``line``, their number from 0 in the order of the files."""
    at = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    rows = read(spark, path, "roots").select("*", at.alias("_at")).withColumn("_id", F.monotonically_increasing_id())
    return positions(rows, ["_at", "_id"], "line").drop("_at", "_id")


# Evaluations -------------------------------------------------------------------------------------------------


def unfit_roots(roots: DataFrame, key: str) -> DataFrame:
    """(id, rule, detail) of positions that cannot be evaluated, as their fields alone show (fen, repetition): no six
    fields, a side or counters that are none, not one king a side, a repetition below 1 or one that ended the game (five
    times, or 150 half-moves). A null repetition counts as the first."""
    fields = F.split("fen", " ")
    part = lambda i: F.get(fields, F.lit(i))
    kings = lambda k: F.regexp_count(part(0), F.lit(k)) == 1
    repetition = F.coalesce("repetition", F.lit(1))
    rules = {
        "fields": F.size(fields) == 6,
        "side": part(1).isin("w", "b"),
        "counters": part(4).rlike("^[0-9]+$") & part(5).rlike("^[0-9]+$"),
        "kings": kings("K") & kings("k"),
        "repetition": repetition >= 1,
        "over": (repetition < 5) & (F.coalesce(part(4).try_cast("int"), F.lit(0)) < 150),
    }
    return violations(roots, rules, key, F.col("fen"))


def evaluation_roots(roots: DataFrame, key: str, most: int | None = None, seed: str = "") -> DataFrame:
    """The roots to evaluate: all, or the ``most`` of smallest draw. One that cannot be is an error, not left out."""
    bad = unfit_roots(roots, key).limit(1).collect()
    if bad:
        raise ValueError(f"root {bad[0]['id']} cannot be evaluated: {bad[0]['rule']}")
    return roots if most is None else sampling.smallest(roots.withColumn("_draw", draws.draw(seed, F.col(key))), most, "_draw", key).drop("_draw")


def write_evaluation(answers: DataFrame, path: str, by: list[str], settings: dict) -> dict:
    """Answers as positions and their summary (``evaluation.summary``), overall and by ``by``. The summary is made from
    what was written, so the answers are worked out once."""
    spark = answers.sparkSession
    made = {"positions": _written(answers, path, "positions", [])}
    rows = _part(spark, path, made["positions"])
    whole = evaluation.summary(rows.withColumns({c: F.lit("overall") for c in by}), by)
    parts = evaluation.summary(rows.withColumns({c: F.col(c).cast("string") for c in by}), by)
    made["summary"] = _written(whole.unionByName(parts), path, "summary", [])
    return _named(spark, path, {"settings": settings}, made)


# Profiles ----------------------------------------------------------------------------------------------------


def profile_text(title: str, curve: list[dict]) -> str:
    """A table for people: a line for each vocabulary size, part and slice. ``curve`` has the texts already."""
    head = ["size", "part", "section", "value", "documents", "tokens", "atoms", "percent"]
    rows = ["| " + " | ".join(str(r[h]) for h in head) + " |" for r in curve]
    return "\n".join([f"# {title}", "", "| " + " | ".join(head) + " |", "|" + "|".join("-" for _ in head) + "|", *rows, ""])


def write_profile(curve: DataFrame, path: str, title: str, settings: dict) -> dict:
    """The compression curve (``fits.tiers``) as rows and as a text. It has a row a size, part and slice, so it is short."""
    spark = curve.sparkSession
    shown = curve.withColumn("percent", percent(F.col("ratio")))
    made = {"curve": _written(shown, path, "curve", ["size", "part", "section", "value"])}
    lines = [r.asDict() for r in _part(spark, path, made["curve"]).orderBy("size", "part", "section", "value").collect()]
    return _named(spark, path, {"settings": settings, "text": profile_text(title, lines)}, made)
