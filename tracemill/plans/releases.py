"""Releases of trace rows: sharded writes, the registry, validation, statistics, export."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import draws
from ..functions.arrays import is_ragged_sound
from ..functions.vocabulary import COMPOSITE
from ..operators import packing, segmentation
from ..operators.profiles import interpolated
from ..operators.references import violations

SHARED = ["fen", "presentation", "repetition", "turn", "teacher_depth", "teacher_width", "trace_text", "final_move", "final_value", "mate_distance", "source"]
LOCAL = ["root_id", "split", "trace_atom_ids", "trace_atom_count", "state_best", "state_value"]
FORMAT = 12


def unpublished(roots: DataFrame, published: DataFrame, dropped: DataFrame) -> DataFrame:
    """Roots that are neither in the release nor given up."""
    return roots.join(published.select("root_id"), "root_id", "left_anti").join(dropped.select("root_id"), "root_id", "left_anti")


def attempts(status: DataFrame, most: int = 3) -> DataFrame:
    """What a run does with each root next, from its attempts so far (root_id, outcome): done, retry, drop."""
    seen = status.groupBy("root_id").agg(F.count_if(F.col("outcome") == "failed").alias("failed"), F.bool_or(F.col("outcome") == "done").alias("done"))
    return seen.select("root_id", F.when(F.col("done"), "done").when(F.col("failed") >= most, "drop").otherwise("retry").alias("next"))


def publish(rows: DataFrame, path: str, shards: int) -> None:
    """Write ``rows`` by split and shard; a root's shard comes from a hash of its id, so a rerun of the same
    roots overwrites exactly its own shards and leaves the others alone."""
    shard = F.pmod(F.xxhash64("root_id"), F.lit(shards)).cast("int")
    out = rows.withColumn("shard", shard).repartition("split", "shard")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("split", "shard").parquet(path)


def manifest(spark: SparkSession, path: str, identity: dict) -> dict:
    """Counts of a published release under an id of its identity, for the caller to store; small by nature."""
    rows = spark.read.parquet(path)
    counts = {f"{r['split']}/{r['shard']}": r["n"] for r in rows.groupBy("split", "shard").agg(F.count("*").alias("n")).collect()}
    name = hashlib.sha256(json.dumps(identity, sort_keys=True).encode()).hexdigest()[:16]
    return {"format_version": FORMAT, "dataset_id": name, "identity": identity, "rows": sum(counts.values()), "shards": dict(sorted(counts.items()))}


def problems(rows: DataFrame, roots: DataFrame, dropped: DataFrame) -> DataFrame:
    """(id, rule, detail) of a release against the roots it was made from."""
    c = F.col
    own = violations(
        rows,
        {
            "atoms": is_ragged_sound(c("trace_atom_ids"), c("trace_atom_count"), COMPOSITE),
            "states": F.size("state_best") == F.size("state_value"),
            "repetition": c("repetition").between(1, 4),
            "turn": c("turn") == F.when(F.split("fen", " ")[1] == "w", "white").otherwise("black"),
            "final_value": c("final_value").isNull() | c("final_value").between(-1, 1),
            "presentation": c("presentation").isin("zero", "full", "random"),
        },
        "root_id",
        c("presentation"),
    )
    twice = rows.groupBy("root_id", "presentation").agg(F.count("*").alias("n")).where("n > 1").select(c("root_id").alias("id"), F.lit("one_row").alias("rule"), c("n").cast("string").alias("detail"))
    both = rows.join(dropped.select("root_id"), "root_id", "left_semi").select(c("root_id").alias("id"), F.lit("dropped_and_published").alias("rule"), F.lit(None).cast("string").alias("detail"))
    met = rows.select("root_id", c("fen").alias("_fen"), c("split").alias("_split")).join(roots.select("root_id", "fen", "split"), "root_id", "full_outer")
    other = F.when(c("fen").isNull(), "unselected").when(c("_fen").isNull(), "missing").when((c("fen") != c("_fen")) | (c("split") != c("_split")), "changed")
    apart = met.withColumn("rule", other).where("rule IS NOT NULL").join(dropped.select("root_id", F.lit(True).alias("_gone")), "root_id", "left").where("NOT (rule = 'missing' AND coalesce(_gone, false))")
    return own.unionByName(twice).unionByName(both).unionByName(apart.select(c("root_id").alias("id"), "rule", F.lit(None).cast("string").alias("detail")))


def encode_documents(rows: DataFrame, order: list[str], prefix: str, atoms: str, dictionary: DataFrame, cap: int) -> DataFrame:
    """``rows`` as documents of a training set: tokens (the board's ``prefix``, then the trace encoded), length, and
    place and start in the given order. A document over ``cap`` is an error, as none is cut or left out."""
    encoded = segmentation.encode(rows, atoms, dictionary, "_encoded").withColumn("tokens", F.concat(prefix, "_encoded")).drop("_encoded")
    length = F.size("tokens")
    sized = encoded.withColumn("length", F.when(length > cap, F.raise_error(F.concat(F.lit(f"a document has more than {cap} tokens: "), length.cast("string"))).cast("int")).otherwise(length))
    return packing.offsets(sized, order, "length")


def _search(key: Column, seed: str, searches: list[tuple[int | str, int, float]]) -> Column:
    """The struct (width, depth) that a root draws; a null width stands for all its moves."""
    made = [(F.struct(F.lit(None if w == "full" else w).cast("int").alias("width"), F.lit(d).alias("depth")), p) for w, d, p in searches]
    return draws.by_weight(draws.uniform(seed, key, "search"), made)


def root_settings(roots: DataFrame, seed: str, searches: list[tuple[int | str, int, float]], mix: list[tuple[str, float]]) -> DataFrame:
    """``roots`` (root_id, legal_width: how many moves the root has) with what the seed and the id draw for each: depth,
    teacher_width ("full" is all moves), effective_width (no more than there are moves) and presentation."""
    drawn = roots.withColumn("_q", _search(F.col("root_id"), seed, searches))
    width = F.coalesce("_q.width", "legal_width")
    kind = draws.by_weight(draws.uniform(seed, F.col("root_id"), "presentation"), mix)
    return drawn.withColumns({"depth": F.col("_q.depth"), "teacher_width": width, "effective_width": F.least(width, F.col("legal_width")), "presentation": kind}).drop("_q")


def settings_problems(rows: DataFrame, seed: str, mix: list[tuple[str, float]], searches: list[tuple[int | str, int, float]] | None = None) -> DataFrame:
    """(id, rule, detail) where a stored presentation or split, and with ``searches`` also a width or depth (teacher_width,
    teacher_depth and legal_width of the rows), is not what the seed and the root's id draw. detail is what is drawn, for a split what is stored."""
    c = F.col
    checks = {"presentation_drawn": ("presentation", draws.by_weight(draws.uniform(seed, c("root_id"), "presentation"), mix)), "split_drawn": ("split", draws.split_of(c("root_id")))}
    if searches:
        drawn = _search(c("root_id"), seed, searches)
        checks |= {"width_drawn": ("teacher_width", F.coalesce(drawn["width"], c("legal_width"))), "depth_drawn": ("teacher_depth", drawn["depth"])}
    differs = (F.when(~c(name).eqNullSafe(of), F.struct(F.lit(rule).alias("rule"), (c(name) if rule == "split_drawn" else of).cast("string").alias("detail"))) for rule, (name, of) in checks.items())
    return rows.select(c("root_id").alias("id"), F.inline(F.filter(F.array(*differs), lambda r: r.isNotNull())))


def unmatched(rows: DataFrame, champions: DataFrame) -> DataFrame:
    """(id, rule, detail) of roots that have a row or a champion but not both."""
    left, right = rows.select("root_id", F.lit(1).alias("_row")).distinct(), champions.select("root_id", F.lit(1).alias("_champion")).distinct()
    met = left.join(right, "root_id", "full_outer").where("_row IS NULL OR _champion IS NULL")
    return met.select(F.col("root_id").alias("id"), F.when(F.col("_row").isNull(), "no_row").otherwise("no_champion").alias("rule"), F.lit("").alias("detail"))


def statistics(rows: DataFrame) -> DataFrame:
    """Lengths per presentation: count, mean and interpolated percentiles."""
    sizes = rows.select("presentation", "root_id", F.col("trace_atom_count").cast("double").alias("n_atoms"))
    return interpolated(sizes, ["presentation"], "n_atoms", ["root_id"], [10, 50, 90]).join(sizes.groupBy("presentation").agg(F.avg("n_atoms").alias("mean")), "presentation")


def export(rows: DataFrame, path: str) -> None:
    """The shared columns alone, by the split names that data sets use."""
    split = F.when(F.col("split") == "val", "validation").otherwise("train")
    rows.select(split.alias("split"), *SHARED).write.mode("overwrite").option("compression", "zstd").partitionBy("split").parquet(path)
