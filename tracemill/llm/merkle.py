"""A Merkle manifest of a table: a store of hash nodes in Parquet, and proofs read from it by coordinate.

1. A row's leaf is the hash of its fields. Within each group the leaves ascend by id: they are dealt to sorted runs,
   and a run's place comes from one row per run and group, so that no group is ever sorted in one task.
2. The store is partitioned by level; a node's coordinate is (group, level, pos). Every two consecutive nodes of a
   level become one of the next, a last single one too, until one node is left. A block of 2^STEP consecutive nodes
   is read once, in order, and gives its STEP levels, each from the one below; the next pass reads the last of these
   levels alone. So a table of any size takes log2(rows) / STEP passes, and a task holds one block.
3. The groups' roots are the leaves of one more such tree.
4. Proofs come from the top: a block of the store, in the order of its coordinates, meets the one path that leads
   from its upper end to the root, and puts the siblings inside the block in front of it. Paths of inner nodes go
   down a pass as rows, one for each 2^STEP nodes below; only the leaves' own paths are as many as the rows.

Cases: a null field hashes as "-", and a null group is one of its own before all others; an empty text is 0 bytes, and
texts of any length are hashed whole; null ids come first; rows of one id are ordered by their leaves, so repeated rows
stand side by side, each with a proof of its own; a group of one row has its leaf as root; an empty table gives an empty
result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import cut, owned, shared_dir

#: Levels of a block: 2^STEP nodes are held at a time.
STEP = 10

_NODE = "g string, level int, pos long, n long, hash string"


def field(x: Column) -> Column:
    """A value as it is hashed: its bytes in UTF-8, counted."""
    s = x.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_hash(*columns: Column) -> Column:
    return F.sha2(F.concat(*(field(c) for c in columns)), 256)


def group_key(x: Column) -> Column:
    """The group's name as text that sorts null first and else by bytes."""
    return F.coalesce(F.concat(F.lit("s"), x.cast("string")), F.lit(""))


def _hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def _height(n: int) -> int:
    """Levels above the leaves."""
    return (n - 1).bit_length()


class Store:
    """The nodes of one tree per group: Parquet at ``path``, partitioned by level, level 0 with what came with it."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, passes: int):
        self.spark, self.path, self.schema, self.passes = spark, path, schema, passes

    def nodes(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def levels(self, first: int, last: int) -> DataFrame:
        return self.nodes().where(F.col("level").between(first, last))

    def tops(self) -> DataFrame:
        """(g, n, hash) of each group's root."""
        return self.nodes().where(F.expr("shiftright(n - 1, level) = 0")).select("g", "n", "hash")


def placed(leaves: DataFrame) -> DataFrame:
    """``leaves`` (g, id, hash, ...) with pos, the place within g by id and hash, and n, the leaves of g."""
    order = [F.col("g"), F.col("id").asc_nulls_first(), F.col("hash"), F.col("_row")]
    rows = leaves.withColumn("_row", F.monotonically_increasing_id())
    runs = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_row").withColumn("_at", F.monotonically_increasing_id()))
    run = F.shiftright("_at", 33).alias("_run")
    per_run = runs.groupBy(run, "g").agg(F.min("_at").alias("_first"), F.count("*").alias("_m"))
    of_group = Window.partitionBy("g")
    earlier = of_group.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_m").over(earlier), F.lit(0))
    starts = cut(per_run.select("_run", "g", (before - F.col("_first")).alias("_shift"), F.sum("_m").over(of_group).alias("n")))
    joined = runs.withColumn("_run", run).join(starts, ["_run", "g"])
    return joined.select(*leaves.columns, (F.col("_at") + F.col("_shift")).alias("pos"), "n")


def _raised(base: int):
    """All levels of a block above ``base``."""

    def up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        g, n, pos, row = pdf["g"].iloc[0], int(pdf["n"].iloc[0]), int(pdf["pos"].iloc[0]), pdf["hash"].tolist()
        out = []
        for level in range(base + 1, min(base + STEP, _height(n)) + 1):
            pos >>= 1
            row = [_hash("".join(row[k : k + 2])) for k in range(0, len(row), 2)]
            out += [(g, level, pos + k, n, h) for k, h in enumerate(row)]
        return pd.DataFrame(out, columns=["g", "level", "pos", "n", "hash"])

    return up


def build(leaves: DataFrame) -> Store:
    """The store of ``leaves`` (g, id, hash and what else is to come with a leaf), written level by level."""
    spark = leaves.sparkSession
    path = f"{shared_dir(spark)}/tracemill-{uuid.uuid4().hex}"
    first = placed(leaves)
    first.withColumn("level", F.lit(0)).write.partitionBy("level").parquet(path)
    store = Store(spark, path, T.StructType([*first.schema, T.StructField("level", T.IntegerType())]), 0)
    owned(store.nodes(), path)
    most = store.levels(0, 0).agg(F.max("n")).first()[0] or 0
    while most > 1 << STEP * store.passes:
        base = STEP * store.passes
        below = store.levels(base, base).where(F.col("n") > F.lit(1 << base)).select("g", "pos", "n", "hash")
        blocks = below.groupBy("g", F.shiftright("pos", STEP).alias("block")).applyInPandas(_raised(base), _NODE)
        blocks.write.mode("append").partitionBy("level").parquet(path)
        store.passes += 1
    return store


def _lowered(base: int, kept: list[str]):
    """Paths of a block's lowest nodes: the siblings inside the block before the path of its upper end."""

    def down(nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        n, over = int(nodes["n"].iloc[0]), list(above["path"].iloc[0])
        top = min(base + STEP, _height(n))
        by_level = {level: part.sort_values("pos") for level, part in nodes.groupby("level")}
        paths = [over]
        for level in range(top - 1, base - 1, -1):
            row = by_level[level]["hash"].tolist()
            beside = [("L" + row[k - 1] if k % 2 else "R" + row[k + 1] if k + 1 < len(row) else "") for k in range(len(row))]
            paths = [[beside[k], *paths[k // 2]] for k in range(len(row))]
        out = by_level[base].reset_index(drop=True)[kept]
        return out.assign(path=paths, subroot=above["subroot"].iloc[0], root=above["root"].iloc[0])

    return down


def paths(store: Store, tops: DataFrame) -> DataFrame:
    """Level 0 of ``store`` with each leaf's path: ``tops`` (g, n, path, subroot, root) says how it goes on above.

    An entry of a path is a sibling's hash after "L" or "R", its side, or empty where the node had none.
    """
    leaf_columns = [c for c in store.schema.names if c != "level"]
    handed = None  # paths from the pass above, by block
    for k in range(max(store.passes, 1) - 1, -1, -1):
        base = STEP * k
        kept = ["g", "pos", "n"] if k else leaf_columns
        ends = tops.where((F.col("n") <= F.lit(1 << base + STEP)) & (F.col("n") > F.lit((1 << base) if k else 0)))
        over = ends.select("g", F.lit(0).cast("long").alias("block"), "path", "subroot", "root")
        over = over if handed is None else over.unionByName(handed)
        blocks = store.levels(base, base + STEP - 1).where((F.col("n") > F.lit(1 << base)) | (F.col("level") == 0))
        blocks = blocks.where((F.col("level") == base) | F.expr("shiftright(n - 1, level) > 0"))
        blocks = blocks.withColumn("block", F.expr(f"shiftright(pos, {base + STEP} - level)"))
        fields = [f for f in store.schema if f.name in kept] + list(T.StructType.fromDDL("path array<string>, subroot string, root string"))
        met = blocks.groupBy("g", "block").cogroup(over.groupBy("g", "block")).applyInPandas(_lowered(base, kept), T.StructType(sorted(fields, key=lambda f: [*kept, "path", "subroot", "root"].index(f.name))))
        if k:
            handed = cut(met.select("g", F.col("pos").alias("block"), "path", "subroot", "root"))
    return met


def manifest(rows: DataFrame, group: str, id_col: str, fields: list[str], carry: Column | None = None) -> DataFrame:
    """Per row: g (see ``group_key``), id, leaf, what ``carry`` says of the row, its proof up to the table's root,
    the group's root and the table's."""
    leaves = rows.select(group_key(F.col(group)).alias("g"), F.col(id_col).alias("id"), leaf_hash(*(F.col(c) for c in fields)).alias("hash"), (F.lit(None).cast("string") if carry is None else carry).alias("carried"))
    store = build(cut(leaves))  # texts are read and hashed once
    tops = cut(store.tops())
    upper = build(tops.select(F.lit("").alias("g"), F.col("g").alias("id"), "hash", F.col("n").alias("below")))
    end = upper.tops().select("g", "n", F.array().cast("array<string>").alias("path"), F.lit("").alias("subroot"), F.col("hash").alias("root"))
    above = cut(paths(upper, end).select(F.col("id").alias("g"), F.col("below").alias("n"), "path", F.col("hash").alias("subroot"), "root"))
    return paths(store, above).select("g", "id", F.col("hash").alias("leaf"), "carried", F.col("path").alias("proof"), "subroot", "root")


def siblings_hash(proof: Column) -> Column:
    """The hash of a proof's siblings, from the leaf upwards."""
    return F.sha2(F.array_join(F.transform(proof, lambda e: F.substr(e, F.lit(2))), ""), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf gives with its proof."""
    other = lambda e: F.substr(e, F.lit(2))
    return F.aggregate(proof, leaf, lambda h, e: F.sha2(F.when(e.startswith("L"), F.concat(other(e), h)).otherwise(F.concat(h, other(e))), 256))
