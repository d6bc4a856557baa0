"""A release that several writers extend: files are staged aside, then one small file makes them a version.

    path/data/writer=<id>/split=<s>/shard=<n>/    rows, written by one Spark job
    path/data/writer=<id>.facts.json              what the writer covers and counted; its presence says "complete"
    path/commits/<version>.json                   the shards a version adds, created only if no one else has

Readers follow the commits, so they see whole versions. A writer that dies before its commit leaves files that no
version names: ``recover`` checks them against their facts and commits or deletes them. A shard has one owner: a
second one is refused unless it says that it replaces, and then the former rows leave with the same commit, also
where the new writer has none for that shard. Two writers that race for a version meet at its file; who comes second
looks at what the first has added and takes the next number.
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Versions that a writer tries for before it gives up.
TRIES = 100


class Conflict(RuntimeError):
    """Another writer has the shard."""


class _Folder:
    """The few file operations of a release, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.root = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, *names: str):
        out = self.root
        for n in names:
            out = self.jvm.org.apache.hadoop.fs.Path(out, n)
        return out

    def names(self, folder: str) -> list[str]:
        at = self.at(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, *names: str) -> dict:
        stream = self.fs.open(self.at(*names))
        try:
            return json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def create(self, content: dict, *names: str) -> bool:
        """Write a file that is not there yet, whole or not at all; whether it was this call that made it."""
        target, aside = self.at(*names), self.at("aside", uuid.uuid4().hex)
        stream = self.fs.create(aside, False)
        stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        stream.close()
        self.fs.mkdirs(target.getParent())
        try:
            if target.toUri().getScheme() in (None, "file"):  # a rename there would replace
                try:
                    os.link(urlparse(aside.toString()).path, urlparse(target.toString()).path)
                    return True
                except FileExistsError:
                    return False
            return not self.fs.exists(target) and self.fs.rename(aside, target)
        finally:
            self.fs.delete(aside, False)

    def delete(self, *names: str) -> None:
        self.fs.delete(self.at(*names), True)


def registry(spark: SparkSession, path: str) -> dict:
    """{version, identity, shards}: the release as its commits say; a shard has its writer, rows and version."""
    folder = _Folder(spark, path)
    out = {"version": 0, "identity": None, "shards": {}}
    for name in folder.names("commits"):
        commit = folder.read("commits", name)
        out["version"] = commit["version"]
        out["identity"] = commit["identity"]
        for shard, rows in commit["shards"].items():
            out["shards"][shard] = {"writer": commit["writer"], "rows": rows, "version": commit["version"]}
    return out


def stage(rows: DataFrame, path: str, covers: list[tuple[str, int]], identity: dict, keys: list[str], totals: dict | None = None, replace: bool = False) -> str:
    """Write ``rows`` (split, shard and others) aside and return the writer's name. ``covers`` names all (split, shard)
    that the writer stands for, with rows or without; ``totals`` (name to aggregate) are gathered while the rows are
    written, at no scan of their own, with n_rows and a digest of ``keys`` that no order changes."""
    spark, writer = rows.sparkSession, uuid.uuid4().hex
    folder = _Folder(spark, path)
    seen = Observation(f"release {writer}")
    inside = F.concat_ws("/", "split", "shard").isin([f"{s}/{k}" for s, k in covers])
    digest = F.sum(F.xxhash64(*keys).cast("decimal(38,0)")).cast("string")
    gathered = {"n_rows": F.count(F.lit(1)), "digest": digest, "strays": F.count_if(~inside), **(totals or {})}
    watched = rows.repartition("split", "shard").observe(seen, *(c.alias(n) for n, c in gathered.items()))
    target = folder.at("data", f"writer={writer}").toString()
    watched.write.option("compression", "zstd").partitionBy("split", "shard").parquet(target)
    facts = {k: _plain(v) for k, v in seen.get.items()}
    if facts.pop("strays", 0):
        folder.delete("data", f"writer={writer}")
        raise ValueError("rows of shards that the writer does not cover")
    facts = {"n_rows": 0, "digest": None} | facts
    content = {"identity": identity, "keys": keys, "replace": replace, "schema": rows.schema.json(), "facts": facts, "shards": _sizes(spark, target, covers), "base": registry(spark, path)["version"]}
    folder.create(content, "data", f"writer={writer}.facts.json")
    return writer


def _plain(v):
    return v if v is None or isinstance(v, int | float | str | bool) else float(v)


def _sizes(spark: SparkSession, target: str, covers: list[tuple[str, int]]) -> dict[str, int]:
    """Rows by shard, from the files' footers: no column is read."""
    out = {f"{s}/{k}": 0 for s, k in covers}
    if out:
        try:
            df = spark.read.parquet(target)
        except Exception as e:
            if "UNABLE_TO_INFER_SCHEMA" in str(e):  # no rows, so no files
                return out
            raise
        if "split" in df.columns:
            out |= {f"{r['split']}/{r['shard']}": r["count"] for r in df.groupBy("split", "shard").count().collect()}
    return out


def commit(spark: SparkSession, path: str, writer: str) -> int:
    """Make a staged writer's files part of the release; its version. A conflict deletes what was staged."""
    folder = _Folder(spark, path)
    staged = folder.read("data", f"writer={writer}.facts.json")
    for _ in range(TRIES):
        now = registry(spark, path)
        owned = {s: now["shards"][s] for s in staged["shards"] if s in now["shards"]}
        if any(v["writer"] == writer for v in owned.values()):
            return now["version"]
        late = [s for s, v in owned.items() if not staged["replace"] or v["version"] > staged["base"]]
        if late or (now["identity"] is not None and now["identity"] != staged["identity"]):
            folder.delete("data", f"writer={writer}")
            folder.delete("data", f"writer={writer}.facts.json")
            raise Conflict(f"already published: {sorted(late)}" if late else "the release has another identity")
        version = now["version"] + 1
        content = {"version": version, "writer": writer, "identity": staged["identity"], "shards": staged["shards"], "facts": staged["facts"]}
        if folder.create(content, "commits", f"{version:012d}.json"):
            return version
    raise Conflict("too many writers at once")


def publish(rows: DataFrame, path: str, covers: list[tuple[str, int]], identity: dict, keys: list[str], totals: dict | None = None, replace: bool = False) -> int:
    return commit(rows.sparkSession, path, stage(rows, path, covers, identity, keys, totals, replace))


def read(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """The rows of the newest version, with split and shard."""
    folder = _Folder(spark, path)
    shards = registry(spark, path)["shards"]
    held = sorted({v["writer"] for v in shards.values() if v["rows"]})
    if schema is None and shards:
        any_writer = next(iter(shards.values()))["writer"]
        schema = T.StructType.fromJson(json.loads(folder.read("data", f"writer={any_writer}.facts.json")["schema"]))
    if not held:
        return spark.createDataFrame([], schema or "split string, shard int")
    folders = [folder.at("data", f"writer={v['writer']}", f"split={s.rsplit('/', 1)[0]}", f"shard={s.rsplit('/', 1)[1]}").toString() for s, v in sorted(shards.items()) if v["rows"]]
    names = [f.name for f in schema] if isinstance(schema, T.StructType) else None
    out = spark.read.schema(schema).option("basePath", folder.at("data").toString()).parquet(*folders)
    return out.select(*names) if names else out.drop("writer")


def recover(spark: SparkSession, path: str, discard: bool = False) -> dict[str, str]:
    """What became of each staged writer that no version names: committed, refused, changed (its files are not those that
    it counted) or, where it never finished, unfinished. ``discard`` deletes what cannot be committed; no other writer may
    be at work then."""
    folder = _Folder(spark, path)
    named = {folder.read("commits", n)["writer"] for n in folder.names("commits")}
    files = folder.names("data")
    out = {}
    for writer in sorted(n.removeprefix("writer=") for n in files if n.startswith("writer=") and not n.endswith(".json")):
        if writer in named:
            continue
        facts = f"writer={writer}.facts.json"
        if facts not in files:
            out[writer] = "unfinished"
        else:
            staged = folder.read("data", facts)
            counted = {"n_rows": 0, "digest": None}
            if staged["facts"]["n_rows"]:
                df = spark.read.schema(T.StructType.fromJson(json.loads(staged["schema"]))).parquet(folder.at("data", f"writer={writer}").toString())
                counted = df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.xxhash64(*staged["keys"]).cast("decimal(38,0)")).cast("string").alias("digest")).first().asDict()
            if any(counted[k] != staged["facts"][k] for k in counted):
                out[writer] = "changed"
            else:
                try:
                    commit(spark, path, writer)
                    out[writer] = "committed"
                except Conflict:
                    out[writer] = "refused"
        if discard and out[writer] in ("unfinished", "changed"):
            folder.delete("data", f"writer={writer}")
            folder.delete("data", facts)
    return out


def validation(spark: SparkSession, path: str) -> dict:
    """The release's roll-up, from what its writers gathered: version, rows, shards, and sums of the totals."""
    folder = _Folder(spark, path)
    now = registry(spark, path)
    facts = [folder.read("commits", n) for n in folder.names("commits")]
    live = {v["writer"] for v in now["shards"].values()}
    whole = [c for c in facts if c["writer"] in live and all(now["shards"][s]["writer"] == c["writer"] for s in c["shards"])]
    sums: dict[str, float] = {}
    for c in whole:
        for k, v in c["facts"].items():
            if k != "digest" and v is not None:
                sums[k] = sums.get(k, 0) + v
    out = {"version": now["version"], "rows": sum(v["rows"] for v in now["shards"].values()), "shards": {s: v["rows"] for s, v in sorted(now["shards"].items())}}
    # a writer of which a part was replaced has totals of rows that are gone
    return out | {"totals": sums, "complete": {c["writer"] for c in whole} == live}


def write_validation(spark: SparkSession, path: str) -> dict:
    """The roll-up stored beside the version that it describes."""
    out = validation(spark, path)
    _Folder(spark, path).create(out, "validation", f"{out['version']:012d}.json")
    return out
