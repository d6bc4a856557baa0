"""Logs made by a provider, a root at a time, and met by the roots they belong to.

A provider is a Python table function that takes a root's rows in order and gives its log (see ``LineDigest``). Spark
deals the rows out by root and sorts them; a provider holds what it keeps of one root, not the rows.
"""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


class LineDigest:
    """A provider: how many lines a root's log has, their first and last type, and a digest of all."""

    RETURNS = "root_id long, lines long, first string, last string, digest string"

    def __init__(self):
        self.root, self.lines, self.first, self.last, self.all = None, 0, None, None, md5()

    def eval(self, row: Row):
        if not self.lines:
            self.root, self.first = row["root_id"], row["type"]
        self.all.update(f"{',' if self.lines else ''}{row['type']}:{row['seq']}".encode())
        self.lines, self.last = self.lines + 1, row["type"]

    def terminate(self):
        if self.lines:
            yield self.root, self.lines, self.first, self.last, self.all.hexdigest()


def provided(rows: DataFrame, key: str, order: list[str], provider: type = LineDigest) -> DataFrame:
    """What ``provider`` makes of each root's ``rows``."""
    make = F.udtf(provider, returnType=provider.RETURNS)
    return make(rows.asTable().partitionBy(key).orderBy(*order))


def matched(roots: DataFrame, logs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(roots with their log, (id, rule) of those that are not one to one): roots without a log, logs without a root,
    roots or logs of one id twice."""
    times = lambda df, n: df.groupBy(key).agg(F.count("*").alias(n))
    met = times(roots, "_roots").join(times(logs, "_logs"), key, "full_outer")
    rule = F.when(F.col("_logs").isNull(), "no_log").when(F.col("_roots").isNull(), "no_root").when(F.col("_roots") > 1, "root_twice").when(F.col("_logs") > 1, "log_twice")
    problems = met.select(F.col(key).alias("id"), rule.alias("rule")).where("rule IS NOT NULL")
    return roots.join(logs, key), problems
