"""Benchmark decontamination: one Aho-Corasick automaton over normalised items, one scan of each text.

Items and texts are normalised to words (A-Z lower-cased, every other ASCII character but digits and letters
a separator) with single spaces between. The automaton holds each item's windows of ``width`` words, or all
words of a shorter item, with a space at both ends so that only whole words match. A match ends at an offset
of the normalised text, which maps to a word's number and from there to offsets of the original text.

The windows are distinct and counted first. At most ``per_automaton`` of them go to an automaton, so what is
broadcast has a fixed bound; a larger benchmark is scanned for in several automata, whose spans are merged by row.

Cases: a null or empty text, or one of separators only, has no words and no hits; items without words have
no windows; repeated items and windows that several items share list every item; repeated rows give a row
each; an empty table on either side gives no hits or an empty result; a column named leak is replaced, others,
whatever their names, stay as they are. A window carries the ids of all items that hold it, so an automaton's size
is bounded by its windows and by the benchmark's items.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, free_name, schema_of, slices, with_row_number

#: Windows in one automaton at most; about 60 MB as an automaton.
PER_AUTOMATON = 100_000
WIDTH = 10

_KEPT = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(0x80, 0x100))
_TABLE = bytes(c if c in _KEPT else 32 for c in bytes(range(256)).lower())
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010FFFF]+")

FOUND = "n_words: long, spans: array<struct<first: int, last: int, start: int, end: int>>, items: array<string>"


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def windows(items: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """Distinct windows with the sorted ids (as strings) of the items that hold them."""

    def cut_up(batches):
        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                w = words(t)
                n = min(len(w), width)
                out += [(f" {b' '.join(w[k : k + n]).decode()} ", i) for k in range(len(w) - n + 1) if n]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string())], names=["window", "item"])

    held = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("t"))
    return held.mapInArrow(cut_up, "window string, item string").groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _matches(automaton, raw: bytes | None) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words; first and last word of every match; the items."""
    w = words(raw)
    if not w:
        return 0, [], set()
    hits, items = [], set()
    for end, (length, ids) in automaton.iter(f" {b' '.join(w).decode()} "):
        hits.append((end, length))
        items.update(ids)
    if not hits:
        return len(w), [], items
    # the space before word k stands at starts[k]
    starts = np.cumsum([0, *(len(x.decode()) + 1 for x in w)])
    ends = np.array(hits)
    first = np.searchsorted(starts, ends[:, 0] - ends[:, 1] + 1)
    last = np.searchsorted(starts, ends[:, 0]) - 1
    return len(w), list(zip(first.tolist(), last.tolist(), strict=True)), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted runs of words; runs that touch or overlap become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _located(text: str, spans: list[tuple[int, int]]) -> list[dict]:
    """Runs of words with their character offsets in the original text."""
    if not spans:
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    return [{"first": a, "last": b, "start": at[a][0], "end": at[b][1]} for a, b in spans]


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "item_id", item_text: str = "text", text_col: str = "text", width: int = WIDTH, per_automaton: int = PER_AUTOMATON) -> DataFrame:
    """``docs`` with a struct column ``leak``: n_words, the runs of hit words (word numbers and original
    character offsets) and the items whose windows occur."""
    spark = docs.sparkSession
    docs = docs.drop("leak")
    wins = cut(windows(items, id_col, item_text, width))
    n = wins.count()
    if n <= per_automaton:
        return _scan(docs, text_col, _automaton_of(spark, wins))
    blocks = -(-n // per_automaton)
    dealt = wins.withColumn("_block", F.pmod(F.xxhash64("window"), F.lit(2 * blocks)))
    row = free_name(docs, "_row")
    rows = cut(with_row_number(docs, row))
    found = None
    for k in range(2 * blocks):
        part = _scan(rows.select(row, text_col), text_col, _automaton_of(spark, dealt.where(F.col("_block") == k).drop("_block")))
        part = part.where(F.size("leak.spans") > 0).select(row, F.col("leak.spans").alias("spans"), F.col("leak.items").alias("items"))
        found = part if found is None else found.unionByName(part)
    old = free_name(docs, "_spans"), free_name(docs, "_items")
    found = found.groupBy(row).agg(F.flatten(F.collect_list("spans")).alias(old[0]), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias(old[1]))
    return _scan(rows.join(found, row, "left"), text_col, None, old).drop(row)


def _automaton_of(spark, wins: DataFrame):
    return spark.sparkContext.broadcast([(r["window"], r["items"]) for r in wins.collect()])


def _scan(docs: DataFrame, text_col: str, shared, held: tuple[str, ...] = ()) -> DataFrame:
    """shared: windows of an automaton; None: only merge the spans and items found before, in the columns ``held``."""
    extra = set(held)
    kept = [f for f in docs.schema if f.name not in extra]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = None
        if shared is not None and shared.value:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for window, ids in shared.value:
                automaton.add_word(window, (len(window), tuple(ids)))
            automaton.make_automaton()
        for b in slices(batches):
            texts = b.column(text_col)
            counts, spans, items = [], [], []
            olds = zip(b.column(held[0]).to_pylist(), b.column(held[1]).to_pylist(), strict=True) if extra else None
            for i, raw in enumerate(texts.cast(pa.binary()).to_pylist()):
                if extra:
                    old, ids = next(olds)
                    n, hit = len(words(raw)), [(x["first"], x["last"]) for x in old or []]
                elif automaton is None:
                    n, hit, ids = len(words(raw)), [], ()
                else:
                    n, hit, ids = _matches(automaton, raw)
                counts.append(n)
                spans.append(_located(texts[i].as_py(), merged(hit)) if hit else [])
                items.append(sorted(ids or ()))
            leak = pa.StructArray.from_arrays(
                [
                    pa.array(counts, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([(x, pa.int32()) for x in ("first", "last", "start", "end")]))),
                    pa.array(items, pa.list_(pa.string())),
                ],
                names=["n_words", "spans", "items"],
            )
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), leak], names=[*(f.name for f in kept), "leak"])

    return docs.mapInArrow(scan, schema_of(docs, [f.name for f in kept], f"leak struct<{FOUND}>"))


def leak_report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: words, hit words, items that occur and a digest of their ids."""
    hit = F.aggregate("leak.spans", F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"] + 1)
    return found.select(
        id_col,
        F.col("leak.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("leak.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("leak.items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
