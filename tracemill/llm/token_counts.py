"""Token counts without token ids: pieces are counted once per distinct pre-token.

A text falls into pre-tokens that no piece crosses: the stretches that begin at each space. The distinct
pre-tokens of the corpus are gathered with a shuffle and each is tokenized once. The ``head`` most frequent
ones (a fixed number, so their table is safe to broadcast) are joined to each document's pre-token
frequencies inside the scan; only the rest goes through a shuffle join. No list of ids is ever built.

Cases: a null or empty text has 0 bytes and 0 tokens; repeated rows and repeated or null ids give a row
each; an empty table gives an empty result; other columns stay, those named like an added one are replaced.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, frequent, packed, schema_of, slices, unpacked, with_row_number

#: Pre-tokens that are broadcast at most: about 4 MB.
HEAD = 200_000
#: Distinct pre-tokens that a counting task holds before it hands them on.
HELD = 200_000
#: The tokenizer's white space; Python's also has four separators.
_WHITE = r"[^\S\x1c-\x1f]"
#: White space, then a space whose own pre-token would differ from the one the tokenizer makes.
_RUNS = re.compile(rf"{_WHITE} (?:{_WHITE}|\Z)")
_SPACES = re.compile(rf"{_WHITE}+\Z|{_WHITE}{{2,}}(?!{_WHITE})")


def pre_tokens(text: str) -> list[str]:
    """Stretches of ``text`` whose token counts add up to that of the whole: each starts at a space.

    Where several spaces stand together a byte-level tokenizer keeps all but the last in one piece, so such
    runs are cut before their last character instead.
    """
    if not text:
        return []
    if not _RUNS.search(text):
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + x for x in rest]
    out, at = [], 0
    for m in _SPACES.finditer(text):
        out += pre_tokens_plain(text[at : m.start()])
        cut_at = m.end() if m.end() == len(text) else m.end() - 1
        if cut_at > m.start():
            out.append(text[m.start() : cut_at])
        at = cut_at
    return out + pre_tokens_plain(text[at:])


def pre_tokens_plain(text: str) -> list[str]:
    first, *rest = text.split(" ")
    return ([first] if first else []) + [" " + x for x in rest]


def _count_pieces(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda texts: [len(e) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def special_strings(path: str) -> list[str]:
    import json

    with open(path, encoding="utf-8") as f:
        return [x["content"] for x in json.load(f).get("added_tokens", [])]


def _split_special(text: str, special: re.Pattern | None) -> tuple[list[str], int]:
    if special is None or not special.search(text):
        return pre_tokens(text), 0
    parts = special.split(text)
    return [p for x in parts for p in pre_tokens(x)], len(parts) - 1


def token_counts(docs: DataFrame, tokenizer: str, text_col: str = "text", head: int = HEAD, limit: int = 512) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit instead of its text.

    tokenizer: path of a byte-level ``tokenizers`` file, there on every executor. Texts are tokenized as the
    library does by default, so the string of an added token inside a text is that one token.
    """
    spark = docs.sparkSession
    names = special_strings(tokenizer)
    pattern = "|".join(map(re.escape, sorted(names, key=len, reverse=True)))
    text = F.coalesce(F.col(text_col), F.lit(""))

    def seen(batches):
        special, held = re.compile(pattern) if pattern else None, Counter()
        for b in slices(batches):
            for t in b.column(0).to_pylist():
                held.update(_split_special(t, special)[0])
                if len(held) > HELD:
                    yield pa.RecordBatch.from_pydict({"piece": list(held), "n": list(held.values())})
                    held = Counter()
        if held:
            yield pa.RecordBatch.from_pydict({"piece": list(held), "n": list(held.values())})

    def tokenized(batches):
        count = _count_pieces(tokenizer)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count(b.column(0).to_pylist()), pa.int32()), b.column(1)], names=["piece", "pieces", "n"])

    vocabulary = cut(
        docs.select(text.alias("t")).mapInArrow(seen, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).mapInArrow(tokenized, "piece string, pieces int, n long")
    )
    top = frequent(vocabulary, "n", head).select("piece", "pieces").toArrow()
    known = spark.sparkContext.broadcast(dict(zip(top["piece"].to_pylist(), top["pieces"].to_pylist(), strict=True)))
    whole = vocabulary.count() == top.num_rows
    kept = [c for c in docs.columns if c not in (text_col, "n_bytes", "n_tokens", "over_limit")]

    def counted(batches):
        special, pieces = re.compile(pattern) if pattern else None, known.value
        for b in slices(batches):
            totals, rest, ns = [], [], []
            for t in b.column("_text").to_pylist():
                found, n = _split_special(t, special)
                unknown, ks = [], []
                for p, k in Counter(found).items():
                    m = pieces.get(p)
                    if m is None:
                        unknown.append(p)
                        ks.append(k)
                    else:
                        n += m * k
                totals.append(n)
                rest.append(unknown)
                ns.append(ks)
            others = [b.column(i) for i in range(b.num_columns) if b.schema.names[i] != "_text"]
            yield pa.RecordBatch.from_arrays(
                [*others, pa.array(totals, pa.int64()), pa.array(rest, pa.list_(pa.string())), pa.array(ns, pa.list_(pa.int64()))],
                names=[n for n in b.schema.names if n != "_text"] + ["n_tokens", "_rest", "_ns"],
            )

    rows = packed(docs, kept, n_bytes=F.octet_length(text).cast("long"), _text=text)
    rows = rows.mapInArrow(counted, schema_of(rows, ["_doc", "n_bytes"], "n_tokens long, _rest array<string>, _ns array<long>"))
    if whole:  # the head holds every pre-token, so nothing is left to join
        out = rows.drop("_rest", "_ns")
    else:
        rows = cut(with_row_number(rows))
        rest = rows.select("_row", F.explode(F.arrays_zip("_rest", "_ns")).alias("x")).select("_row", F.col("x._rest").alias("piece"), F.col("x._ns").alias("k"))
        more = rest.join(vocabulary.select("piece", "pieces"), "piece").groupBy("_row").agg(F.sum(F.col("pieces") * F.col("k")).alias("_more"))
        out = rows.drop("_rest", "_ns").join(more, "_row", "left").withColumn("n_tokens", F.col("n_tokens") + F.coalesce("_more", F.lit(0))).drop("_row", "_more")
    return out.select(*unpacked(kept), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
