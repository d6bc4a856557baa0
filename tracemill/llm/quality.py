"""Quality by nearest neighbours among labelled documents in a latent-semantic space.

Terms are the words of a text and the letter triples inside it (each hashed to a fixed number of terms), the shapes
of three neighbouring characters (letter case, digits, kinds of punctuation) and measures of repetition. How many
documents hold each term is counted over the whole corpus and weights the terms. A truncated singular value
decomposition of the labelled rows' term matrix gives the latent axes; the labelled vectors are broadcast (at most
``labelled`` rows, a bound of the fit) and every document's cosines with all of them are computed exactly, block by
block. The ``k`` nearest vote with their similarity as weight.

Cases: a null or empty text has no terms and gets the labelled rows' mean; null labels do not count; a labelled id
is one row, with its largest label and its first text in order; without labels every score is 0.5; equal
similarities are taken in the order of the labelled ids; repeated rows give a row each; an empty table gives an
empty result; clashing extra columns are ignored.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import slices
from .class_lm import fold

LABELLED, AXES, NEIGHBOURS, PRIOR = 4000, 48, 15, 0.05

_SHAPES = 13
_CLASS = bytearray([12] * 128 + [3] * 128)
for _chars, _k in ((b"abcdefghijklmnopqrstuvwxyz", 2), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 4), (b" \t", 5), (b"\n\r", 6), (b".", 7), (b",", 8), (b"!", 9), (b"|", 10), (b"#*%&$@^~=", 11), (b"\0", 0)):
    for _c in _chars:
        _CLASS[_c] = _k
_CLASS = bytes(_CLASS)
_LETTER = bytes(26 if c == 32 else c - 96 if 97 <= c <= 122 else c - 64 if 65 <= c <= 90 else 27 + c % 5 if c >= 128 else 0 for c in range(256))
#: Terms for words and for letter triples.
WORDS, TRIPLES = 4096, 4096
HELD = 200_000
_SHAPE, _TRIPLE = 0, _SHAPES**3
_WORD = _TRIPLE + TRIPLES
_REPEAT = _WORD + WORDS
#: The last three: words like the one before, words seen before in the text, lines seen before.
TERMS = _REPEAT + 3


class _Terms(dict):
    """Word to its term; kept while they fit."""

    def __missing__(self, word: bytes) -> int:
        term = crc32(word) % WORDS
        if len(self) < HELD:
            self[word] = term
        return term


def terms(text: bytes | None, of: dict) -> tuple[np.ndarray, np.ndarray]:
    """The text's terms in order and the square roots of their shares."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0)
    a = np.frombuffer(b"\0" + text.translate(_CLASS) + b"\0", np.uint8).astype(np.int64)
    shapes = np.bincount((a[:-2] * _SHAPES + a[1:-1]) * _SHAPES + a[2:], minlength=_SHAPES**3) / (len(a) - 2)
    a = np.frombuffer(b"\0" + text.translate(_LETTER) + b"\0", np.uint8).astype(np.int64)
    triples = np.bincount(((a[:-2] << 10 | a[1:-1] << 5 | a[2:]) * 40503 >> 4) % TRIPLES, minlength=TRIPLES) / (len(a) - 2)
    tokens, lines = text.lower().split(), [x for x in text.split(b"\n") if x]
    words = np.bincount(np.fromiter(map(of.__getitem__, tokens), np.int64, len(tokens)), minlength=WORDS) / max(1, len(tokens))
    repeats = np.zeros(3)
    if len(tokens) > 1:
        repeats[0] = sum(x == y for x, y in zip(tokens, tokens[1:], strict=False)) / len(tokens)
        # against the repetition that length alone brings
        repeats[1] = max(0.0, 1 - len(set(tokens)) / len(tokens) - 0.08 * np.log(len(tokens)))
    if len(lines) > 1:
        repeats[2] = 1 - len(set(lines)) / len(lines)
    out = np.sqrt(np.concatenate([shapes, triples, words, repeats]))
    at = np.flatnonzero(out)
    return at, out[at]


def _term_counts(docs: DataFrame) -> tuple[np.ndarray, int]:
    def counted(batches):
        held, n, of = np.zeros(TERMS, np.int64), 0, _Terms()
        for b in slices(batches):
            for t in b.column(0).to_pylist():
                held[terms(t, of)[0]] += 1
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS + 1)), pa.array(np.append(held, n))], names=["term", "n"])

    got = docs.select(F.col("_text").cast("binary")).mapInArrow(counted, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(TERMS + 1, np.int64)
    out[got["term"].to_numpy()] = got["n"].to_numpy()
    return out[:-1], int(out[-1])


def folded(rows: list[tuple[np.ndarray, np.ndarray]], to_axes: np.ndarray) -> np.ndarray:
    """Places of rows of terms on the axes."""
    out = np.zeros((len(rows), to_axes.shape[1]))
    for r, (at, x) in enumerate(rows):
        out[r] = x @ to_axes[at]
    return out


def latent_axes(x: np.ndarray, axes: int, rounds: int = 6) -> np.ndarray:
    """Leading right singular vectors by subspace iteration from a fixed start."""
    q = np.random.default_rng(7).standard_normal((x.shape[1], min(axes, *x.shape))).astype(x.dtype)
    for _ in range(rounds):
        q = np.linalg.qr(x.T @ (x @ np.linalg.qr(q)[0]))[0]
    return q


def _normed(z: np.ndarray) -> np.ndarray:
    n = np.sqrt((z * z).sum(1, keepdims=True))
    return np.divide(z, n, out=np.zeros_like(z), where=n > 0)


def vote(z: np.ndarray, known: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """Similarity-weighted mean label of each row's k nearest (of equally near ones the first), drawn a little to
    the overall mean."""
    mean = y.mean() if len(y) else 0.5
    if not len(y):
        return np.full(len(z), mean)
    s = z @ known.T
    k = min(k, len(y))
    least = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
    over, equal = s > least, s == least
    taken = over | (equal & (np.cumsum(equal, axis=1) <= k - over.sum(1, keepdims=True)))
    w = np.where(taken, np.maximum(s, 0) ** 4, 0)
    return (w @ y + PRIOR * mean) / (w.sum(1) + PRIOR)


def quality_scores(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", folds: int = 5, out_fold: int = 0, labelled: int = LABELLED, axes: int = AXES, k: int = NEIGHBOURS, threshold: float = 0.3) -> DataFrame:
    """Per document: held_out, score and predicted; labels of rows in ``out_fold`` are never used."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"), (fold(id_col, folds) == out_fold).alias("held_out"))
    counts, n = _term_counts(docs)
    weight = np.log((n + 1) / (counts + 1)) + 0.05
    some = labels.where(F.col(label_col).isNotNull() & (fold(id_col, folds) != out_fold)).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    some = F.broadcast(some.orderBy(F.xxhash64("_id"), "_id").limit(labelled))

    def shares(batches):
        of = _Terms()
        for b in slices(batches):
            x = [terms(t, of) for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("_id").cast(pa.string()), b.column("y"), pa.array([v[0] for v in x], pa.list_(pa.int32())), pa.array([v[1] for v in x], pa.list_(pa.float32()))], names=["_id", "y", "at", "x"]
            )

    rows = docs.join(some, "_id").groupBy("_id", "y").agg(F.min("_text").alias("_text"))
    got = rows.mapInArrow(shares, "_id string, y int, at array<int>, x array<float>").toArrow().sort_by("_id")
    x = np.zeros((got.num_rows, TERMS), np.float32)
    for r in range(got.num_rows):
        x[r, np.asarray(got["at"][r].values)] = np.asarray(got["x"][r].values)
    y = got["y"].to_numpy().astype(float)
    del got
    x *= weight
    basis = latent_axes(x, axes) if len(x) else np.zeros((TERMS, 1))
    model = spark.sparkContext.broadcast(((basis * weight[:, None]).astype(np.float32), _normed((x @ basis).astype(float)), y))

    def scored(batches):
        to_axes, known, y = model.value
        of = _Terms()
        for b in slices(batches):
            z = _normed(folded([terms(t, of) for t in b.column("_text").to_pylist()], to_axes))
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("held_out"), pa.array(vote(z, known, y, k))], names=["_id", "held_out", "score"])

    kind = docs.schema["_id"].dataType.simpleString()
    out = docs.mapInArrow(scored, f"_id {kind}, held_out boolean, score double")
    return out.select(F.col("_id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
