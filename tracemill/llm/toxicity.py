"""Toxicity by classifier chains over words and word beginnings.

Categories are predicted in a given order. The linear model of each category sees the words of a text and the
probabilities of the categories before it; in training these come from models that did not see the row (out of
fold), so a later model meets the same kind of input as when scoring. Equal texts share a fold. Features are all
words and beginnings whose counts with a category have a likelihood ratio of LEAST_RATIO, gathered by a Spark
aggregation. The models of a category's folds are fitted by tasks of their own, each to the optimum.

Fitting uses at most ``sample`` labelled rows, chosen by a hash of the id: a bound of the training job only, which
bounds the features too. Scoring reads every text whole and needs no shuffle.

Cases: null and empty texts have no features and get the score of the intercepts; labels that are null do not
count; a labelled id is one row, with its largest label and its first text in order, however often either table
has it; without usable labels, or with one class only, a category's model is its smoothed share; an empty table
gives an empty result; columns named like an added one are replaced, others stay.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import cut, release, schema_of, slices

SAMPLE, LEAST_RATIO, LEAST_DOCS, FOLDS = 20_000, 15.0, 3, 5
PENALTY, STEPS, INNER = 1.0, 40, 60
HELD = 200_000
_EDGE = ".,;:!?\"'()[]{}<>*#$%&|-_/\\«»“”„…"


def terms(word: str) -> tuple[str, ...]:
    """A word's features: itself and its beginnings of four and five letters."""
    w = word.strip(_EDGE)
    return (w, *(f"{w[:k]}*" for k in (4, 5) if len(w) > k)) if w else ()


def text_terms(text: str | None) -> set[str]:
    return {t for w in set(text.lower().split()) for t in terms(w)} if text else set()


def _sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, categories: list[str], sample: int) -> DataFrame:
    """(_id, _text, fold, y0, y1, ...) of at most ``sample`` labelled ids that have a document."""
    ys = [f"y{k}" for k in range(len(categories))]
    some = labels.where(" OR ".join(f"`{c}` IS NOT NULL" for c in categories)).groupBy(F.col(id_col).alias("_id")).agg(*(F.max(F.col(c).cast("int")).alias(y) for c, y in zip(categories, ys, strict=True)))
    some = F.broadcast(some.orderBy(F.xxhash64("_id"), "_id").limit(sample))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(some, "_id").groupBy("_id", *ys).agg(F.min("_text").alias("_text"))
    return rows.select("_id", "_text", F.pmod(F.xxhash64(F.lower("_text")), F.lit(FOLDS)).cast("int").alias("fold"), *ys)


def pick_terms(rows: DataFrame, k: int) -> list[str]:
    """The terms whose presence tells about one of the k categories: likelihood ratio of LEAST_RATIO or more."""
    ys = [f"y{i}" for i in range(k)]

    def counted(batches):
        held: dict[str, list[int]] = {}

        def batch():
            cols = [pa.array([v[j] for v in held.values()], pa.int64()) for j in range(2 * k + 1)]
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *cols], names=["term", "n", *(f"{c}{i}" for i in range(k) for c in ("pos", "all"))])

        for b in slices(batches):
            y = [b.column(c).to_pylist() for c in ys]
            for r, t in enumerate(b.column("_text").to_pylist()):
                add = [1]
                for c in y:
                    add += [int(c[r] == 1), int(c[r] is not None)]
                for w in text_terms(t):
                    if (old := held.get(w)) is None:
                        held[w] = add[:]
                    else:
                        for j, v in enumerate(add):
                            old[j] += v
                if len(held) > HELD:
                    yield batch()
                    held.clear()
        yield batch()

    schema = "term string, n long, " + ", ".join(f"{c}{i} long" for i in range(k) for c in ("pos", "all"))
    table = rows.mapInArrow(counted, schema).groupBy("term").agg(F.sum("n").alias("n"), *(F.sum(f"{c}{i}").alias(f"{c}{i}") for i in range(k) for c in ("pos", "all"))).where(F.col("n") >= LEAST_DOCS)
    totals = rows.agg(*(f(F.col(y) == 1).alias(f"p{i}") if f is F.count_if else f(F.col(y)).alias(f"t{i}") for i, y in enumerate(ys) for f in (F.count_if, F.count))).first()

    def ratio(i):
        p, t = float(totals[f"p{i}"]), float(totals[f"t{i}"])
        a, m = F.col(f"pos{i}").cast("double"), F.col(f"all{i}").cast("double")
        cells = [(a, m, p), (p - a, t - m, p), (m - a, m, t - p), (t - m - p + a, t - m, t - p)]
        return 2 * sum((F.when(x > 0, x * F.log(x * t / (row * col))).otherwise(0.0) for x, row, col in cells), F.lit(0.0)) if 0 < p < t else F.lit(0.0)

    best = F.greatest(*(ratio(i) for i in range(k)), F.lit(0.0))
    picked = table.select("term", best.alias("ratio")).where(F.col("ratio") >= LEAST_RATIO).collect()
    return sorted(r["term"] for r in picked)


def turned(starts: np.ndarray, ids: np.ndarray, features: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have each feature, end to end, how many each has) of rows of present features."""
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    return row[np.argsort(ids, kind="stable")], np.bincount(ids, minlength=features)


def sums(index: np.ndarray, sizes: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Of x, the sums of its elements at so many places of ``index`` each. What a fit asks for hundreds of times: places
    that follow each other are added in order, without a count for each."""
    index, some = index.astype(np.intp), np.flatnonzero(sizes)
    begins, held = (np.cumsum(sizes) - sizes)[some], np.empty(len(index))

    def of(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(sizes))
        if len(some):
            out[some] = np.add.reduceat(np.take(x, index, out=held, mode="clip"), begins)
        return out

    return of


class Linear:
    """Logistic regression with squared penalty on rows of present features and a few dense columns."""

    def __init__(self, features: int, dense: int):
        self.w, self.v, self.bias = np.zeros(features), np.zeros(dense), 0.0

    def fit(self, starts: np.ndarray, ids: np.ndarray, dense: np.ndarray, y: np.ndarray) -> Linear:
        """Newton steps, each solved by conjugate gradients; the optimum is unique."""
        n, k = len(y), len(self.w)
        share = (y.sum() + 0.5) / (n + 1)
        self.bias = float(np.log(share / (1 - share)))
        if not 0 < y.sum() < n:
            return self
        by_row, by_feature = sums(ids, np.diff(starts)), sums(*turned(starts, ids, k))
        times = lambda t: by_row(t[:k]) + dense @ t[k:-1] + t[-1]
        back = lambda g: np.concatenate([by_feature(g), dense.T @ g, [g.sum()]])
        penalty = np.append(np.full(k + dense.shape[1], PENALTY), 0.0)
        theta = np.append(np.zeros(k + dense.shape[1]), self.bias)

        def loss(z, t):
            return np.logaddexp(0, z).sum() - z @ y + 0.5 * (penalty * t) @ t

        z = times(theta)
        now = loss(z, theta)
        for _ in range(STEPS):
            p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            grad = back(p - y) + penalty * theta
            size = np.sqrt(grad @ grad)
            if size < 1e-6 * n:
                break
            curve, step, r = p * (1 - p) + 1e-12, np.zeros_like(theta), -grad
            d, rr = r.copy(), r @ r
            for _ in range(INNER):
                hd = back(curve * times(d)) + penalty * d
                a = rr / (d @ hd)
                step += a * d
                r -= a * hd
                new = r @ r
                if new < (min(0.1, size / n) * size) ** 2:
                    break
                d, rr = r + new / rr * d, new
            along, pace = times(step), 1.0
            while pace > 1e-8 and loss(z + pace * along, theta + pace * step) > now + 1e-4 * pace * (grad @ step):
                pace /= 2
            theta, z = theta + pace * step, z + pace * along
            now = loss(z, theta)
        self.w, self.v, self.bias = theta[:k], theta[k:-1], float(theta[-1])
        return self

    def predict(self, starts: np.ndarray, ids: np.ndarray, dense: np.ndarray) -> np.ndarray:
        row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        z = np.bincount(row, self.w[ids], len(starts) - 1) + dense @ self.v + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit_chain(spark: SparkSession, starts: np.ndarray, ids: np.ndarray, labels: np.ndarray, fold: np.ndarray, features: int) -> list[Linear]:
    """A model for each column of ``labels`` (-1: unknown), in order. A task fits the rows outside one fold, one
    more all rows; the rows are bounded by the sample and broadcast."""
    rows = spark.sparkContext.broadcast((starts, ids, labels, fold))
    earlier, models = np.zeros((len(labels), 0)), []

    for c in range(labels.shape[1]):
        before = spark.sparkContext.broadcast(earlier)

        def fits(batches, c=c, before=before):
            starts, ids, labels, fold = rows.value
            y, sizes = labels[:, c], np.diff(starts)
            for b in batches:
                for f in b.column(0).to_pylist():
                    keep = (y >= 0) & (fold != f)
                    at = np.concatenate([[0], np.cumsum(sizes[keep])])
                    m = Linear(features, c).fit(at, ids[np.repeat(keep, sizes)], before.value[keep], y[keep].astype(float))
                    theta = np.concatenate([m.w, m.v, [m.bias]])
                    yield pa.RecordBatch.from_arrays([pa.array([f], pa.int64()), pa.array([theta.tobytes()], pa.binary())], names=["fold", "theta"])

        apart = np.zeros(len(labels))
        for r in spark.range(0, FOLDS + 1, 1, FOLDS + 1).mapInArrow(fits, "fold long, theta binary").collect():
            theta, model = np.frombuffer(r["theta"]), Linear(features, c)
            model.w, model.v, model.bias = theta[:features], theta[features:-1], float(theta[-1])
            if r["fold"] == FOLDS:
                models.append(model)
            else:
                p = model.predict(starts, ids, earlier)
                apart[fold == r["fold"]] = p[fold == r["fold"]]
        earlier = np.column_stack([earlier, apart])
        before.unpersist()
    rows.unpersist()
    return models


class _Ids(dict):
    """Word to ids of its picked features; kept while they fit."""

    def __init__(self, of: dict[str, int]):
        super().__init__()
        self.of = of

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = tuple(self.of[t] for t in terms(word) if t in self.of)
        if len(self) < HELD:
            self[word] = ids
        return ids


def _matrix(texts: list[str | None], ids: _Ids) -> tuple[np.ndarray, np.ndarray]:
    rows = [sorted(set(chain.from_iterable(map(ids.__getitem__, set(t.lower().split()))))) if t else [] for t in texts]
    return np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64), np.array([i for r in rows for i in r], np.int64)


def toxicity(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``docs`` with p_<category> for each category, predicted in the order given.

    categories: 0/1 columns of ``labels``.
    """
    spark = docs.sparkSession
    rows = cut(_sampled(docs, labels, id_col, text_col, categories, sample))
    picked = pick_terms(rows, len(categories))
    of = spark.sparkContext.broadcast({t: i for i, t in enumerate(picked)})
    ys = [f"y{k}" for k in range(len(categories))]

    def rows_of(batches):
        ids = _Ids(of.value)
        for b in slices(batches):
            starts, found = _matrix(b.column("_text").to_pylist(), ids)
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(found, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("_id").cast(pa.string()), lists, b.column("fold"), *(b.column(y) for y in ys)], names=["_id", "ids", "fold", *ys])

    got = rows.mapInArrow(rows_of, f"_id string, ids array<int>, fold int, {', '.join(f'{y} int' for y in ys)}").toArrow().sort_by("_id").combine_chunks()
    release(rows)
    # all of it stays in Arrow's and numpy's arrays: Python lists of the sample would take ten times the memory
    found = got["ids"].combine_chunks()
    starts = np.concatenate([[0], np.cumsum(pc.list_value_length(found).to_numpy(zero_copy_only=False))]).astype(np.int64)
    y = np.column_stack([pc.fill_null(got[c].combine_chunks(), -1).to_numpy(zero_copy_only=False).astype(np.int64) for c in ys])
    ids = found.flatten().to_numpy(zero_copy_only=False)
    fold = pc.fill_null(got["fold"].combine_chunks(), 0).to_numpy(zero_copy_only=False)
    del got, found
    models = fit_chain(spark, starts, ids, y, fold, len(picked))
    shared = spark.sparkContext.broadcast(models)
    added = [f"p_{c}" for c in categories]
    names = [c for c in docs.columns if c not in added]

    def scored(batches):
        ids = _Ids(of.value)
        for b in slices(batches):
            starts, found = _matrix(b.column(text_col).to_pylist(), ids)
            p = np.zeros((b.num_rows, 0))
            for model in shared.value:
                p = np.column_stack([p, model.predict(starts, found, p)])
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *(pa.array(p[:, k]) for k in range(p.shape[1]))], names=[*names, *added])

    return docs.mapInArrow(scored, schema_of(docs, names, ", ".join(f"`{a}` double" for a in added)))
