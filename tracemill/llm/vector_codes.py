"""Product codes of vectors: codebooks by Hamerly's bounds on integer parts.

1. A component becomes the integer floor(scale * x); a vector is cut into equal parts. What is kept is written once,
   with its components as integers.
2. A position's codebook starts as that part of the vectors with the smallest ids. Each round assigns every part to its
   nearest entry and moves the entries to the floored means of their parts.
3. With each part are persisted its entry, an upper bound of the distance to it and a lower bound of the distance to the
   second nearest. When entries move, the bounds widen by what these moved, and no more; only a part whose upper bound is
   not strictly below the lower one (or half the way to the entry's nearest neighbour) is measured again: first against
   its own entry, then against all. Bounds are rounded outwards and compared strictly, so a skipped part has one nearest
   entry, and equal distances always end in a scan, where the lower index wins.
4. A round is one pass over the stored rows without a shuffle; only sums by position and entry travel, whose number
   the parameters fix, and the codebooks are broadcast.

Cases: vectors that are null or hold null or non-finite components are dropped; repeated rows are coded each; null
ids come last among the first entries, equal ids by their integers; fewer vectors than entries make smaller codebooks; the
length is that of the row with the smallest id, and a vector of another length, of one that the parts do not divide, or
with an integer beyond 2**LIMIT (a squared distance might not fit a long) has a null code and error and moves nothing; an
empty table gives an empty result and empty codebooks; further columns come back only where they are named.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, release, slices

#: Integers are below 2**LIMIT in size.
LIMIT = 26


def _integers(scale: int, limit: int):
    """Rows of usable vectors with the length and the integers, as bytes; none where an integer is too large."""

    def scan(batches):
        for b in slices(batches, 4096):
            keep, dims, raws = [], [], []
            for r, x in enumerate(b.column(1)):
                if not x.is_valid or x.values.null_count:
                    continue
                v = np.asarray(x.values, np.float64)
                if np.isfinite(v).all():
                    small = (np.abs(v) < 2.0**limit / scale).all()
                    keep.append(r)
                    dims.append(len(v))
                    raws.append(np.floor(v * scale).astype(np.int32).tobytes() if small else None)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(dims, pa.int32()), pa.array(raws, pa.binary())], names=["_doc", "dim", "q"])

    return scan


def _outwards(x: np.ndarray, up: bool) -> np.ndarray:
    """32-bit numbers that are not below (or not above) ``x``."""
    return np.nextafter((x * (1 + 1e-12 if up else 1 - 1e-12)).astype(np.float32), np.float32(np.inf if up else 0))


def distances(q: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries, in exact integers."""
    most = max(np.abs(q).max(initial=0), np.abs(book).max(initial=0))
    if 4 * most * most * q.shape[1] < 2**53:  # floating point holds each of these integers exactly
        a, b = q.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    out = np.empty((len(q), len(book)), np.int64)
    for k, c in enumerate(book):
        out[:, k] = ((q - c) ** 2).sum(1)
    return out


class Moves:
    """How far entries are from what they were and from each other, for one position."""

    def __init__(self, old: np.ndarray, new: np.ndarray):
        way = _outwards(np.sqrt(((new - old) ** 2).sum(1)), True)
        self.own = way
        order = np.argsort(way, kind="stable")
        self.others = np.full(len(way), way[order[-1]])
        self.others[order[-1]] = way[order[-2]] if len(way) > 1 else 0
        between = distances(new, new)
        np.fill_diagonal(between, np.iinfo(np.int64).max)
        self.half = _outwards(np.sqrt(between.min(1)) / 2, False)


def assigned(q: np.ndarray, book: np.ndarray, moves: Moves | None = None, entry=None, upper=None, lower=None):
    """(entry, upper, lower, rows measured against all entries) of the parts ``q`` of one position."""
    scan = np.arange(len(q))
    if moves is None:
        entry, upper, lower = np.zeros(len(q), np.uint8), np.zeros(len(q), np.float32), np.zeros(len(q), np.float32)
    else:
        entry = entry.copy()
        upper = np.nextafter(upper + moves.own[entry], np.float32(np.inf))
        lower = np.maximum(np.nextafter(lower - moves.others[entry], np.float32(-np.inf)), 0)
        apart = np.maximum(lower, moves.half[entry])
        scan = np.flatnonzero(upper >= apart)
        upper[scan] = _outwards(np.sqrt(((q[scan] - book[entry[scan]]) ** 2).sum(1)), True)
        scan = scan[upper[scan] >= apart[scan]]
    if len(scan):
        d = distances(q[scan], book)
        best = d.argmin(1)  # the lower index of equal ones
        at = np.arange(len(scan))
        entry[scan], upper[scan] = best, _outwards(np.sqrt(d[at, best]), True)
        d[at, best] = np.iinfo(np.int64).max
        lower[scan] = _outwards(np.sqrt(d.min(1)), False)
    return entry, upper, lower, scan


def _parts(b: pa.RecordBatch, parts: int) -> np.ndarray:
    """The integers of a batch by row, position and place."""
    q = np.frombuffer(b"".join(b.column("q").to_pylist()), np.int32)
    return q.reshape(b.num_rows, parts, -1).astype(np.int64) if b.num_rows else np.zeros((0, parts, 1), np.int64)


def _bounded(books: np.ndarray, before: np.ndarray | None):
    """A round's pass: entries and bounds of every part."""
    parts, entries = books.shape[:2]
    moves = None if before is None else [Moves(before[p], books[p]) for p in range(parts)]
    kinds = (np.uint8, np.float32, np.float32)

    def run(batches):
        for b in slices(batches, 8192):
            q = _parts(b, parts)
            made = [np.empty((len(q), parts), k) for k in kinds]
            held = [] if moves is None else [np.frombuffer(b"".join(b.column(c).to_pylist()), k).reshape(-1, parts) for c, k in zip(("entry", "upper", "lower"), kinds, strict=True)]
            for p in range(parts):
                found = assigned(q[:, p], books[p]) if moves is None else assigned(q[:, p], books[p], moves[p], *(x[:, p] for x in held))
                for x, new in zip(made, found, strict=False):
                    x[:, p] = new
            rows = [pa.array([r.tobytes() for r in x], pa.binary()) for x in made]
            yield pa.RecordBatch.from_arrays([b.column("_doc"), b.column("q"), *rows], names=["_doc", "q", "entry", "upper", "lower"])

    return run


def moved(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks with each entry at the floored mean of its parts; an entry without parts stays."""
    parts, entries, width = books.shape

    def summed(batches):
        total, n = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for b in slices(batches, 8192):
            q, e = _parts(b, parts), np.frombuffer(b"".join(b.column("entry").to_pylist()), np.uint8).reshape(-1, parts)
            for p in range(parts if len(q) else 0):
                n[p * entries : (p + 1) * entries] += np.bincount(e[:, p], minlength=entries)
                order = np.argsort(e[:, p], kind="stable")
                used, first = np.unique(e[order, p], return_index=True)
                total[p * entries + used.astype(np.int64)] += np.add.reduceat(q[order, p], first, axis=0)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(list(total[at]), pa.list_(pa.int64()))], names=["cell", "n", "total"])

    cells = state.select("q", "entry").mapInArrow(summed, "cell long, n long, total array<long>")
    sums = [F.sum(F.col("total")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(width)]
    out = books.copy()
    for r in cells.groupBy("cell").agg(F.sum("n").alias("n"), *sums).collect():  # parts * entries rows at most
        out[r["cell"] // entries, r["cell"] % entries] = [int(r[f"s{k}"]) // r["n"] for k in range(width)]
    return out


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: tuple[str, ...] = (), parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, np.ndarray]:
    """(per kept vector: id, the columns ``keep``, code as one byte a part, error; codebooks by part, entry and place).

    At most 256 entries. The rows' table stays in the shared folder for the returned plan.
    """
    spark = vectors.sparkSession
    doc = F.struct(F.col(id_col).alias("id"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)))
    values = F.col(vector_col).cast("array<double>")
    read = vectors.select(doc.alias("_doc"), values.alias("x"))
    kind = read.schema["_doc"].dataType.simpleString()
    rows = cut(read.mapInArrow(_integers(scale, LIMIT), f"_doc {kind}, dim int, q binary"))
    by_id = [F.col("_doc.id").asc_nulls_last(), F.col("q")]
    first = rows.orderBy(F.col("_doc.id").asc_nulls_last(), "dim").select("dim").first()
    dim = first["dim"] if first else 0
    usable = F.col("q").isNotNull() & (F.col("dim") == dim) & F.lit(dim > 0 and dim % parts == 0)
    start = [r["q"] for r in rows.where(usable).orderBy(*by_id).limit(entries).select("q").collect()]
    names = [F.col("_doc.id").alias(id_col), *(F.col(f"_doc.k{i}").alias(c) for i, c in enumerate(keep))]
    nothing = rows.where(~usable | F.col("q").isNull()).select(*names, F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
    if not start:
        return nothing, np.zeros((parts, 0, 0), np.int64)
    books = np.frombuffer(b"".join(start), np.int32).reshape(len(start), parts, -1).astype(np.int64).transpose(1, 0, 2).copy()
    state, before = rows.where(usable).select("_doc", "q"), None
    for _ in range(rounds):
        done = cut(state.mapInArrow(_bounded(books, before), f"_doc {kind}, q binary, entry binary, upper binary, lower binary"))
        if before is not None:
            release(state)
        state, before = done, books
        books = moved(state, books)

    def coded(batches):
        for b in _bounded(books, before)(batches):
            q, e = _parts(b, parts), np.frombuffer(b"".join(b.column("entry").to_pylist()), np.uint8).reshape(-1, parts)
            error = sum((((q[:, p] - books[p][e[:, p]]) ** 2).sum(1) for p in range(parts)), np.zeros(len(q), np.int64))
            yield pa.RecordBatch.from_arrays([b.column("_doc"), b.column("entry"), pa.array(error)], names=["_doc", "code", "error"])

    out = state.mapInArrow(coded, f"_doc {kind}, code binary, error long")
    return out.select(*names, "code", "error").unionByName(nothing), books


def decoded(code: bytes, books: np.ndarray, scale: int = 256) -> np.ndarray:
    """The vector that a code stands for: the middle of each integer's range."""
    return np.concatenate([(books[p][k] + 0.5) / scale for p, k in enumerate(code)])


def with_group_error(coded: DataFrame, label: str) -> DataFrame:
    """``coded`` with label_error, the errors of its rows of equal ``label`` summed, nulls being equal.

    Sums come from partial ones; a label of any size meets its own in a join, which Spark splits where it is crowded.
    """
    total = coded.groupBy(F.col(label).alias("_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("_sum"))
    joined = coded.join(cut(total), F.col(label).eqNullSafe(F.col("_label")))
    return joined.drop("_label").withColumn("_sum", F.expr("try_cast(_sum as long)")).withColumnRenamed("_sum", "label_error")
