"""Counts of token runs and of neighbouring tokens."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import adjacent_pairs
from ..tables import release, stored

LIMIT, MIN_COUNT = 20_000, 8
#: Tokens are ids of 16 bits, so four of them fit a long.
BITS, PER_LONG = 16, 4
#: Cells of a sieve, a bit each.
CELLS = 1 << 27


def _hashed(k1: np.ndarray, k2: np.ndarray, cells: int) -> np.ndarray:
    """The cell of each packed run; ``cells`` is a power of two."""
    h = (k1.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (k2.astype(np.uint64) + np.uint64(0x165667B19E3779F9))
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h >> np.uint64(65 - cells.bit_length())


def _held(sieve: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    cell = _hashed(k1, k2, 64 * len(sieve))
    return (sieve[cell >> np.uint64(6)] >> (cell & np.uint64(63)) & np.uint64(1)).astype(bool)


def _runs(shortest: int, longest: int, sieve: np.ndarray | None, buckets: int):
    """Arrow rows (length, bucket, k1, k2, n) of all runs within the arrays of a batch: a row has the distinct runs of a
    bucket among PIECE tokens, packed (the first four tokens, and the rest; k2 is null where there is none), and how often
    each occurs. With a ``sieve`` of the runs one shorter than ``shortest``, only runs all of whose such parts may be in it."""

    def packed(batches):
        for tokens, sizes in _gathered(batches):
            t = np.append(tokens.astype(np.int64), np.zeros(longest, np.int64))
            if len(t) and (t.min() < 0 or t.max() >= 1 << BITS):
                raise ValueError(f"tokens are ids of {BITS} bits")
            left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(tokens))  # tokens from here to the array's end
            keys = [np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)]
            at = np.arange(len(left))
            whole = None
            for n in range(1, longest + 1):
                k = keys[n > PER_LONG]
                k[at] = k[at] << BITS | t[at + n - 1]
                if sieve is not None and n == shortest - 1:  # which places begin a run that the sieve holds
                    whole = np.zeros(len(t), bool)
                    ends = at[left[at] >= n]
                    whole[ends] = _held(sieve, keys[0][ends], keys[1][ends])
                    at = ends[whole[ends]]
                    continue
                at = at[left[at] >= n]
                if whole is not None and n >= shortest:
                    at = at[whole[at + n - shortest + 1]]
                if n >= shortest and len(at):
                    k1, k2, times = _summed(keys[0][at], keys[1][at] if n > PER_LONG else None)
                    yield _dealt(n, k1, k2, times, buckets)

    return packed


def _summed(k1: np.ndarray, k2: np.ndarray | None, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """The distinct runs, and what their ``times`` (1 each, if none) add up to."""
    if times is None and k2 is None:
        k1, times = np.unique(k1, return_counts=True)
        return k1, None, times
    order = np.argsort(k1, kind="stable") if k2 is None else np.lexsort((k2, k1))
    k1, k2 = k1[order], None if k2 is None else k2[order]
    new = k1[1:] != k1[:-1] if k2 is None else (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    first = np.flatnonzero(np.append(len(k1) > 0, new)) if len(k1) else np.zeros(0, np.int64)
    total = np.diff(np.append(first, len(k1))) if times is None else np.add.reduceat(times[order], first) if len(k1) else times
    return k1[first], None if k2 is None else k2[first], total


def _dealt(n: int, k1: np.ndarray, k2: np.ndarray | None, times: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Runs of n tokens by bucket; ``buckets`` is a power of two up to 2^16."""
    bucket = _hashed(k1, np.zeros_like(k1) if k2 is None else k2, buckets).astype(np.uint16) if buckets > 1 else np.zeros(len(k1), np.uint16)
    order = np.argsort(bucket, kind="stable")
    many = np.bincount(bucket, minlength=buckets)
    there = np.flatnonzero(many)
    offsets = pa.array(np.concatenate([[0], np.cumsum(many[there])]).astype(np.int32))
    lists = [pa.nulls(len(there), pa.list_(pa.int64())) if x is None else pa.ListArray.from_arrays(offsets, pa.array(x[order])) for x in (k1, k2, times)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(there), n, np.int8)), pa.array(there.astype(np.int32)), *lists], names=["length", "bucket", "k1", "k2", "n"])


def _counted(least: int):
    """Of all rows of a length and a bucket: its runs seen ``least`` times or more."""

    def merged(rows: pa.Table) -> pa.Table:
        k1, k2, n = (pa.concat_arrays(x.flatten() for x in rows[c].chunks).to_numpy() for c in ("k1", "k2", "n"))
        k1, k2, n = _summed(k1, k2 if len(k2) else None, n)
        kept = n >= least
        k2 = np.zeros(len(k1), np.int64) if k2 is None else k2
        length = np.full(kept.sum(), rows["length"][0].as_py(), np.int8)
        return pa.table({"length": length, "k1": k1[kept], "k2": k2[kept], "n": n[kept]})

    return merged


#: Tokens whose runs a task counts by itself before they are shuffled, and runs that a bucket has at most on average.
PIECE, BUCKET = 2_000_000, 500_000


def _pieces(batches, most: int = 250_000):
    """Batches of so many tokens, or of one row."""
    for b in batches:
        ends, at = np.cumsum(pc.fill_null(b.column(0).value_lengths(), 0).to_numpy().astype(np.int64)), 0
        while at < b.num_rows:
            past = max(at + 1, int(np.searchsorted(ends, most + (ends[at - 1] if at else 0), side="right")))
            yield b.slice(at, past - at)
            at = past


def _gathered(batches):
    """(tokens end to end, sizes of the arrays) of some PIECE tokens, in whatever batches they come."""
    held, n = [], 0
    for b in _pieces(batches, PIECE):
        tokens, sizes = pc.fill_null(b.column(0).flatten(), 0).to_numpy(), pc.fill_null(b.column(0).value_lengths(), 0).to_numpy().astype(np.int64)
        if held and n + len(tokens) > PIECE:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
        held.append((tokens, sizes))
        n += len(tokens)
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _sieve(counts: DataFrame, cells: int) -> np.ndarray:
    """A bit for each cell, set where a run of ``counts`` falls; gathered as words, cells / 64 at most."""

    def words(batches):
        for b in batches:
            cell = _hashed(b.column(0).to_numpy(), b.column(1).to_numpy(), cells)
            bit = (np.uint64(1) << (cell & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((cell >> np.uint64(6)).astype(np.int64)), pa.array(bit)], names=["word", "bits"])

    got = counts.select("k1", "k2").mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(cells // 64, np.uint64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def _unpacked() -> Column:
    """The run's tokens from length, k1 and k2."""
    return F.expr(
        f"transform(sequence(0, length - 1), j -> cast(65535 & IF(j < {PER_LONG}, shiftrightunsigned(k1, {BITS} * (least(length, {PER_LONG}) - 1 - least(j, {PER_LONG} - 1))), shiftrightunsigned(k2, {BITS} * (length - 1 - j))) as int))"
    )


def count_windows(df: DataFrame, tokens: str, shortest: int = 2, longest: int = 8, min_count: int = MIN_COUNT, forbidden: Column | None = None) -> DataFrame:
    """(atoms, length, n) of the runs seen ``min_count`` times or more; runs that touch a ``forbidden`` token
    (an array literal) are left out. Runs do not cross rows.

    A run is only that frequent where all of its parts are. So the shortest runs are counted first, then those one
    longer whose two parts are frequent, then all others whose parts of that length are. What is frequent is sent to the
    tasks as bits by hash, CELLS in number whatever the corpus; that lets some runs through in vain, and as all that
    comes through is counted, none is lost. So what a corpus has once, its mass, is never shuffled as a long run. A task
    counts the runs of PIECE tokens by itself and sends them as arrays, one for each bucket of a hash. A bucket's arrays are
    added up by one call; there are more buckets the more tokens there are, so that a call holds no more.
    """
    if not 1 <= shortest <= longest <= 2 * PER_LONG:
        raise ValueError(f"runs have 1 to {2 * PER_LONG} tokens")
    steps = [(n, n) for n in range(shortest, min(shortest + 2, longest + 1))] + ([(shortest + 2, longest)] if longest > shortest + 1 else [])
    steps = steps if min_count > 1 else [(shortest, longest)]
    streams = df.select(F.col(tokens).cast("array<int>").alias("tokens"))
    streams = streams if getattr(df, "_stored_at", None) else stored(streams)  # what is stored already is not stored again
    many = streams.agg(F.sum(F.size("tokens"))).first()[0] or 0
    buckets = 1 << min(16, (max(1, many) // BUCKET).bit_length())
    parts, sieve = [], None
    for first, last in steps:
        held = None if sieve is None else df.sparkSession.sparkContext.broadcast(sieve)
        runs = streams.mapInArrow(_sent(first, last, held, buckets), "length byte, bucket int, k1 array<long>, k2 array<long>, n array<long>")
        counts = runs.groupBy("length", "bucket").applyInArrow(_counted(min_count), "length byte, k1 long, k2 long, n long")
        parts.append(stored(counts))
        if last < longest:
            sieve = _sieve(parts[-1], CELLS)
    release(streams)
    counts = parts[0]
    for p in parts[1:]:
        counts = counts.unionByName(p)
    out = counts.select(_unpacked().alias("atoms"), F.col("length").cast("int").alias("length"), "n")
    return out if forbidden is None else out.where(~F.arrays_overlap("atoms", forbidden))


def _sent(first: int, last: int, sieve, buckets: int):
    return lambda batches: _runs(first, last, sieve and sieve.value, buckets)(batches)


def candidates(counts: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Of each length the ``limit`` most frequent runs (ties by the run), with what each would save.

    A histogram of the counts tells from which count on all runs are kept; only the runs of the last count that
    takes part are ordered, as a top-k per task.
    """
    counts = stored(counts)
    sizes: dict[int, list[tuple[int, int]]] = {}
    for r in counts.groupBy("length", "n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).collect():  # distinct counts, not runs
        sizes.setdefault(r["length"], []).append((r["n"], r["k"]))
    out = None
    for length, hist in sorted(sizes.items()):
        taken, least, rest = 0, 0, 0
        for n, k in hist:
            if taken + k > limit:
                least, rest = n, limit - taken
                break
            taken += k
        own = counts.where(F.col("length") == length)
        kept = own.where(F.col("n") > least)
        if rest:
            kept = kept.unionByName(own.where(F.col("n") == least).orderBy("atoms").limit(rest))
        out = kept if out is None else out.unionByName(kept)
    out = counts.limit(0) if out is None else out
    return out.withColumn("savings", F.col("n") * (F.col("length") - 1))


def pair_counts(df: DataFrame, tokens: str, times: str | None = None) -> DataFrame:
    """(left, right, n) of neighbouring tokens; a row counts ``times`` times."""
    pairs = df.select(F.explode(adjacent_pairs(F.col(tokens))).alias("p"), (F.col(times) if times else F.lit(1)).cast("long").alias("k"))
    return pairs.groupBy(F.col("p.left").alias("left"), F.col("p.right").alias("right")).agg(F.sum("k").alias("n"))
