"""Composite tokens: encoding with the fewest tokens, decoding, usage, and growing a dictionary.

A dictionary is a table (id, atoms) of at most 62,529 entries (ids are 16-bit), so broadcasting it is bounded.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import words
from ..functions.vocabulary import COMPOSITE, CONTROL
from ..tables import release, stored
from .ngrams import BITS, pair_counts

MOST = 65535 - COMPOSITE
LONGEST = 8
#: Runs that a dictionary may be chosen from.
POOL = 1_000_000


def fewest_tokens(stream: list[int], entries: dict[tuple[int, ...], int], longest: int, sizes: list[int] | None = None) -> list[int]:
    """The shortest encoding; of equal ones that which ends in the longest composite, from the end backwards. How many
    tokens each stands for is added to ``sizes``, from the end backwards."""
    cost, took = [0], [0]
    for end in range(1, len(stream) + 1):
        best, size = cost[end - 1] + 1, 1
        for n in range(2, min(longest, end) + 1):
            if cost[end - n] < best and tuple(stream[end - n : end]) in entries:
                best, size = cost[end - n] + 1, n
        cost.append(best)
        took.append(size)
    out, end = [], len(stream)
    while end:
        n = took[end]
        out.append(stream[end - 1] if n == 1 else entries[tuple(stream[end - n : end])])
        end -= n
        if sizes is not None:
            sizes.append(n)
    return out[::-1]


class Encoder:
    """Encodes many streams at a time. All places where an entry occurs are found by sorted hashes and compared; a place
    that no entry spans cuts a stream, so what is left to the shortest path are short runs between such cuts, which are
    walked side by side, a token of each at a time. The few longest of them are walked alone."""

    ALONE, SHORT = 32, 64

    def __init__(self, entries: dict[tuple[int, ...], int]):
        self.entries, self.longest = entries, max(map(len, entries), default=1)
        self.salt, self.tables = 0, {}
        for n in sorted({len(a) for a in entries if len(a) > 1}):
            of = [a for a in entries if len(a) == n]
            atoms, ids = np.array(of, np.int64), np.array([entries[a] for a in of], np.int64)
            self.tables[n] = (atoms, ids)
        while True:  # until no two entries of a length share a hash
            hashes = {n: self._hashed(atoms, self.salt) for n, (atoms, _) in self.tables.items()}
            if all(len(np.unique(h)) == len(h) for h in hashes.values()):
                break
            self.salt += 1
        self.hashes = {}
        for n, h in hashes.items():
            order = np.argsort(h)
            self.hashes[n] = h[order]
            self.tables[n] = tuple(x[order] for x in self.tables[n])

    @staticmethod
    def _step(h: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        h = (h ^ tokens.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))

    @classmethod
    def _hashed(cls, windows: np.ndarray, salt: int) -> np.ndarray:
        out = np.full(len(windows), salt, np.uint64)
        for j in range(windows.shape[1]):
            out = cls._step(out, windows[:, j])
        return out

    def _places(self, flat: np.ndarray):
        """(length, where entries of that length begin, their rows in the table of the length)."""
        h = np.full(len(flat), self.salt, np.uint64)
        for n in range(1, self.longest + 1):
            if len(flat) < n:
                return
            h = self._step(h[: len(flat) - n + 1], flat[n - 1 :])
            if n in self.hashes:
                k = np.minimum(np.searchsorted(self.hashes[n], h), len(self.hashes[n]) - 1)
                at = np.flatnonzero(self.hashes[n][k] == h)
                k = k[at]
                same = np.ones(len(at), bool)
                for j in range(n):
                    same &= flat[at + j] == self.tables[n][0][k, j]
                yield n, at[same], k[same]

    @staticmethod
    def _uncovered(spanned: np.ndarray, ends: np.ndarray) -> np.ndarray:
        cut = np.cumsum(spanned)[:-1] == 0
        cut[ends[ends < len(cut)]] = True
        return cut

    def cuts(self, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which tokens of streams laid end to end begin where no entry spans the place."""
        spanned = np.zeros(len(flat) + 1, np.int64)  # entries over the place before each token, as differences
        row = np.searchsorted(ends, np.arange(len(flat)), side="right")
        for n, at, _ in self._places(flat.astype(np.int64)):
            at = at[row[at] == row[at + n - 1]]
            spanned[at + 1] += 1
            spanned[at + n] -= 1
        return self._uncovered(spanned, ends)

    def encode_flat(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, sizes) of the encoded streams that lie end to end in ``flat``."""
        flat, ends = flat.astype(np.int64), np.cumsum(sizes)
        row = np.repeat(np.arange(len(sizes)), sizes)
        spanned, found = np.zeros(len(flat) + 1, np.int64), {}
        for n, at, k in self._places(flat):
            inside = row[at] == row[at + n - 1]
            at, k = at[inside], k[inside]
            found[n] = np.full(len(flat) + 1, -1, np.int64)  # the entry that ends before each place
            found[n][at + n] = self.tables[n][1][k]
            spanned[at + 1] += 1
            spanned[at + n] -= 1
        starts = np.flatnonzero(self._uncovered(spanned, ends))
        lengths = np.diff(np.append(starts, len(flat)))
        begins, out = np.ones(len(flat), bool), flat.copy()
        many = np.flatnonzero(lengths > 1)
        many = many[np.argsort(-lengths[many], kind="stable")]
        starts, lengths = starts[many], lengths[many]
        limit = max(self.SHORT, int(lengths[self.ALONE]) if len(lengths) > self.ALONE else 0)
        alone = int(np.searchsorted(-lengths, -limit, side="left"))  # those longer than the limit
        for a, n in zip(starts[:alone].tolist(), lengths[:alone].tolist(), strict=True):
            took: list[int] = []
            made = fewest_tokens(flat[a : a + n].tolist(), self.entries, self.longest, took)
            begins[a : a + n] = False
            at = a + np.cumsum([0, *took[::-1][:-1]])
            begins[at], out[at] = True, made
        self._side_by_side(starts[alone:], lengths[alone:], found, begins, out)
        return out[begins], np.bincount(row[begins], minlength=len(sizes))

    def _side_by_side(self, starts, lengths, found, begins, out) -> None:
        """The shortest paths of runs, the longest first; sets where their tokens begin, and which they are."""
        if not len(starts):
            return
        took = np.ones(len(begins) + 1, np.int8)
        costs = [np.zeros(len(starts), np.int32)]  # of the last ends, the newest last
        active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
        for end, m in enumerate(active.tolist(), 1):
            place = starts[:m] + end
            best, size = costs[-1][:m] + 1, np.ones(m, np.int8)
            for n, entry in found.items():
                if n <= end:
                    before = costs[-n][:m]
                    better = (entry[place] >= 0) & (before < best)
                    best, size = np.where(better, before + 1, best), np.where(better, np.int8(n), size)
            took[place] = size
            costs = [*costs[-self.longest + 1 :], best] if self.longest > 1 else [best]
        place, first = starts + lengths, starts
        while len(place):
            size = took[place].astype(np.int64)
            for n, entry in found.items():
                composite = place[size == n]
                out[composite - n] = entry[composite]
                for j in range(1, n):
                    begins[composite - j] = False
            place = place - size
            left = place > first
            place, first = place[left], first[left]

    def encode(self, streams: list[np.ndarray]) -> list[list[int]]:
        sizes = np.array([len(s) for s in streams], np.int64)
        tokens, made = self.encode_flat(np.concatenate([np.zeros(0, np.int64), *streams]), sizes)
        tokens, ends = tokens.tolist(), np.cumsum(made).tolist()
        return [tokens[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _listed(dictionary: DataFrame) -> list[tuple[int, list[int]]]:
    rows = dictionary.select("id", "atoms").orderBy("id").limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"a dictionary has at most {MOST} entries")
    return [(r["id"], list(r["atoms"])) for r in rows]


def unsound_entries(dictionary: DataFrame) -> DataFrame:
    """Entries that a dictionary must not have: wrong lengths, unknown or control atoms, repeated expansions."""
    atoms = F.col("atoms")
    reason = (
        F.when(~F.size(atoms).between(2, LONGEST), "length")
        .when(F.exists(atoms, lambda a: a.isNull() | (a < 0) | (a >= CONTROL["pad"])), "atom")
        .when(F.count("*").over(Window.partitionBy("atoms")) > 1, "repeated")
    )
    return dictionary.withColumn("reason", reason).where("reason IS NOT NULL")


#: Tokens that a task encodes or decodes at a time.
PIECE = 250_000


def encode(df: DataFrame, tokens: str, dictionary: DataFrame, out: str = "encoded") -> DataFrame:
    """``df`` with ``tokens`` encoded. A shortest path per row, for which SQL arrays would copy their state at
    every token, hence a vectorised function; the plan stays free of shuffles."""
    entries = {tuple(a): i for i, a in _listed(dictionary)}
    shared = df.sparkSession.sparkContext.broadcast(entries)

    @F.arrow_udf("array<int>")
    def shortest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(shared.value)
        for b in batches:
            values, sizes, there = words.flat(b)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            made = [encoder.encode_flat(values[ends[i] : ends[j]], sizes[i:j]) for i, j in words.rows_within(sizes, PIECE)]
            yield words.lists(np.concatenate([np.zeros(0, np.int64), *(t for t, _ in made)]), np.concatenate([np.zeros(0, np.int64), *(n for _, n in made)]), there)

    return df.withColumn(out, shortest(F.col(tokens).cast("array<int>")))


def decode(df: DataFrame, tokens: str, dictionary: DataFrame, out: str = "decoded") -> DataFrame:
    """Composites replaced by their atoms; null where an id is unknown."""
    rows = _listed(dictionary)
    shared = df.sparkSession.sparkContext.broadcast(rows)

    @F.arrow_udf("array<int>")
    def expanded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        expander = _Expander(shared.value)
        for b in batches:
            values, sizes, there = words.flat(b)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            made = [expander.expand(values[ends[i] : ends[j]], sizes[i:j]) for i, j in words.rows_within(sizes, PIECE)]
            known = np.concatenate([np.zeros(0, bool), *(k for _, _, k in made)])
            yield words.lists(np.concatenate([np.zeros(0, np.int64), *(t for t, _, _ in made)]), np.concatenate([np.zeros(0, np.int64), *(n for _, n, _ in made)]), there & known)

    # a null token is an unknown one
    return df.withColumn(out, expanded(F.transform(F.col(tokens).cast("array<int>"), lambda t: F.coalesce(t, F.lit(_UNKNOWN)))))


_UNKNOWN = (1 << 31) - 1


class _Expander:
    """Composites to atoms, many streams at a time; an id is its place."""

    def __init__(self, rows: list[tuple[int, list[int]]]):
        self.sizes = np.full(max((i - COMPOSITE for i, _ in rows), default=-1) + 1, -1, np.int64)
        self.starts, self.atoms, at = self.sizes.copy(), np.concatenate([np.zeros(0, np.int64), *(np.array(a, np.int64) for _, a in rows)]), 0
        for i, a in rows:
            if i >= COMPOSITE:
                self.sizes[i - COMPOSITE], self.starts[i - COMPOSITE] = len(a), at
            at += len(a)

    def expand(self, tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(atoms, sizes, whether all ids are known); nothing where they are not."""
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = tokens.astype(np.int64) - COMPOSITE
        composite = place >= 0
        named = composite & (place < len(self.sizes))
        many = np.ones(len(tokens), np.int64)
        many[composite] = -1
        many[named] = self.sizes[place[named]]
        known = np.ones(len(sizes), bool)
        known[row[many < 0]] = False
        kept = known[row]
        tokens, place, many, composite, row = tokens[kept], place[kept], many[kept], composite[kept], row[kept]
        out = np.repeat(tokens.astype(np.int64), many)
        inner = np.repeat(composite, many)
        begin = np.cumsum(many) - many
        source = np.zeros(len(tokens), np.int64)
        source[composite] = self.starts[place[composite]] - begin[composite]
        out[inner] = self.atoms[np.repeat(source, many)[inner] + np.flatnonzero(inner)]
        return out, np.bincount(row, weights=many, minlength=len(sizes)).astype(np.int64), known


def usage(df: DataFrame, encoded: str, dictionary: DataFrame) -> DataFrame:
    """(id, atoms, n): how often each entry was chosen, 0 included."""
    used = df.select(F.explode(encoded).alias("id")).where(F.col("id") >= COMPOSITE).groupBy("id").agg(F.count("*").alias("n"))
    return dictionary.join(used, "id", "left").select("id", "atoms", F.coalesce("n", F.lit(0)).alias("n"))


def merges(df: DataFrame, encoded: str, dictionary: DataFrame, pool: DataFrame, times: str | None = None) -> DataFrame:
    """(atoms, n) of neighbouring tokens whose joint expansion is in the pool (atoms), summed over the ways to
    split it; a row counts ``times`` times."""
    of = dictionary.select(F.col("id"), F.col("atoms"))
    pairs = pair_counts(df, encoded, times)
    for side in ("left", "right"):
        pairs = pairs.join(F.broadcast(of.select(F.col("id").alias(side), F.col("atoms").alias(f"_{side}"))), side, "left")
        pairs = pairs.withColumn(f"_{side}", F.coalesce(f"_{side}", F.array(side)))
    joint = pairs.select(F.concat("_left", "_right").alias("atoms"), "n").where(F.size("atoms") <= LONGEST)
    return joint.groupBy("atoms").agg(F.sum("n").alias("n")).join(pool.select("atoms").distinct(), "atoms", "left_semi")


def _numbered(spark, entries: list[list[int]]) -> DataFrame:
    return spark.createDataFrame([(COMPOSITE + i, a) for i, a in enumerate(entries)], "id int, atoms array<int>")


class _Pool:
    """The runs that may become entries, by number in the order of their tokens."""

    def __init__(self, runs: list[tuple[int, ...]]):
        self.runs = sorted(runs)
        self.number = {a: k for k, a in enumerate(self.runs)}

    def segments(self, batches) -> Iterator[pa.Array]:
        """Each batch's streams cut wherever no run of the pool spans the place; pieces of one token are left out."""
        places = Encoder(self.number)
        for b in batches:
            flat, sizes, _ = words.flat(b.column(0))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            for i, j in words.rows_within(sizes, PIECE):
                t = flat[ends[i] : ends[j]]
                starts = np.flatnonzero(places.cuts(t, ends[i + 1 : j + 1] - ends[i]))
                lengths = np.diff(np.append(starts, len(t)))
                many = lengths > 1
                yield words.lists(t[np.repeat(many, lengths)], lengths[many])

    def inside(self, segment: list[int]) -> set[int]:
        """Numbers of the runs that occur."""
        found = (self.number.get(tuple(segment[i : i + n])) for n in range(2, LONGEST + 1) for i in range(len(segment) - n + 1))
        return {k for k in found if k is not None}


def _changes(pool: _Pool, before: list[int] | None, after: list[int]):
    """How many more times each run of the pool is chosen, and is the joint expansion of two neighbours, when the
    entries ``after`` take the place of ``before`` (none: nothing was counted yet)."""

    base = 1 << BITS  # beyond all tokens, whatever they are

    def tally(batches):
        chosen, joint = Counter(), Counter()
        encoders = [(sign, Encoder({pool.runs[k]: base + k for k in entries})) for sign, entries in ((-1, before), (1, after)) if entries is not None]
        for b in batches:
            times = b.column("times").to_pylist()
            streams = [np.asarray(x.values, np.int64) for x in b.column("segment")]
            made = [encoder.encode(streams) for _, encoder in encoders]
            for row in zip(times, *made, strict=True):
                if len(row) == 3 and row[1] == row[2]:
                    continue
                for (sign, _), tokens in zip(encoders, row[1:], strict=True):
                    atoms = [pool.runs[t - base] if t >= base else (t,) for t in tokens]
                    for t in tokens:
                        if t >= base:
                            chosen[t - base] += sign * row[0]
                    for left, right in zip(atoms, atoms[1:], strict=False):
                        k = pool.number.get(left + right)
                        if k is not None:
                            joint[k] += sign * row[0]
        keys = sorted(chosen.keys() | joint.keys())
        columns = [pa.array(keys, pa.int64()), pa.array([chosen[k] for k in keys], pa.int64()), pa.array([joint[k] for k in keys], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["run", "chosen", "joint"])

    return tally


def select_dictionary(df: DataFrame, tokens: str, pool: DataFrame, budget: int, block: int = 64, rounds: int = 100_000) -> DataFrame:
    """A dictionary of at most ``budget`` entries grown in rounds: encode, drop what was never chosen, admit up
    to ``block`` of the most frequent joint runs. At the end what the last encoding leaves unused is dropped.

    Streams are cut once where no run of the pool spans the place, as no entry ever will, and equal segments become
    one with their number. An index tells which segments hold which run of the pool. A round encodes only the segments
    that hold a run just admitted, before and after, and adds the differences of the counts to what is known; so all
    rounds together cost a few encodings, however many they are. The driver holds two numbers a run of the pool, of
    which there are POOL at most.
    """
    spark = df.sparkSession
    budget = min(budget, MOST)
    runs = [tuple(r["atoms"]) for r in pool.select("atoms").distinct().limit(POOL + 1).collect()]
    if len(runs) > POOL:
        raise ValueError(f"a pool has at most {POOL} runs")
    runs = _Pool([r for r in runs if 2 <= len(r) <= LONGEST])
    shared = spark.sparkContext.broadcast(runs)

    def cut(batches):
        for out in shared.value.segments(batches):
            yield pa.RecordBatch.from_arrays([out], names=["segment"])

    def postings(batches):
        for b in batches:
            found = [(k, i) for i, x in zip(b.column("id").to_pylist(), b.column("segment").to_pylist(), strict=True) for k in shared.value.inside(x)]
            columns = [pa.array([f[j] for f in found], pa.int64()) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["run", "id"])

    pieces = df.select(F.col(tokens).cast("array<int>").alias("t")).mapInArrow(cut, "segment array<int>")
    segments = stored(pieces.groupBy("segment").agg(F.count("*").alias("times")).withColumn("id", F.monotonically_increasing_id()))
    index = stored(segments.select("id", "segment").mapInArrow(postings, "run long, id long").repartitionByRange("run", "id").sortWithinPartitions("run"))

    def counted(rows: DataFrame, before: list[int] | None, after: list[int]) -> None:
        found = rows.select("segment", "times").mapInArrow(lambda bs: _changes(shared.value, before, after)(bs), "run long, chosen long, joint long")
        for r in found.groupBy("run").agg(F.sum("chosen").alias("chosen"), F.sum("joint").alias("joint")).collect():  # POOL rows at most
            chosen[r["run"]] += r["chosen"]
            joint[r["run"]] += r["joint"]

    chosen, joint = np.zeros(len(runs.runs), np.int64), np.zeros(len(runs.runs), np.int64)
    entries: list[int] = []
    counted(segments, None, entries)
    for _ in range(rounds):
        entries = [k for k in entries if chosen[k] > 0]
        room = min(block, budget - len(entries))
        if room <= 0:
            break
        free = joint.copy()
        free[entries] = 0
        best = np.argsort(-free, kind="stable")[:room]  # of equal numbers the first by its tokens
        added = best[free[best] > 0].tolist()
        if not added:
            break
        held = index.where(F.col("run").isin(added)).select("id").distinct()
        counted(segments.join(held, "id", "left_semi"), entries, entries + added)
        entries = entries + added
    release(segments, index)
    return _numbered(spark, [list(runs.runs[k]) for k in entries if chosen[k] > 0])
