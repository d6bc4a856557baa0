"""A class-based n-gram model (Brown et al.): exchange clustering and smoothed perplexity.

1. Words of the training rows are counted over the whole corpus (one shuffle of per-task counts).
2. The ``words`` most frequent words are a unit each, the end of a text is one, and every other word stands, as a
   neighbour, for the unit of its form (letters, ending, length). Counts of neighbouring units are summed over the
   corpus; as units are fixed in number, that table has a fixed bound, and exchange clustering moves units between
   classes as long as the likelihood of the class bigrams grows.
3. Every other word of the corpus, however many there are, goes to the class that makes its own neighbours likeliest:
   its counts of (class before, class after) are gathered by a Spark aggregation over all texts.
4. With g the class of the unit before and h the class of the word,
   P(w | v) = (c(w)+1) * (mix * P(h | g) / mass(h) + (1-mix) / (N+V+1)), mass(h) being what (c+1) sums to in h. All
   unseen words are one word of count 0, in the class with the most words of count 1; the probabilities add up to 1.

The ``head`` most frequent words are broadcast (a fixed number); all others reach the documents by a shuffle join,
so that what is gathered grows with the corpus and nothing is capped.

Cases: null and empty texts are one end token; a null id is the empty string for the fold; without training
rows N and V are 0 and every token has probability 1/1 of the base; repeated rows give a row each; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.words import rows_within
from .base import cut, frequent, release, tidy, with_row_number

HEAD, WORDS, CLASSES, MIX = 200_000, 2048, 64, 0.95
SWEEPS, PRIOR = 8, 100.0
#: What a word's form counts for in favour of that form's class, in log likelihood: it decides for rare words.
HINT = 4.0
#: Bytes of text that a task splits at a time, and neighbours' counts that it scores at a time.
PIECE, MET = 1 << 21, 1 << 15

_LETTER = {c: g for g, cs in enumerate([b"ao", b"e", b"s", b"nr", b"td", b"hg"]) for c in cs}
_DIGITS = frozenset(b"0123456789")
FORMS = 4 * 4 * 3 * 8


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def tokens(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def pieces(batches, column: str = "t"):
    """(rows, distinct words, which of them stands at each place, words of each row) of binary texts, whole rows of PIECE
    bytes at a time: words are split, and equal ones made one, by Arrow."""
    for b in batches:
        for i, j in rows_within(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(), PIECE):
            rows = b.slice(i, j - i)
            split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(rows.column(column), b"").view(pa.string())))
            each = split.flatten()
            there = pc.binary_length(each).to_numpy() > 0
            upto = np.concatenate([[0], np.cumsum(there)])[np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])]
            coded = pc.dictionary_encode(each.view(pa.binary()).filter(pa.array(there)))
            yield rows, coded.dictionary, coded.indices.to_numpy(), np.diff(upto)


def between_ends(values: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(values of all texts with an end before, between and after them, where each value stands)."""
    at = np.arange(len(values)) + np.repeat(np.arange(len(sizes)), sizes) + 1
    out = np.full(len(values) + len(sizes) + 1, end, np.int64)
    out[at] = values
    return out, at


def lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Lists that end before the places ``ends`` of ``values``."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values, kind))


def form(word: bytes) -> int:
    """Which of the FORMS a word has: kind of characters, punctuation at its end, length, last letter."""
    body = word.rstrip(b".,;:!?\"')")
    end = 0 if len(body) == len(word) else 1 if word[-1:] == b"," else 2 if word[-1:] == b"." else 3
    kind = 1 if not word.isascii() else 0 if body.isalpha() else 2 if _DIGITS & set(word) else 3
    size = 0 if len(body) <= 4 else 1 if len(body) <= 8 else 2
    last = _LETTER.get(body[-1], 7 if body[-1] >= 0x80 else 6) if body else 6
    return ((kind * 4 + end) * 3 + size) * 8 + last


#: Of each byte: whether it is a letter, a digit, beyond ASCII; and what it tells as the last one.
_KINDS = np.array([[chr(c).isascii() and chr(c).isalpha(), c in _DIGITS, c >= 0x80] for c in range(256)])
_LAST = np.array([_LETTER.get(c, 7 if c >= 0x80 else 6) for c in range(256)])


def forms(words: pa.Array) -> np.ndarray:
    """``form`` of every one of binary words that are not empty."""
    if not len(words):
        return np.zeros(0, np.int64)
    sizes, bodies = (pc.binary_length(x).to_numpy().astype(np.int64) for x in (words, pc.ascii_rtrim(words.view(pa.string()), characters=".,;:!?\"')")))
    data = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), b"")[0].as_buffer(), np.uint8)
    at = np.cumsum(sizes) - sizes

    def within(kind, upto):
        total = np.concatenate([[0], np.cumsum(_KINDS[:, kind][data], dtype=np.int32)])
        return total[at + upto] - total[at]

    last = data[at + sizes - 1]
    end = np.where(bodies == sizes, 0, np.where(last == ord(","), 1, np.where(last == ord("."), 2, 3)))
    plain = np.where((bodies > 0) & (within(0, bodies) == bodies), 0, np.where(within(1, sizes) > 0, 2, 3))
    kind = np.where(within(2, sizes) > 0, 1, plain)
    size = (bodies > 4).astype(np.int64) + (bodies > 8)
    letter = np.where(bodies > 0, _LAST[data[at + np.maximum(bodies, 1) - 1]], 6)
    return ((kind * 4 + end) * 3 + size) * 8 + letter


def units_of(words: pa.Array, top: pa.Array) -> np.ndarray:
    """The unit of every word: its place in ``top``, or that of its form behind the end."""
    unit = pc.fill_null(pc.index_in(words, value_set=top), -1).to_numpy().astype(np.int64)
    other = np.flatnonzero(unit < 0)
    unit[other] = len(top) + 1 + forms(words.take(pa.array(other)))
    return unit


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, c); the row without a word counts the texts."""

    def counted(batches):
        for rows, words, codes, _ in pieces(batches):
            ns = np.bincount(codes, minlength=len(words))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([words, pa.nulls(1, pa.binary())]), pa.array(np.append(ns, rows.num_rows), pa.int64())], names=["word", "c"])

    return docs.select(F.col(text_col).cast("binary").alias("t")).mapInArrow(counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def unit_bigrams(docs: DataFrame, text_col: str, top: list[bytes]) -> np.ndarray:
    """Counts of neighbouring units over all texts, each with an end before and after it."""
    end = len(top)
    n = end + 1 + FORMS
    shared = docs.sparkSession.sparkContext.broadcast(pa.array(top, pa.binary()))

    def counted(batches):
        held: list[np.ndarray] = []

        def cells():
            at, k = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(at), pa.array(k)], names=["cell", "k"])

        for _, words, codes, sizes in pieces(batches):
            # a text's end is the next text's start, so one array holds many texts
            a, _ = between_ends(units_of(words, shared.value)[codes], sizes, end)
            held.append(a[:-1] * n + a[1:])
            if sum(map(len, held)) > 1_000_000:
                yield cells()
                held = []
        if held:
            yield cells()

    got = docs.select(F.col(text_col).cast("binary").alias("t")).mapInArrow(counted, "cell long, k long").groupBy("cell").agg(F.sum("k").alias("k")).toArrow()
    out = np.zeros(n * n)
    out[got["cell"].to_numpy()] = got["k"].to_numpy()
    return out.reshape(n, n)


def met(docs: DataFrame, text_col: str, top: list[bytes], of: np.ndarray, classes: int) -> DataFrame:
    """(word, codes, ns) for every word but the units: how often it stands between two classes, those as one number. A
    task counts what it splits at a time, so a word has a row for each such piece that holds it."""
    end = len(top)
    shared = docs.sparkSession.sparkContext.broadcast((pa.array(top, pa.binary()), of))

    def around(batches):
        for _, words, codes, sizes in pieces(batches):
            u = units_of(words, shared.value[0])
            g, at = between_ends(shared.value[1][u][codes], sizes, shared.value[1][end])
            other = u[codes] > end
            at, which = at[other], codes[other].astype(np.int64)
            seen, n = np.unique((which * classes + g[at - 1]) * classes + g[at + 1], return_counts=True)
            which, code = np.divmod(seen, classes * classes)
            last = np.flatnonzero(np.diff(which, append=-1))
            yield pa.RecordBatch.from_arrays([words.take(pa.array(which[last])), lists(code, last + 1, pa.int32()), lists(n, last + 1, pa.int32())], names=["word", "codes", "ns"])

    return docs.select(F.col(text_col).cast("binary").alias("t")).mapInArrow(around, "word binary, codes array<int>, ns array<int>")


def assigned(docs: DataFrame, text_col: str, top: list[bytes], of: np.ndarray, log_p: np.ndarray, mass: np.ndarray) -> DataFrame:
    """(word, c, h) for every word but the units: its class h is the one that makes its own occurrences likeliest.
    Rows without a word are the sums, k in all, over those words by (class before, h) as cell.

    of: class of each unit; log_p: log probability of a class after a class; mass: tokens of a class.
    """
    end, classes = len(top), len(log_p)

    def best(batches):
        cells = np.zeros((classes, classes), np.int64)

        def chosen(words, before, after):
            c = before.sum(1)
            score = before @ log_p + after @ log_p.T - c[:, None] * np.log(mass + c[:, None])
            score[np.arange(len(c)), of[end + 1 + forms(words)]] += HINT
            score[:, 0] = -np.inf  # the end's own class
            h = np.argmax(score, axis=1)
            np.add.at(cells.T, h, before.astype(np.int64))
            none = pa.nulls(len(c), pa.int64())
            return pa.RecordBatch.from_arrays([words, pa.array(c, pa.int64(), safe=False), pa.array(h, pa.int32()), none, none], names=["word", "c", "h", "cell", "k"])

        # a word's rows follow each other; the counts of the last one, by class before and after it, wait for the next rows
        held = pa.array([], pa.binary())
        before = after = np.zeros((0, classes))
        for b in batches:
            for i, j in rows_within(np.maximum(b.column("codes").value_lengths().to_numpy(), classes // 8), MET):
                rows = b.slice(i, j - i)
                spelled, lens = pa.concat_arrays([held, rows.column("word")]), np.append(np.zeros(len(held), np.int64), rows.column("codes").value_lengths().to_numpy())
                codes, ns = rows.column("codes").flatten().to_numpy(), rows.column("ns").flatten().to_numpy()
                first = np.append(True, pc.not_equal(spelled[1:], spelled[:-1]).to_numpy(zero_copy_only=False))
                names, own = spelled.filter(pa.array(first)), np.repeat(np.cumsum(first) - 1, lens) * classes
                now = [np.bincount(own + x, ns, len(names) * classes).reshape(-1, classes) for x in (codes // classes, codes % classes)]
                now[0][: len(held)] += before
                now[1][: len(held)] += after
                yield chosen(names[:-1], now[0][:-1], now[1][:-1])
                held, before, after = names[-1:], now[0][-1:], now[1][-1:]
        if len(held):
            yield chosen(held, before, after)
        at = np.flatnonzero(cells)
        none = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.binary()), none, none.cast(pa.int32()), pa.array(at), pa.array(cells.ravel()[at])], names=["word", "c", "h", "cell", "k"])

    found = met(docs, text_col, top, of, classes).repartition("word").sortWithinPartitions("word")
    return cut(found.mapInArrow(best, "word binary, c long, h int, cell long, k long"))


def exchange(bigrams: np.ndarray, classes: int, fixed: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit. Unit ``fixed`` keeps class 0 for itself; every other one moves, most frequent first,
    to the class in which the class bigrams' likelihood is highest, until a sweep moves none."""

    def h(x):
        return x * np.log(np.maximum(x, 1e-300))

    n = len(bigrams)
    total = bigrams.sum(0) + bigrams.sum(1)
    order = [u for u in np.argsort(-total, kind="stable").tolist() if u != fixed and total[u] > 0]
    of = np.ones(n, np.int64)
    of[order] = 1 + np.arange(len(order)) % (classes - 1)
    of[fixed] = 0
    member = np.zeros((n, classes))
    member[np.arange(n), of] = 1
    grid = member.T @ bigrams @ member
    rows, cols = grid.sum(1), grid.sum(0)
    for _ in range(sweeps):
        moved = 0
        for u in order:
            a = of[u]
            right, left, own = np.bincount(of, bigrams[u], classes), np.bincount(of, bigrams[:, u], classes), bigrams[u, u]
            grid[a] -= right
            grid[:, a] -= left
            grid[a, a] += own
            nr, nl = right.sum(), left.sum()
            rows[a] -= nr
            cols[a] -= nl
            right[a] -= own
            left[a] -= own
            hg = h(grid)
            x, y = h(grid + right) - hg, h(grid + left[:, None]) - hg
            d = np.diag(grid)
            gain = x.sum(1) - np.diag(x) + y.sum(0) - np.diag(y) + h(d + right + left + own) - h(d) - h(rows + nr) + h(rows) - h(cols + nl) + h(cols)
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            right[b] += own
            left[b] += own
            grid[b] += right
            grid[:, b] += left
            grid[b, b] -= own
            rows[b] += nr
            cols[b] += nl
            of[u] = b
            moved += a != b
        if not moved:
            break
    return of


class Model:
    """What is fitted: counts, classes and the tables, and ``others``, the words that are no units as (word, c, h)."""

    def __init__(self, train: DataFrame, text_col: str, words: int, classes: int, mix: float):
        counts = cut(word_counts(train, text_col))
        there = F.col("word").isNotNull()
        n_words, distinct, self.ends = counts.agg(F.coalesce(F.sum(F.when(there, F.col("c"))), F.lit(0)), F.count("word"), F.coalesce(F.sum(F.when(~there, F.col("c"))), F.lit(0))).first()
        self.n, self.v = n_words + self.ends, distinct + (self.ends > 0)
        top = counts.where(there).orderBy(F.desc("c"), "word").limit(words).toArrow()
        self.top = [bytes(w) for w in top["word"].to_pylist()]
        self.top_c = top["c"].to_numpy().astype(np.int64)
        self.end = end = len(self.top)

        bigrams = unit_bigrams(train, text_col, self.top)
        self.of = of = exchange(bigrams, classes, end)
        member = np.zeros((len(of), classes))
        member[np.arange(len(of)), of] = 1
        before = member.T @ bigrams  # by class before and unit
        grid = before @ member
        share = (grid.sum(0) + 1) / (grid.sum() + classes)
        log_p = np.log((grid + PRIOR * share) / (grid.sum(1, keepdims=True) + PRIOR))
        words_of = assigned(train, text_col, self.top, of, log_p, grid.sum(0))
        self.others = words_of.where("word IS NOT NULL").select("word", "c", "h")

        self.grid = before[:, : end + 1] @ member[: end + 1]
        for r in words_of.where("word IS NULL").groupBy("cell").agg(F.sum("k").alias("k")).collect():  # one row per pair of classes
            self.grid[r["cell"] // classes, r["cell"] % classes] += r["k"]
        mass, single = np.zeros(classes), np.zeros(classes)
        np.add.at(mass, of[:end], self.top_c + 1)
        np.add.at(single, of[:end], self.top_c == 1)
        if self.ends:
            mass[0] += self.ends + 1
        for r in self.others.groupBy("h").agg(F.sum(F.col("c") + 1).alias("m"), F.count_if(F.col("c") == 1).alias("s")).collect():  # a row per class
            mass[r["h"]] += r["m"]
            single[r["h"]] += r["s"]
        self.unseen = 1 + int(np.argmax(single[1:]))
        mass[self.unseen] += 1
        self.mass = mass
        share = np.where(mass > 0, self.grid.sum(0) + 1, 0)
        self.transition = (self.grid + PRIOR * share / share.sum()) / (self.grid.sum(1, keepdims=True) + PRIOR)
        #: log10 of what stands after (c+1), by the class before and the word's class
        self.table = np.log10(mix * self.transition / np.maximum(mass, 1) + (1 - mix) / (self.n + self.v + 1))
        release(counts)


@tidy
def class_scores(docs: DataFrame, id_col: str, text_col: str, folds: int, out_fold: int, head: int = HEAD, words: int = WORDS, classes: int = CLASSES, mix: float = MIX) -> DataFrame:
    """Per row: the model's and the unigram base's log10 probability of the whole text, learned from the rows
    whose fold is not ``out_fold``."""
    spark = docs.sparkSession
    docs = docs.select(id_col, F.col(text_col).alias("_text"), (fold(id_col, folds) == out_fold).alias("held_out"))
    model = Model(docs.where(~F.col("held_out")), "_text", words, classes, mix)
    end = model.end
    known = frequent(model.others, "c", head).toArrow()
    spellings = pa.concat_arrays([pa.array(model.top, pa.binary()), *known["word"].cast(pa.binary()).chunks])
    unit = np.concatenate([np.arange(end), end + 1 + forms(spellings[end:])]).astype(np.int64)
    shared = spark.sparkContext.broadcast(
        {
            "ids": spellings,
            "log_c": np.log10(np.concatenate([model.top_c, known["c"].to_numpy()]) + 1.0),
            "before": model.of[unit],
            "class": np.concatenate([model.of[:end], known["h"].to_numpy()]).astype(np.int64),
            "of": model.of,
            "table": model.table,
            "log_end": float(np.log10(model.ends + 1)),
        }
    )

    def scored(batches):
        m = shared.value
        ids, log_c, before, cls, of, tab = m["ids"], m["log_c"], m["before"], m["class"], m["of"], m["table"]
        for rows, words, codes, sizes in pieces(batches, "_text"):
            many = rows.num_rows
            ident = pc.fill_null(pc.index_in(words, value_set=ids), -1).to_numpy().astype(np.int64)
            new = np.flatnonzero(ident < 0)
            one = np.zeros(len(words), np.int64)  # class of a word before another
            one[ident >= 0] = before[ident[ident >= 0]]
            one[new] = of[end + 1 + forms(words.take(pa.array(new)))]
            g, at = between_ends(one[codes], sizes, 0)  # the end's class is 0
            row, known, g = np.repeat(np.arange(many), sizes), ident[codes], g[at - 1]
            last = np.zeros(many, np.int64)
            last[sizes > 0] = one[codes[np.cumsum(sizes)[sizes > 0] - 1]]
            old = known >= 0
            summed = lambda x: np.bincount(row[old], x, many)
            ctx = summed(tab[g[old], cls[known[old]]]) + tab[last, 0]
            logs = summed(log_c[known[old]]) + m["log_end"]
            n_known = np.bincount(row[old], minlength=many) + (m["log_end"] > 0)
            # the others of each text with the class before them, equal ones as one
            seen, ks = np.unique((row[~old] * len(words) + codes[~old]) * classes + g[~old], return_counts=True)
            seen, gs = np.divmod(seen, classes)
            own, word = np.divmod(seen, max(len(words), 1))
            ends = np.searchsorted(own, np.arange(many), side="right")
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(id_col), rows.column("held_out"), pa.array(sizes + 1, pa.int64()), pa.array(n_known, pa.int64()), pa.array(logs, pa.float64()), pa.array(ctx, pa.float64()),
                    lists(words.take(pa.array(word)), ends, pa.binary()), lists(gs, ends, pa.int32()), lists(ks, ends, pa.int64()),
                ],
                names=[id_col, "held_out", "n_tokens", "n_known", "_logs", "_ctx", "_rest", "_gs", "_ks"],
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.withColumn("_text", F.col("_text").cast("binary")).mapInArrow(scored, f"`{id_col}` {id_type}, held_out boolean, n_tokens long, n_known long, _logs double, _ctx double, _rest array<binary>, _gs array<int>, _ks array<long>")
    rows = cut(with_row_number(rows))
    table = F.broadcast(spark.createDataFrame([(g, h, float(model.table[g, h])) for g in range(classes) for h in range(classes)], "g int, h int, x double"))
    rest = rows.select("_row", F.explode(F.arrays_zip("_rest", "_gs", "_ks")).alias("x")).select("_row", F.col("x._rest").alias("word"), F.col("x._gs").alias("g"), F.col("x._ks").alias("k"))
    known_of = rest.join(model.others, "word", "left").withColumn("h", F.coalesce("h", F.lit(model.unseen))).join(table, ["g", "h"])
    more = known_of.groupBy("_row").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0)).alias("_more"), F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("_more_logs"), F.sum(F.col("k") * F.col("x")).alias("_more_ctx"))
    rows = rows.drop("_rest", "_gs", "_ks").join(more, "_row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    rows = rows.withColumns({"n_known": plus("n_known", "_more"), "_logs": plus("_logs", "_more_logs"), "_ctx": plus("_ctx", "_more_ctx")})
    n, v = model.n, model.v
    return rows.select(
        id_col,
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("_logs") - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))).alias("base_score"),
        (F.col("_logs") + F.col("_ctx")).alias("score"),
        F.pow(F.lit(10.0), -(F.col("_logs") + F.col("_ctx")) / F.col("n_tokens")).alias("perplexity"),
    )
