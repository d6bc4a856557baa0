"""Secrets in texts: patterns that always count, and a character network over every other candidate.

1. A text is scanned once, in Arrow batches. The patterns give the base findings. Candidates are runs of the characters
   that keys are written in, MIN_RUN or longer, with a digit or with capitals inside; what stands before the last "=" is
   a name and not part of them. Each is kept with its characters and those around it, as windows of fixed size (a long
   candidate has several, so all of it is seen).
2. Labelled findings train the network, all of them: those that the caller names, or else the base findings against all
   other candidates, each by its first window. They are dealt to parts, whose networks are averaged after every round.
   One in CALIBRATE of the documents is held back. Many of the training findings are shown without what stands around them or in another alphabet, so that
   keys are known by more than the words before them. Where the labels are the base findings', other candidates may be
   keys that no pattern names: those that a network of the other half of the documents takes for keys teach nothing.
3. The network embeds characters, convolves them, takes the maxima inside and around the candidate and the mean inside,
   and has one hidden layer. A logistic curve fitted to the documents held back, each label weighing what it does in
   the corpus, turns its outputs into probabilities; per kind of alphabet the threshold is the highest one that keeps
   ``recall`` of the findings held back, shown as they are, bare, and bare in another alphabet; all of
   them are counted, by cells of their scores.
4. Every candidate of every document is scored where its document's row lies, without a shuffle.

Cases: a null text is empty; repeated rows are scanned each, ids may be null or repeat; a candidate that overlaps a base
finding adds nothing; with fewer than LEAST findings or other candidates to learn from, nothing is added and
probabilities are null; equal scores share their side of a threshold; very long texts and runs are scanned whole; an
empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, release, slices

# The base patterns and their kinds, in their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
KINDS = ("assign", "access", "hex", "net")

MIN_RUN = 12
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % MIN_RUN)
_KEYWORDS = ("passw", "secret", "token", "api")
#: Characters before, inside and after a candidate that a window shows.
BEFORE, INSIDE, AFTER = 24, 48, 12
WINDOW = BEFORE + INSIDE + AFTER
#: How far apart a long candidate's windows start.
STRIDE = 32
CALIBRATE, LEAST, RECALL = 4, 20, 0.95
#: Rows that a task learns from at a time, how many sums of networks the driver gets, and cells of scores to 1.
PART, MEANS, CELLS = 8192, 32, 1024
_IN = 128
_LETTERS, _SPACE, _OTHER = 1, 2, 3  # beyond printable ASCII
_CODES = 99 + 4
ALPHABETS = ("digits", "hexadecimal", "one case", "mixed")


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of what the patterns find."""
    return _scan(text)[0]


def _scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Base findings and candidates, each in order of their start."""
    base, candidates = [], []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        base += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    for run in _RUN.finditer(text):  # the two other kinds lie inside such runs
        a, b = run.span()
        if b - a >= LEAST_ACCESS:
            base += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text, a, b) if m.end() - m.start() >= LEAST_ACCESS]
        if b - a >= LEAST_HEX:
            base += [(m.start(), m.end(), 2) for m in HEX.finditer(text, a, b) if m.end() - m.start() >= LEAST_HEX]
        own = run[0].rstrip("=.-")
        a += own.rfind("=") + 1
        own = text[a : run.start() + len(own)]
        own, a = own.lstrip(".-"), a + len(own) - len(own.lstrip(".-"))
        if len(own) >= MIN_RUN and (any(c.isdigit() for c in own) or (own != own.lower() and own[1:] != own[1:].lower() and own != own.upper())):
            candidates.append((a, a + len(own)))
    return sorted(base, key=lambda f: (f[0], f[2])), candidates


def codes(text: str) -> np.ndarray:
    """A number below 128 for each character."""
    a = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out = np.where((a >= 32) & (a < 127), a - 28, _OTHER)
    out[(a == 9) | (a == 10) | (a == 13)] = _SPACE
    out[(a >= 192)] = _LETTERS
    return out.astype(np.uint8)


def windows(text: str, start: int, end: int) -> bytes:
    """The candidate's windows one after the other, 0 where the text has ended, inner characters marked."""
    out = bytearray()
    for at in range(start, max(start + 1, end - (INSIDE - STRIDE)), STRIDE):
        last = min(at + INSIDE, end)
        one = np.zeros(WINDOW, np.uint8)
        left = codes(text[max(0, at - BEFORE) : at])
        inner, right = codes(text[at:last]), codes(text[last : last + AFTER])
        one[BEFORE - len(left) : BEFORE] = left
        one[BEFORE : BEFORE + len(inner)] = inner | _IN
        one[BEFORE + len(inner) : BEFORE + len(inner) + len(right)] = right
        out += one.tobytes()
    return bytes(out)


def alphabet(value: str) -> int:
    if value.isdigit():
        return 0
    if re.fullmatch("[0-9a-f]+", value):
        return 1
    return 2 if value in (value.lower(), value.upper()) else 3


_FOUND = "array<struct<start:long,end:long,kind:int>>"
_CANDIDATES = "array<struct<start:long,end:long,alphabet:int,known:boolean,shown:binary>>"


def _scanned(batches):
    for b in slices(batches):
        found, candidates = [], []
        for t in b.column(1).to_pylist():
            base, others = _scan(t or "")
            at, reach, known = 0, 0, []
            for a, z in others:  # both in order: it overlaps if what starts before its end reaches beyond its start
                while at < len(base) and base[at][0] < z:
                    reach = max(reach, base[at][1])
                    at += 1
                known.append(reach > a)
            found.append([{"start": a, "end": z, "kind": k} for a, z, k in base])
            candidates.append([{"start": a, "end": z, "alphabet": alphabet(t[a:z]), "known": known, "shown": windows(t, a, z)} for (a, z), known in zip(others, known, strict=True)])
        item = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("alphabet", pa.int32()), ("known", pa.bool_()), ("shown", pa.binary())])
        base_item = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32())])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(base_item)), pa.array(candidates, pa.list_(item))], names=["_doc", "base", "candidates"])


class Network:
    """Characters to one number: embedding, convolution, pooling, a hidden layer."""

    EMBED, WIDTH, FILTERS, HIDDEN = 8, 5, 32, 24

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        take = lambda *shape, size: (r.standard_normal(shape) * size).astype(np.float32)
        k = self.WIDTH * (self.EMBED + 1)
        self.p = {
            "embed": take(_CODES, self.EMBED, size=0.5),
            "conv": take(k, self.FILTERS, size=(2 / k) ** 0.5),
            "conv_b": np.zeros(self.FILTERS, np.float32),
            "hidden": take(3 * self.FILTERS, self.HIDDEN, size=(2 / (3 * self.FILTERS)) ** 0.5),
            "hidden_b": np.zeros(self.HIDDEN, np.float32),
            "out": take(self.HIDDEN, 1, size=(1 / self.HIDDEN) ** 0.5),
            "out_b": np.zeros(1, np.float32),
        }

    def forward(self, x: np.ndarray, keep: bool = False):
        """Outputs for rows of window characters; with ``keep`` also what ``gradients`` needs."""
        p, inside = self.p, x >= _IN
        code = x & (_IN - 1)
        e = np.concatenate([p["embed"][code], inside[..., None].astype(np.float32)], axis=2)
        cols = np.lib.stride_tricks.sliding_window_view(e, self.WIDTH, axis=1).transpose(0, 1, 3, 2)
        cols = cols.reshape(len(x), cols.shape[1], -1)
        z = np.maximum(cols @ p["conv"] + p["conv_b"], 0)
        mid = inside[:, self.WIDTH // 2 : self.WIDTH // 2 + z.shape[1], None]
        zi, zo = z * mid, z * ~mid
        n = np.maximum(mid.sum(1), 1).astype(np.float32)
        ai, ao = zi.argmax(1), zo.argmax(1)
        best = lambda of, at: np.take_along_axis(of, at[:, None, :], 1)[:, 0]
        pool = np.concatenate([best(zi, ai), best(zo, ao), zi.sum(1) / n], axis=1)
        h = np.maximum(pool @ p["hidden"] + p["hidden_b"], 0)
        y = (h @ p["out"] + p["out_b"])[:, 0]
        return (y, (code, cols, z, mid, n, ai, ao, pool, h)) if keep else y

    def gradients(self, held, dy: np.ndarray) -> dict:
        code, cols, z, mid, n, ai, ao, pool, h = held
        p, f = self.p, self.FILTERS
        g = {"out": h.T @ dy[:, None], "out_b": dy.sum(keepdims=True)}
        dh = (dy[:, None] @ p["out"].T) * (h > 0)
        g |= {"hidden": pool.T @ dh, "hidden_b": dh.sum(0)}
        dpool = dh @ p["hidden"].T
        dz = mid * (dpool[:, 2 * f :] / n)[:, None, :]
        rows, filters = np.arange(len(z))[:, None], np.arange(f)[None, :]
        dz[rows, ai, filters] += dpool[:, :f] * mid[rows, ai, 0]
        dz[rows, ao, filters] += dpool[:, f : 2 * f] * ~mid[rows, ao, 0]
        dz *= z > 0
        flat = dz.reshape(-1, f)
        g |= {"conv": cols.reshape(len(flat), -1).T @ flat, "conv_b": flat.sum(0)}
        dcols = (flat @ p["conv"].T).reshape(*dz.shape[:2], self.WIDTH, self.EMBED + 1)
        de = np.zeros((*code.shape, self.EMBED), np.float32)
        for k in range(self.WIDTH):
            de[:, k : k + dz.shape[1]] += dcols[:, :, k, : self.EMBED]
        at, de = code.ravel(), de.reshape(-1, self.EMBED)
        return g | {"embed": np.column_stack([np.bincount(at, de[:, k], _CODES) for k in range(self.EMBED)])}

    def scores(self, x: np.ndarray, rows: int = 1024) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.float32), *(self.forward(x[k : k + rows]) for k in range(0, len(x), rows))])


_KEY_CODES = codes("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_LOW_HEX = codes("0123456789abcdef")


def bare(x: np.ndarray) -> np.ndarray:
    """Windows with nothing but the candidate."""
    return np.where(x >= _IN, x, 0).astype(np.uint8)


def varied(x: np.ndarray, y: np.ndarray, r: np.random.Generator) -> np.ndarray:
    """Windows as a round of training shows them: of the findings some bare, in another's surroundings, or with
    their characters replaced one by one from the letters and digits; of the others some bare."""
    x, inside = x.copy(), x >= _IN
    draw = r.random(len(x))
    other = x[r.permutation(len(x))]
    hidden = draw < np.where(y, 0.3, 0.15)
    x[hidden] = bare(x[hidden])
    moved = y & (draw >= 0.3) & (draw < 0.5)
    x[moved] = np.where(inside[moved], x[moved], np.where(other[moved] < _IN, other[moved], 0))
    some = np.flatnonzero(y & (r.random(len(x)) < 0.3))
    x[some] = respelt(x[some], r)
    return x


def respelt(x: np.ndarray, r: np.random.Generator) -> np.ndarray:
    """Windows whose candidates have each hexadecimal digit replaced by some letter or digit, row by row another."""
    x = x.copy()
    for k in range(len(x)):
        to = np.arange(256, dtype=np.uint8)
        to[_LOW_HEX | _IN] = r.permutation(_KEY_CODES)[: len(_LOW_HEX)] | _IN
        x[k] = to[x[k]]
    return x


class Learner:
    """A network with the state of Adam; as bytes it goes to tasks and back."""

    def __init__(self, seed: int = 7):
        self.net = Network(seed)
        self.m, self.v = ({k: np.zeros_like(a) for k, a in self.net.p.items()} for _ in range(2))
        self.t = 0

    def values(self) -> np.ndarray:
        return np.concatenate([a.ravel() for of in (self.net.p, self.m, self.v) for a in of.values()])

    def take(self, values: np.ndarray, t: int) -> Learner:
        at, self.t = 0, t
        for of in (self.net.p, self.m, self.v):
            for k, a in of.items():
                of[k] = values[at : at + a.size].reshape(a.shape).astype(np.float32)
                at += a.size
        return self

    def practise(self, x: np.ndarray, y: np.ndarray, weights: dict[bool, float], epochs: int, done: float, share: float, r: np.random.Generator, batch: int = 128) -> None:
        """Some epochs over windows and labels, which are the ``share`` of all training after what is ``done``."""
        weight = np.where(y, weights[True], weights[False])
        steps, own = epochs * -(-len(x) // batch), 0
        for _ in range(epochs):
            shown = varied(x, y, r)
            order = r.permutation(len(x))
            for k in range(0, len(x), batch):
                at = order[k : k + batch]
                out, held = self.net.forward(shown[at], keep=True)
                dy = ((1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[at]) * weight[at] / len(at)).astype(np.float32)
                self.t, own = self.t + 1, own + 1
                rate = 0.003 * (1 - 0.9 * min(1, done + share * own / steps)) / (1 - 0.9**self.t)
                for name, g in self.net.gradients(held, dy).items():
                    self.m[name] += 0.1 * (g - self.m[name])
                    self.v[name] += 0.001 * (g * g - self.v[name])
                    self.net.p[name] -= (rate * self.m[name] / (np.sqrt(self.v[name] / (1 - 0.999**self.t)) + 1e-8)).astype(np.float32)


def _windows_of(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, WINDOW)


def trained(rows: DataFrame, counts: dict[int, dict[bool, int]], rounds: int, steps: int, seed: int = 7) -> dict[int, Network]:
    """For each number ``net`` a network fitted to all its rows (net, key, y, shown) by Adam, both labels weighing the
    same. ``counts``: rows of each label by net. Rows are dealt by their key to parts of some PART rows; a round of each
    part begins with the mean of all parts' networks of the round before, so no task holds more than its part. Each part
    makes ``steps`` steps at least."""
    sizes = {k: sum(c.values()) for k, c in counts.items()}
    parts = {k: -(-n // PART) for k, n in sizes.items()}
    weights = {k: {y: 0.5 * sizes[k] / max(1, c[y]) for y in (True, False)} for k, c in counts.items()}
    epochs = {k: max(1, -(-steps * 128 * parts[k] // (rounds * n))) for k, n in sizes.items()}
    many = F.create_map(*(F.lit(v) for k, n in parts.items() for v in (k, n)))
    dealt = cut(rows.withColumn("part", F.pmod(F.xxhash64("key"), many[F.col("net")]).cast("int")), max(1, sum(parts.values())))
    learners = {k: Learner(seed) for k in counts}
    spark = rows.sparkSession
    for i in range(rounds):
        start = spark.sparkContext.broadcast({k: (a.values(), a.t) for k, a in learners.items()})

        def of_part(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["key", "y", "shown"])
            k, part = int(pdf["net"].iloc[0]), int(pdf["part"].iloc[0])
            own = Learner(seed).take(*start.value[k])
            own.practise(_windows_of(pdf["shown"]), pdf["y"].to_numpy(bool), weights[k], epochs[k], i / rounds, 1 / rounds, np.random.default_rng([seed, i, part]))
            return pd.DataFrame({"net": [k], "part": [part], "n": [len(pdf)], "t": [own.t], "state": [(own.values() * np.float64(len(pdf))).tobytes()]})

        def summed(pdf: pd.DataFrame) -> pd.DataFrame:
            state = np.zeros(len(pdf["state"].iloc[0]) // 8)
            for one in pdf.sort_values("part")["state"]:
                state += np.frombuffer(one)
            return pd.DataFrame({"net": pdf["net"].iloc[:1], "part": pdf["part"].iloc[:1], "n": [pdf["n"].sum()], "t": [pdf["t"].max()], "state": [state.tobytes()]})

        kind = "net int, part int, n long, t long, state binary"
        made = dealt.groupBy("net", "part").applyInPandas(of_part, kind)
        if max(parts.values()) > MEANS:  # sums by tasks first, so that the driver gets a bounded number
            made = made.groupBy("net", F.pmod("part", F.lit(MEANS))).applyInPandas(summed, kind)
        got = sorted(made.collect(), key=lambda r: (r["net"], r["part"]))
        for k, learner in learners.items():
            own = [r for r in got if r["net"] == k]
            learner.take(sum(np.frombuffer(r["state"]) for r in own) / sum(r["n"] for r in own), max(r["t"] for r in own))
        start.unpersist()
    release(dealt)
    return {k: a.net for k, a in learners.items()}


def logistic(s: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(slope, shift) of the curve that turns scores into probabilities; drawn a little to slope 1."""
    at = np.array([1.0, 0.0])
    x = np.column_stack([s, np.ones(len(s))]).astype(float)
    pull = np.diag([1e-2, 1e-4])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        g = x.T @ (w * (p - y)) + pull @ (at - [1, 0])
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + pull, g)
        at = at - np.clip(step, -5, 5)
    return float(at[0]), float(at[1])


def lowest_kept(p: np.ndarray, recall: float) -> float:
    """The highest threshold at which ``recall`` of the values reach it."""
    return float(np.sort(p)[int(np.floor((1 - recall) * len(p)))])


def kept_threshold(p: np.ndarray, n: np.ndarray, recall: float) -> float:
    """``lowest_kept`` of values that stand for ``n`` each, of which ``p`` is the lowest."""
    order = np.argsort(p)
    return float(p[order][np.searchsorted(np.cumsum(n[order]), np.floor((1 - recall) * n.sum()), side="right")])


def _by(counted: list, name: str) -> dict[int, dict[bool, int]]:
    out: dict[int, dict[bool, int]] = {}
    for r in counted:
        own = out.setdefault(int(r[name]), {True: 0, False: 0})
        own[r["y"]] += r["count"]
    return out


def sure_rows(rows: DataFrame, counted: list) -> DataFrame:
    """``rows`` without candidates that have no label and that a network of the other half takes for keys."""
    learn = {1 - h: c for h, c in _by(counted, "half").items() if min(c.values()) >= LEAST // 2}
    if not learn:
        return rows
    nets = rows.sparkSession.sparkContext.broadcast(trained(rows.withColumn("net", 1 - F.col("half")).where(F.col("net").isin(*learn)), learn, rounds=3, steps=200))

    def judged(batches):
        for b in slices(batches):
            y, half = (np.array(b.column(k).to_pylist(), t) for k, t in (("y", bool), ("half", int)))
            x, doubt = _windows_of(b.column("shown").to_pylist()), np.zeros(len(y), bool)
            for h, net in nets.value.items():
                at = np.flatnonzero((half == h) & ~y)
                doubt[at] = net.scores(x[at]) > 0
            yield b.filter(pa.array(~doubt))

    return cut(rows.mapInArrow(judged, rows.schema))


def fitted(rows: DataFrame, counts: dict[bool, int], recall: float, trusted: bool):
    """(network, slope, shift, thresholds by alphabet) from all labelled windows; none where there are too few."""
    counted = rows.groupBy("y", "held", "half").count().collect()
    if min(_by(counted, "held").get(0, {True: 0, False: 0}).values()) < LEAST:
        return None
    if not trusted:
        rows = sure_rows(rows, counted)
        counted = rows.groupBy("y", "held", "half").count().collect()
    by = _by(counted, "held")
    if not by.get(0, {False: 0})[False]:
        return None
    net = trained(rows.where(~F.col("held")).withColumn("net", F.lit(0)), {0: by[0]}, rounds=10, steps=400)[0]
    use = rows.where("held") if min(by.get(1, {True: 0, False: 0}).values()) else rows
    shared, last = rows.sparkSession.sparkContext.broadcast(net), len(ALPHABETS) - 1

    def views(batches):
        for b in slices(batches):
            y, kind = (np.array(b.column(k).to_pylist(), t) for k, t in (("y", bool), ("alphabet", int)))
            x = _windows_of(b.column("shown").to_pylist())
            plain, keys = bare(x), np.array(b.column("key").to_pylist(), np.int64)[y].view(np.uint64)
            other = [respelt(plain[k : k + 1], np.random.default_rng(int(seed))) for k, seed in zip(np.flatnonzero(y), keys, strict=True)]
            s = shared.value.scores(np.concatenate([x, plain, *other])).astype(float)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([kind, kind, np.full(y.sum(), last)]), pa.int32()), pa.array(np.concatenate([y, y, y[y]])), pa.array(s)], names=["kind", "y", "s"])

    # all scores, in cells so narrow that one number stands for those of a cell; beyond 30 a probability is 0 or 1
    cell = F.floor(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), "s")) * CELLS)
    cells = use.mapInArrow(views, "kind int, y boolean, s double").groupBy("kind", "y", cell.alias("c")).agg(F.count("*").alias("n"), F.avg("s").alias("mean"), F.min("s").alias("low"), F.max("s").alias("high")).toPandas().sort_values(["kind", "y", "c"])
    kinds, y, n = (cells[k].to_numpy() for k in ("kind", "y", "n"))
    y = y.astype(bool)
    w = np.where(y, counts[True] / n[y].sum(), counts[False] / n[~y].sum()) * n
    slope, shift = logistic(cells["mean"].to_numpy(), y, w * n.sum() / w.sum())
    p = np.minimum(*(1 / (1 + np.exp(-np.clip(slope * cells[k].to_numpy() + shift, -30, 30))) for k in ("low", "high")))
    overall = kept_threshold(p[y], n[y], recall)
    of = [y & (kinds == k) for k in range(len(ALPHABETS))]
    return net, slope, shift, np.array([kept_threshold(p[own], n[own], recall) if n[own].sum() >= LEAST else overall for own in of])


def _labelled(scanned: DataFrame, findings: DataFrame | None) -> tuple[DataFrame, dict[bool, int]]:
    """The first window of every candidate with a label (y, alphabet, held, half, key, shown), and how many there are of
    each label."""
    ids = scanned.select(F.col("_doc.id").alias("id"), F.explode("candidates").alias("c"))
    if findings is None:
        each = ids.select("id", "c", F.col("c.known").alias("y"))
    else:
        named = findings.where("id IS NOT NULL").select(F.col("id").alias("_id"), F.col("start").alias("_a"), F.col("end").alias("_z"), F.col("secret").alias("y"))
        overlap = (F.col("id") == F.col("_id")) & (F.col("c.start") < F.col("_z")) & (F.col("_a") < F.col("c.end"))
        each = ids.join(named, overlap).groupBy("id", "c").agg(F.max("y").alias("y")).where("y IS NOT NULL")
    draw = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(0))
    rows = each.select("y", F.col("c.alphabet").alias("alphabet"), draw.alias("draw"), F.substring("c.shown", 1, WINDOW).alias("shown"), F.xxhash64("id", "c.start", "c.shown").alias("key"))
    rows = cut(rows.select("y", "alphabet", (F.col("draw") % CALIBRATE == 0).alias("held"), (F.floor(F.col("draw") / CALIBRATE) % 2).cast("int").alias("half"), "key", "shown"))
    return rows, {False: 0, True: 0} | {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", findings: DataFrame | None = None, recall: float = RECALL) -> DataFrame:
    """Per document: id and findings, an array of (kind, start, end, probability) in order of start and kind.

    ``findings`` (id, start, end, secret): labelled findings to learn from, in place of the base ones.
    """
    spark = docs.sparkSession
    read = docs.select(F.struct(F.col(id_col).alias("id")).alias("_doc"), F.col(text_col).cast("string").alias("text"))
    kind = read.schema["_doc"].dataType.simpleString()
    scanned = cut(read.mapInArrow(_scanned, f"_doc {kind}, base {_FOUND}, candidates {_CANDIDATES}"))
    model = spark.sparkContext.broadcast(fitted(*_labelled(scanned, findings), recall, findings is not None))

    def scored(batches):
        item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())])
        for b in slices(batches):
            rows = b.column("candidates").to_pylist()
            p = iter(_probabilities([c["shown"] for r in rows for c in r], model.value))
            out = []
            for base, candidates in zip(b.column("base").to_pylist(), rows, strict=True):
                judged = [(c["start"], c["end"], *next(p)) for c in candidates]
                starts = [a for a, *_ in judged]
                own = []
                for f in base:  # the last candidate that begins before the finding's end
                    k = bisect_left(starts, f["end"]) - 1
                    own.append((f["start"], f["kind"], f["end"], judged[k][2] if k >= 0 and judged[k][1] > f["start"] else None))
                own += [(a, 3, z, q) for c, (a, z, q, taken) in zip(candidates, judged, strict=True) if not c["known"] and taken[c["alphabet"]]]
                out.append([{"kind": KINDS[k], "start": a, "end": z, "probability": q} for a, k, z, q in sorted(own, key=lambda f: f[:2])])
            yield pa.RecordBatch.from_arrays([b.column("_doc"), pa.array(out, pa.list_(item))], names=["_doc", "findings"])

    out = scanned.mapInArrow(scored, f"_doc {kind}, findings array<struct<kind:string,start:long,end:long,probability:double>>")
    return out.select(F.col("_doc.id").alias(id_col), "findings")


def _probabilities(shown: list[bytes], model):
    """Per candidate its probability (that of its likeliest window) and which alphabets' thresholds let it in."""
    if model is None:
        return [(None, [False] * len(ALPHABETS))] * len(shown)
    net, slope, shift, thresholds = model
    sizes = np.array([len(s) // WINDOW for s in shown], np.int64)
    s = net.scores(np.frombuffer(b"".join(shown), np.uint8).reshape(-1, WINDOW))
    best = np.maximum.reduceat(s, np.cumsum(sizes) - sizes) if len(sizes) else s
    p = 1 / (1 + np.exp(-np.clip(slope * best.astype(float) + shift, -30, 30)))
    return list(zip(p.tolist(), (p[:, None] >= thresholds).tolist(), strict=True))
