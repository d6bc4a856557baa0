"""Near copies among vectors: tiles compared in the order of principal components.

1. Vectors that are equal become one, with their number kept. The others are rotated so that the first coordinates
   carry the most variance; LEAD of them and the norm of the rest stand for a vector.
2. Vectors are dealt to the leaves of a tree that halves the space along its widest leading coordinates, one level
   more for each doubling of the rows, and leaves are cut into tiles of a bounded size. Pairs of tiles are compared
   unless the boxes around them (leading coordinates and rest norms) lie further apart than linked vectors can.
3. In a pair of tiles the leading coordinates are multiplied first, a few and then all LEAD of them; where that
   product plus the product of the rest norms stays below the threshold, the comparison stops. Only vectors that
   have some partner left in that pair of tiles are fetched whole.
4. Their cosines are worked out in double precision. Each pair of tiles returns link counts and a star per connected
   group, never its pairs, so a large group of copies costs rows in proportion to its size.

Cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing and stand
alone; vectors of other lengths never link; repeated rows are other vectors with the same content; a null
vec_id takes part in links but never names a component (unless it is alone, when it is null); an empty table
gives an empty result; clashing extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import cut, tidy, with_row_number
from .components import components

#: Vectors of a tile: a part of the table within bounds, and of so many bytes at most.
TILE_ROWS, TILE_PART, TILE_BYTES = (16_384, 65_536), 64, 32_000_000
#: Numbers of values that the axes of a length are fitted on (a bounded sample: it only orders and deals).
FIT_VALUES = 2_000_000
FIRST, LEAD, BLOCK, EXACT, ROUGH = 8, 32, 1024, 1e-9, 1e-5


def _vectors(wide: bool):
    """Row, id, length, digest and bytes of each vector that can link."""

    def scan(batches):
        for b in batches:
            keep, dims, keys, raws = [], [], [], []
            for r, x in enumerate(b.column(2)):
                if not x.is_valid or x.values.null_count or not len(x.values):
                    continue
                v = np.asarray(x.values, np.float64 if wide else np.float32) + np.float32(0)  # -0.0 becomes 0.0
                if not np.isfinite(v).all() or not v.any():
                    continue
                raw = v.tobytes()
                keep.append(r)
                dims.append(len(v))
                keys.append(hashlib.blake2b(raw, digest_size=16).digest())
                raws.append(raw)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], names=["_row", "id", "dim", "key", "raw"])

    return scan


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def axes_of(x: np.ndarray, lead: int = LEAD) -> np.ndarray:
    """Leading principal axes of unit vectors."""
    d = x.shape[1]
    if d <= 512:
        return np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :lead].copy()
    q = np.random.default_rng(7).standard_normal((d, lead))
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ np.linalg.qr(q)[0]))[0]
    return q


def tree_of(y: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A complete binary tree over points, node k having the children 2k+1 and 2k+2: the coordinate that it halves,
    the one of the widest spread, and where."""
    axis, at = np.zeros(2**depth - 1, np.int32), np.zeros(2**depth - 1)
    parts = {0: np.arange(len(y))}
    for k in range(2**depth - 1):
        own = parts.pop(k)
        if len(own):
            axis[k] = int(np.argmax(np.var(y[own], axis=0)))
            at[k] = np.median(y[own, axis[k]])
        right = y[own, axis[k]] > at[k]
        parts[2 * k + 1], parts[2 * k + 2] = own[~right], own[right]
    return axis, at


def leaf_of(y: np.ndarray, axis: np.ndarray, at: np.ndarray) -> np.ndarray:
    k = np.zeros(len(y), np.int64)
    for _ in range((len(axis) + 1).bit_length() - 1):
        k = 2 * k + 1 + (y[np.arange(len(y)), axis[k]] > at[k])
    return k - len(axis)


def tile_rows(dim: int, n: int, width: int) -> int:
    return int(min(max(TILE_ROWS[0], min(TILE_ROWS[1], n // TILE_PART)), max(256, TILE_BYTES // (dim * width))))


def fitted(nodes: DataFrame, width: int) -> dict[int, tuple]:
    """By vector length: axes and the tree's coordinates and cuts, from at most FIT_VALUES values of that length."""
    counts = {r["dim"]: r["n"] for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    most = {d: max(LEAD, FIT_VALUES // d) for d in counts}
    share = F.create_map(*(F.lit(x) for d, n in counts.items() for x in (d, min(1.0, 1.1 * most[d] / n))))
    some = nodes.where(F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < F.lit(1_000_000) * share[F.col("dim")]).select("dim", "node", "raw")
    kind = np.float64 if width == 8 else np.float32

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        dim = int(pdf["dim"].iloc[0])
        pdf = pdf.sort_values("node").iloc[: most[dim]]
        x = _unit(np.frombuffer(b"".join(pdf["raw"]), kind).reshape(len(pdf), dim).astype(np.float64))
        axes = axes_of(x)
        depth = max(0, math.ceil(math.log2(counts[dim] / tile_rows(dim, counts[dim], width))))
        axis, at = tree_of(x @ axes, min(depth, max(0, int(math.log2(len(x))) - 3)))
        return pd.DataFrame({"dim": [dim], "axes": [axes.tobytes()], "axis": [axis.tobytes()], "at": [at.tobytes()]})

    rows = some.groupBy("dim").applyInPandas(fit, "dim int, axes binary, axis binary, at binary").collect()  # one per vector length
    out = {d: (np.eye(d, min(d, LEAD)), np.zeros(0, np.int32), np.zeros(0)) for d in counts}
    return out | {r["dim"]: (np.frombuffer(r["axes"]).reshape(r["dim"], -1), np.frombuffer(r["axis"], np.int32), np.frombuffer(r["at"])) for r in rows}


def survivors(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of x and of y may have a partner in the other: rows are leading coordinates and a rest norm."""
    left, right = np.zeros(len(x), bool), np.zeros(len(y), bool)
    ox, oy = np.argsort(x[:, 0], kind="stable"), np.argsort(y[:, 0], kind="stable")
    x, y = x[ox], y[oy]
    lead = x.shape[1] - 1
    first = min(FIRST, lead)
    rest = lambda z: np.sqrt((z[:, first:] ** 2).sum(1))
    rx, ry = rest(x), rest(y)
    reach, least = math.sqrt(max(0.0, 2 - 2 * threshold)) + ROUGH, threshold - ROUGH
    for i in range(0, len(x), BLOCK):
        a = x[i : i + BLOCK]
        start = np.searchsorted(y[:, 0], a[0, 0] - reach)
        past = np.searchsorted(y[:, 0], a[-1, 0] + reach, side="right")
        for j in range(start, past, BLOCK):
            b = y[j : min(j + BLOCK, past)]
            s = a[:, :first] @ b[:, :first].T
            may = s + rx[i : i + len(a), None] * ry[None, j : j + len(b)] >= least
            if same and i < j + len(b) and j < i + len(a):
                may &= np.arange(i, i + len(a))[:, None] != np.arange(j, j + len(b))[None, :]
            rows, cols = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
            if not len(rows):
                continue
            s = s[np.ix_(rows, cols)] + a[rows, first:lead] @ b[cols, first:lead].T
            may = may[np.ix_(rows, cols)] & (s + a[rows, lead][:, None] * b[cols, lead][None, :] >= least)
            left[ox[i + rows[may.any(1)]]] = True
            right[oy[j + cols[may.any(0)]]] = True
    return left, right


def linked(x: np.ndarray, y: np.ndarray, threshold: float, same: bool):
    """Index pairs (i, j) with cosine >= threshold, block by block."""
    ux, uy = _unit(x), _unit(y)
    for i in range(0, len(ux), BLOCK):
        for j in range(0, len(uy), BLOCK):
            s = ux[i : i + BLOCK] @ uy[j : j + BLOCK].T
            p, q = np.nonzero(s >= threshold - EXACT)
            close = s[p, q] < threshold + EXACT
            p, q = i + p, j + q
            if close.any():  # rounding of the unit vectors decides nothing
                u, v = x[p[close]], y[q[close]]
                keep = ~close
                keep[close] = (u * v).sum(1) / (np.sqrt((u * u).sum(1)) * np.sqrt((v * v).sum(1))) >= threshold
                p, q = p[keep], q[keep]
            if same:
                p, q = p[p != q], q[p != q]
            if len(p):
                yield p, q


def _roots(n: int, pairs: list[np.ndarray]) -> np.ndarray:
    """Smallest index of each index's component."""
    root = np.arange(n)
    if not pairs:
        return root
    e = np.concatenate(pairs, axis=1)
    while True:
        low = np.minimum(root[e[0]], root[e[1]])
        new = root.copy()
        np.minimum.at(new, e[0], low)
        np.minimum.at(new, e[1], low)
        np.minimum.at(new, root[e[0]], low)
        np.minimum.at(new, root[e[1]], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


@tidy
def vector_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """Per row of ``vectors``: n_links, component_id and kept."""
    spark = vectors.sparkSession
    wide = not isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType)
    width, kind = (8, np.float64) if wide else (4, np.float32)
    values = F.col(vector_col).cast("array<double>") if wide else F.col(vector_col)
    rows = cut(with_row_number(vectors.select(F.col(id_col).alias("id"), values.alias("x"))).select("_row", "id", "x"))
    id_type = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(_vectors(wide), f"_row long, id {id_type}, dim int, key binary, raw binary")
    usable = cut(found.drop("raw"))
    nodes = cut(found.groupBy("dim", "key").agg(F.min("_row").alias("node"), F.min("id").alias("least"), F.count("*").alias("n"), F.first("raw").alias("raw")))
    models = fitted(nodes, width)
    fits = spark.sparkContext.broadcast(models)
    sizes = {r["dim"]: r["n"] for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).collect()}

    def dealt(batches):
        for b in batches:
            dims, raws = b.column("dim").to_numpy(), b.column("raw").to_pylist()
            leaf, lead = np.zeros(b.num_rows, np.int64), [b""] * b.num_rows
            for d in np.unique(dims):
                axes, axis, at = fits.value[int(d)]
                own = np.flatnonzero(dims == d)
                y = _unit(np.frombuffer(b"".join(raws[i] for i in own), kind).reshape(len(own), d).astype(np.float64)) @ axes
                leaf[own] = leaf_of(y, axis, at)
                y = np.column_stack([y, np.sqrt(np.maximum(0, 1 - (y * y).sum(1)))]).astype(np.float32)
                for k, i in enumerate(own):
                    lead[i] = y[k].tobytes()
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("dim"), pa.array(leaf), pa.array(lead, pa.binary())], names=["node", "dim", "leaf", "lead"])

    placed = cut(nodes.select("node", "dim", "raw").mapInArrow(dealt, "node long, dim int, leaf long, lead binary"))
    per_tile = F.create_map(*(F.lit(x) for d, n in (sizes or {0: 1}).items() for x in (d, tile_rows(d or 1, n, width))))
    leaves = placed.groupBy("dim", "leaf").agg(F.count("*").alias("m")).select("dim", "leaf", F.ceil(F.col("m") / per_tile[F.col("dim")]).cast("int").alias("tiles"))
    named = F.concat_ws("/", "dim", "leaf", F.pmod(F.xxhash64("node"), F.col("tiles")))
    tiled = placed.join(leaves, ["dim", "leaf"]).select(named.alias("tile"), "dim", "node", "lead")

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        y = np.frombuffer(b"".join(pdf["lead"]), np.float32).reshape(len(pdf), -1)
        one = pdf.iloc[:1][["tile", "dim"]].copy()
        one["nodes"] = [pdf["node"].to_numpy(np.int64).tobytes()]
        one["lead"] = [y.tobytes()]
        one["lo"], one["hi"] = [y.min(0).tolist()], [y.max(0).tolist()]
        return one

    tiles = cut(tiled.groupBy("tile").applyInPandas(packed, "tile string, dim int, nodes binary, lead binary, lo array<double>, hi array<double>"))
    # candidates share a cell of the first coordinate; boxes decide
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 2 * ROUGH
    cell = max(reach, 0.05)
    ends = tiles.select("tile", "dim", "lo", "hi")
    side = lambda x, add: ends.select("dim", F.col("tile").alias(x), F.col("lo").alias(f"lo{x}"), F.col("hi").alias(f"hi{x}"), F.explode(F.sequence(F.floor(F.element_at("lo", 1) / cell), F.floor((F.element_at("hi", 1) + add) / cell))).alias("cell"))
    gap = lambda a, b: F.zip_with(f"lo{a}", f"hi{b}", lambda x, y: F.greatest(x - y, F.lit(0.0)))
    away = F.aggregate(F.zip_with(gap("s", "t"), gap("t", "s"), lambda x, y: (x + y) * (x + y)), F.lit(0.0), lambda a, x: a + x)
    near = side("s", reach).join(side("t", reach), ["dim", "cell"]).where("s <= t")
    pairs = cut(near.where(away <= reach * reach).select("s", "t").distinct().select(F.concat_ws("|", "s", "t").alias("pair"), "s", "t"))
    sides = pairs.select("pair", F.col("s").alias("tile"), F.lit(True).alias("first")).unionByName(pairs.where("s < t").select("pair", F.col("t").alias("tile"), F.lit(False).alias("first")))
    loads = sides.join(tiles.select("tile", "nodes", "lead"), "tile").select("pair", "first", "nodes", "lead")

    def compared(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first", ascending=False)
        parts = [(np.frombuffer(r.nodes, np.int64), np.frombuffer(r.lead, np.float32).reshape(len(r.nodes) // 8, -1)) for r in pdf.itertuples()]
        same = len(parts) == 1
        (na, xa), (nb, xb) = parts[0], parts[-1]
        left, right = survivors(xa, xb, threshold, same)
        nodes = na[left | right] if same else np.concatenate([na[left], nb[right]])
        first = np.ones(len(nodes), bool) if same else np.arange(len(nodes)) < left.sum()
        return pd.DataFrame({"pair": pdf["pair"].iloc[0], "node": nodes, "first": first})

    left = cut(loads.groupBy("pair").applyInPandas(compared, "pair string, node long, first boolean"))
    whole = left.join(nodes.select("node", "n", "raw"), "node")

    def exact(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [g for g in (pdf[pdf["first"]], pdf[~pdf["first"]]) if len(g)]
        same = len(parts) == 1
        get = lambda g: (g["node"].to_numpy(np.int64), g["n"].to_numpy(np.int64), np.frombuffer(b"".join(g["raw"]), kind).reshape(len(g), -1).astype(np.float64))
        (na, ma, xa), (nb, mb, xb) = get(parts[0]), get(parts[-1])
        node, shift = (na, 0) if same else (np.concatenate([na, nb]), len(na))
        links, stars = np.zeros(len(node), np.int64), []
        for p, q in linked(xa, xb, threshold, same):
            links[: len(na)] += np.bincount(p, mb[q], len(na)).astype(np.int64)
            if not same:
                links[shift:] += np.bincount(q, ma[p], len(nb)).astype(np.int64)
            stars.append(np.stack([p, q + shift]))
            if sum(x.shape[1] for x in stars) > 2_000_000:  # hold a star per component instead of its links
                r = _roots(len(node), stars)
                stars = [np.stack([np.arange(len(node)), r])]
        at = np.flatnonzero(links)
        return pd.DataFrame({"a": node[at], "b": node[_roots(len(node), stars)[at]], "links": links[at]})

    met = cut(whole.groupBy("pair").applyInPandas(exact, "a long, b long, links long"))
    roots = components(met)
    per_node = nodes.select("node", "key", "dim", "n", "least").join(met.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links")), "node", "left").join(roots, "node", "left")
    per_node = cut(per_node.select("key", "dim", "least", F.coalesce("root", "node").alias("root"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    names = per_node.groupBy("root").agg(F.min("least").alias("component_id"))
    known = per_node.join(names, "root").select("key", "dim", "n_links", "component_id")
    linked_rows = usable.join(known, ["key", "dim"]).select("_row", "n_links", "component_id")
    out = rows.select("_row", "id").join(linked_rows, "_row", "left")
    root = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), F.coalesce(F.col("id") == root, F.lit(False)).alias("kept"))
