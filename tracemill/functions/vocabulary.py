"""The token space of traces: where each segment begins, token names, mirrored moves."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sizes of the segments, in order.
SEGMENTS = {
    "piece": 768,
    "side": 2,
    "castling": 8,
    "en_passant": 65,
    "halfmove": 101,
    "repetition": 5,
    "move": 1969,
    "value": 20,
    "mate_win": 29,
    "mate_loss": 31,
    "control": 8,
}
CONTROLS = ("pad", "back", "reset", "board", "final", "refuted", "depth", "end")
PIECES = "PNBRQKpnbrqk"
CLAIM = "<claim_draw>"

START: dict[str, int] = {}
_at = 0
for _name, _size in SEGMENTS.items():
    START[_name] = _at
    _at += _size
#: First id of a composite.
COMPOSITE = _at
CONTROL = {c: START["control"] + i for i, c in enumerate(CONTROLS)}


def square_name(s: int) -> str:
    return "abcdefgh"[s & 7] + "12345678"[s >> 3]


def _reaches(a: int, b: int) -> bool:
    """Whether some piece moves from a to b on an empty board."""
    x, y = abs((a & 7) - (b & 7)), abs((a >> 3) - (b >> 3))
    return a != b and (x == 0 or y == 0 or x == y or x + y == 3)


@lru_cache(1)
def moves() -> tuple[str, ...]:
    """Every move that geometry allows and the draw claim, in the order of their strings."""
    plain = {square_name(a) + square_name(b) for a in range(64) for b in range(64) if _reaches(a, b)}
    last = {m + p for m in plain for p in "bnqr" if m[1] + m[3] in ("78", "21") and abs(ord(m[0]) - ord(m[2])) <= 1}
    return tuple(sorted(plain | last | {CLAIM}))


@lru_cache(1)
def move_ids() -> dict[str, int]:
    return {m: START["move"] + i for i, m in enumerate(moves())}


def mirrored_move(uci: str) -> str:
    return uci if uci == CLAIM else uci.translate(str.maketrans("12345678", "87654321"))


@lru_cache(1)
def names() -> tuple[str, ...]:
    """The name of every token below COMPOSITE."""
    squares = [square_name(s) for s in range(64)]
    out = [f"board:{s}:{p}" for s in squares for p in PIECES]
    out += [f"meta:side:{c}" for c in "wb"]
    out += [f"meta:castling:{r}{sign}" for r in "KQkq" for sign in "-+"]
    out += [f"meta:ep:{s}" for s in [*squares, "-"]]
    out += [f"meta:halfmove:{k}" for k in range(100)] + ["meta:halfmove:100+"]
    out += [f"meta:repetition:{k}" for k in range(1, 5)] + ["meta:repetition:5+"]
    out += moves()
    out += [f"value:bin:{k:02d}" for k in range(SEGMENTS["value"])]
    out += [f"mate:win:{k}" for k in range(SEGMENTS["mate_win"])]
    out += [f"mate:loss:{k}" for k in range(SEGMENTS["mate_loss"])]
    return (*out, *(f"<{c}>" for c in CONTROLS))


def _mirrored_name(name: str) -> str:
    """What the other side calls a board token: ranks turned, colours and their castling rights swapped."""
    kind, *parts = name.split(":")
    if kind == "board":
        return f"board:{mirrored_move(parts[0])}:{parts[1].swapcase()}"
    if parts[:1] == ["castling"]:
        return f"meta:castling:{parts[1].swapcase()}"
    if parts[:1] == ["ep"] and parts[1] != "-":
        return f"meta:ep:{mirrored_move(parts[1])}"
    return name


@lru_cache(1)
def mirror_table() -> tuple[int, ...]:
    """Each token of an observed board as the other side sees it; moves, values and controls stay."""
    ids = {n: i for i, n in enumerate(names())}
    return tuple(ids[_mirrored_name(n)] for n in names())


@lru_cache(1)
def move_mirror_table() -> tuple[int, ...]:
    """Each token, a move's replaced by that of the mirrored move."""
    ids = move_ids()
    return tuple(ids[mirrored_move(moves()[t - START["move"]])] if START["move"] <= t < START["value"] else t for t in range(COMPOSITE))


def literal(values) -> Column:
    """An array literal; one constant in the plan, whatever its length."""
    return F.lit(list(values))


def token_name(token: Column) -> Column:
    return F.try_element_at(literal(names()), token + 1)


def mirror_tokens(tokens: Column) -> Column:
    table = literal(mirror_table())
    return F.transform(tokens, lambda t: F.element_at(table, t + 1))


def mirror_move_tokens(tokens: Column) -> Column:
    table = literal(move_mirror_table())
    return F.transform(tokens, lambda t: F.element_at(table, t + 1))


def mirror_uci(uci: Column) -> Column:
    return F.when(uci == CLAIM, uci).otherwise(F.translate(uci, "12345678", "87654321"))
