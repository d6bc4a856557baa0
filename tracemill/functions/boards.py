"""Boards to tokens and back, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .positions import field
from .vocabulary import CONTROL, PIECES, START, literal, square_name

_SQUARES = [square_name(s) for s in range(64)]
#: Tokens after the pieces: side, four castling rights, en passant, halfmove clock, repetition.
META = 8


def squares(fen: Column) -> Column:
    """The 64 squares from a1 to h8 as one string, a dot for an empty one."""
    placement = field(fen, 0)
    for k in range(1, 9):
        placement = F.replace(placement, F.lit(str(k)), F.lit("." * k))
    return F.array_join(F.reverse(F.split(placement, "/")), "")


def encode_board(fen: Column, repetition: Column) -> Column:
    """Tokens of a position: a piece token per occupied square from a1 to h8, then META more. Null where the
    placement does not fill the board or holds an unknown letter, or the repetition is below 1."""
    return _once(squares(fen), lambda board: _tokens(fen, board, repetition))


def _tokens(fen: Column, board: Column, repetition: Column) -> Column:
    castling, ep = field(fen, 2), field(fen, 3)
    at = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda s: F.struct(s.alias("s"), F.substring(board, s + 1, F.lit(1)).alias("p")))
    pieces = F.transform(F.filter(at, lambda x: x["p"] != "."), lambda x: x["s"] * 12 + F.instr(F.lit(PIECES), x["p"]) - 1)
    rights = [F.lit(START["castling"] + 2 * i) + F.contains(castling, F.lit(r)).cast("int") for i, r in enumerate("KQkq")]
    meta = F.array(
        START["side"] + (field(fen, 1) == "b").cast("int"),
        *rights,
        START["en_passant"] + F.when(ep == "-", 64).otherwise(F.array_position(literal(_SQUARES), ep).cast("int") - 1),
        START["halfmove"] + F.least(field(fen, 4).cast("int"), F.lit(100)),
        START["repetition"] + F.least(repetition.cast("int"), F.lit(5)) - 1,
    )
    sound = (F.length(board) == 64) & F.rlike(board, F.lit(f"^[{PIECES}.]*$")) & (repetition >= 1)
    return F.when(sound, F.concat(pieces, meta))


def _within(token: Column, name: str, size: int) -> Column:
    return token.between(START[name], START[name] + size - 1)


def _once(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, not once for each element that a lambda visits."""
    return F.get(F.transform(F.array(value), use), 0)


def decode_board(tokens: Column) -> Column:
    """Struct (fen, repetition) of a token list in any order; the move number is not stored and reads 1. Null
    where a square or one of the META parts is given twice or is missing."""
    return _once(tokens, _position)


def _position(tokens: Column) -> Column:
    def one(name, size):
        return F.filter(tokens, lambda t: _within(t, name, size))

    pieces = F.filter(tokens, lambda t: t < START["side"])

    at, letters = F.transform(pieces, lambda t: F.floor(t / 12)), F.transform(pieces, lambda t: F.substring(F.lit(PIECES), F.pmod(t, F.lit(12)) + 1, F.lit(1)))
    named = F.struct(at.alias("at"), letters.alias("letters"))
    by_square = lambda x: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda s: F.coalesce(F.get(x["letters"], F.array_position(x["at"], s).cast("int") - 1), F.lit(".")))
    cells = _once(named, lambda x: F.array_join(by_square(x), ""))
    placement = _once(cells, lambda c: F.array_join(F.transform(F.sequence(F.lit(7), F.lit(0), F.lit(-1)), lambda r: F.substring(c, r * 8 + 1, F.lit(8))), "/"))
    for k in range(8, 0, -1):
        placement = F.replace(placement, F.lit("." * k), F.lit(str(k)))
    side = F.when(F.array_contains(tokens, START["side"] + 1), "b").otherwise("w")
    rights = F.concat(*(F.when(F.array_contains(tokens, START["castling"] + 2 * i + 1), r).otherwise("") for i, r in enumerate("KQkq")))
    ep = F.try_element_at(literal([*_SQUARES, "-"]), one("en_passant", 65)[0] - START["en_passant"] + 1)
    half = one("halfmove", 101)[0] - START["halfmove"]
    repetition = one("repetition", 5)[0] - START["repetition"] + 1
    whole = (F.size(F.array_distinct(F.transform(pieces, lambda t: F.floor(t / 12)))) == F.size(pieces)) & (F.size(tokens) == F.size(pieces) + META)
    for name, size in (("side", 2), ("en_passant", 65), ("halfmove", 101), ("repetition", 5)):
        whole &= F.size(one(name, size)) == 1
    for i in range(4):
        whole &= F.array_contains(tokens, START["castling"] + 2 * i) != F.array_contains(tokens, START["castling"] + 2 * i + 1)
    fen = F.concat_ws(" ", placement, side, F.when(rights == "", "-").otherwise(rights), ep, half.cast("string"), F.lit("1"))
    return F.when(whole, F.struct(fen.alias("fen"), repetition.alias("repetition")))


def padded_board(fen: Column, repetition: Column, width: int = 40) -> Column:
    """encode_board, filled with padding to ``width``."""
    tokens = encode_board(fen, repetition)
    return F.concat(tokens, F.array_repeat(F.lit(CONTROL["pad"]), F.lit(width) - F.size(tokens)))
