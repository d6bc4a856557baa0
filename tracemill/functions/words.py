"""Columns over texts: the numbers of their words."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text that a task splits at a time.
PIECE = 1 << 24


def _of(texts: pa.Array, modulus: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all words, how many each text has)."""
    split = pc.split_pattern(pc.fill_null(texts, b""), " ")
    each, sizes = split.flatten(), pc.list_value_length(split).to_numpy().astype(np.int64)
    coded = pc.dictionary_encode(each)
    distinct = (np.frombuffer(b"".join([md5(w).digest()[:4] for w in coded.dictionary.to_pylist()]), ">u4") >> 4).astype(np.int64)
    numbers = (distinct if modulus is None else distinct % modulus).astype(np.int32)[coded.indices.to_numpy()]
    there = pc.binary_length(each).to_numpy() != 0
    if there.all():
        return numbers, sizes
    ends, upto = np.concatenate([[0], np.cumsum(there)]), np.concatenate([[0], np.cumsum(sizes)])
    return numbers[there], np.diff(ends[upto])


def rows_within(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Neighbouring rows, from and to, of ``most`` together by their sizes, or one row each."""
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < len(ends):
        past = max(at + 1, int(np.searchsorted(ends, most + (ends[at - 1] if at else 0), side="right")))
        yield at, past
        at = past


def lists(values: np.ndarray, sizes: np.ndarray, there: np.ndarray | None = None) -> pa.Array:
    """An array of lists of so many values each; null where not ``there``."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    mask = None if there is None else pa.array(~there)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()), mask=mask)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values end to end, sizes, which rows are there) of an array of lists of numbers without nulls inside."""
    return column.flatten().to_numpy(zero_copy_only=False), pc.fill_null(column.value_lengths(), 0).to_numpy().astype(np.int64), column.is_valid().to_numpy(zero_copy_only=False)


def numbered(texts: pa.Array, modulus: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, numbers, how many each text has) of neighbouring binary texts, PIECE bytes together or one text each."""
    for i, j in rows_within(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), PIECE):
        yield i, j, *_of(texts.slice(i, j - i), modulus)


def numbers(text: Column, modulus: int | None = None) -> Column:
    """The words of a text, between spaces, as the first 28 bits of their md5 (its rest by ``modulus``); none for a
    null text. A batch's words are split, and its distinct ones hashed, once."""

    @F.arrow_udf("array<int>")
    def of_words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            made = [(v, n) for _, _, v, n in numbered(b, modulus)]
            yield lists(np.concatenate([np.zeros(0, np.int32), *(v for v, _ in made)]), np.concatenate([np.zeros(0, np.int64), *(n for _, n in made)]))

    return of_words(text.cast("binary"))
