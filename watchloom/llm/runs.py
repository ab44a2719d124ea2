"""Numpy helpers over the bytes of an Arrow batch: runs of chosen bytes, their texts, places of word sequences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags, true from the first to the last byte of each range."""
    flags = np.zeros(256, bool)
    for first, last in ranges:
        flags[first : last + 1] = True
    return flags


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every maximal run of true flags that stays in its row, and for each row the runs before it."""
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    filled = offsets[1:] > offsets[:-1]
    opens, closes = np.empty(len(inside), bool), np.empty(len(inside), bool)
    opens[0], opens[1:] = True, ~inside[:-1]
    closes[-1], closes[:-1] = True, ~inside[1:]
    opens[offsets[:-1][filled]] = True
    closes[offsets[1:][filled] - 1] = True
    starts = np.flatnonzero(opens & inside)
    return starts, np.flatnonzero(closes & inside) + 1, np.searchsorted(starts, offsets)


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The given byte ranges as strings, with A-Z lower-cased."""
    sizes = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    taken = _LOWER[data[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])]] if len(starts) else np.zeros(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(taken)))


def places(words: np.ndarray, counts: np.ndarray, phrase: np.ndarray, rarest: int) -> np.ndarray:
    """First positions of the phrase's words standing one after another inside a row; looked up by its rarest word."""
    first = np.flatnonzero(words == phrase[rarest]) - rarest
    first = first[(first >= 0) & (first + len(phrase) <= len(words))]
    for k, word in enumerate(phrase):
        first = first[words[first + k] == word]
    row = np.searchsorted(counts, first, "right") - 1
    return first[first + len(phrase) <= counts[row + 1]] if len(first) else first
