"""Numpy kernels over the string buffers of an Arrow batch: words, word hashes, shingles.

All documents of a batch are handled at once; nothing loops over words in Python. Words are maximal
runs of bytes other than ``\\x20`` and ``\\x09``-``\\x0D``. In UTF-8 none of these bytes occurs inside
another character, so byte words are code-point words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_MIX_A, _MIX_B, _GOLD = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2**64
_BLOCK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BYTES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _GOLD)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << max(20, int(n).bit_length())
    if n not in _POWERS:
        if len(_POWERS) > 1:
            _POWERS.clear()
        _POWERS[n] = _powers(_BASE, n + 1), _powers(pow(_BASE, -1, 2**64), n + 1)
    return _POWERS[n]


def texts(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and where each row begins and ends in them; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word, and for each row the number of words before it."""
    space = _SPACE[data]
    filled = offsets[:-1][offsets[1:] > offsets[:-1]]
    before = np.empty(len(data), bool)
    before[1:] = space[:-1]
    before[filled] = True
    starts = np.flatnonzero(before & ~space)
    after = np.empty(len(data), bool)
    after[:-1] = space[1:]
    after[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True
    ends = np.flatnonzero(after & ~space) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes; with ``lower``, A-Z count as a-z. Memory is bounded by blocks."""
    table, out = _LOWER if lower else _BYTES, np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _BLOCK, "right")))
        low, high = int(starts[at]), int(ends[to - 1])
        up, down = _tables(high - low)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(table[data[low:high]] * up[: high - low], out=sums[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * _GOLD)
        at = to
    return out


def windows(values: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` values inside each row, and the runs' first positions.

    ``counts`` has for each row the number of values before it, and the total at the end.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total *= np.uint64(_BASE)
        total += values[k : k + n]
    inside = np.ones(n, bool)
    bounds = counts[1:-1]
    for k in range(1, width):
        at = bounds - k
        inside[at[(at >= 0) & (at < n)]] = False
    first = np.flatnonzero(inside)
    return mix(total[first] + np.uint64(width)), first


def shingles(values: np.ndarray, counts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all rows with the row of each; a row with fewer words has its whole sequence."""
    hashes, first = windows(values, counts, width)
    rows = np.searchsorted(counts, first, "right") - 1
    sizes = np.diff(counts)
    extra, at = [], []
    for n in range(1, width):
        short = np.flatnonzero(sizes == n)
        if len(short):
            total = np.zeros(len(short), np.uint64)
            for k in range(n):
                total = total * np.uint64(_BASE) + values[counts[short] + k]
            extra.append(mix(total + np.uint64(n)))
            at.append(short)
    if extra:
        hashes, rows = np.concatenate([hashes, *extra]), np.concatenate([rows, *at])
    return hashes, rows


def distinct(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) pairs, ordered by row, then hash."""
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[new], rows[new]


def slices(batch: pa.RecordBatch, column: str, size: int):
    """Parts of a batch with about ``size`` text bytes each; a longer text is a part of its own."""
    if not batch.num_rows:
        return
    _, offsets = texts(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def planes(values: np.ndarray) -> bytes:
    """Numbers as byte planes: the high bytes of sorted or small numbers compress to nothing in a shuffle."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.dtype.itemsize).T).tobytes()


def numbers(raw: bytes, kind) -> np.ndarray:
    """The numbers of byte planes."""
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()
