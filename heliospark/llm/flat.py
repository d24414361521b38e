"""Rows of text as flat bytes: windows, words and hashes over whole Arrow batches with NumPy, inside a task.

A text column of a batch is one run of UTF-8 bytes with row offsets. Words and windows are found on those bytes, so no
Python object is made per word. Null counts as the empty text everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at a time; bounds the temporary arrays of a task.
PORTION = 1 << 20

_ODD = 0x9E3779B97F4A7C15
_WRAP = 1 << 64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _inverse(odd: int) -> int:
    x = odd
    for _ in range(6):
        x = x * (2 - odd * x) % _WRAP
    return x


#: One fixed random value per byte, so that equal bytes hash alike in every task.
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))

_powers = {1: np.ones(1, np.uint64), -1: np.ones(1, np.uint64)}


def powers(n: int, sign: int = 1) -> np.ndarray:
    """The first n powers of the hash base (sign 1) or of its inverse (sign -1), modulo 2**64."""
    if len(_powers[sign]) < n:
        size = max(n, PORTION + 4096)
        out = np.full(size, _ODD if sign == 1 else _inverse(_ODD), np.uint64)
        out[0] = 1
        _powers[sign] = np.cumprod(out)
    return _powers[sign][:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """n + 1 running sums from which the hash of any span follows, see span_hashes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * powers(len(data)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end), a function of their bytes only."""
    inverse = powers(len(prefix), -1)
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def flat_texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and n + 1 row offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    rows = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    rows = rows.astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[rows[0] : rows[-1]], rows - rows[0]


def portions(offsets: np.ndarray, most: int = PORTION) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes; a longer row is alone in its range."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def texts_of(batch: pa.RecordBatch | pa.Table, name: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of a batch, portion by portion."""
    data, offsets = flat_texts(batch.column(name))
    for a, b in portions(offsets):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def byte_set(inside: bytes | range, invert: bool = False) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(inside)] = True
    return ~out if invert else out


#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: letters, digits and everything outside ASCII.
WORD_BYTES = byte_set([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
#: Bytes that are no white space.
SOLID_BYTES = byte_set([9, 10, 11, 12, 13, 32], invert=True)


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of the given bytes; no run crosses rows."""
    n = len(data)
    flags = inside[data]
    before = np.zeros(n, bool)
    after = np.zeros(n, bool)
    before[1:], after[:-1] = flags[:-1], flags[1:]
    firsts, lasts = offsets[:-1], offsets[1:] - 1
    full = offsets[1:] > offsets[:-1]
    before[firsts[full]] = False
    after[lasts[full]] = False
    starts = np.flatnonzero(flags & ~before)
    ends = np.flatnonzero(flags & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal neighbours."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return starts, np.diff(np.append(starts, len(keys)))


def planes(values: np.ndarray) -> bytes:
    """Sorted 64-bit values, byte plane by byte plane: their high bytes repeat and fold well under a codec."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel()
