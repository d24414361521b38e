"""Columns of 64-bit names with counts, packed by range of names so that they travel and merge as sorted arrays.

A task adds up what it holds before anything is shuffled, so a name that a third of all rows share is one entry per task.
Names are hashes, ranges are even; their number grows with the input, so a range stays a few MB.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from heliospark.llm.flat import planes, runs, unplanes


def cuts(names: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of the ranges (a power of two) starts in rising names, and the end."""
    if ranges == 1:
        return np.array([0, len(names)])
    edges = np.arange(ranges, dtype=np.uint64) << np.uint64(64 - (ranges.bit_length() - 1))
    return np.append(np.searchsorted(names, edges), len(names))


def totals(names: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each name once, rising, and the sum of its counts (of ones where none are given)."""
    if counts is None:
        names = np.sort(names)
        starts, sizes = runs(names)
        return names[starts], sizes
    order = np.argsort(names, kind="stable")
    names = names[order]
    starts, _ = runs(names)
    return names[starts], np.add.reduceat(counts[order], starts) if len(starts) else np.zeros(0, np.int64)


def pack_counts(names: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    return planes(names), planes(counts)


def unpack_counts(names: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return unplanes(names), unplanes(counts).astype(np.int64)


def merged(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Totals over the packed rows of a range."""
    pairs = [unpack_counts(n, c) for n, c in zip(rows.column("names").to_pylist(), rows.column("counts").to_pylist())]
    if not pairs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return totals(np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]))
