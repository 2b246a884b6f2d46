"""Helpers inside tasks: 64-bit hashing in numpy, and groups in sorted Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_P = np.uint64(0x9E3779B97F4A7C15)
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


# Powers that a worker keeps; longer tables last as long as the call that asked for them.
KEPT_POWERS = 1 << 19


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64, at least n of them."""
    global _POW, _INV
    if len(_POW) >= n:
        return _POW, _INV
    size = 1 << max(16, (n - 1).bit_length())
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _P)]), dtype=np.uint64)
    inv = np.uint64(pow(int(_P), -1, 1 << 64))
    inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, inv)]), dtype=np.uint64)
    if size <= KEPT_POWERS:
        _POW, _INV = power, inverse
    return power, inverse


def give_back() -> None:
    """Return freed memory to the system. A Python worker is reused for task after
    task, and would hold the most that any of them took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not a GNU C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run: Callable) -> Callable:
    """A function for ``mapInArrow`` that gives its memory back at the end of a task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of consecutive rows with equal keys, several to a table."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        last = np.ones(b.num_rows, bool)
        for c in cols:
            last &= c == c[-1]
        cut = b.num_rows - int(last[::-1].argmin()) if not last.all() else 0
        if held and cut == 0 and all(held[-1].column(k)[-1].as_py() == c[0] for k, c in zip(keys, cols)):
            held.append(b)
            continue
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = [b.slice(cut)]
        else:
            if held:
                yield pa.Table.from_batches(held)
            held = [b]
    if held:
        yield pa.Table.from_batches(held)


def bounds(cols: list[np.ndarray]) -> np.ndarray:
    """Start of every group of equal consecutive keys, and the end."""
    n = len(cols[0])
    new = np.zeros(n, bool)
    new[0] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)
