"""Words of many texts at once as numpy arrays, with 64-bit hashes.

Texts are split in pieces of a few megabytes, so memory follows the piece (or
the one longest text), never the table. A null text has no words.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20
PIECE_ROWS = 1024
KEPT_POWERS = 8 << 20
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
LETTERS = "alnum"  # [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z
NON_SPACE = "space"  # [^\x20\x09-\x0D], unchanged


class Words(NamedTuple):
    data: np.ndarray  # bytes of all texts, one space after each
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after each word
    first: np.ndarray  # first word of each text, and the number of words
    hash: np.ndarray  # uint64 of each word
    text_start: np.ndarray  # first byte of each text, and the number of bytes
    sums: np.ndarray  # running sums behind the hashes

    def owner(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hash_of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from ``start`` to ``end``, such as words or their beginnings."""
        down = _power("down", pow(BASE, -1, 1 << 64), len(self.data))
        value = (self.sums[end] - self.sums[start]) * down[start]
        return mix(value + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@lru_cache(maxsize=4)
def _tables(kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Byte to byte (lower-casing) and byte to 'belongs to a word'."""
    code = np.arange(256, dtype=np.uint8)
    if kind == NON_SPACE:
        return code, ~((code == 32) | ((code >= 9) & (code <= 13)))
    lower = np.where((code >= 65) & (code <= 90), code + 32, code).astype(np.uint8)
    return lower, ((code >= 48) & (code <= 57)) | ((code >= 97) & (code <= 122)) | (code >= 128)


_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, kept for the next piece unless very long."""
    got = _powers.get(name)
    if got is None or len(got) <= n:
        steps = np.full(1 << n.bit_length(), base, dtype=np.uint64)
        steps[0] = 1
        got = np.multiply.accumulate(steps)
        if n <= KEPT_POWERS:
            _powers[name] = got
    return got


def tidy() -> None:
    """Free what earlier tasks left in a worker that Spark uses again.

    Functions reach the workers by value, each task's with tables of its own, and
    these hang in reference cycles that numpy code rarely makes Python look for.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)  # hand freed memory back, where the C library can
    except (OSError, AttributeError):
        pass


def tidied(run: Callable) -> Callable:
    """A task's function that leaves nothing in its worker: idle workers count as the executor's memory."""

    def tidy_run(batches):
        tidy()
        try:
            yield from run(batches)
        finally:
            _powers.clear()
            tidy()

    return tidy_run


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def unique(values: np.ndarray) -> np.ndarray:
    """The distinct values, sorted: many times faster than the hash table numpy builds for them."""
    values = np.sort(values)
    return values[np.flatnonzero(np.append(True, values[1:] != values[:-1]))] if len(values) else values


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column, most: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of runs of rows of about ``most`` bytes."""
    for base in range(0, len(column), PIECE_ROWS):  # a copy of so many rows at a time, not of the batch
        data, offsets = texts_of(column.slice(base, PIECE_ROWS))
        row, rows = 0, len(offsets) - 1
        while row < rows:
            stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
            yield base + row, base + stop, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
            row = stop


def split(data: np.ndarray, offsets: np.ndarray, kind: str) -> Words:
    """All words of the texts, with hashes of their (lower-cased) bytes."""
    lower, inside = _tables(kind)
    n = len(offsets) - 1
    padded = np.full(len(data) + n + 1, 32, np.uint8)
    text_start = offsets + np.arange(n + 1)
    keep = np.ones(len(padded), bool)
    keep[text_start[1:] - 1] = keep[-1] = False
    padded[keep] = data
    if kind != NON_SPACE:
        padded = lower[padded]
    flags = np.zeros(len(padded) + 1, np.int8)
    flags[1:] = inside[padded]
    step = np.diff(flags)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    first = np.searchsorted(start, text_start)
    first[-1] = len(start)
    sums = np.zeros(len(padded) + 1, np.uint64)
    np.cumsum((padded.astype(np.uint64) + 1) * _power("up", BASE, len(padded))[: len(padded)], out=sums[1:])
    words = Words(padded, start, end, first, np.zeros(0, np.uint64), text_start, sums)
    return words._replace(hash=words.hash_of(start, end))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``size`` values from each place; places too near the end are left out."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    value = np.zeros(n, np.uint64)
    for k in range(size):
        value *= np.uint64(BASE)
        value += hashes[k : k + n]
    return mix(value)


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Whether each of ``n`` words lies in one of the windows at ``starts``."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + size, -1)
    return np.cumsum(step[:-1]) > 0


def per_text(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many flagged words each text has."""
    sums = np.concatenate([[0], np.cumsum(flags)])
    return sums[first[1:]] - sums[first[:-1]]
