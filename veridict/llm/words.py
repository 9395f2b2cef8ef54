"""Vectorised word and shingle hashing over Arrow string columns.

A word is a maximal run of bytes other than space and 0x09-0x0D, so a word in
this module equals a match of ``[^\\x20\\x09-\\x0D]+``.  Texts are hashed
straight from the Arrow buffers in chunks of whole texts: no per-word Python
object is made and the memory in use does not depend on the batch size, only
on the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SAME = np.arange(256, dtype=np.uint8)

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit (unsigned 64-bit)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def seeded(seed: int) -> np.uint64:
    """An odd multiplier that belongs to a seed."""
    return mix64(np.array([seed + 1], dtype=np.uint64))[0] | np.uint64(1)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, CHUNK_BYTES + 1)
        steps = np.full(size, _BASE, dtype=np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
        steps[1:] = _BASE_INVERSE
        _inverses = np.multiply.accumulate(steps)
    return _powers[:n], _inverses[:n]


@dataclass
class Words:
    """Words of consecutive texts.

    ``hashes`` holds one 64-bit hash a word; the words of text ``i`` of the
    chunk are ``bounds[i]:bounds[i + 1]``.  ``first`` is the row in the batch
    of the chunk's first text.
    """

    first: int
    hashes: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owner(self) -> np.ndarray:
        """The text, counted from 0 in the chunk, of each word."""
        return np.repeat(np.arange(len(self)), self.counts)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, bounds


def chunks(bounds: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``limit`` bytes."""
    at, n = 0, len(bounds) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def spans(buf: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last byte of every word; words end where a text ends.

    ``cuts`` are the offsets at which texts begin or end.
    """
    n = len(buf)
    inside = np.zeros(n + 1, dtype=bool)
    inside[:n] = _IS_WORD[buf]
    edge = np.zeros(n + 1, dtype=bool)
    edge[cuts] = True
    before = np.zeros(n + 1, dtype=bool)
    before[1:] = inside[:n]
    starts = np.flatnonzero(inside & (~before | edge))
    ends = np.flatnonzero(before & (~inside | edge))
    return starts, ends


def words(column: pa.Array, lower: bool = True) -> Iterator[Words]:
    """Hashed words of a string column, chunk by chunk.

    With ``lower``, A-Z are hashed as a-z.
    """
    raw, bounds = text_buffer(column)
    table = _LOWER if lower else _SAME
    for a, b in chunks(bounds):
        base = bounds[a]
        buf = table[raw[base : bounds[b]]]
        cuts = bounds[a : b + 1] - base
        starts, ends = spans(buf, cuts)
        powers, inverses = _tables(len(buf) + 1)
        sums = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
        hashes = mix64((sums[ends] - sums[starts]) * inverses[starts])
        yield Words(a, hashes, np.searchsorted(starts, cuts, "left"))


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words of one sequence of word hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        total += hashes[j : j + n] * seeded(j)
    return mix64(total)


@dataclass
class Shingles:
    """Shingles of consecutive texts; those of text ``i`` are ``bounds[i]:bounds[i + 1]``."""

    first: int
    hashes: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1


def shingles(column: pa.Array, size: int, short: bool, lower: bool = True) -> Iterator[Shingles]:
    """Shingles in the order of the text, repeats included.

    A text with fewer than ``size`` words has the whole sequence as its one
    shingle if ``short``, else none; a text without words has none.
    """
    for w in words(column, lower):
        counts = w.counts
        full = shingle_hashes(w.hashes, size)
        number = np.maximum(counts - size + 1, 0)
        few = (counts > 0) & (counts < size) if short else np.zeros(len(w), bool)
        number[few] = 1
        bounds = np.concatenate([[0], np.cumsum(number)])
        owner = np.repeat(np.arange(len(w)), number)
        at = w.bounds[:-1][owner] + np.arange(bounds[-1]) - bounds[:-1][owner]
        out = np.zeros(bounds[-1], dtype=np.uint64)
        whole = ~few[owner]
        out[whole] = full[at[whole]]
        for i in np.flatnonzero(few):
            own = w.hashes[w.bounds[i] : w.bounds[i + 1]]
            weights = np.array([seeded(j) for j in range(len(own))], dtype=np.uint64)
            out[bounds[i]] = mix64(np.array([(own * weights).sum() ^ seeded(1000 + len(own))], dtype=np.uint64))[0]
        yield Shingles(w.first, out, bounds)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
