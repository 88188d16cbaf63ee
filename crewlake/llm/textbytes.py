"""Whole texts as UTF-8 bytes inside Arrow tasks: bounded chunks, words and word hashes as numpy arrays.

A chunk holds complete rows, about ``CHUNK`` bytes of them (one row more than that is a chunk of its own), so memory
follows the chunk, not the batch.  NULL texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_STRETCH = 1 << 18
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
KEEP = np.arange(256, dtype=np.uint8)

_rng = np.random.Generator(np.random.PCG64(20240607))
LETTER = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = 1 << 16
with np.errstate(over="ignore"):
    POWER = np.cumprod(np.full(_STEP, _BASE, dtype=np.uint64))
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole 64-bit value."""
    h = (h ^ (h >> np.uint64(30))) * MIX_1
    h = (h ^ (h >> np.uint64(27))) * MIX_2
    return h ^ (h >> np.uint64(31))


def power_of(pos: np.ndarray) -> np.ndarray:
    """Weights of positions; the table covers 65,536 of them, longer words mix in the number of the stretch."""
    p = POWER[pos & (_STEP - 1)]
    if pos.size and int(pos.max()) >= _STEP:
        p = p * mix((pos >> 16).astype(np.uint64) + np.uint64(1))
    return p


@dataclass
class Chunk:
    """Rows ``first`` to ``last`` (exclusive) of a batch; ``offsets`` has their byte bounds inside ``data``."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return self.last - self.first

    @cached_property
    def _solid(self) -> np.ndarray:
        return ~IS_SPACE[self.data]

    @cached_property
    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end (exclusive) of every word; words never cross rows."""
        solid, n = self._solid, len(self.data)
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cut = np.zeros(n + 1, dtype=bool)
        cut[self.offsets] = True
        start = solid.copy()
        start[1:] &= ~solid[:-1] | cut[1:n]
        end = solid.copy()
        end[:-1] &= ~solid[1:] | cut[1:n]
        return np.flatnonzero(start), np.flatnonzero(end) + 1

    @cached_property
    def word_offsets(self) -> np.ndarray:
        """Index of the first word of each row, and the number of words at the end."""
        return np.searchsorted(self.bounds[0], self.offsets)

    @cached_property
    def word_rows(self) -> np.ndarray:
        """Row, counted from ``first``, of each word."""
        return np.repeat(np.arange(self.rows), np.diff(self.word_offsets))

    def hashes(self, fold: np.ndarray = FOLD) -> np.ndarray:
        """64-bit hash of every word, after mapping its bytes by ``fold``."""
        starts, ends = self.bounds
        if not len(starts):
            return np.zeros(0, np.uint64)
        lens = ends - starts
        letters = fold[self.data[self._solid]]
        bounds = np.concatenate(([0], np.cumsum(lens)))
        out = np.empty(len(lens), np.uint64)
        first = 0
        while first < len(lens):  # a stretch of words at a time: the wide arrays stay small
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + _STRETCH, side="right")) - 1)
            at = (bounds[first:last] - bounds[first]).astype(np.int32 if bounds[last] - bounds[first] < 1 << 31 else np.int64)
            some = lens[first:last]
            pos = np.arange(int(bounds[last] - bounds[first]), dtype=at.dtype) - np.repeat(at, some)
            values = LETTER[letters[bounds[first]: bounds[last]]]
            values *= power_of(pos)
            out[first:last] = np.add.reduceat(values, at)
            first = last
        return mix(out + lens.astype(np.uint64))

    def joined(self, fold: np.ndarray = FOLD) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words one space apart, and each word's start and end in that."""
        starts, ends = self.bounds
        lens = ends - starts
        if not len(starts):
            return b"", starts, ends
        to = np.concatenate(([0], np.cumsum(lens + 1)[:-1]))
        out = np.full(int((lens + 1).sum()), 32, dtype=np.uint8)
        at = np.concatenate(([0], np.cumsum(lens)[:-1]))
        out[np.arange(int(lens.sum())) + np.repeat(to - at, lens)] = fold[self.data[self._solid]]
        return out.tobytes(), to, to + lens


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and its row bounds in them, without a copy."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)
    bounds = bounds[column.offset: column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), bounds


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[Chunk]:
    data, bounds = utf8(column)
    n, first = len(bounds) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1)
        last = min(last, n)
        yield Chunk(first, last, data[bounds[first]: bounds[last]], bounds[first: last + 1] - bounds[first])
        first = last


def windows(values: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """Whether ``width`` consecutive values that begin at each position lie in one row."""
    n = len(values)
    ok = np.zeros(n, dtype=bool)
    if n >= width:
        row_end = np.repeat(offsets[1:], np.diff(offsets))
        ok = np.arange(n) + width <= row_end
    return ok


def gram_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive word hashes (the last ``width - 1`` positions are left out)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = mix(h + words[k: n + k] + np.uint64(k))
    return h


POSITION_BITS = 28
_POSITION = np.uint64((1 << POSITION_BITS) - 1)


def lowest_in_windows(values: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the lowest value (the rightmost of equals) of some ``width`` consecutive values of their row.

    A row with fewer values gives its lowest one.  What is chosen in a window depends on the values in it alone, so two
    equal windows choose alike wherever they are.  Values are compared by their upper 36 bits.
    """
    n = len(values)
    if n == 0:
        return np.zeros(0, np.int64)
    chosen = [lowest_from(values, windows(values, offsets, width), width)]
    lens = np.diff(offsets)
    for r in np.flatnonzero((lens > 0) & (lens < width)):
        part = values[offsets[r]: offsets[r + 1]] & ~_POSITION
        chosen.append(np.array([offsets[r + 1] - 1 - int(np.argmin(part[::-1]))]))
    return np.sort(np.concatenate(chosen))


def lowest_from(values: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Ascending positions of the lowest (rightmost of equals) of the ``width`` values from each marked position on."""
    n = len(values)
    if n < width or not starts.any():
        return np.zeros(0, np.int64)
    table = np.full(n + -n % width, ~np.uint64(0))
    ranked = table[:n]
    np.bitwise_and(values, ~_POSITION, out=ranked)
    ranked |= _POSITION - np.arange(n, dtype=np.uint64)
    table = table.reshape(-1, width)
    left = np.minimum.accumulate(table, axis=1).ravel()
    right = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(right[: n - width + 1], left[width - 1: n])[starts[: n - width + 1]]
    low = low[np.concatenate(([True], low[1:] != low[:-1]))]
    return (_POSITION - (low & _POSITION)).astype(np.int64)
