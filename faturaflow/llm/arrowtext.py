"""Whole texts in Arrow batches: bounded slices, and numpy views of their words.

A slice holds at most `limit` bytes of text, or one text if that alone is longer, so the memory
of a Python worker depends on the limit and the longest text, never on the table.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes that are hashed at a time: bounds the tables of powers and the temporaries.
SPAN = 1 << 17

# Arrow's own pools keep what they free; a worker's memory should follow what it holds.
pa.set_memory_pool(pa.system_memory_pool())

U = np.uint64
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def release() -> None:
    """Gives freed memory back to the system, so that idle workers stay small."""
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * _M1
    x ^= x >> U(27)
    x *= _M2
    x ^= x >> U(31)
    return x


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, by in (("up", self.base), ("down", self.inverse)):
                p = np.full(size, by, U)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up[:n], self.down[:n]


class Hasher:
    """64-bit hashes of byte ranges and of windows of words; a seed gives an independent one."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 1 << 64, 256, dtype=U)
        odd = rng.integers(0, 1 << 64, 2, dtype=U) | U(1)
        self.bytes, self.words = Powers(int(odd[0])), Powers(int(odd[1]))

    def ranges(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of data[starts[i] : ends[i]], for ascending starts; SPAN bytes are worked on at a time."""
        out = np.empty(len(starts), U)
        at = 0
        while at < len(starts):
            lo = int(starts[at])
            to = max(at + 1, int(np.searchsorted(starts, lo + SPAN)))
            s, e = starts[at:to] - lo, ends[at:to] - lo
            n = int(e.max())
            up, down = self.bytes.of(n + 1)
            total = np.zeros(n + 1, U)
            np.cumsum(self.table[data[lo : lo + n]] * up[:-1], out=total[1:])
            out[at:to] = mix((total[e] - total[s]) * down[s] + (e - s).astype(U))
            at = to
        return out

    def windows(self, words: np.ndarray, n: int) -> np.ndarray:
        """Of words[i : i + n] for every i; as many as there are words, less n - 1."""
        if len(words) < n:
            return np.zeros(0, U)
        up, down = self.words.of(len(words) + 1)
        total = np.zeros(len(words) + 1, U)
        np.cumsum(words * up[:-1], out=total[1:])
        return mix((total[n:] - total[:-n]) * down[: len(words) + 1 - n])


def slices(batches, column: str = "text", limit: int = 4 << 20) -> Iterator[pa.Table]:
    """Tables of at most `limit` bytes of text each, nulls as empty texts."""
    for batch in batches:
        t = batch if isinstance(batch, pa.Table) else pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        t = t.set_column(t.schema.get_field_index(column), column, filled(t[column]))
        ends = np.cumsum(pc.binary_length(t[column]).to_numpy().astype(np.int64))
        at = 0
        while at < t.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield t.slice(at, to - at)
            at = to
            release()


def filled(column) -> pa.ChunkedArray:
    """The text column without nulls, as large binary data."""
    column = column if isinstance(column, pa.ChunkedArray) else pa.chunked_array([column])
    return pc.fill_null(column.cast(pa.large_binary()), b"")


class Words:
    """The words of the texts of one slice: data (bytes), starts, ends, and first[i] : first[i + 1] of text i."""

    def __init__(self, column, lower: bool):
        whole = filled(column).combine_chunks()
        if isinstance(whole, pa.ChunkedArray):
            whole = whole.chunk(0) if whole.num_chunks else pa.array([], pa.large_binary())
        offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1] if len(whole) else np.zeros(1, np.int64)
        data = np.frombuffer(whole.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        self.data = _LOWER[data] if lower else data
        inside = ~_BLANK[data]
        before = np.zeros(len(data) + 1, bool)
        before[1:] = inside
        before[self.offsets] = False
        self.starts = np.flatnonzero(inside & ~before[:-1])
        after = np.zeros(len(data) + 1, bool)
        after[:-1] = inside
        after[self.offsets] = False
        self.ends = np.flatnonzero(inside & ~after[1:]) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, hasher: Hasher) -> np.ndarray:
        return hasher.ranges(self.data, self.starts, self.ends)


def crossing(first: np.ndarray, n_words: int, n: int) -> np.ndarray:
    """True for the windows of n words, by their start, that lie within one text."""
    ok = np.ones(max(0, n_words - n + 1), bool)
    for k in range(1, n):
        at = first[1:-1] - k
        at = at[(at >= 0) & (at < len(ok))]
        ok[at] = False
    return ok


def by_two(major: np.ndarray, minor: np.ndarray) -> np.ndarray:
    """The order of pairs by small numbers, 0 or above, then by minor; equal pairs come in any order."""
    if not len(major) or major.max() >= 1 << 16:
        return np.lexsort((minor, major))
    order = np.argsort(minor)
    return order[np.argsort(major[order].astype(np.uint16), kind="stable")]  # two bytes are sorted by counting


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1])


def spans(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of the runs of equal values; none of no values."""
    return list(zip(begins := runs(sorted_values).tolist(), [*begins[1:], len(sorted_values)], strict=True)) if len(sorted_values) else []


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All of starts[i], starts[i] + 1, ... (counts[i] of them), one after another."""
    total = int(counts.sum())
    ahead = np.cumsum(counts) - counts
    return np.repeat(starts - ahead, counts) + np.arange(total)
