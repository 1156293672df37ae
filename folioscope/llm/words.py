"""Texts of an Arrow batch as arrays: words, their hashes, and names of windows of them.

Names are 64-bit hashes of symbol sequences, built by doubling: a window of 2n symbols is named by the names of its two
halves. Everything is vectorised over about a megabyte of text at a time, so memory does not grow with the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_TABLE_ROWS = 64

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that are no letter, digit or part of a non-ASCII character.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
AS_IS = np.arange(256, dtype=np.uint8)
LOWER = AS_IS.copy()
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of ordered pairs of names."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


_TABLE = mix(np.arange(1, _TABLE_ROWS * 256 + 1, dtype=np.uint64))


def window_names(symbols: np.ndarray, k: int) -> np.ndarray:
    """Name of every window of ``k`` symbols, by its start."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, length, done, out = symbols, 1, 0, None
    while True:
        if k & length:
            part = power[done:done + n]
            out = part if out is None else pair(out[:n], part)
            done += length
        if done == k:
            return out[:n]
        power = pair(power[:len(power) - length], power[length:])
        length *= 2


def smallest(names: np.ndarray, w: int) -> np.ndarray:
    """For every run of ``w`` names the place of the smallest, the first of equal ones. Depends on the run alone."""
    n = len(names) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << 24) - 1)
    assert len(names) <= int(low)
    key = (names & ~low) | np.arange(len(names), dtype=np.uint64)
    length = 1
    while 2 * length <= w:
        key = np.minimum(key[:len(key) - length], key[length:])
        length *= 2
    return (np.minimum(key[:n], key[w - length:w - length + n]) & low).astype(np.int64)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after another, and the offsets of each; null is empty."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = pc.fill_null(texts, b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def blocks(texts: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows of the batch in runs of about ``size`` bytes: first row, end row, bytes, offsets of the rows in them."""
    data, offsets = raw(texts)
    lo, n = 0, len(texts)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


class Words:
    """Words of a run of rows: ``names``, ``row`` (from 0), byte ``start`` and ``end``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACES, fold: np.ndarray = AS_IS) -> None:
        first = np.zeros(len(data) + 1, bool)
        first[offsets[:-1]] = True
        parts = []
        lo = 0
        while lo < len(data):
            hi = self._cut(data, lo, breaks)
            parts.append(self._part(data[lo:hi], first[lo:hi], breaks, fold, lo))
            lo = hi
        self.names, self.start, self.end = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        self.n_rows = len(offsets) - 1

    @staticmethod
    def _cut(data: np.ndarray, lo: int, breaks: np.ndarray) -> int:
        """End of a piece of about a block: after a break, so that no word is cut."""
        hi = lo + 2 * BLOCK_BYTES
        while hi < len(data):
            found = np.flatnonzero(breaks[data[hi:hi + 4096]])
            if len(found):
                return hi + int(found[0]) + 1
            hi += 4096
        return len(data)

    @staticmethod
    def _part(data: np.ndarray, first: np.ndarray, breaks: np.ndarray, fold: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inside = ~breaks[data]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1] | first[1:]
        at = np.flatnonzero(inside)
        begin = np.flatnonzero(opens[at])
        if not len(begin):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        length = np.diff(np.append(begin, len(at)))
        start = at[begin]
        place = at - np.repeat(start, length)
        letter = fold[data[at]]
        value = _TABLE[(np.minimum(place, _TABLE_ROWS - 1) << 8) | letter]
        far = np.flatnonzero(place >= _TABLE_ROWS - 1)
        if len(far):
            value[far] = mix((place[far].astype(np.uint64) << np.uint64(9)) | letter[far] | np.uint64(1 << 60))
        names = mix(np.add.reduceat(value, begin) + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return names, start + shift, start + length + shift

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.n_rows)

    def windows(self, k: int, base: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Starts and names of the windows of ``k`` words that lie in one row."""
        names = window_names(self.names if base is None else base, k)
        at = np.flatnonzero(self.row[:len(names)] == self.row[k - 1:]) if len(names) else np.zeros(0, np.int64)
        return at, names[at]

    def first(self) -> np.ndarray:
        """Index of the first word of each row."""
        return np.searchsorted(self.row, np.arange(self.n_rows))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
