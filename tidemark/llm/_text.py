"""Vectorised word splitting and hashing over Arrow string columns.

Everything works on the UTF-8 bytes of a batch of texts at once. Word classes here hold or exclude
whole non-ASCII characters, so deciding byte by byte is exact. Words and windows are known by
64-bit hashes; equal sequences have equal hashes, and for n different ones the chance of any clash
is about n*n / 2**65 (windows) within whatever set of them is compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
CHUNK = 1 << 19

#: Bytes of words: everything but white space.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words: digits, lower-case letters, everything outside ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BYTE_CODES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) <= n:
        size = max(CHUNK * 2, n + 1)
        tables = []
        for base in (_BASE, _INVERSE):
            t = np.full(size, base, dtype=np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers[:] = tables
    return _powers


@dataclass
class Words:
    """The words of some texts: start and end byte, hash, and for text i the words first[i]:first[i+1]."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def left(self) -> np.ndarray:
        """For each word, how many words of its text begin with it."""
        n = self.counts
        return np.repeat(self.first[1:], n) - np.arange(len(self.start))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts and their n + 1 offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=kind, count=texts.offset + n + 1)[texts.offset :].astype(np.int64)
    bytes_ = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_[off[0] : off[-1]], off - off[0]


def words(texts: pa.Array, keep: np.ndarray = NOT_SPACE, lower: bool = False) -> Words:
    data, off = raw(texts)
    codes = _BYTE_CODES[LOWER] if lower else _BYTE_CODES
    inside = keep[LOWER] if lower else keep
    total = len(data)
    starts, ends, hashes = [], [], []
    pos = 0
    while pos < total:
        stop = min(pos + CHUNK, total)
        if stop < total:
            stop = _cut(data, off, inside, pos, stop)
        part = data[pos:stop]
        w = inside[part]
        begins, closes = w.copy(), w.copy()
        begins[1:] &= ~w[:-1]
        closes[:-1] &= ~w[1:]
        lo, hi = np.searchsorted(off, [pos, stop])
        edge = np.unique(off[lo : hi + 1])
        edge = edge[(edge > pos) & (edge < stop)] - pos
        begins[edge] = w[edge]
        closes[edge - 1] = w[edge - 1]
        s, e = np.flatnonzero(begins), np.flatnonzero(closes) + 1
        powers, inverse = _power_tables(len(part))
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(codes[part] * powers[: len(part)], out=sums[1:])
        h = (sums[e] - sums[s]) * inverse[s]
        hashes.append(mix(h ^ (e - s).astype(np.uint64)))
        starts.append(s + pos)
        ends.append(e + pos)
        pos = stop
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    start, end = join(starts, np.int64), join(ends, np.int64)
    return Words(data, off, start, end, join(hashes, np.uint64), np.searchsorted(start, off))


def _cut(data: np.ndarray, off: np.ndarray, inside: np.ndarray, pos: int, stop: int) -> int:
    """A place near stop that is in no word: a text's edge, or just after a separator."""
    at = off[np.searchsorted(off, stop, "right") - 1]
    if at > pos:
        return int(at)
    gaps = np.flatnonzero(~inside[data[pos:stop]])
    if len(gaps):
        return pos + int(gaps[-1]) + 1
    limit = int(off[np.searchsorted(off, stop, "left")])
    while stop < limit:
        gaps = np.flatnonzero(~inside[data[stop : min(stop + CHUNK, limit)]])
        if len(gaps):
            return stop + int(gaps[0]) + 1
        stop += CHUNK
    return limit


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the size words from each word on; the last size - 1 entries run over the end and mean nothing."""
    out = np.zeros(len(hashes), dtype=np.uint64)
    factor = 1
    for k in range(size):
        out[: len(hashes) - k] += hashes[k:] * _U(factor)
        factor = factor * 0xD1342543DE82EF95 % (1 << 64)
    return mix(out)


def pieces(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text at a time; a longer text comes alone."""
    _, off = raw(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


class Members:
    """Which of some hashes are in a set: a bitmap rules most out, binary search decides."""

    BITS = 20

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.map = np.zeros(1 << self.BITS, dtype=bool)
        self.map[self._low(self.keys)] = True

    def _low(self, x: np.ndarray) -> np.ndarray:
        return (x & _U((1 << self.BITS) - 1)).astype(np.int64)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in x of members, and their indexes in keys."""
        at = np.flatnonzero(self.map[self._low(x)])
        k = np.searchsorted(self.keys, x[at])
        k[k == len(self.keys)] = 0
        ok = self.keys[k] == x[at] if len(self.keys) else np.zeros(len(at), bool)
        return at[ok], k[ok]
