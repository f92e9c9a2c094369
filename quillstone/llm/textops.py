"""Vectorised text handling on Arrow string buffers, shared by the operators of this subpackage.

Every function works on a whole Arrow batch at once: the strings' bytes are viewed without a copy, words and
shingles are located and hashed with NumPy, and nothing is decoded to Python strings. Null texts count as empty.
"""

from __future__ import annotations

import copy
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE_WORDS = 5

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Words up to so many bytes are hashed together in NumPy, eight bytes at a time; longer ones one by one by BLAKE2.
_LANES = 8
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [0xFFFFFFFFFFFFFFFF], np.uint64)


def fresh_key() -> int:
    """A random key for word hashes. One call of an operator uses one key throughout; nobody can make words collide under it."""
    return int.from_bytes(os.urandom(8), "little")


def second_key(key: int) -> int:
    """The key of an independent second hash, so that both make 128 bits."""
    return int.from_bytes(hashlib.blake2b(key.to_bytes(8, "little"), digest_size=8).digest(), "little")


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column one after the other, and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], target: int = 2 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut at row borders to about `target` bytes of text each, so that work arrays stay small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + target, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int) -> np.ndarray:
    """64 bits of each word's bytes and length under a key that the words' writers don't know."""
    lengths = ends - starts
    h = mix(np.uint64(key) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    room = np.zeros(len(data) + 8, np.uint8)
    room[: len(data)] = data
    lanes = np.lib.stride_tricks.as_strided(room[:8].view(np.uint64), (len(data) + 1,), (1,))
    live, at, left = None, starts, lengths
    for _ in range(_LANES):
        x = lanes[at] & _MASKS[np.minimum(left, 8)]
        if live is None:
            h = mix(h + x)
        else:
            h[live] = mix(h[live] + x)
        on = np.flatnonzero(left > 8)
        if not len(on):
            return h
        live = on if live is None else live[on]
        at, left = at[on] + 8, left[on] - 8
    secret, view = key.to_bytes(8, "little"), memoryview(data)
    for i in live.tolist():
        h[i] = int.from_bytes(hashlib.blake2b(view[starts[i] : ends[i]], digest_size=8, key=secret).digest(), "little")
    return h


class Words:
    """The words of each row of a column: A-Z lower-cased, split at bytes 0x20 and 0x09 to 0x0D.

    data: lower-cased bytes; starts, ends: of each word; first: index of each row's first word (n + 1 entries);
    hashes: 64 bits of each word's bytes and length under the key.
    """

    def __init__(self, column: pa.Array | pa.ChunkedArray, key: int = 0):
        raw, self.offsets = text_bytes(column)
        self.data = _LOWER[raw]
        size = len(raw)
        # A border inside the joined bytes parts words as white space does.
        inside = np.zeros(size + 1, dtype=bool)
        np.logical_not(_SPACE[raw], out=inside[:size])
        opens = inside[:size].copy()
        if size:
            opens[1:] &= ~inside[: size - 1]
            border = self.offsets[:-1][self.offsets[:-1] < size]
            opens[border] |= inside[border]
            closes = ~inside[1:] & inside[:size]
            last = self.offsets[1:][self.offsets[1:] > 0] - 1
            closes[last] |= inside[last]
            self.starts, self.ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.starts, self.offsets)
        self.hashes = word_hashes(self.data, self.starts, self.ends, key)

    def rehashed(self, key: int) -> Words:
        """The same words, hashed under another key."""
        other = copy.copy(self)
        other.hashes = word_hashes(self.data, self.starts, self.ends, key)
        return other

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def shingles(self, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every run of `width` words, repeats included, and the n + 1 offsets of the rows.

        A row of fewer words has its whole sequence as its one shingle, an empty row none.
        """
        counts = self.counts
        short = (counts > 0) & (counts < width)
        per_row = np.where(short, 1, np.maximum(counts - width + 1, 0))
        out = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(per_row, out=out[1:])
        h = self.hashes
        n = max(len(h) - width + 1, 0)
        rolled = np.zeros(n, np.uint64)
        for k in range(width):
            rolled *= np.uint64(_MULTIPLIER)
            rolled += h[k : k + n]
        # Runs within one row: for each row its first `per_row` window starts.
        row = np.repeat(np.arange(len(counts)), per_row)
        at = np.arange(out[-1]) - out[row] + self.first[row]
        whole = ~short[row]
        found = np.zeros(out[-1], np.uint64)
        found[whole] = rolled[at[whole]]
        for r in np.flatnonzero(short):
            x = np.uint64(0)
            with np.errstate(over="ignore"):
                for w in h[self.first[r] : self.first[r + 1]]:
                    x = x * np.uint64(_MULTIPLIER) + w
                found[out[r]] = x + np.uint64(int(counts[r]))
        return mix(found), out


def distinct_per_row(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's values sorted and without repeats, and their offsets."""
    values = values.copy()
    for a, b in zip(offsets[:-1], offsets[1:]):
        values[a:b].sort()
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = values[1:] != values[:-1]
    keep[offsets[:-1][offsets[:-1] < len(values)]] = True
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    return values[keep], total[offsets]


def distinct_wide(first: np.ndarray, second: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's distinct pairs of two hashes, sorted by the first, and their offsets."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((second, first, row))
    first, second = first[order], second[order]
    keep = np.ones(len(first), dtype=bool)
    keep[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1]) | (row[1:] != row[:-1])
    total = np.zeros(len(first) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    return first[keep], second[keep], total[offsets]


def sum_per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each row's values; 0 for an empty row."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


class Table:
    """Places of 64-bit keys in a sorted array: one probe for most keys, a binary search where two share a slot."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(10, int(4 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.slots[self._slot(keys)] = np.arange(len(keys), dtype=np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for those that are not there."""
        out = self.slots[self._slot(keys)].astype(np.int64)
        other = np.flatnonzero((out >= 0) & (self.keys[out] != keys)) if len(self.keys) else np.zeros(0, np.int64)
        if len(other):
            at = np.minimum(np.searchsorted(self.keys, keys[other]), len(self.keys) - 1)
            out[other] = np.where(self.keys[at] == keys[other], at, -1)
        return out
