"""Vectorised byte work on Arrow text columns, shared by the Python-side operators.

Everything works on one buffer of UTF-8 bytes and an array of row offsets, so the cost is a few
numpy passes over the text and no Python object is made per word.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer single text is taken alone.
CHUNK = 1 << 19


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_table(seed: int) -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def byte_letters() -> dict[int, int]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves, the others follow from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {b: b for b in kept} | {b: 256 + i for i, b in enumerate(rest)}


def powers(n: int, r: int) -> tuple[np.ndarray, np.ndarray]:
    """r**i and its inverse modulo 2**64 for i up to n; r must be odd."""
    one = np.ones(1, np.uint64)
    up = np.concatenate([one, np.cumprod(np.full(n, r, np.uint64))])
    down = np.concatenate([one, np.cumprod(np.full(n, pow(r, -1, 1 << 64), np.uint64))])
    return up, down


class Hasher:
    """Hash of any byte range of a buffer in constant time, from one prefix sum."""

    def __init__(self, seed: int = 1, base: int = 0x9E3779B97F4A7C13):
        self.table, self.base, self.n = byte_table(seed), base, -1

    def load(self, data: np.ndarray) -> None:
        if self.n < len(data):
            self.n = max(len(data), CHUNK)
            self.up, self.down = powers(self.n, self.base)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[: len(data)], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start])


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a text column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def trim() -> None:
    """Gives freed memory back to the system: a Python worker lives on after its task, beside the next stage's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run: Callable) -> Callable:
    """A function of one group or of two, after which freed memory is given back."""

    def one(a):
        out = run(a)
        trim()
        return out

    def two(a, b):
        out = run(a, b)
        trim()
        return out

    return one if run.__code__.co_argcount == 1 else two


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        data, off = texts(batch.column(batch.schema.get_field_index(text)))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to
    trim()


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of bytes other than ASCII white space, and the words before each row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before = np.concatenate([[False], word[:-1]])
    after = np.concatenate([word[1:], [False]])
    start = np.flatnonzero(word & (~before | edge[:-1]))
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, off)


def shingle_sets(data: np.ndarray, off: np.ndarray, hasher: Hasher, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row's word shingles, and the row offsets.

    Words are lower-cased in ASCII. A text of fewer than ``width`` words has one shingle, all of its words.
    """
    hasher.load(lower_ascii(data))
    start, end, words = word_spans(data, off)
    h = hasher.ranges(start, end)
    counts = np.diff(words)
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(sizes)])
    values = np.zeros(first[-1], np.uint64)
    for w in range(1, width + 1):
        rows = np.flatnonzero(counts == w if w < width else counts >= width)
        n = sizes[rows]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(words[rows], n) + step
        x = np.full(len(at), w, np.uint64)
        for i in range(w):
            x = mix64(x * np.uint64(0x100000001B3) + h[at + i])
        values[np.repeat(first[rows], n) + step] = x
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        values[a:b].sort()
    if len(values):
        new = np.concatenate([[True], values[1:] != values[:-1]])
        new[first[:-1][sizes > 0]] = True
        first = np.concatenate([[0], np.cumsum(new)])[first]
        values = values[new]
    return values, first


def bounds(begin: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Start and end of each of the runs that begin there, of n elements in all."""
    return list(zip(begin.tolist(), [*begin[1:].tolist(), n], strict=True)) if len(begin) else []
