"""Words of many texts as flat numpy arrays: byte masks, 64-bit word hashes and n-gram hashes.

Texts arrive as Arrow batches and are cut into slices of bounded size, so the arrays of a task stay small whatever the batch.
A word hash is a polynomial over the word's bytes modulo 2^64 with an odd base, finished with a bijective mixer; equal words
have equal hashes, and two different words agree with probability about 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
HASH_BYTES = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15)
GRAM = np.uint64(0xD6E8FEB86659FD93)


def table(separators: set[int], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(is a word byte, byte after folding A-Z) for each byte value."""
    word = np.array([b not in separators for b in range(256)])
    fold = np.array([b + 32 if lower and 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
    return word, fold


SPACES = {0x20, *range(0x09, 0x0E)}
PLAIN = table(SPACES, lower=False)
FOLDED = table(SPACES, lower=True)
ALNUM = table({b for b in range(0x80) if not (chr(b).isascii() and chr(b).isalnum())}, lower=True)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """base^i and base^-i modulo 2^64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if n <= len(self.up):
            return
        size = max(n, 2 * len(self.up))
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        up = np.full(size, BASE, np.uint64)
        down = np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)


POWERS = _Powers()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def text_of(batch: pa.RecordBatch) -> pa.Array:
    """The column ``text``, or the field of that name of the column ``row``."""
    if "text" in batch.schema.names:
        return batch.column(batch.schema.get_field_index("text"))
    return pc.struct_field(batch.column(batch.schema.get_field_index("row")), "text")


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose text has at most ``most`` bytes, or a single row beyond that."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(text_of(batch)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size.astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, stop - at)
            at = stop


class Words:
    """Words of several texts: byte ``start`` and ``end``, ``hash``, and ``first[d]`` the first word of text d."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: tuple[np.ndarray, np.ndarray]):
        word, self.fold = kind
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = word[data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[offsets[:-1][offsets[:-1] < n]] = False
        after[(offsets[1:] - 1)[offsets[1:] > 0]] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)

    @cached_property
    def hash(self) -> np.ndarray:
        return self.hashes(self.start, self.end)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of ascending spans of the texts, for HASH_BYTES of text at a time."""
        out, low = np.empty(len(start), np.uint64), 0
        while low < len(start):
            base = start[low]
            high = max(low + 1, int(np.searchsorted(end, base + HASH_BYTES, "right")))
            part = self.fold[self.data[base : end[high - 1]]].astype(np.uint64) + np.uint64(1)
            out[low:high] = run_hash(part, start[low:high] - base, end[low:high] - base)
            low = high
        return out

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """Text number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from each position (positions too near the end of all words are left out, text borders are not)."""
        return grams(self.hash, n)

    def whole(self, n: int) -> np.ndarray:
        """Whether the n words from each gram position lie in one text."""
        m = len(self) - n + 1
        if m <= 0:
            return np.zeros(0, bool)
        last = np.repeat(self.first[1:], self.counts())
        return np.arange(m) + n <= last[:m]


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:m].copy()
    for j in range(1, n):
        out *= GRAM
        out += hashes[j : j + m]
    return mix(out)


def run_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the runs values[start:end]."""
    POWERS.reach(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * POWERS.up[: len(values)], out=sums[1:])
    return mix((sums[end] - sums[start]) * POWERS.down[start] + (end - start).astype(np.uint64))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost minimum of each run of ``width`` values."""
    m = len(values) - width + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    best, at = values[:m].copy(), np.arange(m)
    for j in range(1, width):
        less = values[j : j + m] < best
        best[less] = values[j : j + m][less]
        at[less] = np.flatnonzero(less) + j
    return at


def gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated bytes of many spans, and their offsets in the result; indices are made for a part at a time."""
    size = end - start
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    out = np.empty(offsets[-1], data.dtype)
    low = 0
    while low < len(size):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + SLICE_BYTES, "right")) - 1)
        index = np.repeat(start[low:high] - offsets[low:high], size[low:high]) + np.arange(offsets[low], offsets[high])
        out[offsets[low] : offsets[high]] = data[index]
        low = high
    return out, offsets
