"""Words of whole texts and hashes of word sequences, a megabyte at a time in numpy.

A word is a run of bytes without ``[\\x20\\x09-\\x0D]``. All hashes are 64-bit
polynomials modulo 2**64 taken from prefix sums, so the hash of any run of
words costs the same however long it is, and go through a final mixer.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
WORD_BASE = np.uint64(0xD1342543DE82EF95)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


class Words(NamedTuple):
    """Words of some texts: byte ranges in ``data``; text i has words rows[i]..rows[i + 1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    rows: np.ndarray

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` bytes of text, or a single row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of the texts and the offsets of each; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    body = texts.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8)[first:last] if body is not None and last > first else np.zeros(0, np.uint8)
    return data, offsets - first


def split_words(texts: pa.Array, lower: bool = False, breaks: np.ndarray = SPACE) -> Words:
    data, offsets = text_bytes(texts)
    if lower:
        data = LOWER[data]
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return Words(data, none, none, np.zeros(len(offsets), dtype=np.int64))
    space = breaks[data]
    before, after = np.empty_like(space), np.empty_like(space)
    before[0] = after[-1] = True
    before[1:], after[:-1] = space[:-1], space[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = after[inner - 1] = True
    start = np.flatnonzero(~space & before)
    end = np.flatnonzero(~space & after) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole 64-bit result (splitmix64's finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Known(dict):
    """Values computed before; a copy that travels to a worker starts empty."""

    def __reduce__(self):
        return _Known, ()


_POWERS = _Known()


def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, 0 <= exponent <= size."""

    def run(b: int) -> np.ndarray:
        out = np.full(size + 1, b, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    # Sizes are powers of two, so there are few.
    if (base, size) not in _POWERS:
        _POWERS[base, size] = run(base), run(pow(base, -1, 1 << 64))
    return _POWERS[base, size]


def _prefix(values: np.ndarray, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of value * base**position, and the inverse powers that undo the position."""
    size = 1 << max(16, (len(values)).bit_length())
    up, down = _powers(int(base), size)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values.astype(np.uint64) * up[: len(values)], out=sums[1:])
    return sums, down


def range_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64) -> np.ndarray:
    """Mixed hash of values[start:end] for every pair of bounds."""
    sums, down = _prefix(values, base)
    raw = (sums[end] - sums[start]) * down[start]
    return mix(raw + mix((end - start).astype(np.uint64) * base))


def word_hashes(words: Words) -> np.ndarray:
    return range_hashes(words.data, words.start, words.end, BYTE_BASE)


def window_starts(rows: np.ndarray, size: int) -> np.ndarray:
    """Starts of all windows of ``size`` words that lie within one text."""
    count = np.maximum(np.diff(rows) - size + 1, 0)
    first = np.repeat(rows[:-1] - (np.cumsum(count) - count), count)
    return first + np.arange(int(count.sum()))


def as_long(values: np.ndarray) -> pa.Array:
    """Unsigned 64-bit hashes as Spark's bigint."""
    return pa.array(values.view(np.int64))
