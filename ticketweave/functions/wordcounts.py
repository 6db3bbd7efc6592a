"""The Arrow kernel that turns texts into term vectors: what ``text.words_of`` and the hash say, for many rows at once.

The rows of a piece are joined by a byte that no UTF-8 text holds, so each
rewrite rule is one pass over one string; words are hashed once per piece, and
sorted and counted by (row, bucket).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa

from .wordlists import CLEANING_RULES

TERMS = pa.list_(pa.struct([("bucket", pa.int32()), ("tf", pa.int32())]))
# Bytes of text that are treated together, one row at least.
PIECE_BYTES = 4 << 20
# Words whose buckets a task remembers at once.
KNOWN_WORDS = 1 << 18
SPACE, SEPARATOR = 32, 255
_KEPT = b" 0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ\xff"
_SPACES = bytes(b if b in _KEPT else SPACE for b in range(256))
# One space for each character: that of its first byte.
_CONTINUED = bytes(range(0x80, 0xC0))
_DIGITS = bytes(SPACE if b in b"0123456789" else b for b in range(256))


def _single_letters(data: bytes) -> bytes:
    """Blank each letter between two spaces; matches share no space, the first of a row of them counts."""
    a = np.frombuffer(data, np.uint8).copy()
    space = a == SPACE
    found = np.flatnonzero(space[:-2] & space[2:] & (a[1:-1] >= ord("a")) & (a[1:-1] <= ord("z")))
    # In a chain of matches two apart every other one is used up.
    starts = np.flatnonzero(np.diff(found, prepend=-3) != 2)
    place = np.arange(len(found)) - np.repeat(starts, np.diff(starts, append=len(found)))
    a[found[place % 2 == 0] + 1] = SPACE
    return a.tobytes()


# What the rules that are regular expressions do to bytes. Runs of spaces need nothing: words are what lies between.
_BYTE_RULES = {
    r"[\x00-\x1f!-/:-@\[-`{-\x{10ffff}]": lambda data: data.translate(_SPACES, _CONTINUED),
    "[0-9]": lambda data: data.translate(_DIGITS),
    " [a-z]{1} ": _single_letters,
    " {2,}": lambda data: data,
}


class _Buckets(dict):
    """Buckets of words, -1 for those listed; forgets all when it is full."""

    def __init__(self, listed: frozenset[bytes], num_features: int):
        super().__init__()
        self.listed, self.num_features = listed, num_features

    def hashed(self, word: bytes) -> int:
        return int.from_bytes(hashlib.md5(word, usedforsecurity=False).digest()[:4], "big") % self.num_features

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        found = self[word] = -1 if word in self.listed else self.hashed(word)
        return found


def _piece(texts: list[bytes], known: _Buckets, empty: int | None) -> pa.Array:
    """Term vectors of lower-cased texts; rows without words get the bucket ``empty`` unless it is None."""
    data = bytes([SEPARATOR]).join(texts)
    for kind, pattern, replacement in CLEANING_RULES:
        data = data.replace(pattern.encode(), replacement.encode()) if kind == "text" else _BYTE_RULES[pattern](data)
    a = np.frombuffer(data, np.uint8)
    inside = (a != SPACE) & (a != SEPARATOR)
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(a[inside])]
    words = pa.Array.from_buffers(pa.binary(), len(starts), buffers).dictionary_encode()
    buckets = np.array([known[word] for word in words.dictionary.to_pylist()], np.int64)[words.indices.to_numpy()]
    bounds = [0, *np.searchsorted(starts, np.flatnonzero(a == SEPARATOR)).tolist(), len(starts)]
    row = np.repeat(np.arange(len(texts)), np.diff(bounds))
    # Stop words have no bucket.
    kept = buckets >= 0
    row, buckets = row[kept], buckets[kept]
    if empty is not None:
        without = np.flatnonzero(np.bincount(row, minlength=len(texts)) == 0)
        row, buckets = np.concatenate([row, without]), np.concatenate([buckets, np.full(len(without), empty)])
    keys = np.sort(row << 32 | buckets)
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    terms = keys[first]
    struct = pa.StructArray.from_arrays(
        [pa.array((terms & 0xFFFFFFFF).astype(np.int32)), pa.array(np.diff(first, append=len(keys)).astype(np.int32))],
        fields=list(TERMS.value_type),
    )
    upto = np.searchsorted(terms >> 32, np.arange(len(texts) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(upto), struct, type=TERMS)


def counter(stopwords: Iterable[str], drop_empty: bool, num_features: int, piece_bytes: int = PIECE_BYTES):
    """A function from an Arrow array of lower-cased UTF-8 texts without nulls to their term vectors."""
    listed = frozenset(word.encode() for word in stopwords)
    # Filled in the task and kept from batch to batch.
    known: _Buckets | None = None

    # Plans show it by this name.
    def terms_by_md5(texts: pa.Array) -> pa.Array:
        nonlocal known
        known = known or _Buckets(listed, num_features)
        empty = None if drop_empty else known.hashed(b"")
        parts, piece, size = [pa.array([], TERMS)], [], 0
        for text in texts:
            piece.append(text.as_buffer().to_pybytes())
            size += len(piece[-1]) + 1
            if size >= piece_bytes:
                parts.append(_piece(piece, known, empty))
                piece, size = [], 0
        if piece:
            parts.append(_piece(piece, known, empty))
        return pa.concat_arrays(parts)

    return terms_by_md5
