"""Line dedup: drop lines that an earlier document already holds.

1. *Explode.* Every line is stripped and lower-cased; of those long enough only
   a 128-bit hash goes on, once per row.
2. *Count.* The documents of each hash, summed map-side, so that a line that
   most documents hold costs one row per task.
3. *Drop.* Lines in enough documents are joined back to their documents. Only
   hashes travel; a frequent line is split over tasks by adaptive execution.
4. *Reassemble.* Each text is split once more, its listed lines fall out and the
   others are joined by position.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Workspace
from .words import BYTE_BASE, LOWER, SPACE, as_long, mix, range_hashes, slices, text_bytes

MIN_CHARS = 10
MIN_DOCS = 2
SECOND_BASE = np.uint64(0xA0761D6478BD642F)
NEWLINE = 0x0A


def split_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, each line's range [start, end) in them and each text's first line.

    An empty text has one empty line; text i has lines rows[i]..rows[i + 1].
    """
    data, offsets = text_bytes(texts)
    breaks = np.flatnonzero(data == NEWLINE)
    owner = np.searchsorted(offsets, breaks, side="right") - 1
    count = np.bincount(owner, minlength=len(texts)) + 1
    rows = np.concatenate([[0], np.cumsum(count)])
    start, end = np.empty(rows[-1], np.int64), np.empty(rows[-1], np.int64)
    start[rows[:-1]], end[rows[1:] - 1] = offsets[:-1], offsets[1:]
    inner = np.arange(len(breaks)) + owner
    end[inner], start[inner + 1] = breaks, breaks + 1
    return data, start, end, rows


def line_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each line's key and whether the key has ``min_chars`` code points or more."""
    solid = np.flatnonzero(~SPACE[data])
    first, last = np.searchsorted(solid, start), np.searchsorted(solid, end)
    filled = first < last
    a, z = start.copy(), start.copy()
    a[filled], z[filled] = solid[first[filled]], solid[last[filled] - 1] + 1
    # A code point starts at every byte that does not continue one.
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    lowered = LOWER[data]
    one, two = (range_hashes(lowered, a, z, base) for base in (BYTE_BASE, SECOND_BASE))
    return one, two, points[z] - points[a] >= min_chars


def _line_rows(min_chars: int):
    """``mapInArrow``: the distinct keys of each row as two hashes."""

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text"):
                data, start, end, rows = split_lines(piece.column("text"))
                one, two, counted = line_hashes(data, start, end, min_chars)
                row = np.repeat(np.arange(piece.num_rows), np.diff(rows))[counted]
                one, two = one[counted], two[counted]
                order = np.lexsort((two, one, row))
                row, one, two = row[order], one[order], two[order]
                new = np.ones(len(row), dtype=bool)
                new[1:] = (row[1:] != row[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id").take(pa.array(row[new])), as_long(one[new]), as_long(two[new])],
                    names=["doc_id", "h1", "h2"],
                )

    return run


def _drop_lines(names: list[str], min_chars: int):
    """``mapInArrow``: each text without the lines listed in ``gone``, joined by position."""

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text"):
                data, start, end, rows = split_lines(piece.column("text"))
                one, two, counted = line_hashes(data, start, end, min_chars)
                own = one ^ mix(two)
                body = data.tobytes()
                kept_texts, dropped = [], []
                for i, gone in enumerate(piece.column("gone")):
                    a, z = rows[i], rows[i + 1]
                    if not gone.is_valid:
                        kept_texts.append(body[start[a] : end[z - 1]])
                        dropped.append(0)
                        continue
                    out = counted[a:z] & np.isin(own[a:z], _combined(*gone.values.flatten()))
                    stay = np.flatnonzero(~out) + a
                    kept_texts.append(b"\n".join(body[s:e] for s, e in zip(start[stay], end[stay])))
                    dropped.append(int(out.sum()))
                arrays = [piece.column("doc_id"), pa.array(np.diff(rows)), pa.array(dropped, pa.int64())]
                if "kept_text" in names:
                    arrays.append(pa.array(kept_texts, pa.binary()).cast(pa.string()))
                arrays.append(pa.array([hashlib.sha256(t).hexdigest() for t in kept_texts]))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _combined(h1: pa.Array, h2: pa.Array) -> np.ndarray:
    """One code for both hashes of a key, to tell the lines of one text apart."""
    one, two = (h.to_numpy(zero_copy_only=False).view(np.uint64) for h in (h1, h2))
    return one ^ mix(two)


def repeated_lines(lines: DataFrame, min_docs: int, work: Workspace) -> DataFrame:
    """(h1, h2, first): keys that ``min_docs`` documents or more hold, and the smallest doc_id of each."""
    ends = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    shared = work.write(ends.filter("first < last").drop("last"), "shared")
    if min_docs <= 2:
        return shared
    held = lines.join(shared, ["h1", "h2"]).groupBy("h1", "h2", "first", "doc_id").agg(F.lit(1).alias("one"))
    return held.groupBy("h1", "h2", "first").agg(F.count("*").alias("docs")).filter(F.col("docs") >= min_docs).drop("docs")


def drop_repeated_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, keep_text: bool = True
) -> DataFrame:
    """Drop the lines that ``min_docs`` documents or more hold, except in the smallest doc_id holding them.

    A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z in
    lower case; keys of fewer than ``min_chars`` code points always stay.
    Returns a row for each row of ``docs`` (doc_id, text; further columns are
    left out): doc_id, n_lines, n_dropped, kept_text (unless ``keep_text`` is
    false) and kept_sha256.

    A null or empty text is one empty line. A null doc_id neither counts as a
    document nor loses lines. Rows that repeat a doc_id are one document: they
    count once and do not drop each other's lines. A line repeated within one
    document only stays each time.
    """
    if min_docs < 2:
        raise ValueError("a line in one document only cannot be a repeat")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    work = Workspace(docs.sparkSession, "lines")
    named = docs.filter("doc_id IS NOT NULL")
    # Written, so that a frequent line's rows can be split in the join below.
    lines = work.write(named.mapInArrow(_line_rows(min_chars), "doc_id bigint, h1 bigint, h2 bigint"), "lines")
    repeated = repeated_lines(lines, min_docs, work)
    found = lines.join(repeated, ["h1", "h2"]).filter("doc_id > first")
    gone = work.write(found.groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("gone")), "gone")
    work.drop("lines", "shared")
    names = ["doc_id", "n_lines", "n_dropped", *["kept_text"] * keep_text, "kept_sha256"]
    types = {"kept_text": "string", "kept_sha256": "string"}
    schema = ", ".join(f"{n} {types.get(n, 'bigint')}" for n in names)
    return docs.join(gone, "doc_id", "left").mapInArrow(_drop_lines(names, min_chars), schema)
