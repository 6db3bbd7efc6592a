"""Substring dedup: remove word sequences that an earlier document already holds.

Seed and extend, without ever pairing documents:

1. *Seeds.* Every window of ``length`` words picks its smallest ``seed``-word
   hash. Equal windows pick equal anchors, so documents that share a window
   share an anchor. Neighbouring windows with one anchor form a block.
2. *Anchors that only one document holds* end here, and with them most text.
3. *Extension to the whole block.* Blocks with equal words on both sides of the
   anchor are grouped; all but those of the smallest document id are repeats,
   and no window of theirs needs a look of its own.
4. *Extension to single windows.* Where an anchor has different contexts, the
   first copy of each block is opened into its windows, which are grouped by a
   128-bit hash of all their words: the two ends of every maximal repeat.
5. Repeats of a document are merged to maximal spans and cut out.

A passage in a million documents thus costs each of them one row per anchor,
joined to one row that says where it stands first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Workspace
from . import words as W

LENGTH = 13
SEED = 6
SECOND_BASE = np.uint64(0xA0761D6478BD642F)

BLOCKS = "anchor bigint, block bigint, doc_id bigint, part int, start int, n int"
WINDOWS = "h1 bigint, h2 bigint, doc_id bigint, part int, start int"


def _block_rows(length: int, seed: int):
    """``mapInArrow``: one row per block of windows that share their anchor."""

    def run(batches):
        for batch in batches:
            for piece in W.slices(batch, "text"):
                found = W.split_words(piece.column("text"))
                at = W.window_starts(found.rows, length)
                if not len(at):
                    continue
                hashes = W.word_hashes(found)
                grams = np.arange(len(hashes) - seed + 1)
                grams = W.range_hashes(hashes, grams, grams + seed, W.WORD_BASE)
                best, anchor = grams[at], at.copy()
                for shift in range(1, length - seed + 1):
                    other = grams[at + shift]
                    less = other < best
                    best, anchor = np.where(less, other, best), np.where(less, at + shift, anchor)
                owner = found.row_of()[at]
                opens = np.ones(len(at), dtype=bool)
                opens[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
                first = np.flatnonzero(opens)
                count = np.diff(np.append(first, len(at)))
                start, owner = at[first], owner[first]
                place = (anchor[first] - start).astype(np.uint64)
                block = W.mix(W.range_hashes(hashes, start, start + count + length - 1, W.WORD_BASE) + place)
                yield pa.RecordBatch.from_arrays(
                    [
                        W.as_long(best[first]),
                        W.as_long(block),
                        piece.column("doc_id").take(pa.array(owner)),
                        piece.column("part").take(pa.array(owner)),
                        pa.array((start - found.rows[owner]).astype(np.int32)),
                        pa.array(count.astype(np.int32)),
                    ],
                    names=["anchor", "block", "doc_id", "part", "start", "n"],
                )

    return run


def _flat(spans: pa.Array, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (start, n) of all rows and the row of each."""
    counts = pa.compute.fill_null(pa.compute.list_value_length(spans), 0).to_numpy(zero_copy_only=False)
    starts, sizes = spans.flatten().flatten()
    return starts.to_numpy().astype(np.int64), sizes.to_numpy().astype(np.int64), np.repeat(owners, counts)


def _window_rows(length: int):
    """``mapInArrow``: the windows of the listed blocks, with a 128-bit hash of their words."""

    def run(batches):
        for batch in batches:
            for piece in W.slices(batch, "text"):
                found = W.split_words(piece.column("text"))
                start, count, owner = _flat(piece.column("spans"), np.arange(piece.num_rows))
                row = np.repeat(owner, count)
                inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                place = np.repeat(start, count) + inner
                at = found.rows[row] + place
                hashes = W.word_hashes(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        W.as_long(W.range_hashes(hashes, at, at + length, W.WORD_BASE)),
                        W.as_long(W.range_hashes(hashes, at, at + length, SECOND_BASE)),
                        piece.column("doc_id").take(pa.array(row)),
                        piece.column("part").take(pa.array(row)),
                        pa.array(place.astype(np.int32)),
                    ],
                    names=["h1", "h2", "doc_id", "part", "start"],
                )

    return run


def repeats(docs: DataFrame, work: Workspace, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(doc_id, part, start, n): runs of n words that repeat words of a smaller doc_id.

    ``docs`` has doc_id (not null), part and text; (doc_id, part) names a text.
    Runs may touch or overlap.
    """
    if not 0 < seed <= length:
        raise ValueError("a seed must be at least one word and no longer than the length")
    blocks = docs.mapInArrow(_block_rows(length, seed), BLOCKS)
    seeds = (
        blocks.groupBy("anchor")
        .agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"), F.min("block").alias("b"), F.max("block").alias("y"))
        .filter("a < z")
        .select("anchor", (F.col("b") != F.col("y")).alias("mixed"))
    )
    seeds = work.write(seeds, "seeds")
    shared = work.write(blocks.join(seeds, "anchor"), "blocks")
    work.drop("seeds")
    # Written first, so that a passage very many documents hold can be split in the join.
    first = shared.groupBy("anchor", "block").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    first = work.write(first.filter("first < last").drop("last"), "first")
    repeat = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("repeat")
    placed = shared.join(first, ["anchor", "block"], "left").select("doc_id", "part", "start", "n", "mixed", repeat)
    placed = work.write(placed, "placed")
    work.drop("blocks", "first")
    opened = (
        placed.filter("mixed AND NOT repeat")
        .groupBy("doc_id", "part")
        .agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    )
    windows = docs.join(opened, ["doc_id", "part"]).mapInArrow(_window_rows(length), WINDOWS)
    windows = work.write(windows, "windows")
    source = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    source = work.write(source.filter("first < last").drop("last"), "source")
    single = windows.join(source, ["h1", "h2"]).filter("doc_id > first")
    whole = placed.filter("repeat").select("doc_id", "part", "start", (F.col("n") + length - 1).alias("n"))
    runs = whole.unionAll(single.select("doc_id", "part", "start", F.lit(length).alias("n")))
    runs = work.write(runs, "runs")
    work.drop("windows", "source", "placed")
    return runs


def _cut(schema_names: list[str]):
    """``mapInArrow``: count words, mark repeated ones, keep the rest."""

    def run(batches):
        for batch in batches:
            for piece in W.slices(batch, "text"):
                texts = piece.column("text").cast(pa.large_binary()).to_pylist()
                n_words, n_removed, kept, spans_out = [], [], [], []
                for text, spans in zip(texts, piece.column("runs").to_pylist(), strict=True):
                    found = (text or b"").split()
                    merged = _merge(spans or [])
                    for a, z in reversed(merged):
                        del found[a:z]
                    removed = sum(z - a for a, z in merged)
                    n_words.append(len(found) + removed)
                    n_removed.append(removed)
                    kept.append(b" ".join(found))
                    spans_out.append([{"start": a, "end": z} for a, z in merged])
                ids = piece.column("doc_id")
                arrays = [ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
                if "kept_text" in schema_names:
                    arrays.append(pa.array(kept, pa.binary()).cast(pa.string()))
                arrays.append(pa.array([hashlib.sha256(k).hexdigest() for k in kept]))
                arrays.append(pa.array(spans_out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
                yield pa.RecordBatch.from_arrays(arrays, names=schema_names)

    return run


def _merge(runs: list[dict]) -> list[tuple[int, int]]:
    """Maximal spans [a, z) of overlapping or touching runs."""
    out: list[tuple[int, int]] = []
    for a, z in sorted((r["start"], r["start"] + r["n"]) for r in runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, seed: int = SEED, keep_text: bool = True
) -> DataFrame:
    """Cut every run of ``length`` or more words that also stands in a document of smaller doc_id.

    Returns a row for each row of ``docs`` (doc_id, text; further columns are
    left out): doc_id, n_words, n_removed, kept_text (unless ``keep_text`` is
    false), kept_sha256 and ``spans``, the maximal repeats as word ranges.

    A null or empty text has no words and keeps the empty text. Texts shorter
    than ``length`` are never cut. A null doc_id neither cuts others nor is cut.
    Rows that repeat a doc_id belong to one document: they do not cut each
    other, and each is cut by itself.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    work = Workspace(docs.sparkSession, "substring")
    # Texts that share a doc_id are told apart by a digest; elsewhere it would only cost bytes.
    ids = docs.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("z"))
    apart = bool(ids.filter("a <> z").limit(1).count())
    docs = docs.withColumn("part", F.hash("text") if apart else F.lit(0))
    runs = repeats(docs.filter("doc_id IS NOT NULL"), work, length, seed)
    runs = runs.groupBy("doc_id", "part").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    names = ["doc_id", "n_words", "n_removed", *["kept_text"] * keep_text, "kept_sha256", "spans"]
    types = {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "spans": "array<struct<start:int,end:int>>"}
    schema = ", ".join(f"{n} {types.get(n, 'string')}" for n in names)
    return docs.join(runs, ["doc_id", "part"], "left").mapInArrow(_cut(names), schema)
