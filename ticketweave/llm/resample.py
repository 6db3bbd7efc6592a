"""Importance resampling toward a target collection, by hashed word runs.

1. *Words.* An untrained Regex Split over the text, A-Z in lower case, gives the
   words with their offsets.
2. *Features.* All runs of one to three words. Laid side by side with one space
   between, the words' offset pairs are the features' byte ranges; the CRC-32 of
   a range picks its bucket.
   Buckets are written once per document, as the words are the dear part.
3. *Histograms.* Bucket counts of the raw and of the target collection, summed
   within the tasks first: at most ``buckets`` rows of each are shuffled.
4. *Gain* of a bucket: the logarithm of its smoothed share in the target over
   that in the raw collection. A document's weight is the sum over its features.
5. *Draw.* The weight plus Gumbel noise from a hash of the id; the highest scores
   are a sample without replacement in proportion to the weights. Ranks come
   from a sort by ranges, whose sizes are summed up: no task sees all scores.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Workspace
from .words import LOWER, slices

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MAX_RUN = 3
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 5
SEED = 42
GAIN_UNIT = 1000
ASCII_LOWER = LOWER.tobytes()


def word_splitter(pattern: str = WORD):
    """The pre-tokenizer: a Regex Split that keeps the matches and is never trained."""
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(pattern), behavior="removed", invert=True)


def words_with_offsets(splitter, text: bytes) -> list[tuple[str, tuple[int, int]]]:
    """Words of a UTF-8 text with A-Z lower-cased and where each stands in it, in characters."""
    return splitter.pre_tokenize_str(text.translate(ASCII_LOWER).decode())


def feature_buckets(words: list[str], max_run: int = MAX_RUN, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of every run of 1 to ``max_run`` consecutive words, in one pass over their joined bytes."""
    encoded = [w.encode() for w in words]
    line = b" ".join(encoded)
    ends = np.cumsum([len(w) + 1 for w in encoded]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()] if encoded else []
    ends = ends.tolist()
    crc = zlib.crc32
    codes = [crc(line[a:z]) for size in range(1, max_run + 1) for a, z in zip(starts, ends[size - 1 :])]
    return np.array(codes, dtype=np.int64) % buckets


def _feature_rows(max_run: int, buckets: int):
    """``mapInArrow``: number of words and the feature buckets of each text."""

    def run(batches):
        splitter = word_splitter()
        for batch in batches:
            for piece in slices(batch, "text"):
                n_words, codes = [], []
                for text in piece.column("text").cast(pa.large_binary()).to_pylist():
                    words = [w for w, _ in words_with_offsets(splitter, text or b"")]
                    n_words.append(len(words))
                    codes.append(feature_buckets(words, max_run, buckets))
                ends = np.cumsum([0, *map(len, codes)]).astype(np.int32)
                flat = np.concatenate(codes).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(n_words, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(flat))],
                    names=["doc_id", "n_words", "codes"],
                )

    return run


def features(docs: DataFrame, max_run: int = MAX_RUN, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, codes): the feature buckets of each text of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_feature_rows(max_run, buckets), "doc_id bigint, n_words bigint, codes array<int>")


def histogram(featured: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Feature counts by bucket over all documents: ``buckets`` numbers reach the driver."""
    table = featured.select(F.explode("codes").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")).toArrow()
    out = np.zeros(buckets, dtype=np.int64)
    out[table["bucket"].to_numpy()] = table["n"].to_numpy()
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 ln(share in target / share in raw))`` of every bucket, each count smoothed by one."""
    size, s_all, t_all = len(raw), int(raw.sum()), int(target.sum())
    gains = [
        math.floor(GAIN_UNIT * math.log(((t + 1) * (s_all + size)) / ((s + 1) * (t_all + size))))
        for s, t in zip(raw.tolist(), target.tolist())
    ]
    return np.array(gains, dtype=np.int64)


def _weights(gains: np.ndarray):
    """``mapInArrow``: number of features and the summed gain of each document."""

    def run(batches):
        for batch in batches:
            codes = batch.column("codes")
            offsets = codes.offsets.to_numpy()
            sums = np.concatenate([[0], np.cumsum(gains[codes.flatten().to_numpy()])])
            weight = sums[offsets[1:] - offsets[0]] - sums[offsets[:-1] - offsets[0]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(weight)],
                names=["doc_id", "n_words", "n_features", "weight"],
            )

    return run


def gumbel_noise(doc_id, seed: int = SEED):
    """``floor(-1000 ln(-ln(u)))`` with u in (0, 1) from the first 32 bits of the SHA-256 of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256)
    head = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((head + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    max_run: int = MAX_RUN,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """Draw ``percent`` of the documents of ``min_words`` words or more, in proportion to their likeness to ``target``.

    ``docs`` has doc_id and text, ``target`` has text; further columns are left
    out. Returns a row for each row of ``docs``: doc_id, n_words, n_features,
    weight, score and rank (1 for the best; null if not drawn). Ties go to the
    smaller doc_id, then to more features; rows that repeat a doc_id are
    documents of their own that share their noise.

    A null or empty text has no words, no features and weight 0; it counts
    nowhere. A row without doc_id has no score and is never drawn, but its
    features are part of the raw collection. An empty target leaves only the
    raw shares to decide.
    """
    work = Workspace(docs.sparkSession, "resample")
    featured = work.write(features(docs, max_run, buckets), "features")
    aims = features(target.select(F.lit(None).alias("doc_id"), "text"), max_run, buckets)
    gains = bucket_gains(histogram(featured, buckets), histogram(aims, buckets))
    weighed = featured.mapInArrow(_weights(gains), "doc_id bigint, n_words bigint, n_features bigint, weight bigint")
    scored = weighed.withColumn("score", F.col("weight") + gumbel_noise(F.col("doc_id"), seed))
    scored = scored.withColumn("eligible", (F.col("n_words") >= min_words) & F.col("score").isNotNull())
    # Written, as a sort by ranges reads its input twice.
    scored = work.write(scored, "scored")
    work.drop("features")
    order = [F.col("eligible").desc(), F.col("score").desc(), F.col("doc_id"), F.col("n_features").desc()]
    placed = scored.repartitionByRange(*order).sortWithinPartitions(*order)
    # The identifier holds the partition above bit 33 and the place within it below.
    placed = work.write(placed.withColumn("at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("at", 33).alias("part")
    sizes = placed.groupBy(part).agg(F.count_if("eligible").alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # One row per partition of the sort.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = placed.withColumn("part", part).join(F.broadcast(sizes), "part")
    rank = F.col("before") + F.col("at") - F.shiftleft(F.col("part"), 33) + 1
    drawn = F.col("eligible") & (rank <= percent * total // 100)
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", F.when(drawn, rank).alias("rank"))
