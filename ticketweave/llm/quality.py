"""Quality of texts: random-indexing word vectors, pooled, into a small calibrated network.

Two vocabularies of hashed tokens describe a text: its words as they stand, and
their shapes (runs of upper case, lower case, digits, each other sign). Every
token has a fixed sparse random index vector; its context vector is the sum of
the index vectors of its neighbours over all documents, counted in one pass. A
document is the mean of its words' and shapes' unit vectors, with how far the
words spread around that mean, how alike neighbours are, and the length. A
network of two layers, trained in numpy on labelled documents, scores it, and a
temperature fitted on a part kept apart calibrates the probability.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Workspace
from . import words as W

DIMENSIONS = 32
NONZERO = 4
WORD_BUCKETS = 1 << 14
SHAPE_BUCKETS = 1 << 12
CONTEXT = 2
# Labelled documents used for training: at most so many, those of the smallest hash.
MAX_LABELED = 20_000
HIDDEN = 32
EPOCHS = 60
THRESHOLD = 0.3

# Byte classes of shapes; parts of multi-byte characters count as lower-case letters.
CLASSES = np.arange(256, dtype=np.uint8)
CLASSES[ord("A") : ord("Z") + 1] = ord("A")
CLASSES[ord("a") : ord("z") + 1] = ord("a")
CLASSES[ord("0") : ord("9") + 1] = ord("0")
CLASSES[128:] = ord("a")


def shape_hashes(words: W.Words) -> np.ndarray:
    """Hash of each word's shape: its byte classes with runs of one class made one."""
    classes = CLASSES[words.data]
    opens = np.ones(len(classes), dtype=bool)
    opens[1:] = classes[1:] != classes[:-1]
    opens[words.start] = True
    place = np.concatenate([[0], np.cumsum(opens)])
    return W.range_hashes(classes[opens], place[words.start], place[words.end], W.BYTE_BASE)


def token_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word buckets, shape buckets, offsets of the texts)."""
    found = W.split_words(texts)
    surface = (W.word_hashes(found) % np.uint64(WORD_BUCKETS)).astype(np.int64)
    shape = (shape_hashes(found) % np.uint64(SHAPE_BUCKETS)).astype(np.int64)
    return surface, shape, found.rows


def index_vectors(buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Dimensions and signs of the nonzero entries of each bucket's index vector."""
    cells = np.arange(buckets * NONZERO, dtype=np.uint64).reshape(buckets, NONZERO)
    drawn = W.mix(cells + np.uint64(12345))
    return (drawn % np.uint64(DIMENSIONS)).astype(np.int64), np.where(drawn >> np.uint64(63), 1, -1)


def _contexts(buckets: np.ndarray, rows: np.ndarray, size: int, index) -> np.ndarray:
    """Sums of the index vectors of the neighbours of each bucket's tokens: size x DIMENSIONS."""
    dims, signs = index
    total = np.zeros(size * DIMENSIONS)
    owner = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    for step in range(1, CONTEXT + 1):
        near = np.flatnonzero(owner[step:] == owner[:-step]) if len(owner) > step else np.zeros(0, np.int64)
        for a, b in ((near, near + step), (near + step, near)):
            cell = buckets[a][:, None] * DIMENSIONS + dims[buckets[b]]
            total += np.bincount(cell.ravel(), signs[buckets[b]].ravel(), minlength=len(total))
    return total.reshape(size, DIMENSIONS)


COLUMNS = [f"d{i}" for i in range(DIMENSIONS)]


def _context_rows():
    """``mapInArrow``: this task's context sums, one row per bucket it has seen."""

    def run(batches):
        word_index, shape_index = index_vectors(WORD_BUCKETS), index_vectors(SHAPE_BUCKETS)
        total = np.zeros((WORD_BUCKETS + SHAPE_BUCKETS, DIMENSIONS))
        for batch in batches:
            for piece in W.slices(batch, "text"):
                surface, shape, rows = token_buckets(piece.column("text"))
                total[:WORD_BUCKETS] += _contexts(surface, rows, WORD_BUCKETS, word_index)
                total[WORD_BUCKETS:] += _contexts(shape, rows, SHAPE_BUCKETS, shape_index)
        seen = np.flatnonzero(total.any(axis=1))
        arrays = [pa.array(seen.astype(np.int32)), *[pa.array(total[seen, i].astype(np.int64)) for i in range(DIMENSIONS)]]
        yield pa.RecordBatch.from_arrays(arrays, names=["bucket", *COLUMNS])

    return run


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit context vectors of all buckets, counted over every document: a table of fixed size."""
    schema = "bucket int, " + ", ".join(f"{c} bigint" for c in COLUMNS)
    sums = docs.select("text").mapInArrow(_context_rows(), schema).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in COLUMNS])
    found = sums.toArrow()
    vectors = np.zeros((WORD_BUCKETS + SHAPE_BUCKETS, DIMENSIONS), dtype=np.float32)
    values = np.column_stack([found[c].to_numpy() for c in COLUMNS]).astype(np.float64)
    length = np.linalg.norm(values, axis=1, keepdims=True)
    vectors[found["bucket"].to_numpy()] = np.divide(values, length, out=np.zeros_like(values), where=length > 0)
    return vectors


def _pool(vectors: np.ndarray, buckets: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Per text: mean vector, its squared length and the mean product of neighbours."""
    count = np.diff(rows)
    own = vectors[buckets]
    sums = np.zeros((len(buckets) + 1, own.shape[1]))
    np.cumsum(own, axis=0, out=sums[1:])
    mean = (sums[rows[1:]] - sums[rows[:-1]]) / np.maximum(count, 1)[:, None]
    near = np.zeros(len(buckets) + 1)
    if len(buckets) > 1:
        # The product with the word before; the first word of a text is left out by its bounds.
        near[2:] = np.cumsum(np.einsum("ij,ij->i", own[1:], own[:-1], dtype=np.float64))
    first = np.minimum(rows[:-1] + 1, rows[1:])
    alike = (near[rows[1:]] - near[first]) / np.maximum(count - 1, 1)
    return np.column_stack([mean, (mean**2).sum(axis=1), alike])


def text_features(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    surface, shape, rows = token_buckets(texts)
    length = np.log1p(np.diff(rows))[:, None]
    return np.hstack([_pool(vectors[:WORD_BUCKETS], surface, rows), _pool(vectors[WORD_BUCKETS:], shape, rows), length])


def _feature_rows(vectors: np.ndarray):
    """``mapInArrow``: doc_id and pooled features."""

    def run(batches):
        for batch in batches:
            for piece in W.slices(batch, "text"):
                features = text_features(piece.column("text"), vectors).astype(np.float32)
                ends = np.arange(len(features) + 1, dtype=np.int32) * features.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.ListArray.from_arrays(ends, pa.array(features.ravel()))],
                    names=["doc_id", "features"],
                )

    return run


@dataclass
class Network:
    """Standardized features, one hidden layer, a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))

    def save(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.__dict__)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Network:
        return cls(**dict(np.load(io.BytesIO(data))))


def train(x: np.ndarray, y: np.ndarray, apart: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Fit on the rows that are not ``apart``, then the temperature on those that are.

    With no rows, or rows of one class only, the score is the smoothed share of
    class 1 for every text.
    """
    rng = np.random.default_rng(seed)
    prior = (y.sum() + 1.0) / (len(y) + 2.0)
    fit_x, fit_y = x[~apart], y[~apart].astype(np.float64)
    mean = fit_x.mean(axis=0) if len(fit_x) else np.zeros(x.shape[1])
    scale = fit_x.std(axis=0) + 1e-6 if len(fit_x) else np.ones(x.shape[1])
    shapes = [(x.shape[1], HIDDEN), (HIDDEN,), (HIDDEN,), ()]
    values = [rng.normal(0, (2 / x.shape[1]) ** 0.5, shapes[0]), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.array(np.log(prior / (1 - prior)))]
    if len(np.unique(fit_y)) < 2:
        values[2][:] = 0
        return Network(mean, scale, *values)
    z = (fit_x - mean) / scale
    first, second = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(z))
        for at in range(0, len(z), 128):
            rows = order[at : at + 128]
            raw = z[rows] @ values[0] + values[1]
            hidden = np.maximum(raw, 0)
            error = (1 / (1 + np.exp(-np.clip(hidden @ values[2] + values[3], -30, 30))) - fit_y[rows]) / len(rows)
            back = np.outer(error, values[2]) * (raw > 0)
            slopes = [z[rows].T @ back + 1e-4 * values[0], back.sum(axis=0), hidden.T @ error + 1e-4 * values[2], error.sum()]
            step += 1
            for i, g in enumerate(slopes):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                values[i] = values[i] - 0.003 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    network = Network(mean, scale, *values)
    if apart.any():
        raw, truth = network.logits(x[apart]), y[apart]
        losses = {t: np.logaddexp(0, np.where(truth == 1, -raw, raw) / t).mean() for t in np.geomspace(0.25, 8, 41)}
        network.temperature = float(min(losses, key=losses.get))
    return network


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id has fold 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(1))


WIDTH = 2 * (DIMENSIONS + 2) + 1


def _fit(docs: DataFrame, labels: DataFrame, max_labeled: int):
    """(doc_id and features of every row, broadcast word vectors, trained network)."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    work = Workspace(docs.sparkSession, "quality")
    shipped = docs.sparkSession.sparkContext.broadcast(word_vectors(docs))

    def featured(batches):
        return _feature_rows(shipped.value)(batches)

    features = work.write(docs.mapInArrow(featured, "doc_id bigint, features array<float>"), "features")
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").alias("quality"))
    known = known.filter((fold(F.col("doc_id")) != 0) & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    sample = known.join(features, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_labeled)
    sample = sample.select("features", "quality", (fold(F.col("doc_id")) == 1).alias("apart")).toArrow()
    x = sample["features"].combine_chunks().flatten().to_numpy().reshape(-1, WIDTH).astype(np.float64)
    return features, shipped, train(x, sample["quality"].to_numpy(), sample["apart"].to_numpy().astype(bool))


def keep_quality(
    docs: DataFrame, labels: DataFrame, max_labeled: int = MAX_LABELED, threshold: float = THRESHOLD
) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns.

    Learns as ``score_quality`` does. Rows are judged where they are read, so
    no text is shuffled.
    """
    _, shipped, network = _fit(docs, labels, max_labeled)

    def keep(batches):
        for batch in batches:
            for piece in W.slices(batch, "text"):
                scores = np.round(network.score(text_features(piece.column("text"), shipped.value)), 9)
                yield piece.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(keep, docs.schema)


def score_quality(
    docs: DataFrame, labels: DataFrame, max_labeled: int = MAX_LABELED, threshold: float = THRESHOLD
) -> DataFrame:
    """Score every text of ``docs`` (doc_id, text) by what ``labels`` (doc_id, quality) says of others.

    Returns a row for each row of ``docs``: doc_id, held_out (fold 0, never
    learnt from), score (0 to 1, higher for quality 1) and predicted (1 from
    the threshold on).

    Word vectors count all documents; the network learns from at most
    ``max_labeled`` labelled rows of folds 1 to 4, fold 1 serving for the
    temperature. Labels other than 0 and 1 and null ids are ignored. Null and
    empty texts have a score too, that of a text of no words. Repeated rows are
    scored alike. Other columns are not used.
    """
    features, _, network = _fit(docs, labels, max_labeled)

    def score(batches):
        for batch in batches:
            own = batch.column("features").flatten().to_numpy().reshape(-1, WIDTH)
            scores = np.round(network.score(own.astype(np.float64)), 9)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    scored = features.mapInArrow(score, "doc_id bigint, score double")
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id")) == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )
