"""Top-k cosine similarity of a batch of query tickets against a whole corpus.

Every corpus row is scored against every query, as the result demands, in one
pass over the corpus, and no pair of rows is ever shuffled. The query vectors
are written to the shared folder; each task reads them there block by block for
every chunk of its corpus rows and keeps its own k best per query. Only those
are exchanged (tasks x queries x k rows), best of groups of tasks first. The
driver holds no vector, whatever the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.sidetables import read_side, write_side
from ..functions.vectors import NUM_FEATURES, long_form

RESULT_SCHEMA = "id bigint, that_id bigint, similarity double"
# Queries that a task reads at once.
BLOCK_QUERIES = 256
# Corpus rows, and terms of theirs, scored against all blocks before the next ones are taken: rows differ much in length.
CHUNK_ROWS = 16_384
CHUNK_TERMS = 1 << 20
# Groups of tasks whose candidates are merged first.
TASK_GROUPS = 64
EMPTY = -1.0  # stands for "no score" (a vector without terms) and sorts last


def idf_table(vectors: DataFrame, n_docs: int, min_doc_freq: int = 0) -> DataFrame:
    """Document frequency and ``ln((N + 1) / (df + 1))`` per bucket, 0 below the minimum."""
    found = long_form(vectors).groupBy("bucket").agg(F.count("*").alias("doc_freq"))
    return found.select("bucket", "doc_freq", idf_column(F.lit(n_docs), F.col("doc_freq"), min_doc_freq))


def idf_column(n_docs, doc_freq, min_doc_freq: int = 0):
    value = F.log((n_docs + F.lit(1.0)) / (doc_freq + F.lit(1.0)))
    return F.when(doc_freq >= min_doc_freq, value).otherwise(0.0).alias("idf")


def bucket_scale(idf: DataFrame, num_features: int = NUM_FEATURES) -> np.ndarray:
    """The idf table as a vector: at most ``num_features`` rows reach the driver."""
    table = idf.select("bucket", "idf").toArrow()
    scale = np.zeros(num_features)
    scale[table["bucket"].to_numpy()] = table["idf"].to_numpy()
    return scale


class _Block:
    """Some queries as sparse vectors."""

    def __init__(self, batch: pa.RecordBatch, scale: np.ndarray | None):
        self.ids = batch.column("id").to_numpy(zero_copy_only=False)
        self.offsets, self.buckets, self.weights = kernels.csr_parts(batch.column("terms"))
        if scale is not None:
            self.weights = self.weights * scale[self.buckets]
        self.norm = np.sqrt(kernels.row_sums(self.offsets, self.weights**2))

    def dense(self, num_features: int):
        """Each query's id, norm and dense vector, one after the other in the same memory."""
        column = np.zeros(num_features)
        for i, query in enumerate(self.ids.tolist()):
            own = slice(self.offsets[i], self.offsets[i + 1])
            column[self.buckets[own]] = self.weights[own]
            yield query, self.norm[i], column
            column[self.buckets[own]] = 0


def chunks(batches, rows: int, terms: int | None = None):
    """The batches' rows in parts of at most ``rows`` rows and ``terms`` terms, one row at least: short batches joined, long ones cut."""
    terms = CHUNK_TERMS if terms is None else terms
    held, count, size = [], 0, 0
    for batch in batches:
        offsets = batch.column("terms").offsets.to_numpy().astype(np.int64)
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + terms - size, side="right")) - 1
            to = min(max(to, at if held else at + 1), at + rows - count, batch.num_rows)
            if to > at:
                held.append(batch.slice(at, to - at))
                count, size = count + to - at, size + int(offsets[to] - offsets[at])
                at = to
            if at < batch.num_rows or count >= rows or size >= terms:
                yield pa.Table.from_batches(held).combine_chunks()
                held, count, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _scorer(path: str, queries: int, block_queries: int, chunk_rows: int, k: int, exclude_self: bool, scale, num_features: int):
    """A ``mapInArrow`` function giving the k best corpus rows of this task for every query stored at ``path``."""

    def blocks():
        for batch in read_side(path, ["id", "terms"], block_queries):
            yield _Block(batch, scale)

    def score(batches):
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        nothing = (np.empty(0), np.empty(0, dtype=np.int64))
        single = list(blocks()) if queries <= block_queries else None
        for chunk in chunks(batches, chunk_rows):
            ids = chunk["id"].to_numpy()
            terms = chunk["terms"].combine_chunks()
            rows, cols, weights = kernels.csr_parts(terms.chunk(0) if isinstance(terms, pa.ChunkedArray) else terms)
            if scale is not None:
                weights = weights * scale[cols]
            norm = np.sqrt(kernels.row_sums(rows, weights**2))
            for block in single or blocks():
                # Query by query, so that a task holds no more than the chunk's terms and one score a row.
                for query, length, column in block.dense(num_features):
                    dots = kernels.dot_rows(rows, cols, weights, column[None, :])[0]
                    lengths = length * norm
                    similar = np.full(dots.shape, EMPTY)
                    np.divide(dots, lengths, out=similar, where=lengths > 0)
                    values = np.where(similar < 0, EMPTY, kernels.round6(similar))
                    keep = ids != query if exclude_self else slice(None)
                    before = best.get(query, nothing)
                    values = np.concatenate([before[0], values[keep]])
                    names = np.concatenate([before[1], ids[keep]])
                    if len(values) > k:
                        near = np.flatnonzero(values >= np.partition(values, -k)[-k])
                        values, names = values[near], names[near]
                    order = np.lexsort((names, -values))[:k]
                    best[query] = (values[order], names[order])
        for query, (values, names) in best.items():
            if len(values):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(names), query)), pa.array(names), pa.array(values, mask=values == EMPTY)],
                    names=["id", "that_id", "similarity"],
                )

    return score


def store_queries(queries: DataFrame) -> tuple[str, int]:
    """Write the query vectors for the tasks to read; the path and their number."""
    path = write_side(queries.select("id", "terms"), "queries")
    stored = queries.sparkSession.read.parquet(path)
    total, ids = stored.agg(F.count("*"), F.count_distinct("id")).first()
    if total != ids:
        raise ValueError("query ids must be unique and not null")
    return path, total


def top_similar(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 11,
    exclude_self: bool = False,
    idf: DataFrame | None = None,
    num_features: int = NUM_FEATURES,
    block_queries: int = BLOCK_QUERIES,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """The ``k`` most similar corpus rows of each query: (id, that_id, similarity).

    Both inputs hold ``id`` and ``terms``. Scores are rounded to six places and
    ties go to the smaller ``that_id``; rows sharing no bucket score 0, and a
    vector without terms has a null score, last in order. The query itself is
    part of the result when it is in the corpus, unless ``exclude_self``.
    Give ``idf`` (bucket, idf) to weight both sides by it. The queries are
    written at once; the pass over the corpus is lazy for any number of them.
    """
    scale = None if idf is None else bucket_scale(idf, num_features)
    path, count = store_queries(queries)
    scorer = _scorer(path, count, block_queries, chunk_rows, k, exclude_self, scale, num_features)
    return overall_best(corpus.select("id", "terms").mapInArrow(scorer, RESULT_SCHEMA), k)


def overall_best(candidates: DataFrame, k: int) -> DataFrame:
    """The k best of what the tasks kept for each query: within groups of tasks, then overall."""
    for keys in (["id", "_group"], ["id"]):
        if "_group" in keys:
            candidates = candidates.withColumn("_group", F.spark_partition_id() % TASK_GROUPS)
        order = Window.partitionBy(*keys).orderBy(F.col("similarity").desc_nulls_last(), F.col("that_id"))
        candidates = candidates.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k)
    return candidates.drop("_rank", "_group")
