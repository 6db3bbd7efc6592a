"""Approximate nearest neighbours by learned partitions.

1. On a bounded sample, the graph of nearest neighbours is cut into parts of
   equal size by recursive bisection that keeps neighbours together.
2. A small network learns, for a vector, how its neighbours spread over the
   parts. Every row of the index goes to its most probable part.
3. A query visits its most probable parts; how many is measured on vectors that
   neither the graph nor the network has seen, so that the wanted recall is
   reached, and rises to all parts where vectors have no structure to learn.
4. In the visited parts exact inner products rank all vectors. Neighbouring
   parts form bundles, so that a query and its best vectors travel once for all
   parts of a bundle it visits. Bundles are cut into blocks of bounded size, and
   so are the queries that visit one.

Equal vectors are ranked once, with their smallest ids: beyond k + 1 copies no
further one can be among the k nearest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Workspace

# The sample is of SAMPLE vectors, or SAMPLE_PER_PART for each part if that is more.
SAMPLE, SAMPLE_PER_PART = 8_000, 32
NEIGHBOURS = 10
# There are as many parts as a part has rows, to a power of two; beyond MAX_PARTS, which bounds what is learned
# on the driver, parts grow with the table.
MAX_PARTS = 1_024
HIDDEN = 64
# Held-out vectors on which the number of visited parts is chosen, at most a fifth of the sample, and the share
# of neighbours they must find.
TRIALS, WANTED_RECALL = 500, 0.96
# A bundle takes parts up to BUNDLE * sqrt(rows of the index) rows, at most BLOCK_ROWS: larger ones mean
# fewer partial results, smaller ones more tasks. A larger part is a bundle of its own, in several blocks.
BUNDLE, BLOCK_ROWS, BLOCK_QUERIES = 32, 65_536, 1_024
# Rows and queries multiplied at once.
STEP_ROWS, STEP_QUERIES = 4_096, 512


def nearest(rows: np.ndarray, pool: np.ndarray, k: int, skip: np.ndarray | None = None) -> np.ndarray:
    """Indices of the k largest inner products of each row, leaving out ``skip[i]`` for row i."""
    out = np.empty((len(rows), min(k, len(pool) - (skip is not None))), dtype=np.int64)
    for at in range(0, len(rows), 512):
        near = rows[at : at + 512] @ pool.T
        if skip is not None:
            near[np.arange(len(near)), skip[at : at + 512]] = -np.inf
        best = np.argpartition(-near, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
        order = np.argsort(-np.take_along_axis(near, best, axis=1), axis=1, kind="stable")
        out[at : at + 512] = np.take_along_axis(best, order, axis=1)
    return out


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 3) -> np.ndarray:
    """Cut a neighbour graph (row i lists i's neighbours) into ``parts`` (a power of two) of equal size.

    Each bisection smooths random values along the edges until neighbours agree,
    and cuts at the median.
    """
    rng = np.random.default_rng(seed)
    part = np.zeros(len(graph), dtype=np.int64)
    sources, ends = np.repeat(np.arange(len(graph)), graph.shape[1]), graph.ravel()
    done = 1
    while done < parts:
        inside = part[sources] == part[ends]
        a, b = sources[inside], ends[inside]
        degree = 1.0 + np.bincount(a, minlength=len(graph)) + np.bincount(b, minlength=len(graph))
        sizes = np.maximum(np.bincount(part, minlength=done), 1)
        value = rng.normal(size=len(graph))
        for _ in range(60):
            value -= (np.bincount(part, value, minlength=done) / sizes)[part]
            value /= np.sqrt(np.bincount(part, value**2, minlength=done) / sizes + 1e-30)[part]
            pulled = np.bincount(a, value[b], minlength=len(graph)) + np.bincount(b, value[a], minlength=len(graph))
            value = 0.3 * value + 0.7 * (value + pulled) / degree
        order = np.lexsort((np.arange(len(graph)), value, part))
        first = np.searchsorted(part[order], np.arange(done))
        rank = np.empty(len(graph), dtype=np.int64)
        rank[order] = np.arange(len(graph)) - first[part[order]]
        part = 2 * part + (rank >= (np.bincount(part, minlength=done)[part] + 1) // 2)
        done *= 2
    return part


@dataclass
class Router:
    """Network that gives the probability of each part; ``probes`` parts are visited."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def parts(self, x: np.ndarray, count: int) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, :count]


def fit_router(x: np.ndarray, parts: int, k: int, wanted: float, seed: int = 3) -> Router:
    """Learn the parts of a sample and, on vectors held out of it, how many of them a query must visit."""
    rng = np.random.default_rng(seed)
    width = x.shape[1] if x.ndim == 2 else 0
    values = [rng.normal(0, (2 / max(width, 1)) ** 0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, (HIDDEN, parts)), np.zeros(parts)]
    trials = min(TRIALS, len(x) // 5)
    if parts == 1 or not trials or len(x) - trials <= NEIGHBOURS:
        return Router(values[0], values[1], values[2][:, :1], values[3][:1])
    every = x / np.linalg.norm(x, axis=1, keepdims=True)
    shuffled = rng.permutation(len(x))
    trial, unit = shuffled[:trials], every[shuffled[trials:]]
    graph = nearest(unit, unit, NEIGHBOURS, np.arange(len(unit)))
    part = balanced_parts(graph, parts)
    spread = np.zeros((len(unit), parts))
    np.add.at(spread, (np.repeat(np.arange(len(unit)), NEIGHBOURS), part[graph].ravel()), 0.5 / NEIGHBOURS)
    spread[np.arange(len(unit)), part] += 0.5
    first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    for _ in range(20):
        order = rng.permutation(len(unit))
        for at in range(0, len(unit), 256):
            rows = order[at : at + 256]
            raw = unit[rows] @ values[0] + values[1]
            hidden = np.maximum(raw, 0)
            logits = hidden @ values[2] + values[3]
            chance = np.exp(logits - logits.max(axis=1, keepdims=True))
            error = (chance / chance.sum(axis=1, keepdims=True) - spread[rows]) / len(rows)
            back = error @ values[2].T * (raw > 0)
            step += 1
            for i, g in enumerate((unit[rows].T @ back, back.sum(axis=0), hidden.T @ error, error.sum(axis=0))):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                values[i] = values[i] - 0.005 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    router = Router(*values)
    home = router.parts(every, 1)[:, 0]
    near = home[nearest(x[trial], x, k, trial)]
    visited = router.parts(every[trial], parts)
    rank = np.empty_like(visited)
    np.put_along_axis(rank, visited, np.arange(parts)[None, :].repeat(len(trial), axis=0), axis=1)
    found = np.take_along_axis(rank, near, axis=1)
    for probes in range(1, parts + 1):
        if (found < probes).mean() >= wanted:
            break
    router.probes = probes
    return router


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def usable(embedding: Column) -> Column:
    """Neither null nor zero, and every component a finite number."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embedding.isNotNull() & finite & F.exists(embedding, lambda x: x != 0)


def _routed(df: DataFrame, router: Router, width: int, probes: int) -> DataFrame:
    """Add ``parts``: the most probable parts of each embedding."""

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("embedding"), width)
            found = router.parts(x / np.linalg.norm(x, axis=1, keepdims=True), probes).astype(np.int32)
            ends = np.arange(len(x) + 1, dtype=np.int32) * found.shape[1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(ends, pa.array(found.ravel()))], names=[*batch.schema.names, "parts"]
            )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, parts array<int>")


FOUND = "qkey bigint, score double, ids array<bigint>"


def bundles(rows: list[int], limit: int) -> tuple[list[int], list[int]]:
    """Put neighbouring parts together up to ``limit`` rows: the bundle of each part, the rows of each bundle."""
    of, held = [], []
    for n in rows:
        if held and held[-1] + n <= limit:
            held[-1] += n
        else:
            held.append(n)
        of.append(len(held) - 1)
    return of, held


def _best(query: np.ndarray, score: np.ndarray, row: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k largest scores of each query, ties to the smaller ``least``, in order."""
    order = np.lexsort((least[row], -score, query))
    query, score, row = query[order], score[order], row[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[keep], score[keep], row[keep]


def _rank(k: int, width: int):
    """``applyInArrow`` over (block of vectors, block of queries): the k best vectors of each query in its parts."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        names = np.zeros(0, np.int64)
        best = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        if rows.num_rows and asked.num_rows:
            rows = rows.sort_by("part")
            x, q = _matrix(rows["embedding"], width), _matrix(asked["embedding"], width)
            least, part, names = rows["least"].to_numpy(), rows["part"].to_numpy(), asked["qkey"].to_numpy()
            # What rounding may change in a product.
            slack = 1e-12 * np.linalg.norm(x, axis=1).max() * np.linalg.norm(q, axis=1)
            visited = _matrix(asked["parts"], len(asked["parts"][0])).astype(np.int64)
            for at in range(0, len(q), STEP_QUERIES):
                found = [tuple(v[:0] for v in best)]
                # No score below a query's k-th best so far can be among its best.
                bound = np.full(len(q[at : at + STEP_QUERIES]), -np.inf)
                for p in np.unique(part):
                    own = np.flatnonzero((visited[at : at + STEP_QUERIES] == p).any(axis=1))
                    first, last = np.searchsorted(part, (p, p + 1))
                    for a in range(first, last, STEP_ROWS) if len(own) else ():
                        block = x[a : min(a + STEP_ROWS, last)]
                        near = block @ q[at + own].T
                        if len(near) >= k:
                            bound[own] = np.maximum(bound[own], np.partition(near, -k, axis=0)[-k])
                        # All that tie with the last place, to a rounding error, take part.
                        row, col = np.nonzero(near >= bound[own] - slack[at + own])
                        asker = at + own[col]
                        found.append((asker, (block[row] * q[asker]).sum(axis=1), a + row))
                kept = _best(*(np.concatenate(v) for v in zip(*found)), least, k)
                best = tuple(np.concatenate(v) for v in zip(best, kept))
        return pa.table({
            "qkey": pa.array(names[best[0]]),
            "score": pa.array(best[1]),
            "ids": rows["ids"].combine_chunks().take(pa.array(best[2])) if rows.num_rows else pa.array([], pa.list_(pa.int64())),
        })

    return run


def search(
    vectors: DataFrame, is_query: Column, k: int = 20, wanted_recall: float = WANTED_RECALL, sample: int = SAMPLE
) -> DataFrame:
    """The k nearest rows of each query row by inner product: (query_id, rank, vec_id, score).

    ``vectors`` has vec_id and embedding; ``is_query`` picks the queries among
    its rows. Ranks count from 1, ties go to the smaller vec_id, a query's own
    id is not among its neighbours; with fewer candidates than k, those found
    are returned. Scores are double-precision inner products of the vectors as
    given.

    Vectors that are null, zero, of another length than most, or that hold null
    or non-finite components take no part, nor do rows with a null vec_id.
    Repeated rows count once. The router is fitted on at most ``sample`` distinct
    vectors, or ``SAMPLE_PER_PART`` for each of at most ``MAX_PARTS`` parts, those
    of the smallest hash; all rows are indexed. Other columns are not used.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "ann")
    chosen = F.coalesce(is_query, F.lit(False)).alias("is_query")
    given = vectors.schema["embedding"].dataType.simpleString()
    kind = given if given == "array<float>" else "array<double>"
    valid = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"), chosen)
    valid = valid.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    lengths = valid.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    width = lengths[0].width if lengths else 1
    valid = valid.filter(F.size("embedding") == width).groupBy("embedding", "vec_id").agg(F.max("is_query").alias("is_query"))
    valid = work.write(valid, "valid")
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    smallest = valid.withColumn("place", F.row_number().over(copies)).filter(F.col("place") <= k + 1)
    distinct = smallest.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    distinct = work.write(distinct.withColumn("least", F.col("ids")[0]), "distinct")
    total = distinct.count()
    parts = 1
    while parts < MAX_PARTS and parts * parts < total:
        parts *= 2
    drawn = distinct.orderBy(F.xxhash64("embedding"), "least").limit(max(sample, SAMPLE_PER_PART * parts)).select("embedding").toArrow()
    router = fit_router(_matrix(drawn["embedding"], width), parts, k, wanted_recall)

    index = _routed(distinct, router, width, 1).withColumn("part", F.col("parts")[0]).drop("parts")
    index = work.write(index, "index")
    asked = valid.filter("is_query").select("embedding").distinct().withColumn("qkey", F.xxhash64("embedding"))
    # At most MAX_PARTS numbers reach the driver: the rows of each part, then the queries of each bundle.
    sizes = {r.part: r.n for r in index.groupBy("part").agg(F.count("*").alias("n")).collect()}
    limit = max(1, min(BLOCK_ROWS, int(BUNDLE * total**0.5)))
    of, held = bundles([sizes.get(p, 0) for p in range(parts)], limit)
    listed = lambda values, at: F.element_at(F.array(*[F.lit(int(v)) for v in values]), at + 1)
    visits = _routed(asked, router, width, router.probes)
    to_bundles = F.array_distinct(F.transform("parts", lambda p: listed(of, p)))
    visits = work.write(visits.select("qkey", "embedding", "parts", F.explode(to_bundles).alias("bundle")), "visits")
    asking = {r.bundle: r.n for r in visits.groupBy("bundle").agg(F.count("*").alias("n")).collect()}
    row_blocks = listed([max(1, -(-n // BLOCK_ROWS)) for n in held], F.col("bundle"))
    query_blocks = listed([-(-asking.get(b, 0) // BLOCK_QUERIES) for b in range(len(held))], F.col("bundle"))
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = lambda key, n: F.pmod(F.xxhash64(key, F.lit(1)), n).cast("int")
    left = index.withColumn("bundle", listed(of, F.col("part"))).filter(query_blocks > 0)
    left = left.select("bundle", own("embedding", row_blocks).alias("rb"), each(query_blocks).alias("qb"), "part", "embedding", "ids", "least")
    right = visits.select("bundle", each(row_blocks).alias("rb"), own("qkey", query_blocks).alias("qb"), "qkey", "embedding", "parts")
    keys = ("bundle", "rb", "qb")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_rank(k + 1, width), FOUND)
    order = Window.partitionBy("qkey").orderBy(F.desc("score"), F.col("ids")[0])
    best = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    best = work.write(best.select("qkey", "score", "ids"), "best")
    named = valid.filter("is_query").select(F.col("vec_id").alias("query_id"), F.xxhash64("embedding").alias("qkey"))
    pairs = named.join(best, "qkey").select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
