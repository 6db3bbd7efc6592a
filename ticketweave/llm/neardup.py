"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

1. *Sets.* A document is the set of its word shingles, as 64-bit hashes.
   Documents of equal sets form a class (128-bit digest of the set); only its
   smallest id goes on.
2. *Sketch.* ``COORDINATES`` bins. Round i hashes every element to one bin and a
   value; a bin keeps the smallest value of the first round that reached it.
   After that many rounds, a second series visits the bins one by one, so every
   coordinate fills whatever the size of the set. Coordinates of two sets agree
   with probability equal to their Jaccard similarity.
3. *Bands* of ``BAND_ROWS`` coordinates. A pair of similarity 0.8 misses all 73
   bands with probability 3e-8, a more similar one with less.
4. *Verification* on full sets, until each bucket is settled. Every member is
   first compared with one hub, the smallest id among its buckets' smallest
   ids; then with the other hubs, unless the links so far show both together.
   A bucket whose members all are in one component needs no more. In one that
   is not, the strays, its members outside the largest component, are compared
   with all members of other components: as pairs where they are few, otherwise
   in blocks inside the tasks, so that only links come out. A block leaves out
   the pairs that an earlier bucket compares, so a pair is compared once.
   So a group of near copies costs one comparison each and no link is dropped.
5. *Components* of the verified links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Workspace
from . import words as W
from .components import components

SHINGLE = 5
# Links need PERCENT / 100 of the union in common.
PERCENT = 80
COORDINATES = 512
BAND_ROWS = 7
# Strays of a bucket, members outside its largest component, up to which they are paired with
# its other members; more are compared inside tasks, block by block.
FEW_STRAYS = 8
# Shingles of a block, about 8 bytes each.
BLOCK_TOKENS = 500_000
GOLDEN = 0x9E3779B97F4A7C15
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)

SETS = "doc_id bigint, n bigint, d1 bigint, d2 bigint"


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and their offsets.

    A text of fewer words than ``size`` has its whole sequence as one shingle.
    """
    found = W.split_words(texts, lower=True)
    hashes = W.word_hashes(found)
    at = W.window_starts(found.rows, size)
    count = np.diff(found.rows)
    short = np.flatnonzero((count > 0) & (count < size))
    start = np.concatenate([at, found.rows[short]])
    end = np.concatenate([at + size, found.rows[short + 1]])
    row = np.concatenate([found.row_of()[at], short])
    grams = W.range_hashes(hashes, start, end, W.WORD_BASE)
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    grams, row = grams[new], row[new]
    return grams, np.searchsorted(row, np.arange(len(texts) + 1))


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def set_digests(grams: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of each set."""
    return row_sums(W.mix(grams), offsets), row_sums(W.mix(grams ^ np.uint64(GOLDEN)), offsets)


def _round_seed(seed: int, turn: int) -> np.uint64:
    return np.uint64(((seed * 0x2545F491 + turn + 1) * GOLDEN) & int(FULL))


def sketches(grams: np.ndarray, offsets: np.ndarray, bins: int = COORDINATES, seed: int = 0) -> np.ndarray:
    """Fast similarity sketch of every set: one row of ``bins`` values each (FULL for an empty set)."""
    sizes = np.diff(offsets)
    out = np.full((len(sizes), bins), FULL, dtype=np.uint64)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    values = grams
    for turn in range(bins):
        if not len(values):
            break
        hashed = W.mix(values ^ _round_seed(seed, turn))
        cell = owner * bins + (hashed % np.uint64(bins)).astype(np.int64)
        free = flat[cell] == FULL
        np.minimum.at(flat, cell[free], hashed[free] // np.uint64(bins))
        active = (out == FULL).any(axis=1)[owner]
        if not active.all():
            values, owner = values[active], owner[active]
    # What the random placements left empty is visited bin by bin.
    row, place = np.nonzero((out == FULL) & (sizes > 0)[:, None])
    for r, b in zip(row, place):
        own = grams[offsets[r] : offsets[r + 1]]
        out[r, b] = (W.mix(own ^ _round_seed(seed, bins + int(b))) // np.uint64(bins)).min()
    return out


def band_keys(sketch: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """One 64-bit key per band: the hash of its coordinates and its number."""
    bands = sketch.shape[1] // rows
    parts = sketch[:, : bands * rows].reshape(len(sketch), bands, rows)
    keys = np.zeros(parts.shape[:2], dtype=np.uint64)
    for c in range(rows):
        keys = W.mix(keys ^ parts[:, :, c]) + np.uint64(GOLDEN)
    return W.mix(keys + np.arange(bands, dtype=np.uint64)[None, :])


def _set_rows(size: int, banded: bool, seed: int = 0):
    """``mapInArrow``: size and digests of each set and, if ``banded``, its band keys."""

    def run(batches):
        for batch in batches:
            for piece in W.slices(batch, "text"):
                grams, offsets = shingle_sets(piece.column("text"), size)
                sizes = np.diff(offsets)
                one, two = set_digests(grams, offsets)
                arrays = [piece.column("doc_id"), pa.array(sizes), W.as_long(one), W.as_long(two)]
                names = ["doc_id", "n", "d1", "d2"]
                if banded:
                    keys = band_keys(sketches(grams, offsets, seed=seed))
                    held = np.where(sizes > 0, keys.shape[1], 0)
                    ends = np.concatenate([[0], np.cumsum(held)]).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(ends, W.as_long(keys[sizes > 0].reshape(-1))))
                    names.append("bands")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _full_sets(size: int):
    """``mapInArrow``: the sorted shingle hashes of each set as bytes."""

    def run(batches):
        for batch in batches:
            for piece in W.slices(batch, "text"):
                grams, offsets = shingle_sets(piece.column("text"), size)
                sets = [grams[a:z].tobytes() for a, z in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(np.diff(offsets)), pa.array(sets, pa.binary())],
                    names=["id", "n", "shingles"],
                )

    return run


def _verify(percent: int):
    """``mapInArrow``: keep the pairs whose full sets are similar enough."""

    def run(batches):
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("sa"), batch.column("sb")):
                a = np.frombuffer(left.as_buffer(), dtype=np.uint64)
                b = np.frombuffer(right.as_buffer(), dtype=np.uint64)
                both = np.concatenate([a, b])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            part = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            if part.num_rows:
                yield part

    return run


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions starts[i], ..., starts[i] + counts[i] - 1 of all i, in turn."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


class _Postings:
    """Values of several rows, sorted, each with its row."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray):
        owner = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(values, kind="stable")
        self.values, self.owner, self.rows = values[order], owner[order], len(sizes)

    def bounds(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = np.searchsorted(self.values, wanted)
        return start, np.searchsorted(self.values, wanted, side="right") - start

    def counts(self, start: np.ndarray, number: np.ndarray) -> np.ndarray:
        """How many of the wanted values each row holds."""
        return np.bincount(self.owner[_spread(start, number)], minlength=self.rows)


def _held(tokens: np.ndarray, offsets: np.ndarray, rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """How many of the wanted tokens (sorted) each of the listed rows holds."""
    counts = offsets[rows + 1] - offsets[rows]
    own = tokens[_spread(offsets[rows], counts)]
    place = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
    return row_sums((wanted[place] == own).astype(np.uint64), np.concatenate([[0], np.cumsum(counts)])).astype(np.int64)


def _block_links(percent: int):
    """``applyInArrow``: links between the strays of one block and the members of another."""

    def run(members: pa.Table, strays: pa.Table) -> pa.Table:
        links: list[tuple[int, int]] = []
        if members.num_rows and strays.num_rows:
            bucket = members["bucket"][0].as_py()
            tokens = np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in members["shingles"]])
            ids, of, sizes, main = (members[c].to_numpy() for c in ("id", "c", "n", "main"))
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            lists = members["buckets"].combine_chunks()
            shared = _Postings(lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()))
            postings = _Postings(tokens, sizes)
            for stray, own, n, shingles, buckets in zip(*(strays[c] for c in ("id", "c", "n", "shingles", "buckets"))):
                stray, n = stray.as_py(), n.as_py()
                near = 100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n)
                # Two strays meet twice, one pair may meet in several buckets: compare it once.
                wanted = near & (of != own.as_py()) & ((of == main) | (ids < stray))
                before = buckets.values.to_numpy()
                wanted &= shared.counts(*shared.bounds(before[before < bucket])) == 0
                rows = np.flatnonzero(wanted)
                if not len(rows):
                    continue
                mine = np.frombuffer(shingles.as_buffer(), dtype=np.uint64)
                start, number = postings.bounds(mine)
                if number.sum() <= (sizes[rows]).sum():
                    common = postings.counts(start, number)[rows]
                else:
                    common = _held(tokens, offsets, rows, mine)
                similar = rows[100 * common >= percent * (sizes[rows] + n - common)]
                links += [(stray, int(i)) for i in ids[similar]]
        columns = list(zip(*links)) if links else [(), ()]
        return pa.table({"a": pa.array(columns[0], pa.int64()), "b": pa.array(columns[1], pa.int64())})

    return run


def _joined(df: DataFrame, of: DataFrame, column: str, name: str) -> DataFrame:
    """Add the component, or label, of the id in ``column``; an id without one stands for itself."""
    of = of.select(F.col("id").alias(column), F.col("component").alias(name))
    return df.join(of, column, "left").withColumn(name, F.coalesce(name, column))


class _Matcher:
    """Verified links between classes, found bucket by bucket."""

    def __init__(self, docs: DataFrame, work: Workspace, size: int, percent: int):
        self.docs, self.work = docs, work
        self.size, self.percent = size, percent

    def verify(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) whose full sets are similar enough."""
        sets = self.sets
        pairs = pairs.join(sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa")), "a")
        pairs = pairs.join(sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb")), "b")
        # Sets whose sizes are too far apart cannot be similar enough.
        pairs = pairs.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * self.percent)
        return self.work.write(pairs.select("a", "b", "sa", "sb").mapInArrow(_verify(self.percent), "a bigint, b bigint"), name)

    def components(self, members: DataFrame) -> DataFrame:
        """(id, component) of the ids that the members (bucket, id) of the buckets link to a smaller one."""
        work = self.work
        ends = members.groupBy("bucket").agg(F.min("id").alias("hub"), F.max("id").alias("last"))
        ends = work.write(ends.filter("hub < last").select("bucket", "hub"), "hubs")
        members = work.write(members.join(ends, "bucket"), "members")
        held = members.select(F.col("id").alias("doc_id")).distinct()
        own = self.docs.join(held, "doc_id", "left_semi")
        self.sets = work.write(own.mapInArrow(_full_sets(self.size), "id bigint, n bigint, shingles binary"), "sets")

        pairs = members.filter("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b"))
        nearest = pairs.groupBy("a").agg(F.min("b").alias("b"))
        first = self.verify(nearest, "first")
        # Each id leads to one hub, that possibly to another.
        label = first.select(F.col("a").alias("id"), F.col("b").alias("component"))
        label = _joined(label.withColumnRenamed("component", "hub"), label, "hub", "component").select("id", "component")
        others = pairs.distinct().join(nearest.withColumnRenamed("b", "nearest"), "a").filter("b <> nearest")
        others = _joined(_joined(others, label, "a", "ca"), label, "b", "cb").filter("ca <> cb")
        second = self.verify(others.select("a", "b"), "second")
        of = components(first.unionAll(second), work, "of-hubs")

        placed = self._unsettled(members.select("bucket", "id"), of)
        work.drop("hubs", "members", "first", "second")
        few = placed.filter(F.col("rest") <= FEW_STRAYS)
        columns = ("id", "c", "lo", "hi")
        met = few.filter("c <> main").select("bucket", *[F.col(x).alias(f"{x}_a") for x in columns]).join(
            few.select("bucket", "main", *[F.col(x).alias(f"{x}_b") for x in columns]), "bucket"
        )
        close = F.least("hi_a", "hi_b") * 100 >= F.greatest("lo_a", "lo_b") * self.percent
        met = met.filter("c_a <> c_b AND (c_b = main OR id_a > id_b)").filter(close)
        met = met.select(F.greatest("id_a", "id_b").alias("a"), F.least("id_a", "id_b").alias("b")).distinct()
        links = self.verify(met, "pairs").unionAll(self._within(placed.filter(F.col("rest") > FEW_STRAYS)))
        if links.limit(1).count():
            of = components(links.unionAll(of.select(F.col("id").alias("a"), F.col("component").alias("b"))), work, "of-all")
        work.drop("sets", "mixed", "unsettled", "pairs", "within")
        return of

    def _unsettled(self, placed: DataFrame, of: DataFrame) -> DataFrame:
        """Members of buckets that hold several components.

        With c, the own component; main, that with most members of the bucket;
        rest, the members outside it; tokens, the size of all sets; lo and hi,
        the own set's size.
        """
        sizes = self.sets.groupBy("id").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
        placed = _joined(placed, of, "id", "c").join(sizes, "id")
        shares = placed.groupBy("bucket", "c").agg(F.count("*").alias("n"), F.sum("hi").alias("tokens"))
        mixed = shares.groupBy("bucket").agg(
            F.max_by("c", F.struct("n", "c")).alias("main"), F.max("n").alias("top"), F.sum("n").alias("size"), F.sum("tokens").alias("tokens")
        )
        mixed = mixed.filter("size > top").select("bucket", "main", F.expr("size - top AS rest"), "tokens")
        mixed = self.work.write(mixed, "mixed")
        return self.work.write(placed.join(mixed, "bucket"), "unsettled")

    def _within(self, placed: DataFrame) -> DataFrame:
        """Links between strays and all other members of their bucket, compared inside tasks.

        Both sides are cut into blocks of bounded size, every block of one meeting every block of the other.
        """
        sets = self.sets.select("id", "n", "shingles")
        blocks = lambda: F.ceil(F.col("tokens") / BLOCK_TOKENS).cast("int")
        own = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), blocks()).cast("int")
        other = lambda: F.explode(F.sequence(F.lit(0), blocks() - 1))
        held = placed.groupBy("id").agg(F.collect_set("bucket").alias("buckets"))
        full = placed.select("bucket", "id", "c", "main", "tokens").distinct().join(held, "id").join(sets, "id")
        full = self.work.write(full, "full")
        columns = ("id", "c", "main", "n", "shingles", "buckets")
        left = full.select("bucket", own(0).alias("x"), other().alias("y"), *columns)
        right = full.filter("c <> main").select("bucket", other().alias("x"), own(1).alias("y"), *columns)
        keys = ("bucket", "x", "y")
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_block_links(self.percent), "a bigint, b bigint")
        found = self.work.write(found.distinct(), "within")
        self.work.drop("full")
        return found


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Groups of documents linked by shared shingles: a row for each row of ``docs`` (doc_id, text).

    Two documents are linked when ``100 * |A and B| >= percent * |A or B|`` of
    their sets of ``shingle``-word shingles, A-Z in lower case. Returns doc_id,
    n_shingles (size of the set), component_id (smallest doc_id reachable over
    links, itself included) and kept (doc_id = component_id).

    A null or empty text has an empty set and is linked with nothing. Rows that
    repeat a doc_id are one node of the graph. A null doc_id is linked with
    nothing, has a null component_id and is kept. Other columns are not used.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    work = Workspace(docs.sparkSession, "neardup")
    sets = work.write(docs.mapInArrow(_set_rows(shingle, True), f"{SETS}, bands array<bigint>"), "sketches")
    named = sets.filter("n > 0 AND doc_id IS NOT NULL")
    classes = work.write(named.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")), "classes")
    # Classes of one document keep it; only copies need the join.
    copies = named.select("doc_id", "d1", "d2").join(classes.filter("rep < last"), ["d1", "d2"])
    moved = work.write(copies.filter("doc_id <> rep").distinct(), "moved")
    alone = named.join(moved, ["doc_id", "d1", "d2"], "left_anti")
    bands = alone.select(F.col("doc_id").alias("id"), F.explode("bands").alias("bucket"))
    of = _Matcher(docs, work, shingle, percent).components(bands)
    held = alone.select("doc_id").join(moved.select("doc_id"), "doc_id", "left_semi").distinct()
    if moved.select("doc_id").unionAll(held).groupBy("doc_id").count().filter("count > 1").limit(1).count():
        # Rows that repeat a doc_id with other texts tie several classes together.
        edges = of.select(F.col("id").alias("a"), F.col("component").alias("b"))
        of = components(edges.unionAll(moved.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))), work, "of-copies")
    else:
        # A copy is in the component of its class.
        copies = _joined(moved.select(F.col("doc_id").alias("id"), "rep"), of, "rep", "component")
        of = of.unionAll(copies.select("id", "component"))
    linked = of.select(F.col("id").alias("doc_id"), F.col("component").alias("component_id"))
    found = sets.select("doc_id", F.col("n").alias("n_shingles")).join(linked, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return found.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each group of near copies, that of the smallest doc_id, with all columns.

    Of rows that repeat a kept doc_id one stays. Rows with a null doc_id all stay.
    """
    found = near_duplicates(docs, shingle, percent)
    kept = docs.join(found.filter("NOT kept").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
    repeated = found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1")
    if not repeated.limit(1).count():
        return kept
    return kept.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionAll(kept.filter("doc_id IS NULL"))
