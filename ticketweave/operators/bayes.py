"""Multinomial naive Bayes over hashed term counts, as tables.

One pass over the corpus counts everything: documents per class, and per
(class, bucket) the term count and the document frequency, each by fold. All
are whole numbers that add up, so the counts of a training set that leaves out
fold ``f`` are the sums over the other folds, and cross-validation plus the
refit on all rows need no further pass. The idf factor is constant within a
bucket, so it multiplies the summed counts afterwards.

Scoring reads each vector once, inside its task, and shuffles nothing. The model
is a table in the shared folder that the tasks read themselves: what each stored
(class, bucket) pair adds, by bucket. All pairs a class lacks add the same
to it, a constant of the class times the row's weight, so they are never stored.
Neither the driver nor the function that travels to the tasks grows with the
number of classes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels
from ..functions.sidetables import read_side, write_side
from ..functions.vectors import NUM_FEATURES
from .similarity import idf_column

MIN_DOC_FREQ = 2
SMOOTHING = 1.0
FOLDS = 3
# Key of the model trained on all rows; the models of the folds are 0, 1, ...
ALL = -1
# Pseudo-bucket under which the documents themselves are counted.
DOCUMENT = -1
# Buckets that a task reads at once, and the bytes of the model it keeps between batches; the rest is read again.
PART_BUCKETS = 1024
CACHE_BYTES = 256 << 20
# Scores, additions to them, and terms of rows that a task holds at once.
CELLS = 1 << 21
TERMS = 1 << 20
# Cells a pair may take at most for a part to be kept as a table of all classes.
DENSE = 4


def label_index(df: DataFrame, label: str) -> DataFrame:
    """Classes with their frequency and index, most frequent first, ties by name."""
    order = Window.orderBy(F.desc("n"), F.asc("label"))
    counted = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return counted.withColumn("label_index", (F.row_number().over(order) - 1).cast("double"))


def class_counts(vectors: DataFrame, label: str, fold: str | None = None) -> DataFrame:
    """(fold, label, bucket, tf, docs): summed counts and document frequencies in one pass.

    Partial aggregation leaves at most folds x classes x buckets rows per task
    to shuffle, however large a class is.
    """
    marker = F.struct(F.lit(DOCUMENT).alias("bucket"), F.lit(1).alias("tf"))
    terms = F.concat(F.array(marker), F.col("terms"))
    fold_column = F.lit(0) if fold is None else F.col(fold)
    return (
        vectors.select(fold_column.alias("fold"), F.col(label).alias("label"), F.inline_outer(terms))
        .groupBy("fold", "label", "bucket")
        .agg(F.sum("tf").alias("tf"), F.count("*").alias("docs"))
    )


def training_counts(counts: DataFrame, folds: int = 0) -> DataFrame:
    """Counts keyed by ``model``: each row serves the full model and every fold but its own."""
    if not folds:
        return counts.select(F.lit(ALL).alias("model"), "label", "bucket", "tf", "docs")
    others = F.array_except(F.array(*[F.lit(f) for f in range(folds)]), F.array(F.col("fold").cast("int")))
    served = F.concat(F.array(F.lit(ALL)), others)
    return (
        counts.select(F.explode(served).alias("model"), "label", "bucket", "tf", "docs")
        .groupBy("model", "label", "bucket")
        .agg(F.sum("tf").alias("tf"), F.sum("docs").alias("docs"))
    )


@dataclass
class NaiveBayes:
    """A fitted classifier: its counts (model, label, bucket, tf, docs) and parameters.

    The counts say everything; priors, idf and likelihoods are views of them.
    There are at most models x classes x buckets rows, whatever the corpus.
    """

    counts: DataFrame
    smoothing: float = SMOOTHING
    num_features: int = NUM_FEATURES
    min_doc_freq: int = MIN_DOC_FREQ
    # How words were taken from the training texts; tickets are treated alike.
    stopwords: tuple[str, ...] = ()
    drop_empty: bool = True

    def documents(self) -> DataFrame:
        """(model, label, n_docs)."""
        return self.counts.filter(F.col("bucket") == DOCUMENT).select("model", "label", F.col("docs").alias("n_docs"))

    def doc_freq(self) -> DataFrame:
        """(model, bucket, doc_freq)."""
        cells = self.counts.filter(F.col("bucket") != DOCUMENT)
        return cells.groupBy("model", "bucket").agg(F.sum("docs").alias("doc_freq"))

    def cells(self) -> DataFrame:
        """(model, label, bucket, tf), stored pairs only."""
        return self.counts.filter(F.col("bucket") != DOCUMENT).select("model", "label", "bucket", "tf")

    def _sizes(self) -> DataFrame:
        return self.documents().groupBy("model").agg(F.sum("n_docs").alias("n_all"), F.count("*").alias("n_classes"))

    def priors(self) -> DataFrame:
        """(model, label, n_docs, log_prior)."""
        share = (F.col("n_docs") + self.smoothing) / (F.col("n_all") + self.smoothing * F.col("n_classes"))
        return self.documents().join(self._sizes(), "model").select("model", "label", "n_docs", F.log(share).alias("log_prior"))

    def idf(self) -> DataFrame:
        """(model, bucket, doc_freq, idf)."""
        value = idf_column(F.col("n_all"), F.col("doc_freq"), self.min_doc_freq)
        return self.doc_freq().join(self._sizes(), "model").select("model", "bucket", "doc_freq", value)

    def likelihoods(self) -> DataFrame:
        """Stored pairs with idf-weighted mass and log likelihood, and the class's log prior."""
        weighted = self.cells().join(self.idf(), ["model", "bucket"]).select(
            "model", "label", "bucket", (F.col("tf") * F.col("idf")).alias("mass")
        )
        total = weighted.groupBy("model", "label").agg(F.sum("mass").alias("total_mass"))
        value = (F.col("mass") + self.smoothing) / (F.col("total_mass") + self.smoothing * self.num_features)
        return (
            weighted.join(total, ["model", "label"])
            .join(self.priors(), ["model", "label"])
            .select("model", "label", "bucket", "mass", "log_prior", F.log(value).alias("log_likelihood"))
        )

    def save(self, path: str) -> None:
        """Write the model; ``params`` goes last and marks it as complete."""
        self.counts.write.parquet(f"{path}/counts")
        words = [str(word) for word in self.stopwords]
        params = [(float(self.smoothing), int(self.num_features), int(self.min_doc_freq), words, bool(self.drop_empty))]
        schema = "smoothing double, num_features int, min_doc_freq int, stopwords array<string>, drop_empty boolean"
        self.counts.sparkSession.createDataFrame(params, schema).coalesce(1).write.parquet(f"{path}/params")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> NaiveBayes:
        params = spark.read.parquet(f"{path}/params").first()
        return cls(spark.read.parquet(f"{path}/counts"), **params.asDict())


class _Part:
    """What the pairs of some buckets add, by (model, bucket): a row of all classes where most have a pair, else the pairs."""

    def __init__(self, batch: pa.RecordBatch, smoothing: float, width: int):
        keys = _keys(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("model", "bucket")))
        self._place(keys)
        self.idf = batch.column("idf").to_numpy(zero_copy_only=False)
        pairs = batch.column("pairs")
        offsets = pairs.offsets.to_numpy().astype(np.int64)
        self.first, self.number = offsets[:-1] - offsets[0], np.diff(offsets)
        self.classes, mass = (a.to_numpy(zero_copy_only=False) for a in pairs.flatten().flatten())
        # What a pair adds beyond what its absence would.
        self.gains = np.log(mass + smoothing) - np.log(smoothing)
        self.dense = None
        if len(keys) * width <= DENSE * len(self.classes):
            self.dense = np.zeros((len(keys), width))
            self.dense[np.repeat(np.arange(len(keys)), self.number), self.classes] = self.gains
            self.first = self.number = self.classes = self.gains = np.zeros(0, np.int64)

    def _place(self, keys: np.ndarray) -> None:
        self.row = np.argsort(keys)
        self.keys = keys[self.row]

    def size(self) -> int:
        arrays = (self.keys, self.row, self.idf, self.first, self.number, self.classes, self.gains, self.dense)
        return sum(a.nbytes for a in arrays if a is not None)

    @classmethod
    def joined(cls, parts: list[_Part]) -> _Part:
        """Dense parts as one."""
        one = cls.__new__(cls)
        # In the order of each part's rows, which its sorted keys give.
        one._place(np.concatenate([p.keys[np.argsort(p.row)] for p in parts]))
        one.idf, one.dense = np.concatenate([p.idf for p in parts]), np.concatenate([p.dense for p in parts])
        one.first = one.number = one.classes = one.gains = np.zeros(0, np.int64)
        return one


def _keys(model: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    return (model.astype(np.int64) << 32) | bucket


class _Model:
    """The stored model as one task sees it: the classes, and the pairs part by part."""

    def __init__(self, class_path: str, pair_path: str, smoothing: float, part_buckets: int, cache_bytes: int):
        self.pair_path, self.smoothing = pair_path, smoothing
        self.part_buckets = part_buckets
        batches = list(read_side(class_path, ["model", "class", "label", "prior", "tail"], CELLS))
        # By model and, as classes are numbered, by label: equal scores go to the smaller one.
        table = pa.Table.from_batches(batches).sort_by([("model", "ascending"), ("class", "ascending")])
        models = table["model"].to_numpy()
        self.classes = {}
        for key in np.unique(models).tolist():
            own = table.slice(int(np.searchsorted(models, key)), int((models == key).sum()))
            self.classes[key] = (own["label"].to_pylist(), own["prior"].to_numpy(), own["tail"].to_numpy())
        self.most = max(len(labels) for labels, _, _ in self.classes.values())

        # What fits is read now, so that every row is scored by the same parts; dense ones are joined.
        self.kept: list[_Part] = []
        self.beyond = 0
        for part in self._read(0):
            if part.size() > cache_bytes:
                break
            cache_bytes -= part.size()
            self.kept.append(part)
            self.beyond += 1
        else:
            self.beyond = None
        dense = [p for p in self.kept if p.dense is not None]
        if len(dense) > 1:
            self.kept = [p for p in self.kept if p.dense is None] + [_Part.joined(dense)]

    def _read(self, start: int):
        """The stored parts from number ``start``."""
        for number, batch in enumerate(read_side(self.pair_path, ["model", "bucket", "idf", "pairs"], self.part_buckets)):
            if number >= start:
                yield _Part(batch, self.smoothing, self.most)

    def parts(self):
        yield from self.kept
        if self.beyond is not None:
            yield from self._read(self.beyond)

    def scores(self, used: np.ndarray, offsets: np.ndarray, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Rows x classes: each row scored by the model it uses; what is no class of that is -inf."""
        rows, width = len(offsets) - 1, self.most
        owner = np.repeat(np.arange(rows), np.diff(offsets))
        keys = _keys(used[owner], buckets)
        out, weight = np.zeros(rows * width), np.zeros(rows)
        # Part by part and row by row, so sums do not depend on how rows are cut.
        for part in self.parts():
            place = np.searchsorted(part.keys, keys)
            met = np.flatnonzero(part.keys[np.minimum(place, len(part.keys) - 1)] == keys)
            place, row = part.row[place[met]], owner[met]
            x = counts[met] * part.idf[place]
            weight += np.bincount(row, weights=x, minlength=rows)
            if part.dense is not None:
                self._add_dense(out.reshape(rows, width), part, row, place, x)
                continue
            number = part.number[place]
            ends = np.cumsum(number)
            at = 0
            while at < len(met):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CELLS, side="right")))
                own = number[at:to]
                pair = np.repeat(part.first[place[at:to]] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
                np.add.at(out, np.repeat(row[at:to] * width, own) + part.classes[pair], np.repeat(x[at:to], own) * part.gains[pair])
                at = to
        out = out.reshape(rows, width)
        for key, (labels, prior, tail) in self.classes.items():
            own = used == key
            out[own, : len(labels)] += prior + weight[own, None] * tail
            out[own, len(labels) :] = -np.inf
        out[~np.isin(used, list(self.classes))] = -np.inf
        return out

    def _add_dense(self, out: np.ndarray, part: _Part, row: np.ndarray, place: np.ndarray, x: np.ndarray) -> None:
        """A row's terms times the table's rows, one row after the other."""
        step = max(1, CELLS // out.shape[1])
        bounds = np.searchsorted(row, np.arange(len(out) + 1)).tolist()
        for i, (first, last) in enumerate(zip(bounds, bounds[1:])):
            for start in range(first, last, step):
                some = slice(start, min(start + step, last))
                out[i] += x[some] @ part.dense[place[some]]


def _pieces(offsets: np.ndarray, rows: int, terms: int):
    """(start, number) of pieces of at most ``rows`` rows and ``terms`` terms, one row at least."""
    start = 0
    while start < len(offsets) - 1:
        fit = int(np.searchsorted(offsets, offsets[start] + terms, side="right")) - 1 - start
        number = min(max(1, fit), rows, len(offsets) - 1 - start)
        yield start, number
        start += number


def _scorer(class_path: str, pair_path: str, smoothing: float, part_buckets: int, cache_bytes: int, schema: T.StructType, constant, key_column):
    """A ``mapInArrow`` function adding the best class and its score to each row."""
    names = schema.fieldNames()

    def score(batches):
        model = None
        for whole in batches:
            model = model or _Model(class_path, pair_path, smoothing, part_buckets, cache_bytes)
            starts = whole.column("terms").offsets.to_numpy().astype(np.int64)
            for start, number in _pieces(starts, max(1, CELLS // model.most), TERMS):
                batch = whole.slice(start, number)
                offsets, buckets, counts = kernels.csr_parts(batch.column("terms"))
                used = np.full(batch.num_rows, constant)
                if key_column is not None:
                    given = batch.column(key_column)
                    used = given.fill_null(np.iinfo(np.int32).min).to_numpy(zero_copy_only=False)
                scores = model.scores(used, offsets, buckets, counts)
                top = np.argmax(np.round(scores, 6), axis=1)
                found = scores[np.arange(len(top)), top]
                labels = [model.classes[k][0][t] if k in model.classes else None for k, t in zip(used.tolist(), top.tolist())]
                arrays = [batch.column(n) for n in names[:-2]] + [pa.array(labels, pa.string()), pa.array(found, mask=np.isinf(found))]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return score


def store(model: NaiveBayes, keys: list[int] | None = None) -> tuple[str, str]:
    """Write the tables that scoring reads: classes (model, class, label, prior, tail) and pairs by (model, bucket)."""
    if model.smoothing <= 0:
        raise ValueError("scoring needs a positive smoothing")
    spark = model.counts.sparkSession
    counts = model.counts if keys is None else model.counts.filter(F.col("model").isin(keys))
    lam = float(model.smoothing)
    part = NaiveBayes(counts, lam, model.num_features, model.min_doc_freq)
    number = (F.row_number().over(Window.partitionBy("model").orderBy("label")) - 1).cast("int")
    numbered = part.priors().withColumn("class", number).join(part._sizes().select("model", "n_all"), "model")
    classes = spark.read.parquet(write_side(numbered, "numbered"))
    if classes.isEmpty():
        raise LookupError("the model has no classes")
    cells = counts.filter(F.col("bucket") != DOCUMENT).join(classes.select("model", "label", "class", "n_all"), ["model", "label"])
    # One shuffle by bucket gives document frequencies, idf and all pairs of a bucket.
    buckets = cells.groupBy("model", "bucket").agg(
        F.sum("docs").alias("doc_freq"), F.first("n_all").alias("n_all"), F.sort_array(F.collect_list(F.struct("class", "tf"))).alias("cells")
    )
    buckets = buckets.select("model", "bucket", "cells", idf_column(F.col("n_all"), F.col("doc_freq"), model.min_doc_freq)).filter("idf <> 0")
    mass = F.transform("cells", lambda c: F.struct(c["class"].alias("class"), (c["tf"] * F.col("idf")).alias("mass")))
    pair_path = write_side(buckets.select("model", "bucket", "idf", mass.alias("pairs")).sortWithinPartitions("model", "bucket"), "pairs")
    stored = spark.read.parquet(pair_path)
    total = stored.select("model", F.inline("pairs")).groupBy("model", "class").agg(F.sum("mass").alias("total"))
    tail = np.log(lam) - F.log(F.coalesce("total", F.lit(0.0)) + lam * model.num_features)
    placed = classes.join(total, ["model", "class"], "left")
    return write_side(placed.select("model", "class", "label", F.col("log_prior").alias("prior"), tail.alias("tail")), "classes"), pair_path


def classify(
    vectors: DataFrame,
    model: NaiveBayes,
    key: int | str = ALL,
    part_buckets: int = PART_BUCKETS,
    cache_bytes: int = CACHE_BYTES,
) -> DataFrame:
    """Add ``prediction`` and ``score`` to every row and drop ``terms``.

    ``key`` names the model to use, or the column that holds each row's model.
    Scores are compared at six places and ties go to the smaller label. One
    pass, without a shuffle, for any number of classes, ids or none, and
    streaming frames. A task keeps at most ``cache_bytes`` of the model and
    reads what is beyond it again for every few rows; a bucket's row has at most
    one pair per class.
    """
    keep = [f for f in vectors.schema.fields if f.name != "terms"]
    schema = T.StructType(
        [*keep, T.StructField("prediction", T.StringType()), T.StructField("score", T.DoubleType())]
    )
    column, constant = (key, None) if isinstance(key, str) else (None, key)
    paths = store(model, None if constant is None else [int(constant)])
    return vectors.mapInArrow(_scorer(*paths, float(model.smoothing), part_buckets, cache_bytes, schema, constant, column), schema)
