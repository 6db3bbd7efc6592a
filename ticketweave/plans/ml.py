"""The same features and classifier as ``pyspark.ml`` stages, for users' own pipelines.

``HashingTF`` hashes differently from the tables of this package: models and
vectors of the two forms must not be mixed. With ``own_buckets`` the stages
take this package's buckets instead, and both forms predict alike.
"""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import IDF, CountVectorizerModel, HashingTF, IndexToString, Normalizer, StringIndexer, Tokenizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import NUM_FEATURES, with_terms
from ..operators import evaluation
from ..session import materialize


def bucket_words(
    df: DataFrame,
    clean: bool = True,
    stopwords: Iterable[str] = (),
    drop_empty: bool = True,
    num_features: int = NUM_FEATURES,
) -> DataFrame:
    """Replace ``description`` by ``words``: the bucket numbers of the package's own vectors, as often as they count."""
    vectors = with_terms(df, "description", clean, stopwords, drop_empty, num_features)
    repeated = F.transform("terms", lambda t: F.array_repeat(t["bucket"].cast("string"), t["tf"]))
    return vectors.withColumn("words", F.flatten(repeated)).drop("terms")


def classifier(
    labeled: DataFrame, num_features: int = NUM_FEATURES, smoothing: float = 1.0, own_buckets: bool = False
) -> Pipeline:
    """Label index, hashed counts, idf and naive Bayes; predicts ``prediction_label``.

    Takes (description, assigned_to), or (words, assigned_to) as given by
    ``bucket_words`` with ``own_buckets``; then it predicts what
    ``operators.bayes`` does. The index is that of ``labeled``, which must be
    the rows the pipeline is fitted on: the classifier numbers only the classes it sees.
    """
    indexer = StringIndexer(inputCol="assigned_to", outputCol="label").fit(labeled)
    return Pipeline(stages=[indexer, *_counters(num_features, own_buckets), *_learners(indexer.labels, smoothing)])


def _counters(num_features: int, own_buckets: bool) -> list:
    """Stages that give ``raw_features`` of a row and learn nothing."""
    if own_buckets:
        places = [str(bucket) for bucket in range(num_features)]
        return [CountVectorizerModel.from_vocabulary(places, "words", "raw_features")]
    return [
        Tokenizer(inputCol="description", outputCol="words"),
        HashingTF(inputCol="words", outputCol="raw_features", numFeatures=num_features),
    ]


def _learners(labels: list[str], smoothing: float) -> list:
    return [
        IDF(inputCol="raw_features", outputCol="features", minDocFreq=2),
        NaiveBayes(smoothing=smoothing),
        IndexToString(inputCol="prediction", outputCol="prediction_label", labels=labels),
    ]


def similarity_features(num_features: int = NUM_FEATURES, idf: bool = False) -> Pipeline:
    """Tokens, hashed counts, optionally idf, and unit length: column ``norm_features``."""
    stages = [
        Tokenizer(inputCol="description", outputCol="words"),
        HashingTF(inputCol="words", outputCol="tf_features", numFeatures=num_features),
    ]
    if idf:
        stages.append(IDF(inputCol="tf_features", outputCol="tfidf_features"))
    stages.append(Normalizer(inputCol=stages[-1].getOutputCol(), outputCol="norm_features"))
    return Pipeline(stages=stages)


def cross_validate(
    labeled: DataFrame,
    num_features: tuple[int, ...] = (NUM_FEATURES,),
    smoothing: tuple[float, ...] = (1.0,),
    folds: int = 3,
    fold: str | None = None,
    seed: int = 42,
    own_buckets: bool = False,
    parallelism: int = 4,
) -> tuple[PipelineModel, list[float]]:
    """Best pipeline refitted on all rows, and the mean F1 of every grid point.

    Every fold's pipeline indexes the labels of its own training part, and
    predictions are compared as texts, so a class that a part lacks shifts no
    other. Name a ``fold`` column (0 to ``folds`` - 1) to fix the folds; otherwise
    they are drawn by a hash of the row and ``seed``. Words are counted once for
    all fits, of which ``parallelism`` run at a time.
    """
    part = "_fold" if fold is None else fold
    if fold is None:
        drawn = F.pmod(F.xxhash64(*labeled.columns, F.lit(seed)), F.lit(folds))
        labeled = labeled.withColumn(part, drawn.cast("int"))
    grid = [(size, lam) for size in num_features for lam in smoothing]
    counted = {size: _counted(labeled, size, own_buckets) for size in num_features}

    def fitted(size: int, lam: float, number: int | None) -> PipelineModel:
        """The learning stages, fitted on all rows outside fold ``number``."""
        training = counted[size] if number is None else counted[size].filter(F.col(part) != number)
        indexer = StringIndexer(inputCol="assigned_to", outputCol="label").fit(training)
        return Pipeline(stages=[indexer, *_learners(indexer.labels, lam)]).fit(training)

    def held_out(point: tuple[int, float], number: int) -> DataFrame:
        # Without the label column the model leaves out its index.
        rows = counted[point[0]].filter(F.col(part) == number).withColumnRenamed("assigned_to", "_truth")
        return fitted(*point, number).transform(rows).select("_truth", "prediction_label", part)

    with ThreadPoolExecutor(parallelism) as pool:
        tasks = {(i, n): pool.submit(held_out, point, n) for i, point in enumerate(grid) for n in range(folds)}
        # With one grid point its refit needs no result of the folds.
        refit = pool.submit(fitted, *grid[0], None) if len(grid) == 1 else None
        scored = [reduce(DataFrame.unionAll, [tasks[i, n].result() for n in range(folds)]) for i in range(len(grid))]

        def mean(rows: DataFrame) -> float:
            report = evaluation.metrics_report(rows, "_truth", "prediction_label", part)
            return report.agg(F.avg("weighted_f_measure")).first()[0]

        means = list(pool.map(mean, scored))
        size, lam = grid[max(range(len(grid)), key=lambda i: means[i])]
        model = refit.result() if refit else fitted(size, lam, None)
    indexer, *rest = model.stages
    return PipelineModel(stages=[indexer, *_counters(size, own_buckets), *rest]), means


def _counted(labeled: DataFrame, size: int, own_buckets: bool) -> DataFrame:
    """All rows with their ``raw_features``, written once for all fits."""
    rows = PipelineModel(stages=_counters(size, own_buckets)).transform(labeled)
    return materialize(rows.select(*[c for c in labeled.columns if c not in ("words", "description")], "raw_features"), "counted")


def publish(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def latest(path: str) -> PipelineModel:
    return PipelineModel.load(path)
