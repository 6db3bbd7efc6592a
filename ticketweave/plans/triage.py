"""The composed jobs: train, classify, index, find similar, publish models."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import NUM_FEATURES, term_norm, with_terms
from ..operators import bayes, evaluation, similarity
from ..session import materialize
from ..sources.readers import read_if_present


def fold_of(id_column: str = "id", folds: int = bayes.FOLDS):
    """A reproducible fold for each row."""
    return F.pmod(F.col(id_column), F.lit(folds)).cast("int")


def train(
    labeled: DataFrame,
    clean_corpus: bool = True,
    stopwords: Iterable[str] = (),
    smoothing: float = bayes.SMOOTHING,
    num_features: int = NUM_FEATURES,
    drop_empty: bool = True,
) -> bayes.NaiveBayes:
    """A classifier from (description, assigned_to), in one pass over the text."""
    vectors = with_terms(labeled, "description", clean_corpus, stopwords, drop_empty, num_features)
    counts = bayes.training_counts(bayes.class_counts(vectors, "assigned_to"))
    # The model is read several times, the text only once: write the counts.
    return bayes.NaiveBayes(
        materialize(counts, "counts"), smoothing, num_features, stopwords=tuple(stopwords), drop_empty=drop_empty
    )


@dataclass
class Training:
    """Outcome of ``build_model``."""

    model: bayes.NaiveBayes
    vectors: DataFrame  # id, assigned_to, fold, terms of the training rows
    report: DataFrame  # quality per grid point and fold; fold -1 is the refit on its own rows

    def resubstitution(self) -> DataFrame:
        """Training rows with the refitted model's prediction."""
        return bayes.classify(self.vectors, self.model)


def build_model(
    labeled: DataFrame,
    grid: Sequence[tuple[int, float]] = ((NUM_FEATURES, bayes.SMOOTHING),),
    folds: int = bayes.FOLDS,
    clean_corpus: bool = True,
    stopwords: Iterable[str] = (),
    drop_empty: bool = True,
) -> Training:
    """Cross-validate a grid of (num_features, smoothing), refit the best on all rows.

    ``labeled`` has id, description and assigned_to. Grid points of equal
    num_features share one text pass and one counting pass, whatever the folds;
    each point is then scored once, every row by the model that has not seen it
    and by the one that has. The best point has the largest mean held-out
    weighted F-measure.
    """
    if len(grid) > 1 and not folds:
        raise ValueError("choosing from a grid needs folds")
    prepared = labeled.withColumn("fold", fold_of(folds=folds) if folds else F.lit(bayes.ALL))
    keys = F.array("fold", F.lit(bayes.ALL)) if folds else F.array("fold")
    features, fitted, reports = {}, {}, []
    for size in dict.fromkeys(size for size, _ in grid):
        vectors = with_terms(prepared, "description", clean_corpus, stopwords, drop_empty, size)
        vectors = materialize(vectors, "vectors")
        counts = bayes.training_counts(bayes.class_counts(vectors, "assigned_to", "fold"), folds)
        features[size] = (vectors, materialize(counts, "counts"))
    for size, smoothing in grid:
        vectors, counts = features[size]
        model = fitted[size, smoothing] = bayes.NaiveBayes(
            counts, smoothing, size, stopwords=tuple(stopwords), drop_empty=drop_empty
        )
        both = vectors.select("id", "assigned_to", "terms", F.explode(keys).alias("fold"))
        scored = bayes.classify(both, model, "fold")
        reports.append(
            evaluation.metrics_report(scored, "assigned_to", "prediction", "fold").select(
                F.lit(size).alias("num_features"), F.lit(smoothing).alias("smoothing"), "fold", *evaluation.METRICS
            )
        )
    report, best = reports[0], grid[0]
    if len(grid) > 1:
        report = materialize(reduce(DataFrame.unionAll, reports), "report")
        held_out = report.filter(F.col("fold") != bayes.ALL).groupBy("num_features", "smoothing")
        row = (
            held_out.agg(F.avg("weighted_f_measure").alias("f"))
            .orderBy(F.desc("f"), "num_features", "smoothing")
            .first()
        )
        best = (row.num_features, row.smoothing)
    return Training(fitted[best], features[best[0]][0], report)


def classify_tickets(
    tickets: DataFrame,
    model: bayes.NaiveBayes,
    clean: bool = True,
    stopwords: Iterable[str] | None = None,
    drop_empty: bool | None = None,
) -> DataFrame:
    """Score every ticket (id, description, ...): ``prediction`` and ``score`` are added.

    Stop words and the treatment of empty words are those of the training, unless given.
    """
    stopwords = model.stopwords if stopwords is None else stopwords
    drop_empty = model.drop_empty if drop_empty is None else drop_empty
    vectors = with_terms(tickets, "description", clean, stopwords, drop_empty, model.num_features)
    return bayes.classify(vectors, model)


# Labels up to this number are sent to every task; more are joined by shuffle.
BROADCAST_LABELS = 100_000


def assign(scored: DataFrame, model: bayes.NaiveBayes, accounts: DataFrame) -> DataFrame:
    """Turn predictions into ``assigned_to`` and ``assigned_to_name`` (null if no account).

    The model's labels, not the tickets, are looked up among the accounts,
    ignoring case: a label most tickets share costs one lookup. Of several
    accounts with one user name the smallest display name is taken. Tickets that
    already have these two columns get the prediction as ``assigned_to`` and keep
    their old name where no account matches.
    """
    labels = model.documents().filter(F.col("model") == bayes.ALL)
    labels = labels.select("label", F.lower(F.coalesce("label", F.lit(""))).alias("_login"))
    few = labels.count() <= BROADCAST_LABELS
    named = accounts.select(F.lower("username").alias("_login"), "name")
    names = (
        named.join(F.broadcast(labels) if few else labels, "_login")
        .groupBy(F.col("label").alias("assigned_to"))
        .agg(F.min("name").alias("assigned_to_name"))
    )
    kept = [c for c in scored.columns if c not in ("assigned_to", "assigned_to_name")]
    old = F.col("assigned_to_name") if "assigned_to_name" in scored.columns else F.lit(None)
    tickets = scored.select(*[F.col(c).alias("assigned_to") if c == "prediction" else c for c in kept], old.cast("string").alias("_old_name"))
    named = tickets.join(F.broadcast(names) if few else names, "assigned_to", "left")
    columns = ["assigned_to" if c == "prediction" else c for c in kept]
    return named.select(*columns, F.coalesce("assigned_to_name", "_old_name").alias("assigned_to_name"))


def build_index(
    corpus: DataFrame,
    path: str,
    clean_corpus: bool = True,
    stopwords: Iterable[str] = (),
    drop_empty: bool = True,
) -> DataFrame:
    """Write the term vectors of (id, description) to ``path`` and read the table back.

    One row per document, built and written without a shuffle.
    """
    vectors = with_terms(corpus, "description", clean_corpus, stopwords, drop_empty)
    indexed = vectors.select("id", "terms", term_norm().alias("norm"))
    indexed.write.parquet(path)
    return corpus.sparkSession.read.schema(indexed.schema).parquet(path)


def find_similar(
    queries: DataFrame,
    index: DataFrame,
    k: int = 11,
    exclude_self: bool = False,
    weighting: str = "tf",
    stopwords: Iterable[str] = (),
    drop_empty: bool = True,
) -> DataFrame:
    """The ``k`` most similar indexed tickets of each query (id, description)."""
    vectors = with_terms(queries, "description", True, stopwords, drop_empty)
    idf = None
    if weighting == "tfidf":
        idf = similarity.idf_table(index, index.count())
    elif weighting != "tf":
        raise ValueError(f"unknown weighting: {weighting}")
    return similarity.top_similar(vectors, index, k, exclude_self, idf)


def publish_model(model: bayes.NaiveBayes, root: str, version: int) -> None:
    """Write a model under ``root`` and, once complete, announce its version."""
    refit = replace(model, counts=model.counts.filter(F.col("model") == bayes.ALL))
    refit.save(f"{root}/models/{version}")
    spark = model.counts.sparkSession
    spark.createDataFrame([(int(version),)], "version bigint").coalesce(1).write.mode("append").parquet(
        f"{root}/published"
    )


def latest_model(spark: SparkSession, root: str) -> bayes.NaiveBayes:
    """The newest announced model; an error if there is none."""
    published = read_if_present(spark, f"{root}/published", "version bigint")
    version = None if published is None else published.agg(F.max("version")).first()[0]
    if version is None:
        raise LookupError(f"no model has been published under {root}")
    return bayes.NaiveBayes.load(spark, f"{root}/models/{version}")
