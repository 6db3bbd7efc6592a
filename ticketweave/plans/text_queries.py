"""Registered queries over texts: cleaning, vectors, similarity, classification, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.vectors import long_form, normalized_long_form, with_terms
from ..operators import bayes, evaluation, similarity
from ..session import materialize, work_path
from ..sources import readers
from ..streaming import arrivals
from . import ml, oracle, triage
from .oracle import STOPWORDS
from .registry import query, table


def stored(spark, sf, *keep: str) -> DataFrame:
    """The documents as tickets (id, description)."""
    return readers.load_summary(table(spark, sf, "documents"), "doc_id", "text", *keep)


def summaries(spark, sf, *keep: str) -> DataFrame:
    """The documents as tickets, spread over all cores."""
    return readers.spread(stored(spark, sf, *keep), "id")


def questions(spark, sf) -> DataFrame:
    """The benchmark texts as query tickets."""
    return readers.load_summary(table(spark, sf, "benchmark"), "item_id", "text")


def labeled(spark, sf, label: str = "lang") -> DataFrame:
    """Training rows (id, description, assigned_to)."""
    return readers.load_labeled(summaries(spark, sf, label), "description", label, "id")


def known(spark, sf) -> DataFrame:
    return table(spark, sf, "labels").selectExpr("doc_id AS id")


def assigned(spark, sf) -> DataFrame:
    """Documents someone has labelled: the training set."""
    source = stored(spark, sf, "lang")
    kept = source.join(known(spark, sf), "id", "left_semi")
    return readers.load_labeled(readers.spread(kept, "id", source=source), "description", "lang", "id")


def unassigned(spark, sf) -> DataFrame:
    """Documents nobody has labelled: the tickets to classify."""
    source = stored(spark, sf)
    return readers.spread(source.join(known(spark, sf), "id", "left_anti"), "id", source=source)


def vectors(spark, sf) -> DataFrame:
    return with_terms(summaries(spark, sf), "description", stopwords=STOPWORDS)


def report_columns() -> list:
    return [F.round(c, 6).alias(c) for c in evaluation.METRICS]


# ---- cleaning and tokens --------------------------------------------------------


@query("clean_text", f"SELECT doc_id AS id, {oracle.cleaned('text')} AS cleaned FROM documents")
def clean_text(spark, sf):
    return summaries(spark, sf).select("id", text.clean_text("description", STOPWORDS).alias("cleaned"))


@query("clean_pages", f"SELECT page_id AS id, {oracle.cleaned('html')} AS cleaned FROM pages")
def clean_pages(spark, sf):
    pages = readers.spread(readers.load_summary(table(spark, sf, "pages"), "page_id", "html"), "id")
    return pages.select("id", text.clean_text("description", STOPWORDS).alias("cleaned"))


@query(
    "stopword_removal",
    "SELECT doc_id AS id, array_to_string(list_filter(string_split(lower(text), ' '), lambda w: w NOT IN ("
    + ", ".join(f"'{w}'" for w in STOPWORDS)
    + ")), ' ') AS kept FROM documents",
)
def stopword_removal(spark, sf):
    kept = text.remove_stopwords(F.lower("description"), STOPWORDS)
    return summaries(spark, sf).select("id", kept.alias("kept"))


@query(
    "tokens",
    r"""WITH t AS (SELECT doc_id AS id, string_split_regex(rtrim(lower(text), ' ' || chr(9) || chr(10) || chr(13)),
        '\s') AS words FROM documents)
    SELECT id, CAST(position - 1 AS INTEGER) AS position, token FROM (
        SELECT id, unnest(words) AS token, generate_subscripts(words, 1) AS position FROM t)""",
)
def tokens(spark, sf):
    words = summaries(spark, sf).select("id", text.tokenize("description", drop_empty=False).alias("words"))
    return words.select("id", F.posexplode_outer("words").alias("position", "token")).filter("position IS NOT NULL")


@query("hashed_tf", f"WITH {oracle.term_counts('tf', 'documents', 'doc_id', 'text')} SELECT id, bucket, tf FROM tf")
def hashed_tf(spark, sf):
    return long_form(vectors(spark, sf), "id")


@query(
    "tf_normalized",
    f"""WITH {oracle.term_counts('tf', 'documents', 'doc_id', 'text')}
    SELECT id, bucket, tf, round(tf / sqrt(sum(tf * tf) OVER (PARTITION BY id)), 6) AS weight FROM tf""",
)
def tf_normalized(spark, sf):
    return normalized_long_form(vectors(spark, sf), "id").withColumn("weight", F.round("weight", 6))


@query(
    "idf_table",
    f"""WITH {oracle.term_counts('tf', 'documents', 'doc_id', 'text')}
    SELECT bucket, count(*) AS doc_freq, round(CASE WHEN count(*) >= 2 THEN
        ln(((SELECT count(*) FROM documents) + 1.0) / (count(*) + 1.0)) ELSE 0.0 END, 6) AS idf
    FROM tf GROUP BY bucket""",
)
def idf_table(spark, sf):
    n_docs = table(spark, sf, "documents").count()
    return similarity.idf_table(vectors(spark, sf), n_docs, 2).withColumn("idf", F.round("idf", 6))


# ---- similarity --------------------------------------------------------------------


@query("similar_topk", oracle.similar())
def similar_topk(spark, sf):
    queries = with_terms(questions(spark, sf), "description", stopwords=STOPWORDS)
    return similarity.top_similar(queries, vectors(spark, sf))


@query(
    "build_index",
    f"""WITH {oracle.term_counts('tf', 'documents', 'doc_id', 'text')}
    SELECT doc_id AS id, count(bucket) AS n_buckets, coalesce(sum(tf), 0) AS n_words,
        round(sqrt(coalesce(sum(tf * tf), 0)), 6) AS norm
    FROM documents LEFT JOIN tf ON doc_id = id GROUP BY doc_id""",
)
def build_index(spark, sf):
    index = triage.build_index(summaries(spark, sf), work_path(spark, "index"), stopwords=STOPWORDS)
    words = F.aggregate("terms", F.lit(0).cast("bigint"), lambda acc, t: acc + t["tf"])
    return index.select(
        "id", F.size("terms").cast("bigint").alias("n_buckets"), words.alias("n_words"), F.round("norm", 6).alias("norm")
    )


@query("similar_topk_tfidf", oracle.similar("tfidf"))
def similar_topk_tfidf(spark, sf):
    index = triage.build_index(summaries(spark, sf), work_path(spark, "index"), stopwords=STOPWORDS)
    return triage.find_similar(questions(spark, sf), index, weighting="tfidf", stopwords=STOPWORDS)


@query("similar_as_stored", oracle.similar("tf", oracle.stored_words, oracle.cleaned_words))
def similar_as_stored(spark, sf):
    """Only the queries are cleaned, the corpus is taken as stored."""
    path = work_path(spark, "index")
    index = triage.build_index(summaries(spark, sf), path, clean_corpus=False, drop_empty=False)
    return triage.find_similar(questions(spark, sf), index, stopwords=STOPWORDS, drop_empty=False)


# ---- classification ------------------------------------------------------------------


@query(
    "label_index",
    """SELECT label, n, CAST(row_number() OVER (ORDER BY n DESC, label) - 1 AS DOUBLE) AS label_index
    FROM (SELECT source AS label, count(*) AS n FROM documents GROUP BY source)""",
)
def label_index(spark, sf):
    return bayes.label_index(table(spark, sf, "documents", "source"), "source")


@query(
    "nb_model",
    f"""WITH {oracle.bayes('lang')} SELECT label, bucket, round(mass, 4) AS mass, round(log_prior, 6) AS log_prior,
        round(ln((mass + 1.0) / (total + 20000.0)), 6) AS log_likelihood FROM mass JOIN cls USING (m, label)""",
)
def nb_model(spark, sf):
    model = triage.train(labeled(spark, sf), stopwords=STOPWORDS)
    return model.likelihoods().select(
        "label",
        "bucket",
        F.round("mass", 4).alias("mass"),
        F.round("log_prior", 6).alias("log_prior"),
        F.round("log_likelihood", 6).alias("log_likelihood"),
    )


CLASSIFIED_SQL = oracle.bayes("lang", train=oracle.IS_LABELED, test=f"NOT {oracle.IS_LABELED}")
PREDICTED_SQL = f"WITH {CLASSIFIED_SQL} SELECT id, prediction, round(score, 3) AS score FROM scored"


def predicted(scored: DataFrame) -> DataFrame:
    return scored.select("id", "prediction", F.round("score", 3).alias("score"))


@query("nb_classify", PREDICTED_SQL)
def nb_classify(spark, sf):
    model = triage.train(assigned(spark, sf), stopwords=STOPWORDS)
    return predicted(triage.classify_tickets(unassigned(spark, sf), model, stopwords=STOPWORDS))


@query("model_roundtrip", PREDICTED_SQL)
def model_roundtrip(spark, sf):
    root = work_path(spark, "registry")
    triage.publish_model(triage.train(assigned(spark, sf), stopwords=STOPWORDS), root, 1)
    model = triage.latest_model(spark, root)
    return predicted(triage.classify_tickets(unassigned(spark, sf), model))


@query(
    "classify_enriched",
    f"""WITH {CLASSIFIED_SQL}, accounts AS (SELECT upper(lang) AS username, 'Desk of ' || count(*) AS name
        FROM documents GROUP BY lang HAVING lang <> 'es')
    SELECT id, prediction AS assigned_to, name AS assigned_to_name FROM scored
    LEFT JOIN accounts ON lower(username) = lower(prediction)""",
)
def classify_enriched(spark, sf):
    counted = table(spark, sf, "documents", "lang").groupBy("lang").agg(F.count("*").alias("n")).filter("lang <> 'es'")
    accounts = counted.selectExpr("upper(lang) AS username", "'Desk of ' || n AS name")
    model = triage.train(assigned(spark, sf), stopwords=STOPWORDS)
    scored = triage.classify_tickets(unassigned(spark, sf), model, stopwords=STOPWORDS)
    return triage.assign(scored, model, accounts).select("id", "assigned_to", "assigned_to_name")


@query(
    "metrics_report",
    f"WITH {oracle.bayes('source')}, {oracle.METRICS} SELECT {oracle.METRIC_COLUMNS} FROM report",
)
def metrics_report(spark, sf):
    training = triage.build_model(labeled(spark, sf, "source"), folds=0, stopwords=STOPWORDS)
    report = evaluation.metrics_report(training.resubstitution(), "assigned_to", "prediction")
    return report.select(*report_columns())


@query(
    "accuracy_pct",
    f"""WITH {oracle.bayes('lang')} SELECT count(*) AS n,
        sum(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS n_correct,
        round(100.0 * avg(CASE WHEN label = prediction THEN 1 ELSE 0 END), 6) AS accuracy_pct FROM scored""",
)
def accuracy_pct(spark, sf):
    training = triage.build_model(labeled(spark, sf), folds=0, stopwords=STOPWORDS)
    share = evaluation.accuracy_pct(training.resubstitution(), "assigned_to", "prediction")
    return share.withColumn("accuracy_pct", F.round("accuracy_pct", 6))


@query(
    "cv_report",
    f"WITH {oracle.bayes('source', oracle.FOLD_KEYS)}, {oracle.METRICS} "
    f"SELECT m AS fold, {oracle.METRIC_COLUMNS} FROM report",
)
def cv_report(spark, sf):
    training = triage.build_model(labeled(spark, sf, "source"), stopwords=STOPWORDS)
    return training.report.select("fold", *report_columns())


@query(
    "build_model",
    f"""WITH a AS (WITH {oracle.bayes('lang', oracle.FOLD_KEYS)}, {oracle.METRICS}
            SELECT 1.0::DOUBLE AS smoothing, m AS fold, {oracle.METRIC_COLUMNS} FROM report),
        b AS (WITH {oracle.bayes('lang', oracle.FOLD_KEYS, smoothing=0.1)}, {oracle.METRICS}
            SELECT 0.1::DOUBLE AS smoothing, m AS fold, {oracle.METRIC_COLUMNS} FROM report)
    SELECT * FROM a UNION ALL SELECT * FROM b""",
)
def build_model(spark, sf):
    training = triage.build_model(labeled(spark, sf), ((20_000, 1.0), (20_000, 0.1)), stopwords=STOPWORDS)
    return training.report.select("smoothing", "fold", *report_columns())


# ---- pyspark.ml form -------------------------------------------------------------------


@query("ml_pipeline", f"WITH {oracle.bayes('lang')} SELECT id, prediction AS prediction_label FROM scored")
def ml_pipeline(spark, sf):
    # Fitted stage by stage: the text is read once, its words by every stage.
    training = materialize(ml.bucket_words(labeled(spark, sf), stopwords=STOPWORDS), "words")
    model = ml.classifier(training, own_buckets=True).fit(training)
    return model.transform(training.drop("assigned_to")).select("id", "prediction_label")


@query(
    "cv_ml",
    f"""WITH {oracle.bayes('lang', oracle.FOLD_KEYS)}, {oracle.METRICS}
    SELECT count(*) AS n, sum(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS n_correct,
        round(100.0 * avg(CASE WHEN label = prediction THEN 1 ELSE 0 END), 6) AS accuracy_pct,
        (SELECT round(avg(weighted_f_measure), 6) FROM report WHERE m >= 0) AS cv_f1
    FROM scored WHERE m = -1""",
)
def cv_ml(spark, sf):
    training = labeled(spark, sf).withColumn("fold", triage.fold_of())
    training = materialize(ml.bucket_words(training, stopwords=STOPWORDS), "words")
    best, f1 = ml.cross_validate(training, fold="fold", own_buckets=True)
    share = evaluation.accuracy_pct(best.transform(training), "assigned_to", "prediction_label")
    return share.select("n", "n_correct", F.round("accuracy_pct", 6).alias("accuracy_pct"), F.lit(round(f1[0], 6)).alias("cv_f1"))


# ---- streams -----------------------------------------------------------------------------

DOCUMENT_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
BENCHMARK_SCHEMA = "item_id bigint, text string"


@query("stream_classify", PREDICTED_SQL)
def stream_classify(spark, sf):
    model = triage.train(assigned(spark, sf), stopwords=STOPWORDS)
    arriving = arrivals.read_table_arrivals(spark, f"{sf}/documents.parquet", DOCUMENT_SCHEMA)
    new = readers.load_summary(arriving, "doc_id", "text").join(known(spark, sf), "id", "left_anti")
    out = work_path(spark, "classified")
    arrivals.classify_stream(
        new, model, out, work_path(spark, "checkpoint"), stopwords=STOPWORDS,
        partitions=spark.sparkContext.defaultParallelism,
    ).awaitTermination()
    return predicted(spark.read.parquet(out))


@query("stream_similar", oracle.similar())
def stream_similar(spark, sf):
    index = triage.build_index(summaries(spark, sf), work_path(spark, "index"), stopwords=STOPWORDS)
    arriving = readers.load_summary(
        arrivals.read_table_arrivals(spark, f"{sf}/benchmark.parquet", BENCHMARK_SCHEMA), "item_id", "text"
    )
    out = work_path(spark, "similar")
    arrivals.similar_stream(
        arriving, index, out, work_path(spark, "checkpoint"), stopwords=STOPWORDS
    ).awaitTermination()
    return spark.read.schema(similarity.RESULT_SCHEMA).parquet(f"{out}/batch=*")
