"""Naive Bayes: hand-computed values, agreement with pyspark.ml, folds and blocks."""

import math

import pytest
from pyspark.ml.classification import NaiveBayes as MlNaiveBayes
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, StringIndexer
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from ticketweave.functions.vectors import with_terms
from ticketweave.operators import bayes, evaluation
from ticketweave.plans import ml, triage

ROWS = [
    (1, "lampu mati total", "pln"),
    (2, "lampu jalan mati", "pln"),
    (3, "air keruh", "pdam"),
    (4, "air mati lagi", "pdam"),
    (5, "jalan rusak", "pu"),
    (6, "jalan rusak parah", "pu"),
]


def tickets(spark, rows=ROWS):
    return spark.createDataFrame(rows, "id bigint, description string, assigned_to string")


def documents(spark, small, label="lang"):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    return docs.select(F.col("doc_id").alias("id"), F.col("text").alias("description"), F.col(label).alias("assigned_to"))


def test_prior_and_likelihood(spark):
    rows = [(1, "x", "a"), (2, "x", "a"), (3, "y", "b")]
    model = triage.train(tickets(spark, rows), clean_corpus=False)
    priors = {r.label: r.log_prior for r in model.priors().collect()}
    assert priors["a"] == pytest.approx(math.log((2 + 1) / (3 + 2)), abs=1e-9)
    idf = math.log(4 / 3)
    likelihood = {r.label: r.log_likelihood for r in model.likelihoods().filter("mass > 0").collect()}
    assert likelihood == {"a": pytest.approx(math.log((2 * idf + 1) / (2 * idf + 20_000)))}


def test_same_as_pyspark_ml(spark, small):
    docs = documents(spark, small, "source")
    vectors = with_terms(docs, "description").persist()
    scored = bayes.classify(vectors, triage.train(docs)).orderBy("id").collect()

    rows = [
        (r.id, r.assigned_to, Vectors.sparse(20_000, [t.bucket for t in r.terms], [float(t.tf) for t in r.terms]))
        for r in vectors.collect()
    ]
    sparse = spark.createDataFrame(rows, ["id", "assigned_to", "raw"])
    sparse = StringIndexer(inputCol="assigned_to", outputCol="label").fit(sparse).transform(sparse)
    weighted = IDF(inputCol="raw", outputCol="features", minDocFreq=2).fit(sparse).transform(sparse)
    predictions = MlNaiveBayes(smoothing=1.0).fit(weighted).transform(weighted)
    names = {r.label: r.assigned_to for r in predictions.select("label", "assigned_to").distinct().collect()}
    theirs = predictions.orderBy("id").collect()
    assert [r.prediction for r in scored] == [names[r.prediction] for r in theirs]
    assert [r.score for r in scored] == [pytest.approx(max(r.rawPrediction), rel=1e-9) for r in theirs]


def test_fold_counts_equal_separate_training(spark, small):
    docs = documents(spark, small).withColumn("fold", triage.fold_of())
    vectors = with_terms(docs, "description").persist()
    together = bayes.training_counts(bayes.class_counts(vectors, "assigned_to", "fold"), 3)
    for fold in range(3):
        alone = bayes.training_counts(bayes.class_counts(vectors.filter(F.col("fold") != fold), "assigned_to"))
        mine = together.filter(F.col("model") == fold).drop("model")
        assert mine.exceptAll(alone.drop("model")).count() == 0
        assert alone.drop("model").exceptAll(mine).count() == 0


@pytest.mark.parametrize("key", [bayes.ALL, "fold"])
def test_parts_of_the_model_change_nothing(spark, small, key):
    docs = documents(spark, small, "source").withColumn("fold", triage.fold_of())
    vectors = with_terms(docs, "description").persist()
    model = bayes.NaiveBayes(bayes.training_counts(bayes.class_counts(vectors, "assigned_to", "fold"), 3).persist())
    whole = bayes.classify(vectors, model, key).orderBy("id").collect()
    split = bayes.classify(vectors, model, key, part_buckets=300, cache_bytes=40_000).orderBy("id").collect()
    assert [r.prediction for r in whole] == [r.prediction for r in split]
    assert [round(r.score, 6) for r in whole] == [round(r.score, 6) for r in split]


def test_empty_ticket_gets_the_likeliest_class(spark):
    rows = ROWS + [(7, "lampu", "pln")]
    model = triage.train(tickets(spark, rows), clean_corpus=False)
    row = triage.classify_tickets(tickets(spark, [(9, None, None)]).drop("assigned_to"), model).first()
    assert row.prediction == "pln"


def test_ties_go_to_the_smaller_label(spark):
    model = triage.train(tickets(spark, [(1, "x", "b"), (2, "y", "a")]), clean_corpus=False)
    assert triage.classify_tickets(tickets(spark, [(9, "z", None)]), model).first().prediction == "a"


def test_class_missing_from_a_fold(spark):
    rows = [(0, "x y", "a"), (1, "x y", "a"), (2, "x z", "a"), (3, "z z", "only")]
    training = triage.build_model(tickets(spark, rows), clean_corpus=False)
    assert {r.fold for r in training.report.collect()} == {-1, 0, 1, 2}
    held_out = training.vectors.filter("id = 3")
    assert bayes.classify(held_out, training.model, "fold").first().prediction == "a"


def test_label_index(spark):
    rows = [(r.label, r.n, r.label_index) for r in bayes.label_index(tickets(spark), "assigned_to").collect()]
    assert sorted(rows, key=lambda r: r[2]) == [("pdam", 2, 0.0), ("pln", 2, 1.0), ("pu", 2, 2.0)]


def test_grid_picks_the_best_point(spark, small):
    grid = ((20_000, 1.0), (500, 1.0), (20_000, 0.01))
    training = triage.build_model(documents(spark, small, "source"), grid)
    rows = training.report.filter("fold >= 0").collect()
    means = {}
    for r in rows:
        means.setdefault((r.num_features, r.smoothing), []).append(r.weighted_f_measure)
    best = max(means, key=lambda g: sum(means[g]))
    assert (training.model.num_features, training.model.smoothing) == best
    with pytest.raises(ValueError):
        triage.build_model(documents(spark, small), grid, folds=0)


def test_assign_ignores_case_and_keeps_unknown(spark):
    model = triage.train(tickets(spark), clean_corpus=False)
    accounts = spark.createDataFrame([("PLN", "Perusahaan Listrik"), ("pu", "Dinas PU")], "username string, name string")
    scored = triage.classify_tickets(tickets(spark).drop("assigned_to"), model, clean=False)
    rows = {r.id: (r.assigned_to, r.assigned_to_name) for r in triage.assign(scored, model, accounts).collect()}
    assert len(rows) == 6
    assert rows[1] == ("pln", "Perusahaan Listrik") and rows[3] == ("pdam", None) and rows[5] == ("pu", "Dinas PU")


def test_publish_and_fetch(spark, tmp_path):
    root = str(tmp_path / "models")
    with pytest.raises(LookupError):
        triage.latest_model(spark, root)
    triage.publish_model(triage.train(tickets(spark, ROWS[:4])), root, 1)
    triage.publish_model(triage.train(tickets(spark), smoothing=0.5), root, 2)
    model = triage.latest_model(spark, root)
    assert model.smoothing == 0.5 and model.documents().count() == 3


def test_metrics_of_a_small_matrix(spark):
    cells = [("a", "a", 4), ("a", "b", 1), ("b", "b", 2), ("b", "a", 2), ("c", "a", 1)]
    rows = [(label, prediction) for label, prediction, n in cells for _ in range(n)]
    row = evaluation.metrics_report(spark.createDataFrame(rows, "y string, p string"), "y", "p").first()
    assert row.accuracy == pytest.approx(0.6)
    assert row.weighted_precision == pytest.approx((5 * 4 / 7 + 4 * 2 / 3) / 10)
    assert row.weighted_true_positive_rate == pytest.approx(0.6)
    assert row.weighted_false_positive_rate == pytest.approx((5 * 3 / 5 + 4 * 1 / 6) / 10)
    f_a, f_b = 2 * (4 / 7) * 0.8 / (4 / 7 + 0.8), 2 * (2 / 3) * 0.5 / (2 / 3 + 0.5)
    assert row.weighted_f_measure == pytest.approx((5 * f_a + 4 * f_b) / 10)


def test_metrics_equal_the_ml_evaluator(spark, small):
    docs = spark.read.parquet(f"{small}/lineitem.parquet").selectExpr(
        "CAST(l_linenumber % 4 AS DOUBLE) AS label", "CAST(l_suppkey % 5 AS DOUBLE) AS prediction"
    )
    row = evaluation.metrics_report(docs, "label", "prediction").first()
    names = ("accuracy", "f1", "weightedPrecision", "weightedTruePositiveRate", "weightedFalsePositiveRate")
    for column, name in zip(evaluation.METRICS, names):
        theirs = MulticlassClassificationEvaluator(metricName=name).evaluate(docs)
        assert row[column] == pytest.approx(theirs, abs=1e-9)


def test_accuracy_pct(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "c")], "y string, p string")
    row = evaluation.accuracy_pct(rows, "y", "p").first()
    assert (row.n, row.n_correct, row.accuracy_pct) == (4, 3, 75.0)


def test_ml_form_predicts_and_persists(spark, small, tmp_path):
    docs = documents(spark, small)
    model = ml.classifier(docs).fit(docs)
    ml.publish(model, str(tmp_path / "ml"))
    again = ml.latest(str(tmp_path / "ml"))
    new = docs.drop("assigned_to")
    mine = [r.prediction_label for r in model.transform(new).orderBy("id").collect()]
    assert mine == [r.prediction_label for r in again.transform(new).orderBy("id").collect()]
    share = evaluation.accuracy_pct(model.transform(docs), "assigned_to", "prediction_label").first()
    assert share.accuracy_pct > 90


def test_ml_similarity_features(spark):
    for idf in (False, True):
        vector = ml.similarity_features(idf=idf).fit(tickets(spark)).transform(tickets(spark)).first().norm_features
        assert vector.norm(2) == pytest.approx(1.0)


def test_many_classes_keep_repeated_and_null_ids(spark):
    rows = [(i, f"word{i} common", f"c{i:03d}") for i in range(150)]
    model = triage.train(spark.createDataFrame(rows, "id bigint, description string, assigned_to string"), clean_corpus=False)
    asked = [(1, "word7 word7"), (1, "word99 word99"), (None, "word149"), (None, "nothing")]
    frame = spark.createDataFrame(asked, "id bigint, description string")
    for size, room in ((1, 0), (7, 2000), (1000, bayes.CACHE_BYTES)):
        vectors = with_terms(frame, "description", False)
        got = bayes.classify(vectors, model, part_buckets=size, cache_bytes=room).toPandas()
        assert len(got) == 4 and got.score.notna().all() and got.prediction[3] == got.prediction.min()


def test_nothing_that_travels_grows_with_the_classes(spark):
    from pyspark import cloudpickle

    sizes = []
    for number in (3, 3000):
        rows = spark.range(3000).selectExpr("id", "concat('common w', id % 100) AS description", f"concat('c', id % {number}) AS assigned_to")
        model = triage.train(rows, clean_corpus=False)
        assert model.documents().count() == number
        vectors = with_terms(rows, "description", False)
        scorer = bayes._scorer(*bayes.store(model), 1.0, 10, 10, vectors.schema, bayes.ALL, None)
        sizes.append(len(cloudpickle.dumps(scorer)))
    assert abs(sizes[0] - sizes[1]) < 100


def test_assign_replaces_and_keeps_names(spark):
    rows = [("alice", "old", "Old Name", "t"), ("bob", "old", "Old Name", "t")]
    scored = spark.createDataFrame(rows, "prediction string, assigned_to string, assigned_to_name string, title string")
    labels = spark.createDataFrame([(bayes.ALL, n, bayes.DOCUMENT, 1, 1) for n in ("alice", "bob")], "model int, label string, bucket int, tf bigint, docs bigint")
    accounts = spark.createDataFrame([("ALICE", "Alice A")], "username string, name string")
    got = triage.assign(scored, bayes.NaiveBayes(labels), accounts).orderBy("assigned_to").collect()
    assert [(r.assigned_to, r.assigned_to_name, r.title) for r in got] == [("alice", "Alice A", "t"), ("bob", "Old Name", "t")]


def test_a_class_missing_from_a_training_part_shifts_no_label(spark):
    rows = [(i, 3 * f"{label}{label} ", label, fold) for i, (label, fold) in enumerate(
        [("a", 0), ("a", 1), ("b", 0), ("c", 0), ("c", 1), ("d", 0), ("d", 1)] * 2)]
    labeled = spark.createDataFrame(rows, "id bigint, description string, assigned_to string, fold int")
    best, means = ml.cross_validate(labeled, (1000,), folds=2, fold="fold")
    # Fold 0 misses b, which only it holds: six of its eight rows are right. Fold 1 is all right.
    part = labeled.filter("fold = 1")
    model = ml.classifier(part, 1000).fit(part)
    found = model.transform(labeled.drop("assigned_to")).join(labeled.select("id", "assigned_to"), "id").collect()
    assert all(r.prediction_label == r.assigned_to for r in found if r.assigned_to != "b")
    assert 0.8 < means[0] < 1.0
    assert {r.prediction_label for r in best.transform(labeled).collect()} == set("abcd")


def test_a_model_keeps_its_stop_words(spark, tmp_path):
    rows = [(1, "yang lampu", "x"), (2, "yang lampu", "x"), (3, "banjir", "y"), (4, "banjir", "y")]
    labeled = spark.createDataFrame(rows, "id bigint, description string, assigned_to string")
    triage.publish_model(triage.train(labeled, stopwords=["yang"], drop_empty=False), str(tmp_path), 1)
    model = triage.latest_model(spark, str(tmp_path))
    assert (list(model.stopwords), model.drop_empty) == (["yang"], False)
    tickets = spark.createDataFrame([(9, "yang yang banjir")], "id bigint, description string")
    own = triage.classify_tickets(tickets, model).first()
    given = triage.classify_tickets(tickets, model, stopwords=["yang"], drop_empty=False).first()
    assert own == given and own.prediction == "y"


@pytest.mark.parametrize("dense", [0, 4, 10**6])
def test_tables_and_pairs_score_alike(spark, small, dense, monkeypatch):
    import numpy as np

    from ticketweave.functions.sidetables import read_side

    docs = documents(spark, small, "source").withColumn("fold", triage.fold_of())
    vectors = with_terms(docs, "description").persist()
    model = bayes.NaiveBayes(bayes.training_counts(bayes.class_counts(vectors, "assigned_to", "fold"), 3).persist())
    paths = bayes.store(model)
    monkeypatch.setattr(bayes, "DENSE", dense)
    rows = vectors.select("fold", "terms").limit(40).collect()
    offsets = np.cumsum([0] + [len(r.terms) for r in rows])
    pairs = np.array([tuple(t) for r in rows for t in r.terms]).reshape(-1, 2)
    used = np.array([r.fold for r in rows])
    scored = bayes._Model(*paths, 1.0, 500, 1 << 28).scores(used, offsets, pairs[:, 0], pairs[:, 1].astype(float))
    # The plain sum over the stored pairs.
    stored = {}
    for batch in read_side(paths[1], ["model", "bucket", "idf", "pairs"], 10**6):
        for r in batch.to_pylist():
            stored[r["model"], r["bucket"]] = (r["idf"], {p["class"]: p["mass"] for p in r["pairs"]})
    classes = {(r["model"], r["class"]): r for b in read_side(paths[0], ["model", "class", "prior", "tail"], 10**6) for r in b.to_pylist()}
    for i, row in enumerate(rows):
        for c in range(scored.shape[1]):
            if (row.fold, c) not in classes:
                assert scored[i, c] == -np.inf
                continue
            want = classes[row.fold, c]["prior"]
            for bucket, tf in row.terms:
                idf, masses = stored.get((row.fold, bucket), (0.0, {}))
                want += tf * idf * (classes[row.fold, c]["tail"] + (np.log1p(masses[c]) if c in masses else 0.0))
            assert scored[i, c] == pytest.approx(want, rel=1e-9)


def test_classes_that_share_their_words_are_kept_as_a_table(spark):
    rows = [(i, "alpha beta gamma" if i % 2 else "beta gamma delta", f"c{i % 40:02d}") for i in range(80)]
    model = triage.train(spark.createDataFrame(rows, "id bigint, description string, assigned_to string"), clean_corpus=False)
    kept = bayes._Model(*bayes.store(model), 1.0, 1, bayes.CACHE_BYTES).kept
    assert len(kept) == 1 and kept[0].dense is not None and kept[0].dense.shape[1] == 40
