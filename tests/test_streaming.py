"""Streams give what the batch jobs give, also over several batches and a restart."""

import pytest
from pyspark.sql import functions as F

from ticketweave.operators import similarity
from ticketweave.plans import triage
from ticketweave.streaming import arrivals

SCHEMA = "id bigint, description string"


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").select(
        F.col("doc_id").alias("id"), F.col("text").alias("description"), F.col("lang").alias("assigned_to")
    )


def test_classify_stream(spark, docs, tmp_path):
    model = triage.train(docs)
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    new = docs.drop("assigned_to")
    new.filter("id < 120").repartition(3).write.parquet(source)
    stream = arrivals.read_arrivals(spark, source, SCHEMA, files_per_batch=2)
    arrivals.classify_stream(stream, model, out, checkpoint).awaitTermination()
    new.filter("id >= 120").write.mode("append").parquet(source)
    arrivals.classify_stream(stream, model, out, checkpoint).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == docs.count()
    assert got.exceptAll(triage.classify_tickets(new, model)).count() == 0


def test_similar_stream(spark, docs, tmp_path):
    index = triage.build_index(docs.drop("assigned_to"), str(tmp_path / "index"))
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    new = docs.drop("assigned_to").limit(30)
    new.repartition(3).write.parquet(source)
    stream = arrivals.read_arrivals(spark, source, SCHEMA, files_per_batch=1)
    arrivals.similar_stream(stream, index, out, checkpoint).awaitTermination()
    got = spark.read.schema(similarity.RESULT_SCHEMA).parquet(f"{out}/batch=*")
    want = triage.find_similar(new, index)
    assert got.count() == 330 and got.exceptAll(want).count() == 0


def test_stream_takes_a_model_of_many_classes(spark, docs, tmp_path):
    rows = [(i, f"kata{i}", f"desk{i}") for i in range(300)]
    model = triage.train(spark.createDataFrame(rows, "id bigint, description string, assigned_to string"))
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    new = docs.drop("assigned_to")
    new.write.parquet(source)
    stream = arrivals.read_arrivals(spark, source, SCHEMA)
    arrivals.classify_stream(stream, model, out, checkpoint).awaitTermination()
    assert spark.read.parquet(out).count() == docs.count()


def test_index_stream_adds_each_batch_once(spark, docs, tmp_path):
    from ticketweave.plans import index as ix

    source, root, checkpoint = (str(tmp_path / n) for n in ("in", "index", "checkpoint"))
    new = docs.drop("assigned_to")
    new.repartition(3, "id").write.parquet(source)
    run = lambda checkpoint: arrivals.index_stream(
        arrivals.read_arrivals(spark, source, SCHEMA, files_per_batch=1), root, checkpoint
    ).awaitTermination()
    run(checkpoint)
    index = ix.open_index(spark, root)
    assert (index.batch, len(index.segments), index.n_docs) == (2, 3, docs.count())
    # A stream that lost its checkpoint sends everything again, in batches the manifest knows.
    run(str(tmp_path / "another"))
    assert ix.open_index(spark, root) == index
    # The same tickets under later batch numbers hold no new ids.
    new.limit(50).write.mode("append").parquet(source)
    run(checkpoint)
    after = ix.open_index(spark, root)
    assert (after.batch, after.segments) == (3, index.segments)
    got = ix.search_index(new.limit(20), after, 5)
    assert got.exceptAll(triage.find_similar(new.limit(20), after.vectors(), 5)).count() == 0


def test_replayed_tickets_come_once(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    rows = lambda ids, at: spark.createDataFrame([(i, f"kata {i}", at) for i in ids], "id bigint, description string, at int")
    timed = lambda df: df.withColumn("at", F.timestamp_seconds(F.col("at") + 1_700_000_000))
    for ids, at in ((range(5), 0), ([1, 2, 7], 50), ([None, None], 60)):
        timed(rows(ids, at)).coalesce(1).write.mode("append").parquet(source)
    schema = "id bigint, description string, at timestamp"

    def run():
        once = arrivals.first_arrivals(arrivals.read_arrivals(spark, source, schema, files_per_batch=1), "at", "1 hour")
        once.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.id for r in spark.read.parquet(out).collect() if r.id is not None)

    assert run() == [0, 1, 2, 3, 4, 7]
    timed(rows([0, 7, 8], 100)).coalesce(1).write.mode("append").parquet(source)
    assert run() == [0, 1, 2, 3, 4, 7, 8]
    # Beyond the delay a key is forgotten, and rows older than the watermark are dropped.
    timed(rows([9], 90_000)).coalesce(1).write.mode("append").parquet(source)
    assert run() == [0, 1, 2, 3, 4, 7, 8, 9]
    timed(rows([3, 4], 200)).coalesce(1).write.mode("append").parquet(source)
    assert run() == [0, 1, 2, 3, 4, 7, 8, 9]


@pytest.mark.parametrize("files", [1, 3])
def test_a_table_arrives_as_file_or_folder(spark, docs, tmp_path, files):
    path, new = str(tmp_path / "documents.parquet"), docs.drop("assigned_to")
    new.repartition(files).write.parquet(path)
    if files == 1:
        (path,) = spark.read.parquet(path).inputFiles()
    stream = arrivals.read_table_arrivals(spark, path, SCHEMA)
    out = str(tmp_path / "out")
    arrivals.classify_stream(stream, triage.train(docs), out, str(tmp_path / "checkpoint")).awaitTermination()
    assert spark.read.parquet(out).count() == docs.count()


def test_stream_classify_reads_a_folder_of_files(spark, small, tmp_path):
    from ticketweave.plans import registry

    registry.load_all()
    for name in ("documents", "labels"):
        spark.read.parquet(f"{small}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    got, want = (registry.QUERIES["stream_classify"](spark, folder) for folder in (str(tmp_path), small))
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0
