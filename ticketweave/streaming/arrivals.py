"""Tickets scored and compared as they arrive."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import bayes
from ..plans import index as stored
from ..plans import triage


def read_arrivals(
    spark: SparkSession, folder: str, schema: str, pattern: str | None = None, fmt: str = "parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """A stream of the files that appear in a folder (those matching ``pattern``, if given)."""
    reader = spark.readStream.format(fmt).schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    return reader.load(folder)


def read_table_arrivals(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table as a stream of its files, whether ``path`` is one file or a folder of them."""
    # A stream's source must be a folder or a glob, and a glob also takes a single file.
    return read_arrivals(spark, f"{path[:-1]}[{path[-1]}]", schema)


def first_arrivals(arrivals: DataFrame, time: str, delay: str, key: str = "id") -> DataFrame:
    """Each ticket once, however often its row arrives again.

    State holds the keys seen within ``delay`` of the newest ``time`` and is part
    of the stream's checkpoint, so a restart remembers them. A row older than
    that is dropped whether seen or not: ``delay`` is how late a first arrival
    may be. Rows without a key count as one ticket.
    """
    return arrivals.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def classify_stream(
    arrivals: DataFrame,
    model: bayes.NaiveBayes,
    out: str,
    checkpoint: str,
    clean: bool = True,
    stopwords: Iterable[str] | None = None,
    partitions: int | None = None,
) -> StreamingQuery:
    """Classify each arriving ticket (id, description, ...) and append it to a Parquet table.

    Scoring keeps no state, and the file sink records each batch once. Give
    ``partitions`` when a batch comes in fewer files than there are cores.
    """
    if partitions:
        arrivals = arrivals.repartition(partitions)
    scored = triage.classify_tickets(arrivals, model, clean, stopwords)
    return (
        scored.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def similar_stream(
    arrivals: DataFrame,
    index: DataFrame | stored.TicketIndex,
    out: str,
    checkpoint: str,
    k: int = 11,
    stopwords: Iterable[str] | None = None,
) -> StreamingQuery:
    """Find the similar indexed tickets of each arriving one.

    A table of vectors is read whole by every batch; of a stored index only the
    postings that the batch needs, with the index's own settings. Every batch is written to a folder named after its number and replaces what
    an interrupted attempt left there, so a replayed batch is not counted twice.
    """

    def handle(batch: DataFrame, number: int) -> None:
        if isinstance(index, stored.TicketIndex):
            found = stored.search_index(batch, replace(index, spark=batch.sparkSession), k, stopwords=stopwords)
        else:
            found = triage.find_similar(batch, index, k, stopwords=stopwords or ())
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        arrivals.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def index_stream(
    arrivals: DataFrame,
    root: str,
    checkpoint: str,
    settings: stored.Settings = stored.Settings(),
    stream: str = "arrivals",
    shard_docs: int | None = None,
) -> StreamingQuery:
    """Add arriving tickets (id, description) to the index under ``root``, a segment per batch.

    The manifest records the last batch of the stream along with the segments,
    in one row: a batch that is tried again either has all or nothing in the
    index, and is skipped or redone. Of rows with one id in a batch that of the
    smallest text is taken; ids the index holds already are left out.
    """
    options = {} if shard_docs is None else {"shard_docs": shard_docs}

    def handle(batch: DataFrame, number: int) -> None:
        tickets = batch.groupBy("id").agg(F.min("description").alias("description")).filter("id IS NOT NULL")
        try:
            index = stored.open_index(batch.sparkSession, root)
        except LookupError:
            index = stored.create_index(tickets.filter("false"), root, settings)
        if index.settings != settings:
            raise ValueError("the index was made with other settings")
        if index.stream != stream or index.batch is None or index.batch < number:
            stored.append_index(tickets, index, stream=stream, batch=number, **options)

    return (
        arrivals.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
