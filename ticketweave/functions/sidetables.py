"""Tables in the shared folder that tasks read by themselves, a block at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import work_path


def write_side(df: DataFrame, name: str) -> str:
    """Write a table for the tasks of a later job to read; its path."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def read_side(path: str, columns: list[str], rows: int) -> Iterator[pa.RecordBatch]:
    """The table's rows in the order they were written, at most ``rows`` at a time; runs inside tasks.

    Any folder that Arrow's file systems reach will do: a mounted one, hdfs, s3, gs.
    """
    from pyarrow import dataset, fs

    system, folder = fs.FileSystem.from_uri(path.replace("s3a://", "s3://"))
    held, count = [], 0
    table = dataset.dataset(folder, filesystem=system, format="parquet")
    # Read little ahead: a task holds a block, not the table.
    for batch in table.to_batches(columns=columns, batch_size=rows, batch_readahead=1, fragment_readahead=1):
        # Files end with short batches: fill each block before it goes out.
        while batch.num_rows:
            part = batch.slice(0, rows - count)
            batch = batch.slice(part.num_rows)
            held.append(part)
            count += part.num_rows
            if count == rows:
                yield _joined(held)
                held, count = [], 0
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
