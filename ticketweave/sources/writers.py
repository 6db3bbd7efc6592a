"""Writing tables. Parquet tables are replaced by writing a new snapshot and announcing it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import read_if_present


def append_rows(df: DataFrame, path: str) -> None:
    """Add rows to a Parquet table."""
    df.write.mode("append").parquet(path)


def write_snapshot(df: DataFrame, root: str) -> str:
    """Write a new version of a table beside the old ones, then make it current.

    The old version stays readable throughout, so ``df`` may be derived from it.
    """
    spark = df.sparkSession
    number = (_newest(spark, root) or (0, ""))[0] + 1
    folder = f"{number:08d}-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/data/{folder}")
    row = spark.createDataFrame([(number, folder)], "number bigint, folder string")
    row.coalesce(1).write.mode("append").parquet(f"{root}/versions")
    return f"{root}/data/{folder}"


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The current version of a table."""
    newest = _newest(spark, root)
    if newest is None:
        raise LookupError(f"no snapshot under {root}")
    return spark.read.parquet(f"{root}/data/{newest[1]}")


def _newest(spark: SparkSession, root: str) -> tuple[int, str] | None:
    versions = read_if_present(spark, f"{root}/versions", "number bigint, folder string")
    if versions is None:
        return None
    row = versions.agg(F.max(F.struct("number", "folder")).alias("v")).first()
    return None if row.v is None else (row.v.number, row.v.folder)
