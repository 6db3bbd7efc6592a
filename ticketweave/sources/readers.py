"""Loading tables and the two text corpora."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, *columns: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """A file-based table, pruned to ``columns`` when some are named."""
    reader = spark.read.format(fmt)
    if schema:
        reader = reader.schema(schema)
    df = reader.load(path)
    return df.select(*columns) if columns else df


def jdbc_options(
    url: str,
    table: str,
    user: str | None = None,
    password: str | None = None,
    driver: str | None = None,
    partition_column: str | None = None,
    lower: int | None = None,
    upper: int | None = None,
    partitions: int = 1,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Options of a JDBC read, cut into ``partitions`` ranges of a numeric column if given."""
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size)}
    for name, value in (("user", user), ("password", password), ("driver", driver)):
        if value is not None:
            options[name] = value
    if partition_column is not None:
        if lower is None or upper is None:
            raise ValueError("a partitioned read needs lower and upper bounds")
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(lower),
            "upperBound": str(upper),
            "numPartitions": str(partitions),
        }
    return options


def read_jdbc(spark: SparkSession, columns: list[str], **source) -> DataFrame:
    """A database table; ``columns`` and later filters are pushed to the database."""
    return spark.read.format("jdbc").options(**jdbc_options(**source)).load().select(*columns)


def read_if_present(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A Parquet table, or None if nothing has been written to the path yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def spread(df: DataFrame, *keys: str, source: DataFrame | None = None) -> DataFrame:
    """Redistribute rows whose scan gives fewer splits than there are cores.

    Text work is bound by the processor. A table of many files already has
    enough splits and passes through untouched. Name the plain scan as
    ``source`` when ``df`` has filters or joins on top of it, so that only the
    rows they keep are moved.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    splits = (df if source is None else source).rdd.getNumPartitions()
    return df if splits >= wanted else df.repartition(wanted, *keys)


def load_labeled(df: DataFrame, description: str, assigned_to: str, *keep: str) -> DataFrame:
    """Training corpus: ``description`` and ``assigned_to``, nulls as ''."""
    return df.select(
        *keep,
        F.coalesce(F.col(description), F.lit("")).alias("description"),
        F.coalesce(F.col(assigned_to), F.lit("")).alias("assigned_to"),
    )


def load_summary(df: DataFrame, id_column: str, description: str, *keep: str) -> DataFrame:
    """Similarity corpus: ``id`` and ``description`` as stored."""
    return df.select(F.col(id_column).alias("id"), F.col(description).alias("description"), *keep)
