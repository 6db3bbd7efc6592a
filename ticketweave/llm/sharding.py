"""Rendezvous hashing of record keys over weighted shards.

Every (key, shard) pair has a fixed pseudo-random draw u in (0, 1); the key goes
to the shard with the largest ``weight / -ln(u)``. A shard's draws do not depend
on the other shards, so an added shard takes keys only into itself, in
proportion to its weight, and a removed one gives up only its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows that one task numbers, as expected; the number of buckets follows the table.
ROWS_PER_BUCKET = 50_000
# Bits of the key's hash that order rows within a shard.
ORDER_BITS = 52


def hash52(value: Column) -> Column:
    """The first 52 bits of the MD5 of a string, as a whole number that a double holds exactly."""
    return F.conv(F.substring(F.md5(value), 1, ORDER_BITS // 4), 16, 10).cast("bigint")


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """Shard number of a key; ties go to the smaller number, a null key counts as one key."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    text = F.coalesce(key.cast("string"), F.lit("null"))
    scores = []
    for shard, weight in enumerate(weights):
        draw = (hash52(F.concat(text, F.lit(f":{shard}"))) + 0.5) / float(1 << ORDER_BITS)
        scores.append(F.struct((F.lit(float(weight)) / -F.log(draw)).alias("score"), F.lit(-shard).alias("shard")))
    best = F.array_max(F.array(*scores))
    return (-best["shard"]).cast("int")


def assign_shards(
    records: DataFrame, key: str, shards: int | Sequence[float], grown: float | None = None
) -> DataFrame:
    """Add ``shard``, ``slot`` and, if ``grown`` is a weight, ``grown_shard`` to every record.

    ``shards`` is a number of equal shards or their weights. ``slot`` numbers
    the records of a shard from 0 without gaps, in order of a hash of the key;
    records of equal keys get neighbouring slots in no particular order.
    ``grown_shard`` is the shard when one more of weight ``grown`` exists.

    Records with a null key all go to one fixed shard. Existing columns of these
    three names are replaced, all others are kept.

    The slots need no task that sees a whole shard: rows are numbered within
    hash ranges, whose number follows the size of the table, and the ranges'
    sizes are summed up. Only rows of one and the same key meet in one range;
    keys of records are expected to be close to unique.
    """
    weights = [1.0] * shards if isinstance(shards, int) else list(shards)
    column = F.col(key)
    kept = [c for c in records.columns if c not in ("shard", "slot", "grown_shard")]
    placed = records.select(F.struct(*kept).alias("row"), shard_of(column, weights).alias("shard"),
        (shard_of(column, [*weights, grown]) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        hash52(F.concat(F.coalesce(column.cast("string"), F.lit("null")), F.lit("#"))).alias("place"))
    return _numbered(placed, records.count()).select("row.*", "shard", "slot", "grown_shard")


def _numbered(placed: DataFrame, rows: int) -> DataFrame:
    ranges = max(1, rows // ROWS_PER_BUCKET)
    width = (1 << ORDER_BITS) // ranges + 1
    placed = placed.withColumn("range", (F.col("place") / width).cast("bigint"))
    sizes = placed.groupBy("shard", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "range").orderBy("place")
    numbered = placed.withColumn("_in", F.row_number().over(inside) - 1)
    return numbered.join(sizes, ["shard", "range"]).withColumn("slot", (F.col("first") + F.col("_in")).cast("bigint"))
