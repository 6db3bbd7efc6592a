"""Stored tables whose writes and reads touch only what they need.

``BucketedTable`` keeps rows in buckets of their key; a change replaces the
folders of the buckets it touches. ``SortedTable`` keeps rows in order; a page
reads the few parts it lies in. Both announce a version by one row in a small
table, after its files are written. One writer at a time.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import keyed, listing
from .readers import read_if_present

BUCKETS = 64
# Changed rows up to which the touched buckets are rewritten where they are read.
BROADCAST_CHANGES = 100_000
# Rows of a part of a sorted table, and of a file, which holds several parts where these are smaller.
ROWS_PER_PART = 100_000
ROWS_PER_FILE = 100_000
# A part's number is that of its file and, in the bits below, its place there.
FILE_SHIFT = 32

BUCKET_MANIFEST = "version bigint, key string, buckets int, schema string, folders map<int,string>"
SORT_MANIFEST = "columns array<struct<name:string,descending:boolean>>, schema string"


@dataclass(frozen=True)
class BucketedTable:
    """One version of a bucketed table."""

    spark: SparkSession
    root: str
    key: str
    buckets: int
    schema: str
    version: int
    folders: dict[int, str]

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        wanted = self.folders if buckets is None else [b for b in buckets if b in self.folders]
        paths = [f"{self.root}/data/{self.folders[b]}/bucket={b}" for b in sorted(wanted)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _write(self, rows: DataFrame, touched: list[int]) -> BucketedTable:
        """Write the touched buckets anew and announce the version that has them."""
        folder = uuid.uuid4().hex
        path = f"{self.root}/data/{folder}"
        rows.withColumn("bucket", self._bucket()).write.partitionBy("bucket").parquet(path)
        written = self.spark.read.schema(f"{self.schema}, bucket int").parquet(path).select("bucket").distinct().collect()
        kept = {b: f for b, f in self.folders.items() if b not in touched}
        new = replace(self, version=self.version + 1, folders=kept | {r.bucket: folder for r in written})
        row = (new.version, new.key, new.buckets, new.schema, new.folders)
        self.spark.createDataFrame([row], BUCKET_MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.root}/versions")
        return new

    def _touched(self, changes: DataFrame) -> list[int]:
        return [r.b for r in changes.select(self._bucket().alias("b")).distinct().collect()]

    def _rewritten(self, changes: DataFrame) -> tuple[DataFrame, list[int], DataFrame]:
        """The base rows of the buckets that change, those buckets, and the changed keys as the join should see them.

        Few changes travel to the base; only for many the touched buckets are shuffled.
        """
        touched = self._touched(changes)
        few = changes.limit(BROADCAST_CHANGES + 1).count() <= BROADCAST_CHANGES
        return self.read(touched), touched, F.broadcast(changes) if few else changes

    def upsert(self, changes: DataFrame, sequence: str | None = None) -> BucketedTable:
        """Replace whole rows by key and add new ones, as ``keyed.upsert``; the next version."""
        base, touched, joined = self._rewritten(changes)
        untouched = keyed.delete_keys(base, joined, self.key)
        if sequence is not None:
            changes = listing.latest_per_key(changes, self.key, [sequence]).drop(sequence)
        return self._write(untouched.unionByName(changes.select(*base.columns)), touched)

    def delete(self, keys: DataFrame) -> BucketedTable:
        """Remove the rows of the listed keys; the next version."""
        base, touched, joined = self._rewritten(keys)
        return self._write(keyed.delete_keys(base, joined, self.key), touched)


def create_bucketed(df: DataFrame, root: str, key: str, buckets: int = BUCKETS) -> BucketedTable:
    """Write a table in buckets of ``key``: the only time all rows are shuffled."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    table = BucketedTable(df.sparkSession, root, key, buckets, schema, 0, {})
    return table._write(df.repartition(buckets, table._bucket()), list(range(buckets)))


def open_bucketed(spark: SparkSession, root: str) -> BucketedTable:
    """The newest version."""
    versions = read_if_present(spark, f"{root}/versions", BUCKET_MANIFEST)
    row = None if versions is None else versions.orderBy(F.desc("version")).first()
    if row is None:
        raise LookupError(f"no table under {root}")
    return BucketedTable(spark, root, row.key, row.buckets, row.schema, row.version, dict(row.folders))


@dataclass(frozen=True)
class SortedTable:
    """A stored listing in order of ``columns``, (name, descending) pairs that together identify a row."""

    spark: SparkSession
    root: str
    columns: tuple[tuple[str, bool], ...]
    schema: str

    def _ranges(self) -> DataFrame:
        """(part, n, last): rows of each part and the sort values of its last row."""
        return self.spark.read.parquet(f"{self.root}/ranges")

    def parts_after(self, last: tuple | None, size: int) -> list[int]:
        """The parts that hold the ``size`` rows after the one with sort values ``last``."""
        ranges = self._ranges()
        if last is not None:
            # A part whose last row is beyond has rows beyond.
            ranges = ranges.filter(listing.beyond([(f"last.{n}", d) for n, d in self.columns], last))
        # Every part holds a row, so these are enough; of the first one, any number may lie before.
        parts, held = [], 0
        for row in ranges.select("part", "n").orderBy("part").limit(size + 1).collect():
            parts.append(row.part)
            held += row.n if len(parts) > 1 or last is None else 1
            if held >= size:
                break
        return parts

    def page_after(self, last: tuple | None, size: int) -> DataFrame:
        """The ``size`` rows after the one with sort values ``last``, or the first ones; reads the parts they lie in."""
        parts = self.parts_after(last, size)
        rows = self.spark.read.schema(f"{self.schema}, part bigint, file int").parquet(f"{self.root}/rows")
        files = sorted({part >> FILE_SHIFT for part in parts})
        rows = rows.filter(F.col("file").isin(files) & F.col("part").isin(parts)).drop("part", "file")
        if last is None:
            return rows.orderBy(*listing.order_of(list(self.columns))).limit(size)
        return listing.page_after(rows, list(self.columns), last, size)


def write_sorted(df: DataFrame, root: str, columns: list[tuple[str, bool]], rows_per_part: int = ROWS_PER_PART) -> SortedTable:
    """Write a table in order, in parts of ``rows_per_part`` rows.

    Nulls lead where a column descends and are last where it ascends. Files hold
    about ``ROWS_PER_FILE`` rows, or one part if that is larger: small parts add
    rows to the table of ranges, but no task, file or folder.
    """
    spark, order = df.sparkSession, listing.order_of(columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    files = df.count() // max(rows_per_part, ROWS_PER_FILE) + 1
    ordered = df.repartitionByRange(files, *order).withColumn("file", F.spark_partition_id()).sortWithinPartitions("file", *order)
    ordered = ordered.withColumn("_place", F.monotonically_increasing_id())
    # The lower 33 bits of that id count the rows of the partition.
    within = F.floor(F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) / F.lit(rows_per_part)).cast("bigint")
    ordered = ordered.withColumn("part", F.shiftleft(F.col("file").cast("bigint"), FILE_SHIFT) + within)
    ordered.write.partitionBy("file").parquet(f"{root}/rows")
    rows = spark.read.schema(f"{schema}, _place bigint, part bigint, file int").parquet(f"{root}/rows")
    last = F.max_by(F.struct(*[n for n, _ in columns]), "_place").alias("last")
    ranges = rows.groupBy("part").agg(F.count("*").alias("n"), last)
    ranges.coalesce(1).write.parquet(f"{root}/ranges")
    spark.createDataFrame([(list(columns), schema)], SORT_MANIFEST).coalesce(1).write.parquet(f"{root}/manifest")
    return open_sorted(spark, root)


def open_sorted(spark: SparkSession, root: str) -> SortedTable:
    manifest = read_if_present(spark, f"{root}/manifest", SORT_MANIFEST)
    if manifest is None:
        raise LookupError(f"no table under {root}")
    row = manifest.first()
    return SortedTable(spark, root, tuple((c.name, c.descending) for c in row.columns), row.schema)
