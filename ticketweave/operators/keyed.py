"""Changes by key: each returns the changed table as a new DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .listing import latest_per_key


def upsert(base: DataFrame, changes: DataFrame, key: str, sequence: str | None = None) -> DataFrame:
    """Replace whole rows by key and add new ones.

    With ``sequence`` the batch may hold several rows of a key: the last counts.
    """
    # The raw batch says which keys change; only the new rows need the reduced one.
    untouched = base.join(changes.select(key), key, "left_anti").select(*base.columns)
    if sequence is not None:
        changes = latest_per_key(changes, key, [sequence]).drop(sequence)
    return untouched.unionByName(changes.select(*base.columns))


def delete_keys(df: DataFrame, keys: DataFrame, column: str, key_column: str | None = None) -> DataFrame:
    """Rows whose key is not listed; keys that do not exist are no error."""
    listed = keys.select(F.col(key_column or column).alias("_key"))
    return df.join(listed, F.col(column) == F.col("_key"), "left_anti")


def insert_with_ids(base: DataFrame, new: DataFrame, id_column: str, key: str) -> DataFrame:
    """Append rows and give them contiguous ids after the largest one in use, in the order of ``key``.

    ``key`` identifies a new row. The batch is cut into ranges of the key and
    written once, so that sizes and numbers speak of the same ranges; rows are
    numbered within a range, and each range starts where the one before ends.
    More rows make more ranges, and ids do not depend on their number.
    """
    ranged = new.repartitionByRange(F.col(key)).withColumn("_range", F.spark_partition_id())
    ranged = materialize(ranged, "ranged")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_size"))
    # The ids in use count as a range before the first one.
    used = base.agg(F.coalesce(F.max(id_column), F.lit(0)).cast("bigint").alias("_size"))
    sizes = sizes.unionByName(used.select(F.lit(-1).alias("_range"), "_size"))
    # One row per range: the only window over a whole table, and small enough to broadcast.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.sum("_size").over(before).alias("_start"))
    position = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    numbered = ranged.join(F.broadcast(starts), "_range").withColumn(id_column, F.col("_start") + position)
    return base.unionByName(numbered.select(*base.columns))


def append(base: DataFrame, *batches: DataFrame) -> DataFrame:
    """The table followed by more rows."""
    for batch in batches:
        base = base.unionByName(batch)
    return base


def _taken(accounts: DataFrame, column: str) -> DataFrame:
    return accounts.select(F.lower(column).alias("_taken")).filter(F.col("_taken").isNotNull())


def new_accounts(candidates: DataFrame, accounts: DataFrame) -> DataFrame:
    """Candidates whose user name and e-mail address are both free, ignoring case."""
    for column in ("username", "email"):
        taken = _taken(accounts, column)
        candidates = candidates.join(taken, F.lower(candidates[column]) == taken["_taken"], "left_anti")
    return candidates


def taken_accounts(candidates: DataFrame, accounts: DataFrame, id_column: str) -> DataFrame:
    """Ids of the candidates whose user name or e-mail address is in use.

    Two equality joins instead of one with OR, which could only be a loop over all pairs.
    """
    found = []
    for column in ("username", "email"):
        taken = _taken(accounts, column)
        hits = candidates.join(taken, F.lower(candidates[column]) == taken["_taken"], "left_semi")
        found.append(hits.select(id_column))
    return found[0].unionAll(found[1]).distinct()


def generated_username(provider_id: Column, provider_key: Column) -> Column:
    """A reproducible 30-character user name for a new profile."""
    return F.substring(F.sha2(F.concat_ws("|", provider_id, provider_key), 256), 1, 30)


def merge_profiles(accounts: DataFrame, profiles: DataFrame, as_of: Column) -> DataFrame:
    """Take over name, address and picture of known logins; add unknown ones as inactive.

    Logins match on provider and, ignoring case, key. ``profiles`` has one row per login.
    """
    incoming = profiles.select(
        F.col("provider_id").alias("_provider"),
        F.lower("provider_key").alias("_key"),
        F.struct("provider_key", "name", "email", "avatar_url").alias("_new"),
    )
    joined = accounts.join(
        incoming,
        (accounts["provider_id"] == incoming["_provider"]) & (F.lower(accounts["provider_key"]) == incoming["_key"]),
        "full_outer",
    )
    update, insert = F.col("_new").isNotNull(), F.col("username").isNull()
    taken_over = {c: F.when(update, F.col(f"_new.{c}")).otherwise(F.col(c)) for c in ("name", "email", "avatar_url")}
    generated = {
        "username": generated_username(F.col("_provider"), F.col("_new.provider_key")),
        "active": F.lit(False),
        "created_at": as_of,
        "provider_id": F.col("_provider"),
        "provider_key": F.col("_new.provider_key"),
    }
    columns = []
    for c in accounts.columns:
        if c in taken_over:
            columns.append(taken_over[c].alias(c))
        elif c in generated:
            columns.append(F.when(insert, generated[c]).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.col(c))
    return joined.select(*columns)


def activate(accounts: DataFrame, usernames: DataFrame) -> DataFrame:
    """Set ``active`` for the listed user names, ignoring case; unknown names do nothing."""
    listed = usernames.select(F.lower("username").alias("_listed")).distinct()
    joined = accounts.join(listed, F.lower(accounts["username"]) == listed["_listed"], "left")
    active = F.when(F.col("_listed").isNotNull(), F.lit(True)).otherwise(F.col("active"))
    return joined.select(*[active.alias(c) if c == "active" else F.col(c) for c in accounts.columns])


def rename_keys(accounts: DataFrame, renames: DataFrame) -> DataFrame:
    """Replace user names by ``renames`` (old_username, username), one row per old name."""
    mapping = renames.select(F.col("old_username").alias("_old"), F.col("username").alias("_new"))
    joined = accounts.join(mapping, accounts["username"] == mapping["_old"], "left")
    renamed = F.coalesce("_new", accounts["username"])
    return joined.select(*[renamed.alias(c) if c == "username" else accounts[c] for c in accounts.columns])


def purge(keys: DataFrame, key_column: str, tables: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Remove every row that belongs to the listed keys, ignoring case, from each table.

    ``tables`` gives (table, column that holds the key), dependants first.
    """
    listed = keys.select(F.lower(key_column).alias("_listed"))
    return {
        name: df.join(listed, F.lower(df[column]) == listed["_listed"], "left_anti")
        for name, (df, column) in tables.items()
    }


# Listed keys up to which they are sent to every task; more are filtered by a bitmap first.
BROADCAST_KEYS = 100_000
# Bits of the bitmap per key, and at most (32 MB): with more keys more rows pass it, never fewer.
BITS_PER_KEY = 32
MAX_BITS = 1 << 28
SLOT_BITS = 32_768


def key_bitmap(listed: DataFrame, bits: int) -> DataFrame:
    """(_slot, _bits): the hashes of ``_listed`` as a bitmap of ``bits`` bits, a row for each 4 KB of it."""
    place = F.pmod(F.xxhash64("_listed"), F.lit(bits)) + 1
    return listed.groupBy(F.bitmap_bucket_number(place).alias("_slot")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits")
    )


def _may_be_listed(df: DataFrame, key: Column, bitmap: DataFrame, bits: int) -> DataFrame:
    """(row, key, maybe) of each row of ``df``: maybe is false only where the key is certainly not listed."""
    marked = df.select(F.struct("*").alias("row"), key.alias("key"), F.pmod(F.xxhash64(key), F.lit(bits)).alias("place"))
    found = marked.join(F.broadcast(bitmap), F.expr(f"place DIV {SLOT_BITS} + 1") == F.col("_slot"), "left")
    inner = F.col("place") % SLOT_BITS
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (inner / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = found.withColumn("byte", byte)
    bit = F.expr("shiftright(byte, CAST(place % 8 AS INT)) & 1") == 1
    return found.select("row", "key", F.coalesce(bit & F.col("key").isNotNull(), F.lit(False)).alias("maybe"))


def purge_filtered(
    keys: DataFrame, key_column: str, tables: dict[str, tuple[DataFrame, str]], broadcast_keys: int = BROADCAST_KEYS
) -> dict[str, DataFrame]:
    """A ``purge`` for any number of keys, in which only rows that may go are shuffled.

    Up to ``broadcast_keys`` keys go to every task. Beyond, a bitmap of their
    hashes does, of checked size; the rows it lets through are joined with the
    keys, all others stay where they are read.
    """
    listed = materialize(keys.select(F.lower(key_column).alias("_listed")).filter("_listed IS NOT NULL").distinct(), "listed")
    number = listed.count()
    if number <= broadcast_keys:
        small = F.broadcast(listed)
        return {n: df.join(small, F.lower(df[c]) == F.col("_listed"), "left_anti") for n, (df, c) in tables.items()}
    bits = min(MAX_BITS, max(SLOT_BITS, BITS_PER_KEY * number))
    bitmap = materialize(key_bitmap(listed, bits), "bitmap")
    left = {}
    for name, (df, column) in tables.items():
        marked = _may_be_listed(df, F.lower(column), bitmap, bits)
        stays = marked.filter("NOT maybe").select("row.*")
        checked = marked.filter("maybe").join(listed, F.col("key") == F.col("_listed"), "left_anti").select("row.*")
        left[name] = stays.unionAll(checked)
    return left


def purge_report(keys: DataFrame, key_column: str, tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(table_name, n_removed, n_kept) of a ``purge`` with the same arguments, reading each table once."""
    listed = keys.select(F.lower(key_column).alias("_listed")).distinct()
    rows = []
    for name, (df, column) in tables.items():
        marked = df.select(F.lower(column).alias("_key")).join(listed, F.col("_key") == F.col("_listed"), "left")
        gone = F.count("_listed")
        rows.append(marked.agg(gone.alias("n_removed"), (F.count("*") - gone).alias("n_kept")).select(
            F.lit(name).alias("table_name"), "n_removed", "n_kept"
        ))
    return reduce(DataFrame.unionAll, rows)
