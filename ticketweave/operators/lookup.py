"""Filters and lookups over the ticket tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def find_by(df: DataFrame, condition: Column) -> DataFrame:
    """Rows meeting any condition. A failing condition raises; it is not an empty result."""
    return df.filter(condition)


def equals(df: DataFrame, column: str, value) -> DataFrame:
    """Rows whose ``column`` equals ``value``; pushed down to the scan."""
    return df.filter(F.col(column) == F.lit(value))


def equals_ci(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows whose ``column`` equals ``value`` whatever the case."""
    return df.filter(F.lower(column) == value.lower())


def lookup_keys(df: DataFrame, keys: DataFrame, column: str, ignore_case: bool = False) -> DataFrame:
    """Rows whose key is in a table of keys, each row once."""
    if not ignore_case:
        return df.join(keys.select(column), column, "left_semi")
    wanted = keys.select(F.lower(column).alias("_key"))
    return df.join(wanted, F.lower(df[column]) == wanted["_key"], "left_semi")


def first_match(df: DataFrame, condition: Column, *order: str) -> DataFrame:
    """One matching row or none: the first in ``order``."""
    return df.filter(condition).orderBy(*order).limit(1)


def newest_first(df: DataFrame, column: str, value, time: str, tie: str) -> DataFrame:
    """History of one person or ticket, newest first."""
    return equals(df, column, value).orderBy(F.col(time).desc_nulls_first(), F.col(tie))


def by_login(df: DataFrame, provider_id: str, provider_key: str) -> DataFrame:
    """Accounts of a provider login: provider as given, key whatever the case."""
    return df.filter((F.col("provider_id") == provider_id) & (F.lower("provider_key") == provider_key.lower()))


def by_provider_and_email(df: DataFrame, provider_id: str, email: str) -> DataFrame:
    """Accounts of a provider with exactly this e-mail address."""
    return df.filter((F.col("provider_id") == provider_id) & (F.col("email") == email))


def by_username_or_email(df: DataFrame, username: str, email: str, email_as_given: bool = True) -> DataFrame:
    """Accounts with this user name or e-mail address, ignoring case.

    With ``email_as_given`` the given address is not lower-cased, so one with
    capitals matches nothing.
    """
    wanted = email if email_as_given else email.lower()
    return df.filter((F.lower("username") == username.lower()) | (F.lower("email") == wanted))


def not_expired(df: DataFrame, expires_at: str, as_of: datetime | Column, inclusive: bool = False) -> DataFrame:
    """Rows still valid at ``as_of``; ``inclusive`` also accepts the very moment."""
    moment = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return df.filter(F.col(expires_at) >= moment if inclusive else F.col(expires_at) > moment)


def with_expiry(df: DataFrame, created_at: str, hours: int = 1) -> DataFrame:
    """Add ``expires_at``, some hours after ``created_at``."""
    return df.withColumn("expires_at", F.col(created_at) + F.expr(f"INTERVAL {int(hours)} HOUR"))


def two_hop(df: DataFrame, middle: DataFrame, last: DataFrame, first_key: tuple[str, str], second_key: tuple[str, str]) -> DataFrame:
    """Follow two key references; rows without a match at either hop are left out."""
    return df.join(middle, F.col(first_key[0]) == F.col(first_key[1])).join(
        last, F.col(second_key[0]) == F.col(second_key[1])
    )
