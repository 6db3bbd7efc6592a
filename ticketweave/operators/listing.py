"""Counts, sorted listings and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest(time: str, tie: str) -> list[Column]:
    """Newest first; rows without a time lead, as in a descending database sort."""
    return [F.col(time).desc_nulls_first(), F.col(tie).asc_nulls_last()]


def ascending(*columns: str) -> list[Column]:
    """Ascending with nulls last, text in byte order."""
    return [F.col(c).asc_nulls_last() for c in columns]


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 0) of a sorted listing; empty past the end.

    Costs grow with the page number, since every task keeps the rows before it:
    for deep pages use ``page_after``.
    """
    return df.orderBy(*order).offset(number * size).limit(size)


def order_of(columns: list[tuple[str, bool]]) -> list[Column]:
    """The order of (name, descending) pairs, as in ``newest`` and ``ascending``."""
    return [F.col(n).desc_nulls_first() if descending else F.col(n).asc_nulls_last() for n, descending in columns]


def beyond(columns: list[tuple[str, bool]], last: tuple) -> Column:
    """Whether a row comes after the one with sort values ``last``."""
    later, same = [], F.lit(True)
    for (name, descending), value in zip(columns, last):
        column = F.col(name)
        if value is None:
            after = column.isNotNull() if descending else F.lit(False)
        else:
            after = column < F.lit(value) if descending else (column > F.lit(value)) | column.isNull()
        later.append(same & after)
        same = same & column.eqNullSafe(F.lit(value))
    return reduce(Column.__or__, later)


def page_after(df: DataFrame, columns: list[tuple[str, bool]], last: tuple, size: int) -> DataFrame:
    """The page that follows the row with sort values ``last``, whatever the depth.

    ``columns`` are (name, descending) pairs that together identify a row. Nulls
    lead where a column descends and are last where it ascends, as in ``newest``
    and ``ascending``. The bound is an ordinary filter that reaches the scan;
    ``sources.stored.SortedTable`` also bounds what is read beyond it.
    """
    return df.filter(beyond(columns, last)).orderBy(*order_of(columns)).limit(size)


def counts(**tables: DataFrame) -> DataFrame:
    """(table_name, n): row count of every given table."""
    rows = [
        df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()
    ]
    return reduce(DataFrame.unionAll, rows)


def latest_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row per key in ``order`` (ascending; the columns must settle ties).

    An aggregation with map-side combine, so a key holding a large share of the
    rows is reduced where it is read. Columns that hold maps, which have no
    order, are carried along; ties are settled by all others.
    """
    sortable = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    rest = [c for c in sortable if c != key and c not in order]
    newest_row = F.max_by(F.struct(*[c for c in df.columns if c != key]), F.struct(*order, *rest)).alias("_row")
    columns = [F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in df.columns]
    return df.groupBy(key).agg(newest_row).select(*columns)


def timeline(tickets: DataFrame, milestones: DataFrame, key: str, milestone_key: str, order: list[str]) -> DataFrame:
    """Every ticket with its latest milestone, if it has one."""
    latest = latest_per_key(milestones, milestone_key, order)
    return tickets.join(latest, tickets[key] == latest[milestone_key], "left")
