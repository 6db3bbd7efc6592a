"""Hashed term vectors, built without a shuffle.

A vector is ``terms: array<struct<bucket int, tf int>>`` sorted by bucket.
Texts that are cleaned go through an Arrow kernel, batch by batch; texts taken
as stored are tokenized, hashed, sorted and run-length counted by column
expressions. The long form ``(id, bucket, tf)`` is one ``inline_outer`` away.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import words_of
from .wordcounts import counter

NUM_FEATURES = 20_000


def bucket_of(word: Column, num_features: int = NUM_FEATURES) -> Column:
    """Bucket of a word: the first 32 bits of its MD5, modulo the feature count."""
    head = F.conv(F.substring(F.md5(word), 1, 8), 16, 10)
    return (head.cast("bigint") % num_features).cast("int")


def with_terms(
    df: DataFrame,
    text: str,
    clean: bool = True,
    stopwords: Iterable[str] = (),
    drop_empty: bool = True,
    num_features: int = NUM_FEATURES,
) -> DataFrame:
    """Replace column ``text`` by its term vector in a column ``terms``."""
    if not clean:
        return _terms_by_expressions(df, text, clean, stopwords, drop_empty, num_features)
    count = F.arrow_udf(counter(stopwords, drop_empty, num_features), "array<struct<bucket:int,tf:int>>")
    lowered = F.lower(F.coalesce(F.col(text), F.lit(""))).cast("binary")
    return df.select(*[c for c in df.columns if c != text], count(lowered).alias("terms"))


def _terms_by_expressions(
    df: DataFrame, text: str, clean: bool, stopwords: Iterable[str], drop_empty: bool, num_features: int
) -> DataFrame:
    """The vectors as column expressions, of cleaned texts too."""
    words = words_of(text, clean, stopwords, drop_empty)
    keep = [c for c in df.columns if c != text]
    # Each step is a projection of its own that later steps use more than once,
    # so Catalyst keeps it as a column instead of inlining it into the lambdas.
    hashed = df.select(
        *keep,
        F.sort_array(F.transform(words, lambda w: bucket_of(w, num_features))).alias("_sorted"),
    )
    runs = hashed.withColumn(
        "_starts",
        F.expr(
            "CASE WHEN size(_sorted) = 0 THEN array() ELSE filter(sequence(0, size(_sorted) - 1), "
            "i -> i = 0 OR _sorted[i] <> _sorted[i - 1]) END"
        ),
    )
    return runs.select(
        *keep,
        F.expr(
            "transform(_starts, (i, n) -> named_struct('bucket', _sorted[i], "
            "'tf', coalesce(get(_starts, n + 1), size(_sorted)) - i))"
        ).alias("terms"),
    )


def term_norm(terms: Column | str = "terms") -> Column:
    """Euclidean length of a term vector (exact: the squares are whole numbers)."""
    column = F.col(terms) if isinstance(terms, str) else terms
    squares = F.aggregate(
        column,
        F.lit(0).cast("bigint"),
        lambda acc, t: acc + t["tf"].cast("bigint") * t["tf"].cast("bigint"),
    )
    return F.sqrt(squares.cast("double"))


def long_form(df: DataFrame, *keep: str) -> DataFrame:
    """One row per (kept columns, bucket) with its count.

    The outer generator is deliberate: the inner one makes Catalyst infer a
    filter on the array and evaluate the whole text pipeline a second time.
    """
    columns = [F.col(c) for c in keep]
    return df.select(*columns, F.inline_outer("terms")).filter(F.col("bucket").isNotNull())


def normalized_long_form(df: DataFrame, *keep: str) -> DataFrame:
    """Long form with each count divided by the row's Euclidean length."""
    measured = df.withColumn("norm", term_norm())
    return long_form(measured, *keep, "norm").select(
        *keep, "bucket", "tf", (F.col("tf") / F.nullif(F.col("norm"), F.lit(0.0))).alias("weight")
    )
