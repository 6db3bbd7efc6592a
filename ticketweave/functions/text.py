"""Cleaning and tokenizing as built-in column expressions (no Python per row)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .wordlists import CLEANING_RULES

# What "\\s" matches in a Java regular expression.
WHITESPACE = " \t\n\x0b\f\r"


def _as_column(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def normalize_text(text: Column | str) -> Column:
    """Lower-case, apply the rewrite rules in order and trim; null becomes ''."""
    out = F.lower(F.coalesce(_as_column(text), F.lit("")))
    for kind, pattern, replacement in CLEANING_RULES:
        if kind == "text":
            out = F.replace(out, F.lit(pattern), F.lit(replacement))
        else:
            out = F.regexp_replace(out, pattern, replacement)
    return F.trim(out)


def drop_words(words: Column, stopwords: Iterable[str]) -> Column:
    """Remove every listed word from an array of words."""
    listed = sorted(set(stopwords))
    return F.filter(words, lambda w: ~w.isin(listed)) if listed else words


def clean_text(text: Column | str, stopwords: Iterable[str] = ()) -> Column:
    """The whole cleaning: rewrite, trim, then drop stop words."""
    return F.array_join(drop_words(F.split(normalize_text(text), " "), stopwords), " ")


def remove_stopwords(text: Column | str, stopwords: Iterable[str] = ()) -> Column:
    """Drop stop words from a text whose words are separated by single spaces."""
    return F.array_join(drop_words(F.split(_as_column(text), " "), stopwords), " ")


def tokenize(text: Column | str, drop_empty: bool = True) -> Column:
    """Lower-case and split at each white space character.

    As in ``pyspark.ml.feature.Tokenizer``, leading and inner empty tokens are
    kept when ``drop_empty`` is false, trailing ones never are.
    """
    lowered = F.lower(F.coalesce(_as_column(text), F.lit("")))
    stripped = F.rtrim(lowered, F.lit(WHITESPACE))
    words = F.split(stripped, r"\s")
    if drop_empty:
        return F.filter(words, lambda w: w != "")
    only_space = (stripped == "") & (lowered != "")
    return F.when(only_space, F.array().cast("array<string>")).otherwise(words)


def words_of(
    text: Column | str,
    clean: bool = True,
    stopwords: Iterable[str] = (),
    drop_empty: bool = True,
) -> Column:
    """Tokens of a description, cleaned first unless ``clean`` is false.

    Cleaned text holds only ``[a-z ]``, so its words are taken from the cleaned
    array directly instead of being joined and split again. With ``drop_empty``
    false an emptied text keeps one empty token, as the tokenizer gives it.
    """
    if not clean:
        return tokenize(text, drop_empty)
    if not drop_empty:
        return tokenize(clean_text(text, stopwords), drop_empty)
    return drop_words(F.split(normalize_text(text), " "), [*stopwords, ""])
