"""Mix sources to target weights: iterative proportional fitting, then sampling. DataFrame functions only.

Tokens are counted per cell, a combination of the dimensions' values. The cell
weights are raked: scaled to the target share of each value, one dimension
after the other, until all hold. No cell can give more tokens than it has, so
the targets are first brought within what each value holds, and every step of
the raking fills its value's cells up to their tokens at most. A document's
probability is its cell's filled share. Unless told how much to keep, the mixture
keeps the largest share of all tokens at which no value's target is out of reach.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Workspace
from .sharding import ORDER_BITS, hash52

ROUNDS = 10
# Rounds between two writes of the cells.
CUT_EVERY = 5
# Cells up to which they are raked in one task and sent to every task; beyond, they are shuffled by value and joined.
FEW_CELLS = 100_000
NULL = "\u0000null"
# Topic of a text: the first marker it holds.
TOPICS = (("contact", "@|://"), ("licence", "(?i)licen[sc]e"), ("table", r"\|"), ("number", "[0-9]"))


def topic_of(text: Column, topics=TOPICS) -> Column:
    """The name of the first pattern found in the text, otherwise ``prose``."""
    value = F.coalesce(text.cast("string"), F.lit(""))
    tests = reduce(lambda c, t: c.when(value.rlike(t[1]), t[0]), topics[1:], F.when(value.rlike(topics[0][1]), topics[0][0]))
    return tests.otherwise("prose")


def word_count(text: Column) -> Column:
    r"""Words ``[^\x20\x09-\x0D]+`` of a text; null has none."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def _sum(df: DataFrame, column: str) -> float:
    """One number: the sum of a column, 0 without rows."""
    return float(df.agg(F.coalesce(F.sum(column), F.lit(0)).alias("s")).first().s)


def tempered_shares(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """(value, share): the dimension's own token shares raised to a power; below 1 it lifts the rare values."""
    sums = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").alias("tokens"))
    raised = sums.filter("tokens > 0").withColumn("share", F.pow(F.col("tokens").cast("double"), F.lit(float(power))))
    return raised.select("value", (F.col("share") / F.lit(_sum(raised, "share") or 1.0)).alias("share"))


def largest_keep(cells: DataFrame, dimensions: list[str]) -> float:
    """The share of all tokens up to which every value holds what its target asks for; cells as for ``rake_within``."""
    total, least = _sum(cells, "tokens"), 1.0
    for d in dimensions:
        values = cells.groupBy(d).agg(F.sum("tokens").alias("held"), F.first(f"share_{d}").alias("share"))
        part = values.filter("share > 0 AND held > 0").agg(F.min(F.col("held") / (F.col("share") * total)).alias("m")).first().m
        least = least if part is None else min(least, part)
    return least


def _filled(df: DataFrame, wanted: Column, weight: str, capacity: str, by: list[str], ties: list[str]) -> DataFrame:
    """Add ``factor``: within each group, sum(min(capacity, factor * weight)) is ``wanted``; null where the whole capacity is needed.

    A group is sorted in one task: the cells of a value, or the values of a dimension, one short row each.
    """
    group = Window.partitionBy(*by)
    order = group.orderBy(F.desc(F.col(weight) / F.col(capacity)), *ties)
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    left = wanted - F.coalesce(F.sum(capacity).over(before), F.lit(0.0))
    tried = df.withColumn("tried", F.greatest(left, F.lit(0.0)) / F.sum(weight).over(rest))
    fits = F.max(F.when(F.col("tried") * F.col(weight) <= F.col(capacity), F.col("tried"))).over(group)
    needed = wanted >= F.sum(capacity).over(group) * (1 - 1e-12)
    return tried.withColumn("factor", F.when(~needed, fits)).drop("tried")


def rake_within(cells: DataFrame, dimensions: list[str], keep: float, work: Workspace, rounds: int = ROUNDS) -> DataFrame:
    """Add ``probability`` to cells (dimensions, tokens, share_<dimension>) so that expected tokens follow the shares at ``keep``.

    A value whose target exceeds its tokens is kept whole, and the others share
    the rest in proportion to their targets. What is left to a cell never
    exceeds its tokens, so the kept tokens follow the targets that can be reached.
    """
    shares = [F.coalesce(F.col(f"share_{d}"), F.lit(0.0)) for d in dimensions]
    usable = reduce(lambda a, b: a & b, [s > 0 for s in shares]) & (F.coalesce(F.col("tokens"), F.lit(0)) > 0)
    wanted = F.lit(_sum(cells, "tokens") * keep)
    marked = work.write(cells.withColumn("usable", usable), "marked")
    current = marked.filter("usable").withColumn("room", F.col("tokens").cast("double")).withColumn("weight", F.col("room"))
    for d in dimensions:
        values = marked.filter("usable").groupBy(d).agg(
            F.sum("tokens").cast("double").alias("held"), F.first(f"share_{d}").alias("share")
        )
        filled = _filled(values, wanted, "share", "held", [], [d])
        reached = F.coalesce(F.least("held", F.col("factor") * F.col("share")), F.col("held")).alias(f"goal_{d}")
        current = current.join(filled.select(d, reached), d)
    current = work.write(current, "goals")
    for turn in range(rounds):
        for d in dimensions:
            current = _filled(current, F.col(f"goal_{d}"), "weight", "room", [d], dimensions)
            scaled = F.coalesce(F.col("factor") * F.col("weight"), F.greatest("weight", "room"))
            current = current.withColumn("weight", scaled).drop("factor")
        if (turn + 1) % CUT_EVERY == 0:
            current = work.write(current, "filled")
    chance = current.select(*dimensions, F.least(F.lit(1.0), F.col("weight") / F.col("room")).alias("chance"))
    joined = marked.join(chance, dimensions, "left")
    return joined.select(*cells.columns, F.coalesce("chance", F.lit(0.0)).alias("probability"))


def shares(mixture: DataFrame, dimensions: list[str], power: float = 0.5, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """What a mixture reaches: (dimension, value, own, target, expected, largest_keep), shares of tokens.

    ``mixture`` is what ``mix`` returns and ``targets`` what it was given.
    ``largest_keep`` is the share of all tokens up to which the value's target
    can be met without repeating documents; the smallest of them bounds ``keep``.
    """
    kept = F.sum(F.col("tokens") * F.col("probability")).alias("kept")
    cells = mixture.groupBy("cell").agg(F.sum("tokens").alias("tokens"), kept).select("cell.*", "tokens", "kept")
    parts = []
    for d in dimensions:
        sums = cells.groupBy(F.col(d).alias("value")).agg(F.sum("tokens").alias("tokens"), F.sum("kept").alias("kept"))
        own = (F.col("tokens") / F.lit(_sum(sums, "tokens") or None)).alias("own")
        sums = sums.select("value", own, (F.col("kept") / F.lit(_sum(sums, "kept") or None)).alias("expected"))
        sums = sums.join(_target(cells, d, power, targets), "value", "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
        limit = F.least(F.lit(1.0), F.col("own") / F.nullif(F.col("share"), F.lit(0.0))).alias("largest_keep")
        parts.append(sums.select(F.lit(d).alias("dimension"), "value", "own", F.col("share").alias("target"), "expected", limit))
    return reduce(DataFrame.unionByName, parts)


def _target(cells: DataFrame, dimension: str, power: float, targets: dict[str, DataFrame] | None) -> DataFrame:
    given = (targets or {}).get(dimension)
    if given is None:
        return tempered_shares(cells, dimension, power)
    return given.select(F.coalesce(F.col("value").cast("string"), F.lit(NULL)).alias("value"), F.col("share").cast("double").alias("share"))


def mix(
    docs: DataFrame,
    dimensions: dict[str, Column],
    tokens: Column,
    key: Column,
    keep: float | None = None,
    power: float = 0.5,
    targets: dict[str, DataFrame] | None = None,
    rounds: int = ROUNDS,
    seed: str = "mix",
) -> DataFrame:
    """Sample documents so that expected tokens follow the target shares of every dimension.

    ``targets`` gives (value, share) tables by dimension; a dimension without
    one gets its own shares raised to ``power``. ``keep`` is the share of all
    tokens to keep in expectation, by default the ``largest_keep`` of the
    targets; targets beyond what a value holds at that share are met as far as
    they can be (``shares`` reports it). Returns a row for each document with
    ``row`` (a struct of all its columns), ``cell`` (its dimensions' values as
    text), ``tokens``, ``probability`` and ``kept``.

    A null value of a dimension is a value of its own. Values without a target
    share, and documents without tokens in a cell without any, have probability
    0. Rows that repeat a key are kept or dropped together. The draw is a hash
    of key and seed, so a repeated run keeps the same documents.
    """
    work = Workspace(docs.sparkSession, "mixing")
    names = list(dimensions)
    values = [F.coalesce(column.cast("string"), F.lit(NULL)).alias(name) for name, column in dimensions.items()]
    cell = F.struct(*values).alias("cell")
    counted = docs.select(cell, tokens.cast("bigint").alias("tokens"))
    cells = counted.groupBy("cell").agg(F.sum("tokens").alias("tokens")).select("cell.*", "tokens")
    cells = work.write(cells, "cells")
    few = cells.count() <= FEW_CELLS
    for name in names:
        given = _target(cells, name, power, targets)
        cells = cells.join(given.withColumnsRenamed({"value": name, "share": f"share_{name}"}), name, "left")
    cells = work.write(cells.coalesce(1) if few else cells, "targets")
    cells = cells.coalesce(1) if few else cells
    raked = rake_within(cells, names, largest_keep(cells, names) if keep is None else keep, work, rounds)
    chances = work.write(raked.select(F.struct(*names).alias("cell"), "probability"), "chances")
    placed = docs.select(F.struct(*docs.columns).alias("row"), cell, tokens.cast("bigint").alias("tokens"), key.cast("string").alias("key"))
    joined = placed.join(F.broadcast(chances) if few else chances, "cell")
    draw = (hash52(F.concat_ws(":", F.coalesce("key", F.lit("null")), F.lit(seed))) + 0.5) / float(1 << ORDER_BITS)
    return joined.select("row", "cell", "tokens", "probability", (draw < F.col("probability")).alias("kept"))
