"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

A mask such as ``1110111`` reads a window of words and ignores those under 0,
so two windows that differ only there get one hash. Every window of a document
is hashed under every mask and looked up among the windows of the test items.

``overlaps`` takes seeds so short that every stretch its rule accepts holds
one: a stretch of at least twice ``MIN_SPAN`` words has a half that is accepted
too, and of those below, 11 of 13 to 20 of 25 agreeing words always hold four
in a row or three, a gap and three. A hit only names a diagonal of a (document,
item) pair; the diagonal's words are then compared from end to end for its best
stretch.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Workspace

# Every stretch of MIN_SPAN words or more of which MIN_SHARE agree holds one of these.
SEEDS = ("1111", "1110111")
MIN_SPAN = 13
# An overlap counts with this many agreeing words, and this share of its span.
MIN_MATCHES = 11
MIN_SHARE = 0.8
# Windows of test items up to which they are sent to every task (at most 200 bytes each).
BROADCAST_WINDOWS = 100_000
SEPARATOR = r"[^\p{L}\p{N}]+"


def normalized_words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), SEPARATOR), lambda w: w != "")


def _windows(df: DataFrame, hashes: str, span: int, *keep: str) -> DataFrame:
    """One row per window: its position and the hashes w0..w{span - 1} of its words."""
    long_enough = df.filter(F.size(hashes) >= span)
    shifted = [F.slice(F.col(hashes), i + 1, F.size(hashes) - span + 1).alias(f"w{i}") for i in range(span)]
    return long_enough.select(*keep, F.posexplode(F.arrays_zip(*shifted)).alias("pos", "w")).select(
        *keep, "pos", *[F.col(f"w.w{i}").alias(f"w{i}") for i in range(span)]
    )


def _short_seeds(df: DataFrame, masks: Sequence[str], *keep: str) -> DataFrame:
    """Rows (keep, pos, seed) of each mask wherever it fits; of shorter texts one, of all their words."""
    parts = []
    for number, mask in enumerate(masks):
        hashed = F.xxhash64(F.lit(number), *[F.col(f"w{i}") for i, bit in enumerate(mask) if bit == "1"])
        parts.append(_windows(df, "hashes", len(mask), *keep).select(*keep, "pos", hashed.alias("seed")))
    size = F.size("hashes")
    tiny = df.filter((size > 0) & (size < len(masks[0])))
    parts.append(tiny.select(*keep, F.lit(0).alias("pos"), F.xxhash64(F.lit(-1), "hashes").alias("seed")))
    return reduce(DataFrame.unionByName, parts)


def _best_stretch(agree: str, span: int, share: float) -> Column:
    """(start, n_words, n_matches) of the stretch of ``agree`` with most true values; null without any.

    A stretch has at least ``span`` values, ``share`` of them true; n_words
    counts from its first true value to its last. Two pointers walk over the
    lows of the prefix sums and the last end that stays above each.
    """
    part = round(1000 * share)
    sums = f"aggregate({agree}, array(0L), (s, x) -> concat(s, array(element_at(s, -1) + IF(x, {1000 - part}L, -{part}L))))"
    lows = "aggregate(slice(p, 2, size(p)), array(0L), (s, x) -> concat(s, array(least(element_at(s, -1), x))))"
    highs = "reverse(aggregate(slice(reverse(p), 2, size(p)), array(element_at(p, -1)), (s, x) -> concat(s, array(greatest(element_at(s, -1), x)))))"
    count = f"CAST((element_at(v.p, t.b + 1) - element_at(v.p, t.a + 1) + {part}L * (t.b - t.a)) / 1000 AS INT)"
    better = f"element_at(v.p, t.a + 1) = element_at(v.lo, t.a + 1) AND t.b - t.a >= {span} AND {count} > t.m"
    start = "named_struct('a', 0, 'b', 0, 'm', 0, 'from', 0, 'to', 0)"
    step = f"""CASE WHEN t.a >= size(v.p) THEN t
      WHEN t.b + 1 < size(v.p) AND element_at(v.hi, t.b + 2) >= element_at(v.lo, t.a + 1)
      THEN named_struct('a', t.a, 'b', t.b + 1, 'm', t.m, 'from', t.from, 'to', t.to)
      WHEN {better} THEN named_struct('a', t.a + 1, 'b', t.b, 'm', {count}, 'from', t.a, 'to', t.b)
      ELSE named_struct('a', t.a + 1, 'b', t.b, 'm', t.m, 'from', t.from, 'to', t.to) END"""
    walk = f"aggregate(sequence(1, 2 * size(v.p)), {start}, (t, i) -> {step})"
    views = f"transform(transform(array({sums}), p -> named_struct('p', p, 'lo', {lows}, 'hi', {highs})), v -> {walk})[0]"
    cut = f"slice({agree}, w.from + 1, w.to - w.from)"
    ends = f"named_struct('f', array_position({cut}, true) - 1, 'l', array_position(reverse({cut}), true) - 1)"
    found = f"""transform(filter(array({views}), w -> w.m > 0), w -> transform(array({ends}), e -> named_struct(
      'start', CAST(w.from + e.f AS INT), 'n_words', CAST(w.to - w.from - e.f - e.l AS INT), 'n_matches', w.m))[0])"""
    return F.expr(f"get({found}, 0)")


def _named_items(items: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """Items of equal words once (rep, hashes), and which items each stands for (item_id, rep)."""
    tests = items.filter("item_id IS NOT NULL").select(
        F.col("item_id").alias("item_id"), F.transform(normalized_words(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes")
    )
    tests = work.write(tests.withColumn("same", F.xxhash64("hashes")), "items")
    distinct = tests.groupBy("same", "hashes").agg(F.min("item_id").alias("rep"))
    return distinct, tests.join(distinct.select("same", "hashes", "rep"), ["same", "hashes"]).select("item_id", "rep").distinct()


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.filter("doc_id IS NOT NULL").select(
        F.col("doc_id").alias("doc_id"), F.transform(normalized_words(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes")
    )


def overlaps(
    docs: DataFrame,
    items: DataFrame,
    min_matches: int = MIN_MATCHES,
    min_share: float = MIN_SHARE,
    min_span: int = MIN_SPAN,
    seeds: Sequence[str] = SEEDS,
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """Passages of test items in documents: (doc_id, item_id, doc_start, item_start, n_words, n_matches).

    ``docs`` has doc_id and text, ``items`` item_id and text. Positions count
    normalized words (lower-case runs of letters and digits) from 0. A passage
    is a stretch of at least ``min_span`` words, word by word against the item,
    with ``min_matches`` and ``min_share`` of them agreeing; every such stretch
    is found with the default values and seeds. n_words counts from its first
    agreeing word to its last. Items shorter than ``min_span`` count where all
    their words occur in a row, and those shorter than the first seed where they
    are the whole document. Each (document, item) pair has at most one row, its
    passage with most agreeing words; ties go to the smaller position in the
    document, then in the item.

    Null and empty texts match nothing. Rows with a null id are left out. Items
    of equal words are looked up once and all reported. Rows that repeat a
    doc_id count as one document. Further columns of either table are not used.
    """
    work = Workspace(docs.sparkSession, "decontaminate")
    distinct, named = _named_items(items, work)
    distinct = work.write(distinct.select("rep", "hashes"), "distinct")
    theirs = work.write(_short_seeds(distinct, seeds, "rep").withColumnRenamed("pos", "item_pos").distinct(), "seeds")
    few = theirs.count() <= broadcast_windows
    ours = _short_seeds(_hashed(docs), seeds, "doc_id")
    hits = ours.join(F.broadcast(theirs) if few else theirs, "seed")
    # A diagonal once, whatever number of hits it has.
    lines = work.write(hits.select("doc_id", "rep", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct(), "lines")
    found = _hashed(docs.join(lines.select("doc_id").distinct(), "doc_id", "left_semi"))
    theirs = distinct.withColumnRenamed("hashes", "item")
    pairs = lines.join(found, "doc_id").join(F.broadcast(theirs) if few else theirs, "rep")
    low = F.greatest(F.lit(0), -F.col("shift"))
    length = F.greatest(F.lit(0), F.least(F.size("item"), F.size("hashes") - F.col("shift")) - low)
    same = F.zip_with(F.slice("hashes", F.col("shift") + low + 1, length), F.slice("item", low + 1, length), lambda a, b: a == b)
    pairs = pairs.select("doc_id", "rep", "shift", low.alias("low"), F.size("item").alias("size"), F.size("hashes").alias("n"), same.alias("agree"))
    whole = (F.size("agree") == F.col("size")) & ~F.array_contains("agree", False)
    whole = whole & ((F.col("size") >= len(seeds[0])) | (F.col("size") == F.col("n")))
    entire = F.struct(F.lit(0).alias("start"), F.col("size").alias("n_words"), F.col("size").alias("n_matches"))
    stretch = F.when(F.col("size") < min_span, F.when(whole, entire)).otherwise(_best_stretch("agree", min_span, min_share))
    scored = pairs.select("doc_id", "rep", "shift", "low", "size", stretch.alias("s")).filter("s IS NOT NULL")
    scored = scored.filter((F.col("s.n_matches") >= min_matches) | (F.col("size") < min_span))
    start = F.col("low") + F.col("s.start")
    best = scored.groupBy("doc_id", "rep").agg(
        F.max(F.struct(F.col("s.n_matches").alias("n_matches"), (-F.col("shift") - start).alias("d"), (-start).alias("i"), F.col("s.n_words").alias("n_words"))).alias("b")
    )
    return _reported(best, named)


def _reported(best: DataFrame, named: DataFrame) -> DataFrame:
    return best.join(named, "rep").select(
        "doc_id", "item_id", (-F.col("b.d")).alias("doc_start"), (-F.col("b.i")).alias("item_start"),
        F.col("b.n_words").alias("n_words"), F.col("b.n_matches").alias("n_matches"),
    )


def remove_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no passage of a test item, all columns kept."""
    found = overlaps(docs, items, **options).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)
