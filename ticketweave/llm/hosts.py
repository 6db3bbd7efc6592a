"""Host reputation by empirical Bayes, and rules that come before it.

The share of good pages of a host is shrunk toward its registered domain's,
that toward its suffix's, that toward the share of all labelled pages. Each
level's beta-binomial prior has the parent's mean and a strength estimated by
moments from all groups of the level. A page is blocked when the posterior's
upper bound for its host is below the wanted share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Workspace

WANTED_SHARE = 0.7
# Standard deviations from the posterior mean to its bound (95 % one-sided).
DEVIATIONS = 1.6448536269514722
MIN_CORRELATION, MAX_CORRELATION = 0.001, 0.5
# Suffixes of two labels under which names are registered, where no table of suffixes is given.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br")
# Labels that a suffix of a table has at most.
MAX_LABELS = 5
BROADCAST_HOSTS = 100_000
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?`` or ``#``, A-Z in lower case; '' if there is none."""
    return F.translate(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), URL, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), URL, 2)


def suffix_of(host: Column, two_label: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(list(two_label)), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, two_label: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    """The suffix and one label more."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(list(two_label)), F.substring_index(host, ".", -3)).otherwise(two)


def registered(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """(host, domain, suffix) of the distinct hosts.

    ``suffixes`` (suffix) lists the suffixes under which names are registered,
    like ``co.uk``; the longest that fits counts, the last label if none does.
    Without it the last label and ``TWO_LABEL_SUFFIXES`` are such.
    """
    hosts = hosts.select("host").distinct()
    if suffixes is None:
        return hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    listed = suffixes.select(F.translate("suffix", UPPER, LOWER).alias("tail")).filter("tail <> ''").distinct()
    few = listed.count() <= BROADCAST_HOSTS
    labels = F.explode(F.sequence(F.lit(1), F.least(F.size(F.split("host", r"\.")), F.lit(MAX_LABELS)))).alias("labels")
    tails = hosts.select("host", labels).withColumn("tail", F.expr("substring_index(host, '.', -labels)"))
    longest = tails.join(F.broadcast(listed) if few else listed, "tail").groupBy("host").agg(F.max("labels").alias("labels"))
    named = hosts.join(longest, "host", "left").fillna(1, ["labels"])
    cut = lambda more: F.expr(f"substring_index(host, '.', -(labels + {more}))")
    return named.select("host", cut(1).alias("domain"), cut(0).alias("suffix"))


def matching_rule(host: Column, path: Column, rules: Sequence[str]) -> Column:
    """The longest of the rules (``host/path``) that fits; null if none does."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        found = F.when(fits, rule).otherwise(found)
    return found


def _shrunk(level: DataFrame, name: str) -> DataFrame:
    """Add the level's posterior (a, b) and mean to (name, n, y, mu), mu being the parent's mean."""
    spread = F.col("mu") * (1 - F.col("mu"))
    sums = level.agg(
        F.sum(F.pow(F.col("y") - F.col("n") * F.col("mu"), F.lit(2.0))).alias("seen"),
        F.sum(spread * F.col("n")).alias("plain"),
        F.sum(spread * F.col("n") * (F.col("n") - 1)).alias("scale"),
    ).first()
    correlation = (sums.seen - sums.plain) / sums.scale if sums.scale else MAX_CORRELATION
    strength = 1 / min(max(correlation, MIN_CORRELATION), MAX_CORRELATION) - 1
    a = F.lit(strength) * F.col("mu") + F.col("y")
    b = F.lit(strength) * (1 - F.col("mu")) + F.col("n") - F.col("y")
    return level.select(name, a.alias("a"), b.alias("b"), (a / (a + b)).alias("mean"))


def host_reputation(outcomes: DataFrame, hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """(host, mean, upper) for every host of ``hosts``, from outcomes (host, good).

    ``good`` is 0 or 1; other outcomes and null or empty hosts are ignored.
    A host without outcomes has its domain's mean, and so on upward; with no
    outcomes at all the mean is one half.
    """
    named = registered(hosts, suffixes)
    counts = outcomes.filter(F.col("good").isin(0, 1) & (F.col("host") != "")).groupBy("host").agg(
        F.count("*").cast("double").alias("n"), F.sum("good").cast("double").alias("y")
    )
    work = Workspace(hosts.sparkSession, "hosts")
    base = work.write(named.join(counts, "host", "left").fillna(0.0, ["n", "y"]), "counts")
    total = base.agg(F.sum("n").alias("n"), F.sum("y").alias("y")).first()
    overall = ((total.y or 0.0) + 1) / ((total.n or 0.0) + 2)
    suffixes = base.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).withColumn("mu", F.lit(overall))
    suffixes = _shrunk(suffixes, "suffix").select("suffix", F.col("mean").alias("mu"))
    domains = base.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).join(suffixes, "suffix")
    domains = _shrunk(work.write(domains, "domains"), "domain").select("domain", F.col("mean").alias("mu"))
    own = _shrunk(work.write(base.join(domains, "domain"), "own"), "host")
    size = F.col("a") + F.col("b")
    deviation = F.sqrt(F.col("a") * F.col("b") / (size * size * (size + 1)))
    return own.select("host", "mean", (F.col("mean") + DEVIATIONS * deviation).alias("upper"))


def judge(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: dict[str, str],
    wanted: float = WANTED_SHARE,
    suffixes: DataFrame | None = None,
) -> DataFrame:
    """A verdict for each row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, mean, upper.

    ``outcomes`` has page_id and good (0 or 1). ``rules`` maps ``host/path`` to
    ``allow`` or ``block``; a rule fits its host and all subdomains if the path
    starts with its path, and the longest one decides. Elsewhere a page is
    blocked when the upper bound of its host's share of good pages is below
    ``wanted``. ``suffixes`` is a table of public suffixes, as for ``registered``.

    A null url, or one without ``://``, has empty host and path, no rule and the
    verdict allow. Outcomes of absent pages count nowhere; every outcome row
    counts for each page row of its id. Rows with a null page_id are judged, but
    have no outcomes. Other columns are not used.
    """
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    work = Workspace(pages.sparkSession, "judge")
    parsed = work.write(parsed, "parsed")
    labelled = parsed.join(outcomes.select("page_id", "good"), "page_id").select("host", "good")
    known = work.write(host_reputation(labelled, parsed.filter("host <> ''"), suffixes), "reputation")
    few = known.count() <= BROADCAST_HOSTS
    joined = parsed.join(F.broadcast(known) if few else known, "host", "left")
    rule = matching_rule(F.col("host"), F.col("path"), list(rules))
    decided = F.create_map(*[F.lit(x) for pair in sorted(rules.items()) for x in pair])[F.col("rule")] if rules else F.lit(None)
    method = F.when(F.col("upper") < wanted, "block").otherwise("allow")
    return joined.withColumn("rule", rule).select(
        "page_id", "host", "path", "rule", F.coalesce(decided, method).alias("verdict"), "mean", "upper"
    )
