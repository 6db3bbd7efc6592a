"""The registered queries of this subpackage, each over its whole table, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Workspace
from . import ann, decontaminate, hosts, licenses, lines, mixing, neardup, quality, resample, sharding, substring, trie, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


SUBSTRING_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), win AS (
  SELECT doc_id, s, array_to_string(words[s : s + 12], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS s FROM w)
), firsts AS (SELECT win, min(doc_id) AS first FROM win GROUP BY win),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS p
  FROM win JOIN firsts USING (win) WHERE doc_id > first
), gone_lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(len(ps), 0) AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN words
    ELSE list_filter(words, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone_lists USING (doc_id)
"""


@query("op1_substring_dedup", SUBSTRING_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    cut = substring.remove_repeats(table(spark, folder, "documents"), keep_text=False)
    return cut.select("doc_id", "n_words", "n_removed", "kept_sha256")


NEARDUP_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) < 2 THEN words
    ELSE list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) END AS shingles
  FROM w
), x AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS n_both
  FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id
), link AS (SELECT a, b FROM common WHERE 100 * n_both >= 80 * (na + nb - n_both)),
reach AS (
  SELECT doc_id, doc_id AS other FROM s
  UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.other
)
SELECT s.doc_id, any_value(len(shingles)) AS n_shingles, min(other) AS component_id, s.doc_id = min(other) AS kept
FROM s JOIN reach USING (doc_id) GROUP BY s.doc_id
"""


@query("op4_minhash_neardup", NEARDUP_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"), shingle=2)


def _draw(key: str, shard: str) -> str:
    return f"((('0x' || substr(md5({key} || ':' || {shard}), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"


# The CRC-32 by its table of 256 steps: ``crc`` has one row, the list ``crcs``.
CRC_TABLE = """crc AS (
  SELECT list(list_reduce(list_prepend(k, range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY k) AS crcs
  FROM (SELECT unnest(range(256)) AS k)
)"""


def crc32_sql(text: str) -> str:
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
    regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])))"""


SHARDING_SQL = f"""
WITH p AS (
  SELECT doc_id, s, 1.0 / -ln({_draw("doc_id", "s")}) AS score
  FROM documents, (SELECT unnest(range(9)) AS s)
), best AS (
  SELECT doc_id, arg_max(s, score) FILTER (s < 8) AS shard, arg_max(s, score) AS grown FROM p GROUP BY doc_id
), {CRC_TABLE}
SELECT d.doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
  {crc32_sql("coalesce(text, '')")} AS text_crc32, 'key' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5(d.doc_id || '#')) - 1 AS slot, grown::INT AS grown_shard
FROM documents d JOIN best USING (doc_id), crc
"""


@query("op2_rendezvous_sharding", SHARDING_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    sized = table(spark, folder, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    return sharding.assign_shards(sized, "doc_id", 8, grown=1.0)


_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
# The rule itself, without seeds: every diagonal with enough equal words, every stretch of it.
DECONTAMINATE_SQL = f"""
WITH d AS (SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
b AS (SELECT item_id, w, len(w) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)),
dw AS (SELECT doc_id, n, unnest(range(n)) AS p, unnest(w) AS word FROM d),
bw AS (SELECT item_id, n AS size, unnest(range(n)) AS q, unnest(w) AS word FROM b),
lines AS MATERIALIZED (
  SELECT doc_id, item_id, p - q AS shift, n, size, list(q ORDER BY q) AS same, count(*) AS hits
  FROM dw JOIN bw USING (word) GROUP BY doc_id, item_id, p - q, n, size
  HAVING count(*) >= {decontaminate.MIN_MATCHES} AND size >= {decontaminate.MIN_SPAN} OR count(*) = size
), ends AS (
  SELECT *, unnest(range(greatest(0, -shift), least(size, n - shift))) AS a FROM lines WHERE size >= {decontaminate.MIN_SPAN}
), stretches AS (
  SELECT doc_id, item_id, shift, list_filter(same, lambda q: q >= a AND q < z) AS found FROM (
    SELECT *, unnest(range(a + {decontaminate.MIN_SPAN}, least(size, n - shift) + 1)) AS z FROM ends)
  WHERE len(found) >= {decontaminate.MIN_MATCHES} AND 10 * len(found) >= {round(10 * decontaminate.MIN_SHARE)} * (z - a)
), good AS (
  SELECT doc_id, item_id, shift, found[1] AS item_start, found[-1] - found[1] + 1 AS n_words, len(found) AS n_matches FROM stretches
  UNION ALL SELECT doc_id, item_id, shift, 0, size, size FROM lines
  WHERE size < {decontaminate.MIN_SPAN} AND hits = size AND (size >= {len(decontaminate.SEEDS[0])} OR size = n)
)
SELECT doc_id, item_id, (shift + item_start)::INT AS doc_start, item_start::INT AS item_start,
  n_words::INT AS n_words, n_matches::INT AS n_matches
FROM good
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_matches DESC, shift + item_start, item_start) = 1
"""


@query("op5_decontamination", DECONTAMINATE_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def _mixing_sql() -> str:
    """Raking within the cells' tokens written out: one CTE per round and dimension."""
    dims = ("source", "lang", "topic")
    topics = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in mixing.TOPICS)
    parts = [
        f"""d AS (SELECT doc_id, coalesce(source, '<null>') AS source, coalesce(lang, '<null>') AS lang,
  CASE {topics} ELSE 'prose' END AS topic, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS tokens
  FROM (SELECT *, coalesce(text, '') AS t FROM documents))""",
        "c AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM d GROUP BY ALL HAVING sum(tokens) > 0)",
    ]
    for x in dims:
        parts.append(f"t_{x} AS (SELECT {x}, sqrt(sum(tokens)) / sum(sqrt(sum(tokens))) OVER () AS share_{x} FROM c GROUP BY {x})")
    joined = " ".join(f"JOIN t_{x} USING ({x})" for x in dims)
    parts.append(f"cell AS MATERIALIZED (SELECT *, sum(tokens) OVER () AS total FROM c {joined})")
    held = " UNION ALL ".join(f"SELECT sum(tokens) / (any_value(share_{x}) * any_value(total)) AS most FROM cell GROUP BY {x}" for x in dims)
    parts.append(f"keep AS (SELECT least(1.0, min(most)) AS keep FROM ({held}))")
    # Each value's goal, then the cells of a value filled to it, one dimension after the other.
    filled = """greatest({wanted} - coalesce(sum({room}) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)
  / sum({weight}) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tried"""
    for x in dims:
        tried = filled.format(wanted="wanted", room="held", weight="share")
        parts += [
            f"""v_{x} AS (SELECT {x}, any_value(share_{x}) AS share, sum(tokens) AS held, any_value(total) * any_value(keep) AS wanted
  FROM cell, keep WHERE tokens > 0 GROUP BY {x})""",
            f"w_{x} AS (SELECT *, {tried} FROM v_{x} WINDOW o AS (ORDER BY share / held DESC, {x}))",
            f"""g_{x} AS (SELECT {x}, coalesce(least(held, CASE WHEN wanted < sum(held) OVER () * (1 - 1e-12)
  THEN max(tried) FILTER (tried * share <= held) OVER () END * share), held) AS goal_{x} FROM w_{x})""",
        ]
    goals = " ".join(f"JOIN g_{x} USING ({x})" for x in dims)
    parts.append(f"r0 AS MATERIALIZED (SELECT source, lang, topic, tokens AS room, tokens AS weight, goal_source, goal_lang, goal_topic FROM cell {goals})")
    number = 0
    for _ in range(mixing.ROUNDS):
        for x in dims:
            number += 1
            tried = filled.format(wanted=f"goal_{x}", room="room", weight="weight")
            order = f"WINDOW o AS (PARTITION BY {x} ORDER BY weight / room DESC, source, lang, topic)"
            parts.append(
                f"""r{number} AS MATERIALIZED (SELECT * EXCLUDE (weight, tried), coalesce(CASE WHEN goal_{x} < sum(room) OVER g * (1 - 1e-12)
  THEN max(tried) FILTER (tried * weight <= room) OVER g END * weight, greatest(weight, room)) AS weight
  FROM (SELECT *, {tried} FROM r{number - 1} {order}) WINDOW g AS (PARTITION BY {x}))"""
            )
    parts.append(f"p AS (SELECT source, lang, topic, least(1.0, weight / room) AS probability FROM r{number})")
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, source, lang, topic, tokens, round(coalesce(probability, 0), 9) AS probability,
  {_draw("doc_id", "'mix'")} < coalesce(probability, 0) AS kept
FROM d LEFT JOIN p USING (source, lang, topic)"""


# Share of all tokens that the pipeline's mixture keeps.
KEEP = 0.8


def mixed(docs: DataFrame, keep: float | None = KEEP) -> DataFrame:
    """Sources, languages and topics at the square root of their own shares, as far as ``keep`` lets them be reached."""
    dimensions = {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.topic_of(F.col("text"))}
    return mixing.mix(docs, dimensions, mixing.word_count(F.col("text")), F.col("doc_id"), keep)


@query("op9_mixing", _mixing_sql())
def op9(spark: SparkSession, folder: str) -> DataFrame:
    # As much is kept as lets every target be reached.
    return mixed(table(spark, folder, "documents"), keep=None).select(
        "row.doc_id", "cell.source", "cell.lang", "cell.topic", "tokens", F.round("probability", 9).alias("probability"), "kept"
    )


@query("op6_quality")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op3_license_scan")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, folder, "documents"))


RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def _hosts_sql() -> str:
    """The levels of the hierarchy written out, each with its strength by moments."""
    two = ", ".join(f"'{s}'" for s in hosts.TWO_LABEL_SUFFIXES)
    fits = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{h}/{p}'"
        for h, _, p in (r.partition("/") for r in sorted(RULES, key=lambda r: (len(r), r), reverse=True))
    )
    decided = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in RULES.items())

    def level(name: str, source: str) -> str:
        return f"""{name}_s AS (SELECT 1 / least(greatest(coalesce((sum((y - n * mu) ** 2) - sum(mu * (1 - mu) * n))
  / nullif(sum(mu * (1 - mu) * n * (n - 1)), 0), {hosts.MAX_CORRELATION}), {hosts.MIN_CORRELATION}), {hosts.MAX_CORRELATION}) - 1 AS s FROM ({source})),
{name}_p AS (SELECT *, s * mu + y AS a, s * (1 - mu) + n - y AS b FROM ({source}), {name}_s)"""

    return f"""
WITH parsed AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{hosts.UPPER}', '{hosts.LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages
), named AS (
  SELECT DISTINCT host, string_split(host, '.') AS l, array_to_string(l[-2:], '.') AS two, two IN ({two}) AS long,
    CASE WHEN long THEN array_to_string(l[-3:], '.') ELSE two END AS domain, CASE WHEN long THEN two ELSE l[-1] END AS suffix
  FROM parsed WHERE host <> ''
), outcomes AS (
  SELECT host, count(*)::DOUBLE AS n, sum(quality)::DOUBLE AS y FROM parsed JOIN labels ON doc_id = page_id
  WHERE quality IN (0, 1) GROUP BY host
), base AS (SELECT host, domain, suffix, coalesce(n, 0) AS n, coalesce(y, 0) AS y FROM named LEFT JOIN outcomes USING (host)),
x AS (SELECT suffix, sum(n) AS n, sum(y) AS y, (SELECT (sum(y) + 1) / (sum(n) + 2) FROM base) AS mu FROM base GROUP BY suffix),
{level("x", "SELECT * FROM x")},
d AS (SELECT domain, sum(n) AS n, sum(y) AS y, any_value(m.mu) AS mu FROM base JOIN (SELECT suffix, a / (a + b) AS mu FROM x_p) m USING (suffix) GROUP BY domain),
{level("d", "SELECT * FROM d")},
h AS (SELECT host, n, y, m.mu FROM base JOIN (SELECT domain, a / (a + b) AS mu FROM d_p) m USING (domain)),
{level("h", "SELECT * FROM h")},
ruled AS (SELECT *, CASE {fits} END AS rule FROM parsed)
SELECT page_id, host, path, rule, CASE {decided}
  WHEN a / (a + b) + {hosts.DEVIATIONS} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) < {hosts.WANTED_SHARE} THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN h_p USING (host)"""


@query("op7_url_reputation", _hosts_sql())
def op7(spark: SparkSession, folder: str) -> DataFrame:
    outcomes = table(spark, folder, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return hosts.judge(table(spark, folder, "pages"), outcomes, RULES).drop("mean", "upper")


@query("op8_learned_partitions")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return ann.search(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
k AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS first FROM k)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < first THEN first END AS refers_to
FROM f"""


@query("op10_warc", WARC_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    archives = warc.write_archives(table(spark, folder, "pages"))
    stored = Workspace(spark, "archives").write(archives, "archives")
    records = warc.read_archives(stored, payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


TRIE_SQL = f"""
WITH {CRC_TABLE},
t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS d
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, {crc32_sql("conv_id::VARCHAR")} % 4 AS h, conv_id - conv_id % 20 AS base FROM (SELECT DISTINCT conv_id FROM t), crc
), o AS (SELECT c.conv_id, t.d, role, text FROM c JOIN t ON t.conv_id = base AND t.d <= h),
m AS (SELECT conv_id, count(*) AS m FROM o GROUP BY conv_id),
r AS (
  SELECT * FROM o UNION ALL
  SELECT t.conv_id, t.d - h + coalesce(m, 0), role, text FROM t JOIN c USING (conv_id) LEFT JOIN m USING (conv_id) WHERE t.d > h
), k AS MATERIALIZED (
  SELECT conv_id, d, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS w,
    md5(string_agg(md5(role || chr(0) || text), '') OVER (PARTITION BY conv_id ORDER BY d)) AS node
  FROM r UNION ALL SELECT conv_id, 0, 0, 'root' FROM c
), n AS MATERIALIZED (
  SELECT node, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w FROM k GROUP BY node, d
), p AS MATERIALIZED (
  SELECT n.*, up.node AS parent, np.conv_id AS parent_conv_id FROM n
  LEFT JOIN k up ON up.conv_id = n.conv_id AND up.d = n.depth - 1 LEFT JOIN n np ON np.node = up.node
), kids AS (SELECT parent AS node, count(*) AS n_children FROM p WHERE parent IS NOT NULL GROUP BY parent),
v AS (SELECT p.*, coalesce(n_children, 0) AS n_children FROM p LEFT JOIN kids USING (node)),
sums AS (
  SELECT k.node, sum((n_convs - 1) * v.w)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM v JOIN k ON k.conv_id = v.conv_id AND k.d <= v.depth GROUP BY k.node
), ends AS (
  SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
  FROM (SELECT * FROM k QUALIFY d = max(d) OVER (PARTITION BY conv_id)) GROUP BY node
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM v JOIN sums USING (node) LEFT JOIN ends USING (node)
"""


@query("op11_prefix_trie", TRIE_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    work = Workspace(spark, "op11")
    turns = trie.number_turns(table(spark, folder, "conversations"), work)
    ids = work.write(turns.select("conv_id").distinct(), "ids")
    return trie.prefix_nodes(trie.share_openings(turns, ids, work), ids, work).drop("k1", "k2")


LINES_SQL = f"""
WITH l AS (
  SELECT doc_id, len(all_lines) AS n_lines, unnest(all_lines) AS line, unnest(range(len(all_lines))) AS place
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS all_lines FROM documents)
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{hosts.UPPER}', '{hosts.LOWER}') AS key FROM l
), repeated AS (
  SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= {lines.MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {lines.MIN_DOCS}
), marked AS (SELECT k.*, coalesce(doc_id > first, false) AS gone FROM k LEFT JOIN repeated USING (key))
SELECT doc_id, any_value(n_lines) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op12_line_dedup", LINES_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return lines.drop_repeated_lines(table(spark, folder, "documents"), keep_text=False)


def _features_sql(name: str, source: str) -> str:
    """Buckets of all word runs of one table: each distinct run is hashed once."""
    runs = " UNION ALL ".join(
        f"SELECT id, array_to_string(w[i : i + {n}], ' ') AS run FROM (SELECT id, w, unnest(range(1, len(w) - {n - 1})) AS i FROM {name}_w)"
        for n in range(resample.MAX_RUN)
    )
    return f"""{name}_w AS (
  SELECT id, regexp_extract_all(translate(coalesce(text, ''), '{hosts.UPPER}', '{hosts.LOWER}'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM ({source})
), {name}_r AS MATERIALIZED (SELECT id, run, count(*) AS n FROM ({runs}) GROUP BY id, run),
{name}_h AS (SELECT run, {crc32_sql("run")} % {resample.BUCKETS} AS bucket FROM (SELECT DISTINCT run FROM {name}_r), crc),
{name}_b AS MATERIALIZED (SELECT id, bucket, sum(n) AS n FROM {name}_r JOIN {name}_h USING (run) GROUP BY id, bucket)"""


RESAMPLE_SQL = f"""
WITH {CRC_TABLE},
{_features_sql("d", "SELECT doc_id AS id, text FROM documents")},
{_features_sql("t", "SELECT item_id AS id, text FROM benchmark")},
totals AS (SELECT (SELECT sum(n) FROM d_b) AS s_all, (SELECT coalesce(sum(n), 0) FROM t_b) AS t_all),
gains AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * (s_all + {resample.BUCKETS}))
    / ((s.n + 1)::DOUBLE * (t_all + {resample.BUCKETS}))))::BIGINT AS gain
  FROM (SELECT bucket, sum(n) AS n FROM d_b GROUP BY bucket) s
  LEFT JOIN (SELECT bucket, sum(n) AS n FROM t_b GROUP BY bucket) t USING (bucket), totals
), w AS (
  SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM d_b JOIN gains USING (bucket) GROUP BY id
), scored AS (
  SELECT d.id AS doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || d.id)[1:8])::BIGINT + 0.5) / 4294967296)))::BIGINT AS score,
    len(d.w) >= {resample.MIN_WORDS} AS eligible
  FROM d_w d LEFT JOIN w USING (id)
)
SELECT doc_id, n_features, weight, score, CASE WHEN eligible AND place <= {resample.PERCENT} * n // 100 THEN place END AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY eligible ORDER BY score DESC, doc_id) AS place,
  count(*) OVER (PARTITION BY eligible) AS n FROM scored)
"""


@query("op13_importance_resampling", RESAMPLE_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    drawn = resample.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
