"""SQL fragments for checking the text queries; a second, independent statement of them."""

from __future__ import annotations

# Frequent words of the four languages of the test texts, used as the stop words
# of the registered queries.
STOPWORDS = (
    "the of and to in is that it for on with as le la les de des un une et que der die das und ein "
    "eine den el los las en y del br bdg"
).split()

# The text rewrite rules, in the order they must be applied.
_RULES = (
    ("'\"'", "' '"),
    ("'<br />'", "' '"),
    ("'[^A-Za-z0-9 ]'", "' '"),
    ("'jl '", "'jalan '"),
    ("'jln '", "'jalan '"),
    ("' sy '", "' saya '"),
    ("' bpk '", "' bapak '"),
    ("' blm '", "' belum '"),
    ("' dtg '", "' datang '"),
    ("' bdg '", "' bandung '"),
    ("'ma af'", "' '"),
    ("'terima kasih'", "' '"),
    ("'tindak lanjut'", "' '"),
    ("'[0-9]'", "' '"),
    ("' [a-z]{1} '", "' '"),
    ("' +'", "' '"),
)


def normalized(column: str) -> str:
    out = f"lower(coalesce({column}, ''))"
    for pattern, replacement in _RULES:
        out = f"regexp_replace({out}, {pattern}, {replacement}, 'g')"
    return f"trim({out})"


def _listed() -> str:
    return ", ".join(f"'{w}'" for w in STOPWORDS)


def words(column: str) -> str:
    """Cleaned words as a list, without stop words and empty ones."""
    return (
        f"list_filter(string_split({normalized(column)}, ' '), "
        f"lambda w: w <> '' AND w NOT IN ({_listed()}))"
    )


def cleaned(column: str) -> str:
    kept = f"list_filter(string_split({normalized(column)}, ' '), lambda w: w NOT IN ({_listed()}))"
    return f"array_to_string({kept}, ' ')"


BUCKET = "CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 20000"


def stored_words(column: str) -> str:
    """Words of a text as stored, the empty ones between two spaces included."""
    stripped = f"rtrim(lower({column}), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    split = f"string_split_regex({stripped}, '[ \\t\\n\\x0b\\f\\r]')"
    return f"CASE WHEN {stripped} = '' AND {column} <> '' THEN [] ELSE {split} END"


def cleaned_words(column: str) -> str:
    """Words of a cleaned text; an emptied one keeps a single empty word."""
    return f"string_split({cleaned(column)}, ' ')"


def term_counts(name: str, source: str, id_column: str, text: str, words=words) -> str:
    """CTE (id, bucket, tf)."""
    return (
        f"{name} AS (SELECT id, {BUCKET} AS bucket, count(*) AS tf FROM "
        f"(SELECT {id_column} AS id, unnest({words(text)}) AS w FROM {source}) GROUP BY 1, 2)"
    )


def similar(weighting: str = "tf", corpus_words=words, query_words=words, queries: str = "benchmark") -> str:
    """Top 11 documents for each query (item_id, text), empty overlaps and empty texts included."""
    n = "(SELECT count(*) FROM documents)"
    if weighting == "tf":
        d_weight = q_weight = "CAST(tf AS DOUBLE)"
    else:
        d_weight = q_weight = "tf * coalesce(idf, 0)"
    return f"""WITH {term_counts("d0", "documents", "doc_id", "text", corpus_words)},
    {term_counts("q0", queries, "item_id", "text", query_words)},
    idf AS (SELECT bucket, ln(({n} + 1.0) / (count(*) + 1.0)) AS idf FROM d0 GROUP BY bucket),
    d AS (SELECT id, bucket, {d_weight} AS x FROM d0 LEFT JOIN idf USING (bucket)),
    q AS (SELECT id, bucket, {q_weight} AS x FROM q0 LEFT JOIN idf USING (bucket)),
    dn AS (SELECT id, sqrt(sum(x * x)) AS norm FROM d GROUP BY id),
    qn AS (SELECT id, sqrt(sum(x * x)) AS norm FROM q GROUP BY id),
    dots AS (SELECT q.id AS qid, d.id AS did, sum(q.x * d.x) AS dot FROM q JOIN d USING (bucket) GROUP BY 1, 2),
    scored AS (SELECT b.item_id AS id, c.doc_id AS that_id,
        round(CASE WHEN qn.norm > 0 AND dn.norm > 0 THEN coalesce(dot, 0) / (qn.norm * dn.norm) END, 6) AS similarity
        FROM {queries} b CROSS JOIN documents c LEFT JOIN dots ON qid = b.item_id AND did = c.doc_id
        LEFT JOIN qn ON qn.id = b.item_id LEFT JOIN dn ON dn.id = c.doc_id)
    SELECT id, that_id, similarity FROM (SELECT *, row_number() OVER
        (PARTITION BY id ORDER BY similarity DESC NULLS LAST, that_id) AS rk FROM scored) WHERE rk <= 11"""


def bayes(label: str, keys: str = "(-1)", train: str = "true", test: str = "true", smoothing: float = 1.0) -> str:
    """CTEs up to ``scored`` (m, id, label, prediction, score) for models ``keys``.

    Model -1 is trained on all rows meeting ``train``, model f on those outside
    fold f. Rows meeting ``test`` are scored by model -1 and by that of their fold.
    """
    lam = float(smoothing)
    return f"""{term_counts("tf", "documents", "doc_id", "text")},
    docs AS (SELECT doc_id AS id, coalesce({label}, '') AS label, CAST(doc_id % 3 AS INTEGER) AS fold,
             {train} AS is_train, {test} AS is_test FROM documents),
    models AS (SELECT * FROM (VALUES {keys}) AS v(m)),
    tr AS (SELECT m, id, label FROM docs JOIN models ON m = -1 OR fold <> m WHERE is_train),
    te AS (SELECT m, id, label FROM docs JOIN models ON m = -1 OR fold = m WHERE is_test),
    n AS (SELECT m, count(*) AS n_all, count(DISTINCT label) AS n_cls FROM tr GROUP BY m),
    df AS (SELECT m, bucket, count(*) AS doc_freq FROM tr JOIN tf USING (id) GROUP BY m, bucket),
    idf AS (SELECT m, bucket, doc_freq,
            CASE WHEN doc_freq >= 2 THEN ln((n_all + 1.0) / (doc_freq + 1.0)) ELSE 0.0 END AS idf
            FROM df JOIN n USING (m)),
    mass AS (SELECT m, label, bucket, sum(tf * idf) AS mass FROM tr JOIN tf USING (id) JOIN idf USING (m, bucket)
             GROUP BY m, label, bucket),
    total AS (SELECT m, label, sum(mass) AS total FROM mass GROUP BY m, label),
    cls AS (SELECT m, label, n_docs, ln((n_docs + {lam}) / (n_all + {lam} * n_cls)) AS log_prior,
            coalesce(total, 0.0) AS total
            FROM (SELECT m, label, count(*) AS n_docs FROM tr GROUP BY m, label) JOIN n USING (m)
            LEFT JOIN total USING (m, label)),
    xs AS (SELECT m, id, bucket, tf * idf AS x FROM te JOIN tf USING (id) JOIN idf USING (m, bucket)),
    weight AS (SELECT m, id, sum(x) AS w FROM xs GROUP BY m, id),
    hits AS (SELECT m, id, mass.label, sum(x * (ln(mass + {lam}) - ln({lam}))) AS s
             FROM xs JOIN mass USING (m, bucket) GROUP BY m, id, mass.label),
    ranked AS (SELECT te.m, te.id, te.label, cls.label AS prediction,
        log_prior + coalesce(s, 0) + coalesce(w, 0) * (ln({lam}) - ln(total + {lam} * 20000)) AS score
        FROM te JOIN cls USING (m) LEFT JOIN weight USING (m, id)
        LEFT JOIN hits ON hits.m = te.m AND hits.id = te.id AND hits.label = cls.label),
    scored AS (SELECT m, id, label, prediction, score FROM (SELECT *, row_number() OVER
        (PARTITION BY m, id ORDER BY round(score, 6) DESC, prediction) AS rk FROM ranked) WHERE rk = 1)"""


METRICS = """pairs AS (SELECT m, label AS cls, 1 AS support, 0 AS predicted,
            CASE WHEN label = prediction THEN 1 ELSE 0 END AS tp FROM scored
        UNION ALL SELECT m, prediction, 0, 1, 0 FROM scored),
    per AS (SELECT m, cls, sum(support) * 1.0 AS s, sum(predicted) * 1.0 AS p, sum(tp) * 1.0 AS tp,
            sum(sum(support)) OVER (PARTITION BY m) * 1.0 AS n FROM pairs GROUP BY m, cls),
    rates AS (SELECT m, s, n, tp, coalesce(tp / nullif(p, 0), 0) AS prec, coalesce(tp / nullif(s, 0), 0) AS rec,
            coalesce((p - tp) / nullif(n - s, 0), 0) AS fpr FROM per),
    report AS (SELECT m, sum(tp) / max(n) AS accuracy,
        sum(s * coalesce(2 * prec * rec / nullif(prec + rec, 0), 0)) / max(n) AS weighted_f_measure,
        sum(s * prec) / max(n) AS weighted_precision, sum(s * rec) / max(n) AS weighted_true_positive_rate,
        sum(s * fpr) / max(n) AS weighted_false_positive_rate FROM rates GROUP BY m)"""

METRIC_COLUMNS = (
    "round(accuracy, 6) AS accuracy, round(weighted_f_measure, 6) AS weighted_f_measure, "
    "round(weighted_precision, 6) AS weighted_precision, "
    "round(weighted_true_positive_rate, 6) AS weighted_true_positive_rate, "
    "round(weighted_false_positive_rate, 6) AS weighted_false_positive_rate"
)

FOLD_KEYS = "(-1), (0), (1), (2)"
IS_LABELED = "doc_id IN (SELECT doc_id FROM labels)"
