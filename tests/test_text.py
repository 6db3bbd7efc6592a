"""Hand-written cases for cleaning and tokenizing."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ticketweave.functions import text, vectors, wordcounts, wordlists

LISTED = ["br", "bdg", "yang", "di"]

NORMALIZED = [
    ("x a b c y", "x b y"),
    ("Jl Merdeka", "jalan merdeka"),
    ("a <BR /> b", "a b"),
    ("lampu <br> mati", "lampu br mati"),
    ("lama aflatoksin", "la latoksin"),
    ("bajl x y", "bajalan y"),
    ("12 rusak 3", "rusak"),
    ('kata "kutip" <br"/>ya', "kata kutip ya"),
    ("pak bpk rt blm dtg", "pak bapak rt belum dtg"),
    ("terima kasih atas tindak lanjutnya", "atas nya"),
    ("jalan é raya", "jalan raya"),
    ("ok \U0001f600 ya", "ok ya"),
    # A capital dotted I becomes an i and a combining dot, and the dot a space.
    ("12\u0130jalan", "jalan"),
    ("  ", ""),
    ("", ""),
    (None, ""),
]

CLEANED = [
    ("jalan bdg raya", "jalan bandung raya"),
    ("jalan bdg", "jalan"),
    ("lampu <br> mati", "lampu mati"),
    ("yang di br", ""),
    (None, ""),
]

TOKENS = [
    ("", [""], []),
    (" ", [], []),
    (" a  b ", ["", "a", "", "b"], ["a", "b"]),
    ("A\tB\nc", ["a", "b", "c"], ["a", "b", "c"]),
    (None, [""], []),
]


def apply(spark, expression, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in rows.select("i", expression.alias("x")).orderBy("i").collect()]


def test_normalize(spark):
    assert apply(spark, text.normalize_text("t"), [v for v, _ in NORMALIZED]) == [w for _, w in NORMALIZED]


def test_clean(spark):
    assert apply(spark, text.clean_text("t", LISTED), [v for v, _ in CLEANED]) == [w for _, w in CLEANED]


def test_stopword_removal_is_idempotent(spark):
    once = text.remove_stopwords("t", LISTED)
    twice = text.remove_stopwords(once, LISTED)
    values = ["yang satu di dua", "br br", "", "tanpa"]
    assert apply(spark, once, values) == apply(spark, twice, values) == ["satu dua", "", "", "tanpa"]


@pytest.mark.parametrize("drop_empty", [False, True])
def test_tokenize(spark, drop_empty):
    got = apply(spark, text.tokenize("t", drop_empty), [v for v, *_ in TOKENS])
    assert got == [w[drop_empty] for _, *w in TOKENS]


def test_tokenize_equals_the_ml_stage(spark):
    from pyspark.ml.feature import Tokenizer

    values = ["", " ", " a  b ", "x\t\ty \n", "  lead", "Mixed CASE  end  "]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    theirs = Tokenizer(inputCol="t", outputCol="w").transform(df).orderBy("i").collect()
    assert apply(spark, text.tokenize("t", False), values) == [r.w for r in theirs]


def test_words_of_equals_cleaning_then_tokenizing(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    whole = text.tokenize(text.clean_text("text", LISTED))
    assert docs.filter(text.words_of("text", True, LISTED) != whole).count() == 0


def test_an_emptied_text_keeps_one_token_on_request(spark):
    values = ["yang di", "", "lampu yang  mati"]
    assert apply(spark, text.words_of("t", True, LISTED, drop_empty=False), values) == [[""], [""], ["lampu", "mati"]]
    assert apply(spark, text.words_of("t", True, LISTED), values) == [[], [], ["lampu", "mati"]]


def test_read_stopwords(tmp_path):
    path = tmp_path / "words.txt"
    path.write_text("satu\n\ndua\nsatu\n", encoding="utf-8")
    assert wordlists.read_stopwords(path) == ["satu", "dua"]


def test_terms_count_every_word(spark):
    values = ["b a b", "", None, "a", "b b b b"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, t string")
    long = vectors.long_form(vectors.with_terms(df, "t", clean=False), "id")
    bucket = {w: df.select(vectors.bucket_of(F.lit(w)).alias("b")).first().b for w in "ab"}
    got = {(r.id, r.bucket): r.tf for r in long.collect()}
    assert got == {(0, bucket["a"]): 1, (0, bucket["b"]): 2, (3, bucket["a"]): 1, (4, bucket["b"]): 4}


def test_words_sharing_a_bucket_are_added(spark):
    df = spark.createDataFrame([(1, "satu dua tiga empat lima")], "id int, t string")
    row = vectors.with_terms(df, "t", clean=False, num_features=1).first()
    assert [(t.bucket, t.tf) for t in row.terms] == [(0, 5)]


def test_cleaning_equals_sql_on_random_texts(spark):
    import random

    import duckdb
    import pandas as pd

    from ticketweave.plans import oracle

    parts = (
        ' "|<br />|<BR />|<br/>|jl |jln |Jl| sy | bpk | blm | dtg | bdg |ma af|maaf|terima kasih|tindak lanjut| a | b|'
        "12| 7 |.|, |\n|\t|  |   |é|Ü|ß|\u2028|\U0001f600|the|der|los|lampu|jalan|x|bandung|br|bdg"
    ).split("|")
    draw = random.Random(7)
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 14))) for _ in range(5000)]
    frame = pd.DataFrame({"i": range(len(texts)), "t": texts})
    want = duckdb.sql(f"SELECT i, {oracle.cleaned('t')} AS x FROM frame ORDER BY i").fetchall()
    got = apply(spark, text.clean_text("t", oracle.STOPWORDS), texts)
    differ = [(t, g, w) for t, g, (_, w) in zip(texts, got, want) if g != w]
    assert differ == []


ODD = [
    None, "", " ", "a", " a ", "a b c d e", " a b  c d  e f g ", "yang di", "Jl A b C jl jln bpk sy sy ya", "ma  af ma af maaf",
    "x1y 2 z3 4 a", 'm<br" />n <BR /> "a"b"', "\u0130 \u212a \u00c9t\u00e9 \u65e5\u672c \U0001f600x", "\x00\x7f\ttab\nline\x85end", "<br", "/>", "rusak " * 50,
]


@pytest.mark.parametrize("drop_empty, num_features", [(True, 20_000), (False, 97)])
def test_kernel_counts_what_the_expressions_say(spark, drop_empty, num_features):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ODD * 3)], "id int, description string").coalesce(2)
    found = vectors.with_terms(rows, "description", True, LISTED, drop_empty, num_features)
    assert "RegExpReplace" not in found._jdf.queryExecution().optimizedPlan().toString()
    expected = vectors._terms_by_expressions(rows, "description", True, LISTED, drop_empty, num_features)
    assert sorted(found.collect()) == sorted(expected.collect())


@pytest.mark.parametrize("piece_bytes", [1, 40, 1 << 20])
def test_pieces_change_no_vector(piece_bytes, monkeypatch):
    monkeypatch.setattr(wordcounts, "KNOWN_WORDS", 2)
    texts = pa.array([(t or "").lower().encode() for t in ODD], pa.binary())
    whole = pa.concat_arrays([wordcounts.counter(LISTED, True, 1000)(texts[i : i + 1]) for i in range(len(ODD))])
    assert wordcounts.counter(LISTED, True, 1000, piece_bytes)(texts).equals(whole)
    assert len(wordcounts.counter(LISTED, True, 1000)(texts[:0])) == 0
