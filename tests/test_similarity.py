"""Similarity against a plain computation on every pair."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ticketweave.functions.vectors import with_terms
from ticketweave.operators import similarity
from ticketweave.plans import triage

TEXTS = [
    (1, "lampu jalan mati"),
    (2, "lampu jalan mati"),
    (3, "lampu taman"),
    (4, "banjir sungai meluap"),
    (5, ""),
    (6, "jalan rusak jalan berlubang"),
    (7, "jalan"),
]


def brute(queries, corpus, k, weight=lambda w: 1.0, exclude_self=False):
    def vector(text):
        return {w: n * weight(w) for w, n in Counter(text.split()).items()}

    def length(v):
        return math.sqrt(sum(x * x for x in v.values()))

    out = []
    for q, text in queries:
        a = vector(text)
        scored = []
        for d, other in corpus:
            if exclude_self and d == q:
                continue
            b = vector(other)
            whole = length(a) * length(b)
            score = round(sum(a[w] * b.get(w, 0) for w in a) / whole, 6) if whole else None
            scored.append((score, d))
        scored.sort(key=lambda s: (s[0] is None, -(s[0] or 0), s[1]))
        out += [(q, d, s) for s, d in scored[:k]]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, description string")


def vectors(spark, rows):
    return with_terms(frame(spark, rows), "description", clean=False)


def collected(df):
    return sorted((r.id, r.that_id, r.similarity) for r in df.collect())


@pytest.mark.parametrize("k", [1, 3, 11])
@pytest.mark.parametrize("exclude_self", [False, True])
def test_equals_all_pairs(spark, k, exclude_self):
    got = similarity.top_similar(vectors(spark, TEXTS), vectors(spark, TEXTS).repartition(3), k, exclude_self)
    assert collected(got) == brute(TEXTS, TEXTS, k, exclude_self=exclude_self)


@pytest.mark.parametrize("block_queries", [1, 4, 64])
@pytest.mark.parametrize("chunk_rows", [1, 2, 64])
def test_blocks_and_chunks_change_nothing(spark, block_queries, chunk_rows):
    corpus = vectors(spark, TEXTS).repartition(3).persist()
    got = similarity.top_similar(vectors(spark, TEXTS), corpus, 3, block_queries=block_queries, chunk_rows=chunk_rows)
    assert collected(got) == brute(TEXTS, TEXTS, 3)


def test_one_corpus_scan_for_any_number_of_queries(spark, tmp_path):
    triage.build_index(frame(spark, TEXTS), str(tmp_path / "index"), clean_corpus=False)
    corpus = spark.read.parquet(str(tmp_path / "index"))
    for number in (1, 2000):
        queries = with_terms(spark.range(number).selectExpr("id", "'lampu jalan' AS description"), "description")
        found = similarity.top_similar(queries, corpus, 3)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1
        assert found.count() == 3 * number and [r.that_id for r in found.filter("id = 0").orderBy("that_id").collect()] == [1, 2, 7]


def test_identical_disjoint_and_empty_texts(spark):
    got = {(r[0], r[1]): r[2] for r in collected(similarity.top_similar(vectors(spark, TEXTS), vectors(spark, TEXTS)))}
    assert got[1, 2] == 1.0 and got[1, 4] == 0.0 and got[1, 5] is None and got[5, 1] is None


def test_many_copies_of_one_text(spark):
    rows = [(i, "lampu mati" if i % 3 == 0 else f"laporan {i % 50} lampu") for i in range(300)]
    queries = [(0, "lampu mati"), (1, "laporan 7")]
    got = similarity.top_similar(vectors(spark, queries), vectors(spark, rows).repartition(5), 11)
    assert collected(got) == brute(queries, rows, 11)


def test_scores_stay_within_bounds(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    v = with_terms(docs, "text").persist()
    rows = similarity.top_similar(v, v, block_queries=64).collect()
    assert len(rows) == 11 * docs.count()
    assert all(r.similarity is None or 0 <= r.similarity <= 1 for r in rows)


def test_whole_documents_equal_all_pairs(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id").alias("id"), "text").limit(50)
    v = with_terms(docs, "text").persist()
    plain = [(r.id, {t.bucket: t.tf for t in r.terms}) for r in v.collect()]
    got = collected(similarity.top_similar(v, v, 5))
    want = []
    for q, a in plain:
        scored = []
        for d, b in plain:
            dot = sum(n * b.get(t, 0) for t, n in a.items())
            norms = math.sqrt(sum(n * n for n in a.values())) * math.sqrt(sum(n * n for n in b.values()))
            scored.append((math.floor(dot / norms * 1e6 + 0.5) / 1e6, d))
        want += [(q, d, s) for s, d in sorted(scored, key=lambda s: (-s[0], s[1]))[:5]]
    assert got == sorted(want)


def test_tfidf_weighting(spark, tmp_path):
    index = triage.build_index(frame(spark, TEXTS), str(tmp_path / "index"), clean_corpus=False)
    got = triage.find_similar(frame(spark, TEXTS), index, weighting="tfidf")
    df = Counter(w for _, t in TEXTS for w in set(t.split()))
    want = brute(TEXTS, TEXTS, 11, lambda w: math.log((len(TEXTS) + 1) / (df[w] + 1)))
    assert collected(got) == want


def test_unknown_weighting(spark, tmp_path):
    index = triage.build_index(frame(spark, TEXTS), str(tmp_path / "index"))
    with pytest.raises(ValueError):
        triage.find_similar(frame(spark, TEXTS), index, weighting="bm25")


@pytest.mark.parametrize("block_queries", [2, 256])
def test_repeated_query_ids_are_refused(spark, block_queries):
    rows = [(1, f"kata{i}") for i in range(3)]
    with pytest.raises(ValueError):
        similarity.top_similar(vectors(spark, rows), vectors(spark, TEXTS), block_queries=block_queries)


def test_empty_batch(spark):
    assert similarity.top_similar(vectors(spark, TEXTS).filter("id < 0"), vectors(spark, TEXTS)).count() == 0


def test_idf_table(spark):
    rows = [(1, "satu dua"), (2, "satu"), (3, "tiga")]
    table = similarity.idf_table(vectors(spark, rows), 3, 2).collect()
    assert sorted((r.doc_freq, round(r.idf, 6)) for r in table) == [(1, 0.0), (1, 0.0), (2, 0.287682)]


def test_chunks_are_bounded_by_terms():
    import pyarrow as pa

    def batch(start, sizes):
        terms = pa.array([[{"bucket": b, "tf": 1} for b in range(n)] for n in sizes], pa.list_(pa.struct([("bucket", pa.int32()), ("tf", pa.int32())])))
        return pa.RecordBatch.from_arrays([pa.array(range(start, start + len(sizes))), terms], names=["id", "terms"])

    sizes = [[3, 0, 90, 2], [], [7, 1, 1, 200, 0, 5]]
    batches = [batch(10 * i, s) for i, s in enumerate(sizes)]
    got = list(similarity.chunks(iter(batches), 3, 50))
    assert [i for c in got for i in c["id"].to_pylist()] == [0, 1, 2, 3, 20, 21, 22, 23, 24, 25]
    assert [n for c in got for n in map(len, c["terms"].to_pylist())] == [n for s in sizes for n in s]
    assert all(c.num_rows <= 3 and (c.num_rows == 1 or sum(map(len, c["terms"].to_pylist())) <= 50) for c in got)


def test_a_task_holds_little_however_long_the_rows_are(tmp_path, monkeypatch):
    import tracemalloc

    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    def rows(count, size):
        pairs = pa.StructArray.from_arrays([np.tile(np.arange(size, dtype=np.int32), count), np.ones(count * size, np.int32)], ["bucket", "tf"])
        return pa.ListArray.from_arrays(np.arange(0, count * size + 1, size, dtype=np.int32), pairs)

    pq.write_table(pa.table({"id": np.arange(200), "terms": rows(200, 100)}), tmp_path / "part-0.parquet")
    batch = pa.RecordBatch.from_arrays([np.arange(1000) % 200, np.arange(1000), rows(1000, 4000)], names=["id", "that_id", "terms"])
    from ticketweave.operators import postings

    for run in (postings._exact(str(tmp_path)), similarity._scorer(str(tmp_path), 200, 256, 16_384, 11, False, None, 20_000)):
        tracemalloc.start()
        found = sum(b.num_rows for b in run(iter([batch] * 4)))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found in (4000, 2200) and peak < 120e6
