"""Registered queries against DuckDB, and the pipeline's stages."""

import hashlib
import itertools
import math
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle_check import compare, duck  # noqa: E402

from test_neardup import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from ticketweave.llm import decontaminate, quality, queries  # noqa: E402
from ticketweave.session import Workspace, shared_dir  # noqa: E402


def words_of_item(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_like_sql(spark, small, name):
    assert compare(spark, duck(small), small, name) == ""


def test_pipeline_keeps_whole_rows(spark, small):
    docs = pd.read_parquet(f"{small}/documents.parquet")
    got = corpus_pipeline.run(spark, small).toPandas()
    assert [n for n, _ in corpus_pipeline.STAGES] and list(got.columns) == [*docs.columns, "shard", "slot"]
    merged = got.merge(docs, on=list(docs.columns))
    assert len(merged) == len(got) > 0.5 * len(docs) and got.doc_id.is_unique
    for _, slots in got.groupby("shard").slot:
        assert sorted(slots) == list(range(len(slots)))
    items = queries.table(spark, small, "benchmark")
    assert decontaminate.overlaps(spark.createDataFrame(got[["doc_id", "text"]]), items).count() == 0


def test_stages_take_an_empty_table(spark, small):
    docs = queries.table(spark, small, "documents").filter("doc_id < 0")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small).count() == 0, name


def test_recall_of_learned_partitions(spark, small):
    found = queries.op8(spark, small).toPandas()
    rows = pd.read_parquet(f"{small}/embeddings.parquet").set_index("vec_id").embedding
    hits = total = 0
    for query, own in found.groupby("query_id"):
        near = rows.drop(query).map(lambda v, q=rows[query]: float(sum(float(a) * float(b) for a, b in zip(v, q))))
        best = near.sort_values(ascending=False, kind="stable").index[:20]
        assert list(own.sort_values("rank").vec_id) == list(own.sort_values(["score", "vec_id"], ascending=[False, True]).vec_id)
        hits, total = hits + len(set(best) & set(own.vec_id)), total + len(best)
    assert hits / total >= 0.9


# -- The pipeline's stages, each judged on its own input -------------------------------------------------------------


def plain_overlap(text, item):
    """Whether a text holds a passage of an item, by looking at every stretch of every diagonal."""
    if len(item) < 13:
        return text == item or len(item) > 3 and any(text[i : i + len(item)] == item for i in range(len(text)))
    where = {}
    for q, word in enumerate(item):
        where.setdefault(word, []).append(q)
    lines = Counter(p - q for p, word in enumerate(text) for q in where.get(word, ()))
    for shift, hits in lines.items():
        if hits < 11:
            continue
        agree = [text[q + shift] == item[q] for q in range(len(item)) if 0 <= q + shift < len(text)]
        sums = [0, *itertools.accumulate(agree)]
        for a, b in itertools.combinations(range(len(sums)), 2):
            if b - a >= 13 and sums[b] - sums[a] >= 11 and 5 * (sums[b] - sums[a]) >= 4 * (b - a):
                return True
    return False


def plain_shard(doc_id):
    draw = lambda s: (int(hashlib.md5(f"{doc_id}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    return max(range(8), key=lambda s: (1 / -math.log(draw(s)), -s))


def test_stages_decide_like_plain_python(spark, small):
    items = [words_of_item(t) for t in pd.read_parquet(f"{small}/benchmark.parquet").text]
    docs, left = queries.table(spark, small, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.toPandas()
        docs = Workspace(spark, "test").write(stage(spark, docs, small), "out")
        left[name] = (before, docs.toPandas())
    assert [n for n, _ in corpus_pipeline.STAGES] == list(left)
    before, after = left["quality classifier"]
    scored = quality.score_quality(spark.createDataFrame(before), queries.table(spark, small, "labels")).toPandas()
    assert set(after.doc_id) == set(scored.doc_id[scored.score >= 0.3])
    before, after = left["MinHash near-dedup"]
    assert set(after.doc_id) == {i for i, _, _, kept in brute(list(zip(before.doc_id, before.text)), 5) if kept}
    before, after = left["benchmark decontamination"]
    clean = {i for i, t in zip(before.doc_id, before.text) if not any(w and plain_overlap(words_of_item(t), w) for w in items)}
    assert set(after.doc_id) == clean
    before, after = left["mixing sources to target weights"]
    mixture = queries.mixed(spark.createDataFrame(before)).select("row.doc_id", "tokens", "probability").toPandas()
    draw = lambda i: (int(hashlib.md5(f"{i}:mix".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    assert set(after.doc_id) == {r.doc_id for r in mixture.itertuples() if draw(r.doc_id) < r.probability}
    assert abs((mixture.tokens * mixture.probability).sum() / mixture.tokens.sum() - queries.KEEP) < 0.01
    before, after = left["sharding"]
    assert {r.doc_id: r.shard for r in after.itertuples()} == {i: plain_shard(i) for i in before.doc_id}
    assert all(list(a.columns) == list(b.columns) for b, a in list(left.values())[:-1])


def test_runs_leave_one_table_each(spark, small):
    folder = Path(shared_dir(spark))
    before = set(folder.iterdir())
    corpus_pipeline.run(spark, small)
    assert len([p for p in folder.rglob("*/_SUCCESS") if not any(b in p.parents for b in before)]) == 1


def test_quality_ranks_held_out_labels(spark, small):
    """Area under the curve over labelled rows that nothing was learnt from."""
    folder = small.replace("sf0.001", "sf0.01")
    scored = queries.op6(spark, folder).toPandas()
    labels = pd.read_parquet(f"{folder}/labels.parquet")[["doc_id", "quality"]]
    held = scored[scored.held_out].merge(labels, on="doc_id")
    good, bad = (held.score[held.quality == q].to_numpy() for q in (1, 0))
    area = ((good[:, None] > bad[None, :]).mean() + (good[:, None] == bad[None, :]).mean() / 2)
    assert len(good) > 10 and len(bad) > 10 and area > 0.99
    assert all(scored.held_out == scored.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0))
