"""Near duplicates against brute force over all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from ticketweave.llm import components, neardup
from ticketweave.session import Workspace


def sets_of(text, size):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(rows, size, percent=80):
    sets = [(i, sets_of(t, size)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, sa in sets:
        for b, sb in sets:
            if sa and sb and 100 * len(sa & sb) >= percent * len(sa | sb):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def corpus(seed, groups=12, copies=9):
    """Groups of near copies, and texts that share a passage but are not alike."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(3))
    passage = [word() for _ in range(25)]
    texts = []
    for g in range(groups):
        base = [word() for _ in range(rng.randint(1, 60))] + passage * (g % 3 > 0)
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(text) // 8))):
                text[rng.randrange(len(text))] = word()
            texts.append(" ".join(text))
    texts += [" ".join([word() for _ in range(rng.randint(5, 20))] + passage) for _ in range(60)]
    texts += [texts[0]] * 5 + [texts[1].upper(), "", None, "  \n", "one", "ONE", " ".join(["a"] * 3000)]
    rng.shuffle(texts)
    return list(enumerate(texts, start=3))


@pytest.mark.parametrize(("seed", "size", "few", "block"), [(1, 2, 2, 500_000), (3, 2, 0, 300), (5, 5, 8, 500_000), (6, 5, 0, 900)])
def test_like_brute_force(documents, monkeypatch, seed, size, few, block):
    monkeypatch.setattr(neardup, "FEW_STRAYS", few)
    monkeypatch.setattr(neardup, "BLOCK_TOKENS", block)
    rows = corpus(seed)
    got = neardup.near_duplicates(documents(rows), size)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect())) == brute(rows, size)


def test_a_pair_is_compared_in_one_bucket_only():
    """Sets that share a core without being alike meet in many buckets; all buckets together compare each pair once."""
    rng = np.random.default_rng(4)
    core = rng.integers(0, 2**63, 86, dtype=np.uint64)
    sets = [np.unique(np.concatenate([core, rng.integers(0, 2**63, 14, dtype=np.uint64)])) for _ in range(120)]
    offsets = np.cumsum([0, *map(len, sets)])
    keys = neardup.band_keys(neardup.sketches(np.concatenate(sets), offsets)).view(np.int64)
    wanted = []
    held, counts = neardup._held, neardup._Postings.counts
    compared = {"pairs": 0, "met": 0}

    def count_rows(tokens, offsets, rows, mine):
        compared["pairs"] += len(rows)
        return held(tokens, offsets, rows, mine)

    neardup._held, bounds = count_rows, neardup._Postings.bounds
    # Few of the wanted sets are left in most buckets, so all go the way that is counted.
    neardup._Postings.bounds = lambda self, w: (bounds(self, w) if len(w) != 100 else (np.zeros(100, int), np.full(100, 1 << 40)))
    try:
        for bucket, number in zip(*np.unique(keys, return_counts=True)):
            here = np.flatnonzero((keys == bucket).any(axis=1))
            if number < 2:
                continue
            compared["met"] += len(here) * (len(here) - 1) // 2
            table = pa.table({
                "bucket": [int(bucket)] * len(here), "id": here, "c": here, "main": [int(here[0])] * len(here), "n": [len(sets[i]) for i in here],
                "shingles": [sets[i].tobytes() for i in here], "buckets": [np.sort(keys[i]).tolist() for i in here],
            })
            wanted += neardup._block_links(80)(table, table.slice(1)).to_pylist()
    finally:
        neardup._held, neardup._Postings.counts, neardup._Postings.bounds = held, counts, bounds
    assert not wanted
    assert 0 < compared["pairs"] <= 120 * 119 // 2 < compared["met"] / 4


def test_repeated_and_null_ids(documents):
    rows = [(5, "a b c d"), (5, "x y z w"), (9, "x y z w"), (9, "a b c d e f"), (None, "a b c d"), (7, "q"), (7, "q")]
    got = neardup.near_duplicates(documents(rows), 2).collect()
    assert {r.doc_id: r.component_id for r in got} == {5: 5, 9: 5, None: None, 7: 7}
    assert len(got) == len(rows) and all(r.kept for r in got if r.doc_id is None)


def test_empty_table(documents):
    assert neardup.near_duplicates(documents([])).count() == 0


def test_sketch_agrees_with_similarity_and_fills():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 1200, dtype=np.uint64)
    sets = [pool[:1000], pool[200:], pool[:1], pool[:3]]
    offsets = np.cumsum([0, *map(len, sets)])
    sketch = neardup.sketches(np.concatenate(sets), offsets)
    assert (sketch != neardup.FULL).all()
    assert abs((sketch[0] == sketch[1]).mean() - 800 / 1200) < 0.07
    assert (neardup.sketches(np.zeros(0, np.uint64), np.array([0, 0])) == neardup.FULL).all()


def test_digest_does_not_depend_on_order():
    one = neardup.shingle_sets(pa.array(["a b c", "b c a b", "c"]), 2)
    assert np.diff(one[1]).tolist() == [2, 3, 1]


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(3, 3), (None, 4)]
    frame = spark.createDataFrame(edges, "a bigint, b bigint")
    with Workspace(spark, "test") as work:
        got = {r.id: r.component for r in components.components(frame, work).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 50)}
