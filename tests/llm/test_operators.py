"""Small cases of each operator: nulls, empty and long texts, ties, repeated rows, empty tables."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from ticketweave.llm import ann, decontaminate, hosts, licenses, mixing, quality, sharding, substring, warc, words


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))


def brute_cut(rows, length):
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in texts:
        for s in range(len(w) - length + 1):
            key = tuple(w[s : s + length])
            if i is not None:
                first[key] = min(i, first.get(key, i))
    out = []
    for i, w in texts:
        gone = set()
        for s in range(len(w) - length + 1):
            if i is not None and first[tuple(w[s : s + length])] < i:
                gone |= set(range(s, s + length))
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_substring_like_brute_force(documents):
    rng = random.Random(5)
    shared = [prose(rng, n) for n in (12, 13, 14, 40)]
    texts = [" ".join(rng.sample(shared, 2) + [prose(rng, rng.randint(0, 20))]) for _ in range(60)]
    rows = list(enumerate(texts)) + [(500, texts[0]), (500, texts[1]), (7, texts[9]), (None, texts[0])]
    rows += [(600, None), (601, ""), (602, " \t\n"), (603, "a " * 5000), (604, "a " * 40), (605, "é\u00a0x " * 20)]
    cut = substring.remove_repeats(documents(rows))
    got = [tuple(r) for r in cut.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=repr) == brute_cut(rows, 13)
    one = cut.filter("doc_id = 603").first()
    assert one.n_removed == 0 and one.kept_text.split() == ["a"] * 5000
    assert cut.filter("doc_id = 604").first().spans[0].end == 40
    assert substring.remove_repeats(documents([])).count() == 0


def test_sharding(spark):
    rows = [(i, "s", 9) for i in range(4000)] + [(None, "s", 9), (7, "s", 9)]
    frame = spark.createDataFrame(rows, "doc_id bigint, shard string, score int")
    got = sharding.assign_shards(frame, "doc_id", [1.0, 1.0, 2.0], grown=1.0).toPandas()
    assert len(got) == len(rows) and list(got.columns) == ["doc_id", "score", "shard", "slot", "grown_shard"]
    share = got.shard.value_counts(normalize=True)
    assert abs(share[2] - 0.5) < 0.04 and abs(share[0] - 0.25) < 0.04
    moved = got[got.shard != got.grown_shard]
    assert (moved.grown_shard == 3).all() and abs(len(moved) / len(got) - 0.2) < 0.03
    for _, slots in got.groupby("shard").slot:
        assert sorted(slots) == list(range(len(slots)))
    assert sharding.assign_shards(frame.limit(0), "doc_id", 8).count() == 0
    with pytest.raises(ValueError, match="positive"):
        sharding.assign_shards(frame, "doc_id", [1.0, 0.0])


def test_licenses(documents):
    mit = licenses.TEMPLATES["MIT"]
    changed = mit.replace("free of charge", "without any fee").replace("Permission", "Leave")
    texts = ["Intro.\n" + mit + "\nOutro words", "x " + changed, mit[: len(mit) // 3], "Released under\nthe MIT license!",
             "All rights reserved. Then: all rights reserved.", "", None, "free " * 4000]
    got = licenses.scan_licenses(documents(list(enumerate(texts)))).collect()
    found = {(r.doc_id, r.license): r for r in got}
    assert sorted((r.doc_id, r.license) for r in got) == [
        (0, "MIT"), (1, "MIT"), (3, "MIT line"), (4, "rights reserved"), (4, "rights reserved")]
    assert found[0, "MIT"].coverage == 1.0 and found[0, "MIT"].start == 1
    assert 0.9 < found[1, "MIT"].coverage < 1.0 and found[1, "MIT"].end == found[1, "MIT"].words + 1
    assert licenses.scan_licenses(documents([])).count() == 0


def test_alignment_bridges_gaps():
    a = np.array([1, 2, 3, 4, 5, 6, 7, 8], dtype=np.uint64)
    text = np.array([90, 1, 2, 91, 3, 4, 6, 7, 8, 92], dtype=np.uint64)
    assert licenses.align(a, text, -2, 4) == (7, 1, 9)
    assert licenses.align(a, text, 1, 1) == (5, 1, 9) and licenses.align(a, text[:0], -8, 0)[0] == 0


def plain_fit(template, text):
    """Unbanded alignment cell by cell: (score, matched, start, end)."""
    row = [(0, 0, j) for j in range(len(text) + 1)]
    for word in template:
        new = [(row[0][0] - 1, *row[0][1:])]
        for j, other in enumerate(text):
            same = word == other
            step = (row[j][0] + (2 if same else -1), row[j][1] + same, row[j][2])
            new.append(max(step, (row[j + 1][0] - 1, *row[j + 1][1:]), (new[j][0] - 1, *new[j][1:])))
        row = new
    end = max(range(len(row)), key=lambda j: (row[j][0], -j))
    return row[end][1], row[end][2], end


def whole_fit(template, text):
    """Unbanded alignment of a template anywhere in a whole text, a template word at a time."""
    score, match, places = 1 << 44, 1 << 28, np.arange(len(text) + 1, dtype=np.int64)
    row = places.copy()
    for word in template:
        new = row - score
        np.maximum(new[1:], row[:-1] + np.where(text == word, 2 * score + match, -score), out=new[1:])
        row = np.maximum.accumulate(new + places * score) - places * score
    end = int(np.argmax(row >> 44))
    return int(row[end] >> 28) & 0xFFFF, int(row[end]) & (match - 1), end


def test_licenses_like_unbanded_alignment_of_every_template_everywhere(spark, small):
    """The whole table of documents: every template aligned with every whole text, then with what is left of it."""
    folder = small.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    index = licenses.Index(licenses.TEMPLATES, licenses.MIN_COVERAGE, licenses.MARKS)
    want = set()
    for row in docs.collect():
        text, _ = licenses._hashes(pa.array([row.text or ""]))
        found = []
        for number, template in enumerate(index.words):
            parts, need = [(0, len(text))], 0.8 * len(template)
            while parts:
                a, z = parts.pop()
                if z - a < need or np.isin(template, text[a:z]).sum() < need:
                    continue
                matched, start, end = whole_fit(template, text[a:z])
                if matched >= need and all(licenses._runs_at(text[a + start : a + end], m) for m in index.marks[number]):
                    found.append((number, a + start, a + end, matched, len(template)))
                if end > start:
                    parts += [(a, a + start), (a + end, z)]
        want |= {(row.doc_id, index.names[t], s, e, m) for t, s, e, m, _ in licenses.apart(found)}
    got = [(r.doc_id, r.license, r.start, r.end, r.matched) for r in licenses.scan_licenses(docs).collect()]
    assert len(want) > 10 and set(got) == want and len(got) == len(want)


def test_fingerprints_leave_most_runs_out_and_meet_every_long_stretch():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    grams, starts = licenses.winnow(text, np.array([0, 3000, 5000]), 3, 8)
    assert 0.15 < len(grams) / 5000 < 0.3
    for at in range(100, 2900, 37):
        own, _ = licenses.winnow(text[at : at + 10], np.array([0, 10]), 3, 8)
        assert np.isin(own, grams).all()
    for words in range(1, 200):
        gram, window = licenses.fingerprint_sizes(words, 0.8)
        missing = words // 5
        assert gram + window - 1 <= -(-(words - missing) // (missing + 1)) and gram >= 1 and window >= 1


def test_licenses_with_insertions_cuts_and_other_versions(documents):
    """Every template is found with words inserted or left out in the middle and cut at either end, like unbanded alignment."""
    texts, want = [], {}
    for name, template in licenses.TEMPLATES.items():
        words = re.findall(r"[a-z0-9]+", template.lower())
        n = len(words)
        fifth, extra, half = n // 5, ["zz"] * max(3, n // 7 + 1), n // 2
        cases = [words[:half] + extra + words[half:]]
        if n > 40:
            cases += [words[:half] + words[half + fifth :], words[fifth:] + ["zz"] * 5, ["zz"] * 5 + words[: n - fifth]]
        if n >= 12:
            for case in cases:
                want[len(texts)] = (name, *plain_fit(words, case))
                texts.append(" ".join(case))
    for text, start, end in (("Released under a MIT License.", 0, 5), ("x released the MIT license y", 1, 5)):
        want[len(texts)] = ("MIT line", 4, start, end)
        texts.append(text)
    wrong = ["Released under the BSD License.", "Licensed under CC BY 4.0.", "Licensed under the Apache License, Version 1.1.",
             "This work is licensed under the GNU General Public License, version 2.",
             "This work is licensed under the GNU Lesser General Public License, version 3."]
    got = licenses.scan_licenses(documents(list(enumerate(texts + wrong)))).collect()
    assert {r.doc_id: (r.license, r.matched, r.start, r.end) for r in got} == want and len(got) == len(want)
    assert all(r.coverage >= 0.8 for r in got)


def test_decontamination(spark, documents):
    rng = random.Random(3)
    item, other = prose(rng, 30), prose(rng, 30)
    w = item.split()
    swapped = w[:6] + ["zzz"] + w[7:20] + ["yyy"] + w[21:]
    texts = [f"{prose(rng, 40)}, {item.upper()}! {prose(rng, 9)}", " ".join(swapped), " ".join(w[:12]), prose(rng, 300), "", None,
             " ".join(x for pair in zip(w, w) for x in pair), item]
    rows = [*enumerate(texts), (7, item), (None, item)]
    items = spark.createDataFrame([(1, item, 0), (2, item, 0), (3, other, 0), (4, "", 0), (5, None, 0), (None, item, 0)],
                                  "item_id bigint, text string, doc_id int")
    for limit in (100_000, 0):
        found = decontaminate.overlaps(documents(rows), items, broadcast_windows=limit).collect()
        got = {(r.doc_id, r.item_id): r for r in found}
        assert set(got) == {(d, i) for d in (0, 1, 7) for i in (1, 2)} and len(found) == len(got)
        assert (got[0, 1].doc_start, got[0, 1].item_start, got[0, 1].n_words, got[0, 1].n_matches) == (40, 0, 30, 30)
        assert got[1, 1].n_matches == 28
    kept = decontaminate.remove_contaminated(documents(rows), items)
    assert sorted(kept.toPandas().doc_id.dropna()) == [2, 3, 4, 5, 6] and kept.columns == documents([]).columns
    assert decontaminate.overlaps(documents([]), items).count() == 0
    assert decontaminate.overlaps(documents(rows), items.limit(0)).count() == 0


def test_decontamination_finds_all_its_rule_accepts(spark, documents):
    """Seeds hit every accepted pattern of 13 to 25 words, and overlaps agree with all stretches of all diagonals."""
    for n in range(13, 26):
        for wrong in range(n // 5 + 1):
            for places in itertools.combinations(range(n), wrong):
                line = "".join("0" if i in places else "1" for i in range(n))
                assert "1111" in line or any(line[i : i + 3] == line[i + 4 : i + 7] == "111" for i in range(n - 6))
    rng = random.Random(8)
    items = [prose(rng, n).split() for n in (13, 15, 16, 20, 40, 9, 3)]
    texts = []
    for _ in range(120):
        w = list(rng.choice(items[:5]))
        for at in rng.sample(range(len(w)), rng.randint(1, len(w) // 4)):
            w[at] = "zzz"
        cut = rng.randint(0, 3)
        texts.append(prose(rng, rng.randint(0, 9)).split() + w[cut:] + prose(rng, rng.randint(0, 9)).split())
    texts += [["q"] + items[5] + ["q"], items[5][:8], items[6], items[6] + ["q"], items[3][:13]]

    def best(text, item):
        if len(item) < 13:
            whole = text == item or len(item) > 3 and any(text[i : i + len(item)] == item for i in range(len(text)))
            return len(item) if whole else 0
        found = 0
        for shift in range(-len(item), len(text)):
            agree = [text[q + shift] == item[q] for q in range(len(item)) if 0 <= q + shift < len(text)]
            for a, b in itertools.combinations(range(len(agree) + 1), 2):
                m = sum(agree[a:b])
                if b - a >= 13 and 5 * m >= 4 * (b - a):
                    found = max(found, m)
        return found

    want = {(d, i): m for d, t in enumerate(texts) for i, item in enumerate(items) if (m := best(t, item))}
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")
    rows = [(d, " ".join(t)) for d, t in enumerate(texts)]
    for limit in (100_000, 0):
        found = decontaminate.overlaps(documents(rows), table, broadcast_windows=limit).collect()
        assert {(r.doc_id, r.item_id): r.n_matches for r in found} == want and len(found) == len(want)
        for r in found:
            t, w = texts[r.doc_id], items[r.item_id]
            agree = [t[r.doc_start + k] == w[r.item_start + k] for k in range(r.n_words)]
            assert agree[0] and agree[-1] and sum(agree) == r.n_matches


def test_quality(spark, documents):
    rng = random.Random(1)
    good = [(i, prose(rng, 60)) for i in range(150)]
    bad = [(i, " ".join(x + "###" for x in prose(rng, 60).split())) for i in range(150, 300)]
    rows = [*good, *bad, (900, None), (901, ""), (902, "a " * 20000), (0, good[0][1]), (None, bad[0][1])]
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)] + [(None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, text int")
    got = quality.score_quality(documents(rows), labels).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    held = got[got.held_out & (got.doc_id < 300)]
    assert ((held.doc_id < 150) == (held.predicted == 1)).mean() > 0.95
    none = quality.score_quality(documents(rows), labels.limit(0)).toPandas()
    assert none.score.nunique() == 1 and none.score.iloc[0] == 0.5
    assert quality.score_quality(documents([]), labels).count() == 0
    kept = quality.keep_quality(documents(rows), labels)
    assert kept.columns == documents([]).columns and kept.filter("doc_id < 150").count() == 151
    assert quality.Network.load(quality.Network(*[np.ones(1)] * 5, 0.0).save()).b2 == 0.0


def test_hosts(spark):
    urls = ["http://A.Example.org/es/x?y", "https://example.org/en/12", "https://example.org/en/2", "http://x.com/de/", "http://x.com?/de/",
            None, "no scheme", "http://", "http://bad.net/a", "http://good.net/a", "ftp://a.b.co.uk#f", "x://y://z/a"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(8, urls[8], "x"), (None, urls[9], "x")], "page_id bigint, url string, host string")
    rows = [(8, 0)] * 60 + [(9, 1)] * 600 + [(10, None), (999, 0), (None, 1)]
    outcomes = spark.createDataFrame(rows, "page_id bigint, good int")
    rules = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/de/": "block"}
    got = {r.page_id: r for r in hosts.judge(pages, outcomes, rules).collect()}
    view = lambda i: (got[i].host, got[i].path, got[i].rule, got[i].verdict)
    assert view(0) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert view(1)[2:] == ("example.org/en/1", "block") and view(2)[2:] == ("org/", "allow")
    assert view(3)[2:] == ("com/de/", "block") and view(4) == ("x.com", "", None, "allow")
    assert all(view(i) == ("", "", None, "allow") for i in (5, 6, 7))
    assert view(8)[3] == "block" and view(9)[3] == "allow" and view(11)[:2] == ("y:", "//z/a")
    assert got[9].mean > got[10].mean > got[8].mean
    assert hosts.judge(pages, outcomes.limit(0), {}).filter("verdict = 'allow'").count() == len(urls) + 2
    assert hosts.judge(pages.limit(0), outcomes, rules).count() == 0


def test_ann_bundles_and_blocks(spark, monkeypatch):
    """Several parts in a bundle, several blocks of rows and of queries: still every neighbour of the visited parts."""
    assert ann.bundles([3, 4, 9, 1, 0, 2], 7) == ([0, 0, 1, 2, 2, 2], [7, 9, 3])
    assert ann.bundles([], 7) == ([], [])
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(600, 8)), 1)
    x[300:330] = x[0]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    x = x.astype(np.float32).astype(np.float64)
    for name, value in (("BUNDLE", 6), ("BLOCK_ROWS", 64), ("BLOCK_QUERIES", 16), ("STEP_ROWS", 32), ("STEP_QUERIES", 7)):
        monkeypatch.setattr(ann, name, value)
    found = ann.search(frame, F.col("vec_id") % 3 == 0, k=5, wanted_recall=1.1).toPandas()
    assert len(found) == 200 * 5
    for query, rows in found.groupby("query_id"):
        rows = rows.sort_values("rank")
        score = (x * x[query]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(600), -score)) if i != query][:5]
        assert rows.vec_id.tolist() == order
        assert np.allclose(rows.score, score[order], atol=1e-12, rtol=0)


@pytest.mark.parametrize("kind", ["clustered", "smooth"])
def test_ann_recall_where_few_of_many_parts_are_visited(spark, monkeypatch, kind):
    """Every twentieth vector asks; the router has never seen most of them and visits few of at least 32 parts."""
    rng = np.random.default_rng(7)
    if kind == "clustered":
        x = rng.normal(size=(60, 16))[rng.integers(0, 60, 5000)] * rng.uniform(0.5, 2, (5000, 1)) + 0.2 * rng.normal(size=(5000, 16))
    else:
        x = rng.normal(size=(5000, 4)) @ rng.normal(size=(4, 16))
    fitted, fit = [], ann.fit_router
    monkeypatch.setattr(ann, "fit_router", lambda sample, parts, *a: fitted.append((len(sample), parts, fit(sample, parts, *a))) or fitted[-1][2])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    found = ann.search(frame, F.col("vec_id") % 20 == 0, sample=2000).toPandas()
    sample, parts, router = fitted[0]
    assert parts == 128 and sample == 4096 and router.probes < parts
    hits = 0
    for q, own in found.groupby("query_id"):
        near = (x * x[q]).sum(axis=1)
        near[q] = -np.inf
        hits += len(set(np.argsort(-near, kind="stable")[:20]) & set(own.vec_id))
        # Double vectors are ranked as they are given.
        assert np.array_equal(own.sort_values("rank").score.to_numpy(), np.sort(near[own.vec_id])[::-1]) or np.allclose(own.score, near[own.vec_id], rtol=1e-14)
    assert hits / (20 * 250) >= 0.9


def test_ann(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(20, 8))
    base = (centers[rng.integers(0, 20, 600)] + 0.1 * rng.normal(size=(600, 8))).astype(np.float32)
    base[100:160] = base[100]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(base)] + [(5, base[5].tolist(), 1)]
    rows += [(700, None, 1), (720, [0.0] * 8, 1), (740, [None] * 8, 1), (760, [float("nan")] * 8, 1), (780, [1.0], 1), (None, base[0].tolist(), 1)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int")
    found = ann.search(frame, F.col("vec_id") % 20 == 0).toPandas()
    assert set(found.query_id) == set(range(0, 600, 20)) and (found.groupby("query_id").size() == 20).all()
    hits = 0
    for q, own in found.groupby("query_id"):
        near = base.astype(float) @ base[q].astype(float)
        near[q] = -np.inf
        best = np.lexsort((np.arange(600), -np.round(near, 9)))[:20]
        hits += len(set(best) & set(own.vec_id))
        assert np.allclose(own.sort_values("rank").score, near[own.sort_values("rank").vec_id])
    assert hits / (20 * 30) >= 0.9
    few = ann.search(frame.filter("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert [(r.query_id, r.rank) for r in few] == [(0, 1), (0, 2)]
    assert ann.search(frame.limit(0), F.lit(True)).count() == 0


def test_balanced_parts():
    graph = np.array([[(i + 1) % 64, (i - 1) % 64] for i in range(64)])
    assert np.bincount(ann.balanced_parts(graph, 4)).tolist() == [16] * 4


def test_mixing(spark):
    rows = [(i, "x y", "en" if i % 10 else "fr", None if i % 3 else "s", 5) for i in range(3000)] + [(None, None, None, "s", 5), (1, "x y", "en", None, 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, probability int")
    dims = {"lang": F.col("lang"), "source": F.col("source")}
    target = spark.createDataFrame([("en", 0.5), ("fr", 0.5)], "value string, share double")
    got = mixing.mix(docs, dims, mixing.word_count(F.col("text")), F.col("doc_id"), 0.1, targets={"lang": target})
    frame = got.select("row.doc_id", "cell.lang", "tokens", "probability", "kept").toPandas()
    assert len(frame) == len(rows)
    expected = (frame.tokens * frame.probability).groupby(frame.lang).sum()
    assert abs(expected["en"] / expected["fr"] - 1) < 0.01 and abs(expected.sum() / frame.tokens.sum() - 0.1) < 0.001
    assert abs(frame[frame.kept].tokens.sum() / frame.tokens.sum() - 0.1) < 0.03
    whole = mixing.mix(docs, dims, mixing.word_count(F.col("text")), F.col("doc_id"), 1.0, power=1.0)
    assert whole.filter("NOT kept AND tokens > 0").count() == 0
    assert mixing.mix(docs.limit(0), dims, F.lit(1), F.col("doc_id"), 0.5).count() == 0


def test_mixing_meets_the_targets_its_cells_can_give(spark):
    """At a high keep whole cells are kept; the other cells make up for them, and unreachable targets end at their bound."""
    sizes = {("a", "x"): 50, ("a", "y"): 300, ("b", "x"): 350, ("b", "y"): 60, ("c", "x"): 120, ("c", "y"): 120}
    rows = [(f"{s}{l}{i}", "w", s, l) for (s, l), n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, s string, l string")
    dims = {"s": F.col("s"), "l": F.col("l")}
    target = {"s": spark.createDataFrame([("a", 0.25), ("b", 0.45), ("c", 0.3)], "value string, share double"),
              "l": spark.createDataFrame([("x", 0.6), ("y", 0.4)], "value string, share double")}
    reach = lambda keep: {
        r.value: r for r in mixing.shares(mixing.mix(docs, dims, F.lit(1), F.col("doc_id"), keep, targets=target), ["s", "l"], targets=target).collect()}
    met = reach(0.78)
    assert all(abs(r.expected - r.target) < 1e-3 for r in met.values())
    assert abs(met["c"].largest_keep - 0.8) < 1e-9 and met["a"].largest_keep == 1.0
    over = reach(0.85)
    assert abs(over["c"].expected - 0.24 / 0.85) < 1e-3 and abs(over["a"].expected / over["b"].expected - 0.25 / 0.45) < 5e-3


def test_warc_round_trip(spark, tmp_path):
    long, other = "<p>é" + "x" * 2000, "y" * 999
    rows = [(1, "http://a/\r\nX: y", long, 0), (2, None, long, 0), (3, "u", other, 0), (4, "u", other, 0), (5, "u", None, 0), (6, "u", "", 0),
            (2, "u", long, 0), (None, "u", long, 0), (7, "u", "\r\n\r\n" * 900, 0)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, content int")
    archives = warc.write_archives(pages).toPandas()
    for i, content in enumerate(archives.content):
        (tmp_path / f"{i}.warc.zst").write_bytes(bytes(content))
    got = warc.read_archives(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert len(got) == len(rows)
    for r in got:
        body = next(h for i, _, h, _ in rows if i == r.page_id) or ""
        assert r.payload_bytes == len(body.encode()) and r.payload_digest == hashlib.sha1(body.encode()).hexdigest()
        assert (r.record_type, r.refers_to) == (("revisit", 2) if r.page_id == 1 else ("response", None))
        assert r.payload is None if r.page_id == 1 else bytes(r.payload).decode() == body
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_mixing_keeps_what_its_targets_allow(spark, small):
    """The registered mixture: no keep given, so each target alone is in reach; with some documents a cell all are met."""
    from ticketweave.llm import queries

    docs = queries.table(spark, small.replace("sf0.001", "sf0.01"), "documents")
    mixture = queries.mixed(docs, keep=None)
    got = mixing.shares(mixture, ["source", "lang", "topic"]).collect()
    assert all(abs(r.expected - r.target) < 1e-3 for r in got)
    expected, held = mixture.agg(F.sum(F.col("tokens") * F.col("probability")), F.sum("tokens")).first()
    assert abs(expected / held - min(r.largest_keep for r in got)) < 1e-3


def foreign_record(kind, block, content_type="application/http; msgtype=response", **fields):
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{len(block):032x}>", "WARC-Date: 2020-02-03T04:05:06Z"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in fields.items()]
    lines += [f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
    return b"WARC/1.0\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_warc_archives_of_other_writers(spark):
    body = b"<html>caf\xc3\xa9</html>"
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n folded\r\n\r\n"
    sha1 = hashlib.sha1(body).digest()
    records = [
        foreign_record("warcinfo", b"software: some crawler\r\nformat: WARC File Format 1.0\r\n", "application/warc-fields", WARC_Filename="a.warc"),
        foreign_record("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "application/http; msgtype=request", WARC_Target_URI="http://a/"),
        foreign_record("response", http + body, WARC_Target_URI="http://a/"),
        foreign_record("response", http + body, WARC_Payload_Digest="sha1:" + warc._base32(sha1), WARC_Block_Digest="sha256:" + hashlib.sha256(http + body).hexdigest()),
        foreign_record("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n0\r\n\r\n", WARC_Payload_Digest="sha1:" + warc._base32(hashlib.sha1(b"abc").digest())),
        foreign_record("response", b"HTTP/1.1 200 OK\r\nContent-Length: 99\r\n\r\ncut", WARC_Truncated="length"),
        foreign_record("metadata", b"outlink: http://b/\r\n", "application/warc-fields", WARC_Concurrent_To="<urn:uuid:1>"),
        foreign_record("revisit", b"", WARC_Refers_To="<urn:uuid:7>", WARC_Payload_Digest="sha1:" + warc._base32(sha1)),
        foreign_record("resource", body, "text/html", WARC_Payload_Digest="xxh3:123"),
    ]
    packer = warc._compressor(b"")
    note = b"\x53\x2a\x4d\x18\x05\x00\x00\x00hello"
    content = note + packer.compress(records[0]) + note + b"".join(map(packer.compress, records[1:])) + note
    got = warc.read_archives(spark.createDataFrame([(content,), (None,), (b"",)], "content binary")).collect()
    assert [r.record_type for r in got] == [r.split(b"WARC-Type: ")[1].split(b"\r\n")[0].decode() for r in records]
    assert all(r.page_id is None and r.refers_to is None and r.record_id.startswith("<urn:uuid:") for r in got)
    assert bytes(got[2].payload) == bytes(got[3].payload) == bytes(got[8].payload) == body and got[2].payload_digest == sha1.hex()
    assert got[7].payload is None and got[7].payload_digest == sha1.hex() and got[7].refers_to_id == "<urn:uuid:7>"
    assert bytes(got[0].payload).startswith(b"software") and bytes(got[5].payload) == b"cut" and got[5].payload_bytes == 3
    for bad in (foreign_record("response", http + body, WARC_Payload_Digest="sha1:" + warc._base32(hashlib.sha1(b"x").digest())),
                foreign_record("response", b"HTTP/1.1 200 OK\r\nContent-Length: 99\r\n\r\ncut"),
                foreign_record("metadata", b"x", "text/plain", WARC_Block_Digest="md5:" + "0" * 32), foreign_record("response", b"no message")):
        with pytest.raises(ValueError):
            warc.parse_record(bad)
    with pytest.raises(ValueError, match="cut off"):
        list(warc.frames(content[:-2]))


def test_warc_dictionary_and_damage():
    records = [warc.record_bytes(i, "http://a/", f"payload {i}".encode() * 50, None) for i in range(40)]
    plain = zstandard.train_dictionary(2000, records * 5).as_bytes()
    for front in (plain, zstandard.ZstdCompressor().compress(plain), b""):
        packer = warc._compressor(plain if front else b"")
        content = warc.open_archive(front) + b"".join(map(packer.compress, records))
        assert [warc.parse_record(f)["page_id"] for f in warc.frames(content)] == list(range(40))
        with pytest.raises(ValueError, match="cut off"):
            list(warc.frames(content[:-3]))
    for bad in (records[0].replace(b"Content-Length: 4", b"Content-Length: 5", 1), b"x" + records[0], records[0].replace(b"payload 0", b"payload 1"),
                records[0].replace(b"WARC-Date", b"WARC-Data")):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


def test_words_of_slices_and_hashes():
    texts = pa.array(["A b\tc", None, "", "b c", " " * 50 + "x" * 100_000])
    found = words.split_words(texts)
    hashes = words.word_hashes(found)
    assert np.diff(found.rows).tolist() == [3, 0, 0, 2, 1] and hashes[1] == hashes[3] and hashes[0] != hashes[1]
    batch = pa.record_batch([texts], names=["text"])
    assert [s.num_rows for s in words.slices(batch, "text", 10)] == [4, 1]


def test_registered_domains_by_a_table_of_suffixes(spark):
    names = ["a.b.co.nz", "co.nz", "x.gov.uk", "y.z.k12.ca.us", "w.example.com", "localhost", "q.r.unknown"]
    given = spark.createDataFrame([(n,) for n in names + names[:2]], "host string")
    listed = spark.createDataFrame([("CO.nz",), ("gov.uk",), ("us",), ("k12.ca.us",), ("",), (None,), ("co.nz",)], "suffix string")
    got = {r.host: (r.domain, r.suffix) for r in hosts_table(given, listed)}
    assert got == {
        "a.b.co.nz": ("b.co.nz", "co.nz"), "co.nz": ("co.nz", "co.nz"), "x.gov.uk": ("x.gov.uk", "gov.uk"),
        "y.z.k12.ca.us": ("z.k12.ca.us", "k12.ca.us"), "w.example.com": ("example.com", "com"),
        "localhost": ("localhost", "localhost"), "q.r.unknown": ("r.unknown", "unknown")}
    plain = {r.host: (r.domain, r.suffix) for r in hosts_table(given, None)}
    assert plain["a.b.co.nz"] == ("co.nz", "nz") and len(plain) == len(names)
    pages = spark.createDataFrame([(i, f"http://{h}/p") for i, h in enumerate(["a.spam.co.nz", "b.fine.co.nz"] * 40)], "page_id bigint, url string")
    outcomes = spark.createDataFrame([(i, i % 2) for i in range(60)], "page_id bigint, good int")
    for suffixes in (listed, None):
        verdicts = {r.host: r.verdict for r in judge_rows(pages, outcomes, suffixes)}
        assert verdicts == {"a.spam.co.nz": "block", "b.fine.co.nz": "allow"}


def hosts_table(frame, listed):
    return hosts.registered(frame, listed).collect()


def judge_rows(pages, outcomes, suffixes):
    return hosts.judge(pages, outcomes, {}, suffixes=suffixes).select("host", "verdict").distinct().collect()
