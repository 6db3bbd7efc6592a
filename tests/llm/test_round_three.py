"""Prefix trie, line dedup and importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from ticketweave.llm import lines, queries, resample, trie
from ticketweave.session import Workspace

SPACES = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id bigint, turn int, role string, text string, d int, w string, shard string"


# -- op11 ----------------------------------------------------------------------------------------------------------


def brute_nodes(convs):
    """Nodes of {conv_id: [(role, text), ...]}."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    words = lambda path: len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[k] for k in kids[path]) or 1
        saved[path] = (len(members[path]) - 1) * words(path) + sum(saved[k] for k in kids[path])
    out = set()
    for path, own in members.items():
        ends = ",".join(map(str, sorted(c for c in own if len(convs[c]) == len(path))))
        parent = min(members[path[:-1]]) if path else None
        out.add((min(own), len(path), parent, len(own), len(kids[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes(frame):
    rows = [tuple(r) for r in frame.select(COLUMNS).collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def drawn_conversations(seed):
    rng = random.Random(seed)
    turn = lambda: (rng.choice(["user", "bot", ""]), rng.choice(["", "a b", "c", "d e f", "  x "]))
    convs = {}
    for c in rng.sample(range(-50, 400), 120):
        start = list(rng.choice(list(convs.values()))) if convs and rng.random() < 0.7 else []
        convs[c] = start[: rng.randint(0, len(start))] + [turn() for _ in range(rng.randint(0 if start else 1, 6))] or [turn()]
    many = [("user", f"w{i} x") for i in range(90)]
    convs[1000] = convs[1001] = convs[1002] = many
    convs[1003] = many[:70]
    convs[1004] = many[:75] + [("user", f"v{i}") for i in range(60)]
    convs[1005] = [("bot", "alone")] * 130
    for c in range(2000, 2300):
        convs[c] = [("user", "same"), ("bot", "same")]
    return convs


def table_of(spark, convs, shuffled=3):
    rows = [(c, t if t else None, r, x, 1, "q", "s") for c, turns in convs.items() for t, (r, x) in enumerate(turns)]
    random.Random(shuffled).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize(
    "settings", [{}, {"shard_turns": 40, "prefix_turns": 10, "tail_after": 4}, {"shard_turns": 7, "prefix_turns": 1, "tail_after": 1}]
)
def test_trie_like_brute_force(spark, monkeypatch, settings):
    monkeypatch.setattr(trie, "TAIL_RUN", 16)
    convs = drawn_conversations(8)
    got = trie.conversation_trie(table_of(spark, convs), **settings)
    assert nodes(got) == brute_nodes(convs)


def test_trie_gives_texts_and_takes_odd_rows(spark):
    rows = [(1, None, None, None, 0, "", ""), (1, 1, "user", "b", 0, "", ""), (None, 1, "user", "z", 0, "", "")]
    rows += [(2, None, "", "", 0, "", ""), (2, 5, "user", "b", 0, "", ""), (2, 5, "user", "b", 0, "", "")]
    got = trie.conversation_trie(spark.createDataFrame(rows, SCHEMA))
    want = {1: [("", ""), ("user", "b")], 2: [("", ""), ("user", "b"), ("user", "b")]}
    assert nodes(got) == brute_nodes(want)
    assert got.filter("depth = 2").select("role", "text").first() == ("user", "b")
    assert trie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_conversation_of_very_many_turns(spark):
    """A third of all rows in one conversation, with a copy; ties go by a digest, so both stay equal."""
    rows = spark.range(20_000).selectExpr("explode(array(1, 2)) conv_id", "cast(id as int) turn", "'user' role", "concat('w ', id) text")
    got = trie.conversation_trie(rows)
    assert got.count() == 20_001
    assert got.filter("depth = 20000").select(COLUMNS[:7]).first() == (1, 20000, 1, 2, 0, 1, 2)
    assert got.filter("depth = 1").select(COLUMNS[:7]).first() == (1, 1, 1, 2, 1, 1, 40_000)


def test_rebuilt_openings_like_brute_force(spark):
    convs = {c: t for c, t in drawn_conversations(4).items() if t}
    for c in (0, 20, 40, 60, 100):
        convs.pop(c, None)
    convs |= {20: [("u", "one")], 40: [("u", "one"), ("u", "two"), ("u", "three"), ("u", "four")], 21: [("u", "x")], 105: [("u", "y")]}
    rebuilt = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - math.fmod(c, 20)
        rebuilt[c] = convs.get(int(base), [])[:h] + turns[h:]
    assert any(not t for t in rebuilt.values())
    work = Workspace(spark, "test")
    turns = trie.number_turns(table_of(spark, convs), work)
    ids = turns.select("conv_id").distinct()
    assert nodes(trie.prefix_nodes(trie.share_openings(turns, ids, work), ids, work)) == brute_nodes(rebuilt)


def test_double_array_holds_every_path():
    rng = np.random.default_rng(2)
    for size, label in ((1, 1), (40, 3), (400, 200), (300, 5000)):
        paths = [rng.integers(1, label + 1, rng.integers(0, 9)) for _ in range(size)]
        ids = np.concatenate([*paths, np.zeros(0, dtype=np.int64)]).astype(np.int64)
        offsets = np.cumsum([0, *map(len, paths)])
        parent, names = trie.branches(ids, offsets)
        base, check = trie.pack(parent, names)
        assert (check >= 0).sum() == len(parent) == len({tuple(p[:d]) for p in paths for d in range(len(p) + 1)})
        ends = {}
        for _, alive, before, after in trie.walk(base, check, ids, offsets):
            ends |= dict(zip(alive.tolist(), after.tolist()))
        for i, path in enumerate(paths):
            state, walked = ends.get(i, 0), []
            while state:
                walked.append(state - base[check[state]])
                state = int(check[state])
            assert walked[::-1] == list(path)


# -- op12 ----------------------------------------------------------------------------------------------------------


def line_key(line):
    return line.strip(SPACES).translate({c: c + 32 for c in range(65, 91)})


def brute_lines(rows, min_chars=10, min_docs=2):
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(line_key(line)) >= min_chars:
                holders[line_key(line)].add(i)
    out = []
    for i, text in rows:
        own = (text or "").split("\n")
        gone = lambda k: i is not None and len(holders.get(k, ())) >= min_docs and i > min(holders[k])  # noqa: E731, B023
        kept = [x for x in own if not gone(line_key(x))]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_docs", [2, 3])
def test_lines_like_brute_force(documents, min_docs):
    rng = random.Random(3)
    pool = ["shared line number one", "SHARED line Number One ", "\tshared line number one\r", "nine char", "ten chars.", "ümläut ÄÖ x", "Ümläut äö X"]
    pool += ["", "  not a space ", "a" * 3000, "\x0bvertical tab line\x0c"]
    rows = [(i, "\n".join(rng.choice(pool + [f"own {i} {rng.random()}"]) for _ in range(rng.randint(1, 9)))) for i in range(80)]
    rows += [(7, "shared line number one\nother"), (500, None), (501, ""), (502, "\n\n"), (None, "shared line number one"), (3, None)]
    rows += [(600, "\n".join(["ten chars."] * 4000)), (-1, "ten chars.\nten chars.")]
    got = lines.drop_repeated_lines(documents(rows), min_docs=min_docs)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_lines(rows, min_docs=min_docs)
    assert lines.drop_repeated_lines(documents([])).count() == 0


def test_a_line_in_one_document_is_no_repeat(documents):
    with pytest.raises(ValueError):
        lines.drop_repeated_lines(documents([]), min_docs=1)


# -- op13 ----------------------------------------------------------------------------------------------------------


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10_000 for r in runs]


def brute_resample(rows, target, percent=5, min_words=20):
    own = [(i, *plain_features(t)) for i, t in rows]
    s, t = np.zeros(10_000, int), np.zeros(10_000, int)
    for _, _, codes in own:
        np.add.at(s, codes, 1)
    for text in target:
        np.add.at(t, plain_features(text)[1], 1)
    gain = [math.floor(1000 * math.log((tb + 1) * (s.sum() + 10_000) / ((sb + 1) * (t.sum() + 10_000)))) for sb, tb in zip(s.tolist(), t.tolist())]
    out = []
    for i, n, codes in own:
        weight, score = sum(gain[c] for c in codes), None
        if i is not None:
            h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, n, len(codes), weight, score, None])
    able = sorted((r for r in out if r[1] >= min_words and r[0] is not None), key=lambda r: (-r[4], r[0], -r[2]))
    for place, row in enumerate(able[: percent * len(able) // 100]):
        row[5] = place + 1
    return sorted(map(tuple, out), key=repr)


def test_resampling_like_brute_force(spark, documents):
    rng = random.Random(11)
    word = lambda: rng.choice(["alpha", "BETA", "gämma", "42", "d e", "x中", "-", "\x7f", "Éa", "it's"])
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(400)]
    rows += [(900, None), (901, ""), (None, "alpha " * 30), (902, "beta " * 20_000), (7, "alpha beta " * 15), (7, "alpha beta " * 15)]
    target = ["Alpha beta gämma 42", None, ""]
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, score int")
    got = resample.resample(documents(rows), aim)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_resample(rows, target)
    most = resample.resample(documents(rows), aim, percent=50, min_words=5)
    assert sorted((tuple(r) for r in most.collect()), key=repr) == brute_resample(rows, target, 50, 5)
    assert resample.resample(documents([]), aim).count() == 0
    nothing = resample.resample(documents(rows), aim.filter("false"))
    assert sorted((tuple(r) for r in nothing.collect()), key=repr) == brute_resample(rows, [])


def test_words_keep_their_offsets():
    text = "Héllo, WÖRLD 42 x y"
    found = resample.words_with_offsets(resample.word_splitter(), text.encode())
    assert [w for w, _ in found] == ["héllo", "wÖrld", "42 x", "y"]
    assert all(text[a:z].encode().translate(resample.ASCII_LOWER).decode() == w for w, (a, z) in found)


def test_new_queries_are_registered():
    assert {"op11_prefix_trie", "op12_line_dedup", "op13_importance_resampling"} <= queries.QUERIES.keys() & queries.ORACLES.keys()
