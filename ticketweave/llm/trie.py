"""Prefix trie of conversations: double arrays per prefix shard, upper nodes merged globally.

A conversation is the sequence of its turns (role, text). A node of the trie is
a distinct sequence of first turns; its members are the conversations that start
with it.

1. *Turns* become 128-bit keys and are numbered within their conversation by a
   range sort, whose runs are summed up, so no task sees all of one conversation.
2. *Classes.* Conversations of equal sequences are one path with a weight. What
   follows grows with distinct paths, whatever the number of copies.
3. *Prefix shards.* A path belongs to its shortest prefix that few enough turns
   share. Whole prefixes are bundled into shards of about equal size. Paths
   without such a prefix are spread by their own digest: all they touch is shared.
4. *Double array.* A shard gives its turns dense ids and packs the trie into BASE
   and CHECK: the child of state s by turn i is BASE[s] + i, if CHECK there is s.
   All paths walk it at once and leave their members at the states. The end of a
   path that no other shares, beyond ``tail_after`` turns, is no part of the
   arrays, as the TAIL of such tries; its nodes follow from the turns themselves.
5. *Merge.* Nodes below a shard's prefixes are complete. The upper ones, which
   several shards hold, are summed up by their digest; each is owned by one
   shard, and the shards sum the owned ones up to the root once more.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Workspace

# Turns of one shard's arrays, and of the largest prefix that is bundled whole.
SHARD_TURNS = 20_000
PREFIX_TURNS = 5_000
# Depth up to which every path is in the arrays, shared or not.
TAIL_AFTER = 64
# Ids that one row of a class's id list holds; turns of one run of tail sums.
LIST_IDS = 4096
TAIL_RUN = 1 << 16
# Free places tried for the children of one node before the array grows.
TRIES = 64
NO_END = hashlib.sha256(b"").hexdigest()
NEVER = (1 << 31) - 1

PACKED = (
    "shard int, depth int, x1 bigint, x2 bigint, p1 bigint, p2 bigint, k1 bigint, k2 bigint, shared boolean, upper boolean, "
    "conv_id bigint, parent_conv_id bigint, n bigint, words bigint, children bigint, leaves bigint, saved bigint, ends string"
)
NODE = ("depth", "x1", "x2")


def turn_keys(role: Column, text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a turn."""
    digest = F.substring(F.md5(F.concat(role, F.lit("\0"), text)), 1, 16)
    return F.xxhash64(role, text), F.conv(digest, 16, -10).cast("bigint")


def _place() -> tuple[Column, Column]:
    """Partition and place within it, from the identifier that a sorted table carries."""
    part = F.shiftright("at", 33)
    return part, F.col("at") - F.shiftleft(part, 33)


def number_turns(conversations: DataFrame, work: Workspace) -> DataFrame:
    """(conv_id, d, k1, k2, w): the turns of each conversation, numbered from 1 without gaps.

    In order of ``turn``, null first; turns of one number are ordered by a digest
    of role and text. ``w`` counts the words of the text. Rows without conv_id
    are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    k1, k2 = turn_keys(role, text)
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        k1.alias("k1"),
        k2.alias("k2"),
        F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("bigint").alias("w"),
        # Parts equal rows, whichever way.
        F.monotonically_increasing_id().alias("row"),
    )
    # Written, as a sort by ranges reads its input twice.
    turns = work.write(turns, "keyed")
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("k1"), F.col("k2"), F.col("row")]
    ordered = turns.repartitionByRange(*order).sortWithinPartitions(*order).drop("row", "turn")
    part, _ = _place()
    ordered = work.write(ordered.withColumn("at", F.monotonically_increasing_id()), "ordered").withColumn("part", part)
    runs = ordered.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv_id", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    numbered = ordered.join(runs, ["conv_id", "part"])
    numbered = work.write(numbered.select("conv_id", (F.col("at") + F.col("shift")).alias("d"), "k1", "k2", "w"), "turns")
    work.drop("keyed", "ordered")
    return numbered


# -- Double arrays -----------------------------------------------------------------------------------------------


def branches(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parent and label of every node of the trie of the paths ids[offsets[i]:offsets[i + 1]], root first, by depth."""
    sizes = np.diff(offsets)
    at = np.zeros(len(sizes), dtype=np.int64)
    parents, labels, total = [np.array([-1])], [np.array([0])], 1
    span = int(ids.max()) + 1 if len(ids) else 1
    for d in range(int(sizes.max(initial=0))):
        alive = np.flatnonzero(sizes > d)
        code, place = np.unique(at[alive] * span + ids[offsets[alive] + d], return_inverse=True)
        parents.append(code // span)
        labels.append(code % span)
        at[alive] = total + place
        total += len(code)
    return np.concatenate(parents), np.concatenate(labels)


def pack(parent: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BASE and CHECK of a trie whose nodes come by depth and, within a parent, by label; labels start at 1.

    The root is state 0. Nodes of one child take the free places in turn; wider
    ones, widest first, the first of some free places where all labels fit.
    """
    nodes = len(parent)
    first = np.searchsorted(parent, np.arange(nodes + 1))
    width = np.diff(first)
    state, offset = np.zeros(nodes, dtype=np.int64), np.zeros(nodes, dtype=np.int64)
    taken, end, start = np.zeros(max(int(label.max()) + 2, 2 * nodes), dtype=bool), 1, 1
    taken[0] = True
    for node in np.flatnonzero(width > 1)[np.argsort(-width[width > 1], kind="stable")]:
        own = label[first[node] : first[node + 1]]
        reach = int(own[-1] - own[0]) + 1
        while start < end and taken[start]:
            start += 1
        shift = end - own[0]
        for place in start + np.flatnonzero(~taken[start:end])[:TRIES]:
            if place + reach <= len(taken) and not taken[place - own[0] + own].any():
                shift = place - own[0]
                break
        if shift + own[-1] >= len(taken):
            taken = np.concatenate([taken, np.zeros(max(len(taken), reach), dtype=bool)])
        taken[shift + own] = True
        offset[node], state[first[node] : first[node + 1]] = shift, shift + own
        end = max(end, int(shift + own[-1]) + 1)
    single = np.flatnonzero(width == 1)
    free = np.flatnonzero(~taken[:end])[: len(single)]
    free = np.concatenate([free, np.arange(end, end + len(single) - len(free))])
    child = first[single]
    state[child], offset[single] = free, free - label[child]
    size = max(end, int(free.max(initial=0)) + 1)
    base, check = np.zeros(size, dtype=np.int64), np.full(size, -1, dtype=np.int64)
    base[state] = offset
    check[0] = 0
    check[state[1:]] = state[parent[1:]]
    return base, check


def walk(base: np.ndarray, check: np.ndarray, ids: np.ndarray, offsets: np.ndarray):
    """Go along all paths at once: (depth, alive paths, their former and new states), depth by depth."""
    sizes = np.diff(offsets)
    state = np.zeros(len(sizes), dtype=np.int64)
    for d in range(int(sizes.max(initial=0))):
        alive = np.flatnonzero(sizes > d)
        before = state[alive]
        after = base[before] + ids[offsets[alive] + d]
        if not (check[after] == before).all():
            raise AssertionError("a path leaves the double array")
        state[alive] = after
        yield d + 1, alive, before, after


def _pack_shard(shard_table: pa.Table) -> pa.Table:
    """``applyInArrow``: the nodes of one shard's trie, with all that the shard knows about them."""
    rep, n, exclusive, tail_turns, tail_words = (
        shard_table[c].to_numpy() for c in ("rep", "n", "exclusive", "tail_turns", "tail_words")
    )
    paths = shard_table["path"].combine_chunks()
    offsets = paths.offsets.to_numpy().astype(np.int64)
    _, k1, k2, t1, t2, w = (a.to_numpy(zero_copy_only=False) for a in paths.values.flatten())
    turns, ids = np.unique(np.stack([k1, k2], axis=1), axis=0, return_inverse=True)
    ids = ids.reshape(-1).astype(np.int64) + 1
    base, check = pack(*branches(ids, offsets))

    size = len(base)
    depth, members, words, label = (np.zeros(size, dtype=np.int64) for _ in range(4))
    x1, x2 = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    least = np.full(size, np.iinfo(np.int64).max)
    complete = np.zeros(size, dtype=bool)
    last = np.zeros(len(rep), dtype=np.int64)
    members[0], least[0] = n.sum(), rep.min()
    for d, alive, before, after in walk(base, check, ids, offsets):
        at = offsets[alive] + d - 1
        depth[after], words[after], label[after] = d, w[at], ids[at]
        x1[after], x2[after] = x1[before] ^ t1[at], x2[before] ^ t2[at]
        np.add.at(members, after, n[alive])
        np.minimum.at(least, after, rep[alive])
        complete[after[exclusive[alive] <= d]] = True
        last[alive] = after

    children, leaves, saved = (np.zeros(size, dtype=np.int64) for _ in range(3))
    nodes = np.flatnonzero(check >= 0)
    below = nodes[nodes > 0]
    np.add.at(children, check[below[complete[below]]], 1)
    tails = tail_turns > 0
    np.add.at(children, last[tails], 1)
    leaves[complete & (children == 0)] = 1
    np.add.at(leaves, last[tails], 1)
    saved[complete] = ((members - 1) * words)[complete]
    np.add.at(saved, last, (n - 1) * tail_words)
    order = below[complete[below]]
    order = order[np.argsort(depth[order], kind="stable")]
    bounds = np.searchsorted(depth[order], np.arange(1, int(depth.max()) + 2))
    for a, z in zip(bounds[-2::-1], bounds[:0:-1]):
        here = order[a:z]
        np.add.at(leaves, check[here], leaves[here])
        np.add.at(saved, check[here], saved[here])

    ends = np.full(size, None, dtype=object)
    ends[last[~tails]] = shard_table["ends"].to_numpy(zero_copy_only=False)[~tails]
    parent = check[nodes]
    root = nodes == 0
    key = np.concatenate([np.zeros((1, 2), dtype=np.int64), turns.reshape(-1, 2)])[label[nodes]]
    columns = {
        "shard": np.full(len(nodes), shard_table["shard"][0].as_py(), dtype=np.int32),
        "depth": depth[nodes].astype(np.int32),
        "x1": x1[nodes],
        "x2": x2[nodes],
        "p1": x1[parent],
        "p2": x2[parent],
        "k1": key[:, 0],
        "k2": key[:, 1],
        "shared": ~complete[nodes],
        "upper": ~root & ~complete[parent],
        "conv_id": least[nodes],
        "parent_conv_id": pa.array(least[parent], mask=root),
        "n": members[nodes],
        "words": words[nodes],
        "children": children[nodes],
        "leaves": leaves[nodes],
        "saved": saved[nodes],
        "ends": pa.array(ends[nodes], pa.string()),
    }
    return pa.table({name: pa.array(c) if isinstance(c, np.ndarray) else c for name, c in columns.items()})


def _sum_up(shard_table: pa.Table) -> pa.Table:
    """``applyInArrow``: sum leaves and saved words of one shard's upper nodes up to the root."""
    depth, x1, x2, p1, p2, leaves, saved = (
        shard_table[c].to_numpy().copy() for c in ("depth", "x1", "x2", "p1", "p2", "leaves", "saved")
    )
    for d in range(int(depth.max()), 0, -1):
        here, above = np.flatnonzero(depth == d), np.flatnonzero(depth == d - 1)
        place = {pair: i for pair, i in zip(zip(x1[above].tolist(), x2[above].tolist()), above.tolist())}
        parent = np.array([place[pair] for pair in zip(p1[here].tolist(), p2[here].tolist())], dtype=np.int64)
        np.add.at(leaves, parent, leaves[here])
        np.add.at(saved, parent, saved[here])
    return pa.table({"depth": depth, "x1": x1, "x2": x2, "leaves": leaves, "saved": saved})


# -- Ids of the conversations that end at a node -------------------------------------------------------------------


def _id_lists(batches):
    """``mapInArrow`` over rows sorted by (rep, conv_id): ids joined by comma, up to LIST_IDS a row."""
    rep, ids = None, []
    for batch in batches:
        out = []
        for r, c in zip(batch.column("rep").to_pylist(), batch.column("conv_id").to_pylist()):
            if ids and (r != rep or len(ids) == LIST_IDS):
                out.append((rep, ids[0], ",".join(map(str, ids))))
                ids = []
            rep = r
            ids.append(c)
        yield _batch(out, ("rep", "first", "ids"), (pa.int64(), pa.int64(), pa.string()))
    if ids:
        yield _batch([(rep, ids[0], ",".join(map(str, ids)))], ("rep", "first", "ids"), (pa.int64(), pa.int64(), pa.string()))


def _hash_lists(batches):
    """``mapInArrow`` over rows sorted by (rep, first): the SHA-256 of each rep's whole list, as it streams by."""
    rep, state = None, None
    types = (pa.int64(), pa.string())
    for batch in batches:
        out = []
        for r, ids in zip(batch.column("rep").to_pylist(), batch.column("ids").to_pylist()):
            if r == rep:
                state.update(b"," + ids.encode())
                continue
            if state:
                out.append((rep, state.hexdigest()))
            rep, state = r, hashlib.sha256(ids.encode())
        yield _batch(out, ("rep", "ends"), types)
    if state:
        yield _batch([(rep, state.hexdigest())], ("rep", "ends"), types)


def _batch(rows: list[tuple], names: tuple, types: tuple) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=list(names))


def _end_hashes(members: DataFrame) -> DataFrame:
    """(rep, ends): the hash of all conv_ids of each rep in ascending order.

    The ids are joined in sorted pieces, so the task that hashes a class of very
    many members streams a few long rows; it holds one of them at a time.
    """
    order = ("rep", "conv_id")
    lists = members.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    lists = lists.mapInArrow(_id_lists, "rep bigint, first bigint, ids string")
    return lists.repartition("rep").sortWithinPartitions("rep", "first").mapInArrow(_hash_lists, "rep bigint, ends string")


# -- The whole trie ------------------------------------------------------------------------------------------------


def prefix_nodes(
    turns: DataFrame,
    ids: DataFrame,
    work: Workspace,
    shard_turns: int = SHARD_TURNS,
    prefix_turns: int = PREFIX_TURNS,
    tail_after: int = TAIL_AFTER,
) -> DataFrame:
    """The nodes of the trie of ``turns`` (conv_id, d, k1, k2, w), as ``conversation_trie`` gives them, with k1 and k2.

    ``ids`` lists every conversation once (conv_id), those without turns included.
    """
    marked = turns.select("*", F.xxhash64("k1", "k2", "d").alias("t1"), F.xxhash64("d", "k2", "k1").alias("t2"))
    # Prefixes are looked at after each of the first turns, then at doubling depths.
    stop = F.expr(f"CASE WHEN d <= {tail_after} THEN d ELSE shiftleft({tail_after}L, length(bin((d - 1) DIV {tail_after}))) END")
    levels = marked.groupBy("conv_id", stop.alias("stop")).agg(
        F.bit_xor("t1").alias("t1"), F.bit_xor("t2").alias("t2"), F.max("d").alias("d")
    )
    upto = Window.partitionBy("conv_id").orderBy("stop").rowsBetween(Window.unboundedPreceding, 0)
    levels = levels.select("conv_id", "stop", "d", F.bit_xor("t1").over(upto).alias("x1"), F.bit_xor("t2").over(upto).alias("x2"))
    levels = work.write(levels, "levels")
    whole = levels.groupBy("conv_id").agg(F.max_by(F.struct("d", "x1", "x2"), "d").alias("end"))
    zero = F.struct(F.lit(0).cast("bigint").alias("d"), F.lit(0).cast("bigint").alias("x1"), F.lit(0).cast("bigint").alias("x2"))
    whole = work.write(ids.join(whole, "conv_id", "left").select("conv_id", F.coalesce("end", zero).alias("end")), "whole")
    classes = whole.groupBy("end").agg(F.min("conv_id").alias("rep"), F.count("*").alias("n"))
    classes = work.write(classes.select("rep", "n", "end"), "classes")
    copied = classes.filter("n > 1").select("end", "rep")
    ends = work.write(_end_hashes(whole.join(copied, "end")), "ends")

    # Where each class belongs: its shortest prefix that few turns share, if any.
    sized = classes.select(F.col("rep").alias("conv_id"), F.col("end.d").alias("size"))
    own = work.write(levels.join(sized, "conv_id").filter("d = stop"), "own")
    held = own.groupBy("stop", "x1", "x2").agg(F.count("*").alias("classes"), F.sum("size").alias("turns"))
    own = own.join(held, ["stop", "x1", "x2"])
    few = F.when((F.col("turns") <= prefix_turns) | (F.col("classes") == 1), F.col("stop"))
    alone = F.when((F.col("classes") == 1) & (F.col("stop") >= tail_after), F.col("stop"))
    placed = own.groupBy(F.col("conv_id").alias("rep")).agg(
        F.min(few).alias("exclusive"), F.min_by(F.struct("x1", "x2"), few).alias("prefix"), F.min(alone).alias("head")
    )
    items = classes.join(placed, "rep", "left").join(ends, "rep", "left")
    items = items.select(
        "rep",
        "n",
        F.col("end.d").alias("size"),
        F.coalesce(F.col("exclusive"), F.lit(NEVER)).cast("bigint").alias("exclusive"),
        F.coalesce("prefix", F.struct("end.x1", "end.x2")).alias("prefix"),
        F.least(F.coalesce("head", "end.d"), "end.d").alias("head"),
        F.coalesce("ends", F.sha2(F.col("rep").cast("string").cast("binary"), 256)).alias("ends"),
    )
    items = work.write(items, "items")
    work.drop("levels", "whole", "classes", "own", "ends")
    packed_turns = items.agg(F.coalesce(F.sum("head"), F.lit(0))).first()[0]
    shard = F.pmod(F.xxhash64("prefix"), F.lit(packed_turns // shard_turns + 1)).cast("int")

    inside = F.col("d") <= F.col("head")
    heads = marked.join(items.select(F.col("rep").alias("conv_id"), "head"), "conv_id").groupBy(F.col("conv_id").alias("rep")).agg(
        F.sort_array(F.collect_list(F.when(inside, F.struct("d", "k1", "k2", "t1", "t2", "w")))).alias("path"),
        F.sum(F.when(inside, 0).otherwise(F.col("w"))).alias("tail_words"),
    )
    none = F.array().cast("array<struct<d:bigint,k1:bigint,k2:bigint,t1:bigint,t2:bigint,w:bigint>>")
    shards = items.join(heads, "rep", "left").select(
        shard.alias("shard"), "rep", "n", "exclusive", (F.col("size") - F.col("head")).alias("tail_turns"),
        F.coalesce("tail_words", F.lit(0)).alias("tail_words"), "ends", F.coalesce("path", none).alias("path"),
    )
    packed = work.write(shards.groupBy("shard").applyInArrow(_pack_shard, PACKED), "packed")

    result = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "k1", "k2"]
    upper = _merged(packed, work)
    parents = upper["by_shard"].select(
        "shard", (F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("above")
    )
    complete = packed.filter("NOT shared")
    # The shard is part of the key: a node with very many children has few in each.
    hanging = complete.filter("upper").join(parents, ["shard", "depth", "p1", "p2"]).withColumn("parent_conv_id", F.col("above"))
    whole_below = complete.filter("NOT upper").unionByName(hanging.select(complete.columns))
    below = whole_below.select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NO_END)).alias("ends_sha256"), "k1", "k2",
    )
    tails = _tail_nodes(turns, items)
    numbers = [F.col(c) if c == "ends_sha256" else F.col(c).cast("bigint").alias(c) for c in result]
    return below.unionByName(upper["nodes"].select(result)).unionByName(tails.select(result)).select(numbers)


def _merged(packed: DataFrame, work: Workspace) -> dict[str, DataFrame]:
    """The upper nodes, merged over all shards, and by shard."""
    shared = packed.filter("shared")
    merged = shared.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"),
        F.sum("n").alias("n"),
        F.sum("children").alias("children"),
        F.max("ends").alias("ends"),
        F.min("shard").alias("owner"),
        *[F.min(c).alias(c) for c in ("words", "p1", "p2", "k1", "k2")],
    )
    merged = work.write(merged, "merged")
    counted = merged.filter("depth > 0").groupBy(
        (F.col("depth") - 1).cast("int").alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")
    ).agg(F.count("*").alias("inner"))
    children = F.col("children") + F.coalesce("inner", F.lit(0))
    merged = merged.join(counted, [*NODE], "left").withColumn("children", children).drop("inner")
    merged = work.write(merged, "counted")
    known = merged.select(*NODE, "owner", F.col("conv_id").alias("all_conv"), F.col("n").alias("all_n"), F.col("children").alias("all_children"))
    by_shard = work.write(shared.join(known, [*NODE]), "by-shard")
    owned = F.col("shard") == F.col("owner")
    own = by_shard.select(
        "shard", *NODE, "p1", "p2",
        (F.col("leaves") + F.when(owned & (F.col("all_children") == 0), 1).otherwise(0)).alias("leaves"),
        (F.col("saved") + F.when(owned, (F.col("all_n") - 1) * F.col("words")).otherwise(0)).alias("saved"),
    )
    summed = own.groupBy("shard").applyInArrow(_sum_up, "depth int, x1 bigint, x2 bigint, leaves bigint, saved bigint")
    sums = summed.groupBy(*NODE).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    above = merged.select(
        (F.col("depth") + 1).cast("int").alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id")
    )
    nodes = merged.join(sums, [*NODE]).join(above, ["depth", "p1", "p2"], "left").select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends", F.lit(NO_END)).alias("ends_sha256"), "k1", "k2",
    )
    return {"nodes": nodes, "by_shard": by_shard.select("shard", *NODE, F.col("all_conv").alias("conv_id"))}


def _tail_nodes(turns: DataFrame, items: DataFrame) -> DataFrame:
    """Nodes beyond a path's head: one class, one child each, and the words from there to the end."""
    long = items.filter("size > head").select(F.col("rep").alias("conv_id"), "head", "size", "n", "ends")
    tail = turns.join(long, "conv_id").filter("d > head").withColumn("run", F.expr(f"d DIV {TAIL_RUN}"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, -1)
    runs = tail.groupBy("conv_id", "run").agg(F.sum("w").alias("w"))
    runs = runs.select("conv_id", "run", F.coalesce(F.sum("w").over(later), F.lit(0)).alias("after"))
    rest = Window.partitionBy("conv_id", "run").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    words = F.sum("w").over(rest)
    return tail.withColumn("rest", words).join(runs, ["conv_id", "run"]).select(
        "conv_id", F.col("d").alias("depth"), F.col("conv_id").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        (F.col("d") < F.col("size")).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"),
        ((F.col("n") - 1) * (F.col("rest") + F.col("after"))).alias("saved_tokens"),
        F.when(F.col("d") == F.col("size"), F.col("ends")).otherwise(F.lit(NO_END)).alias("ends_sha256"), "k1", "k2",
    )


def conversation_trie(conversations: DataFrame, **settings: int) -> DataFrame:
    """The nodes of the prefix trie of ``conversations`` (conv_id, turn, role, text; further columns are left out).

    One row per node: conv_id, its smallest member; depth, its number of turns
    (0 for the root); parent_conv_id, the parent's conv_id (null for the root);
    n_convs, members; n_children; n_leaves, childless nodes in its subtree;
    saved_tokens, the sum over its subtree of (n_convs - 1) times the words of
    the node's last turn, what storing each prefix once saves; ends_sha256, the
    hash of the conv_ids that end here, ascending, joined by comma; role and text
    of its last turn. (conv_id, depth) names a node.

    Turns are in order of ``turn``, null first, equal ones by a digest of role
    and text; repeated rows are turns of their own. Null role or text is empty.
    Rows without conv_id are left out. An empty table has no nodes.

    A path's head, what two different conversations share or ``tail_after``
    turns, is one array in one row (48 bytes a turn).
    """
    work = Workspace(conversations.sparkSession, "trie")
    turns = number_turns(conversations, work)
    nodes = prefix_nodes(turns, turns.select("conv_id").distinct(), work, **settings)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    k1, k2 = turn_keys(role, text)
    known = conversations.select(k1.alias("k1"), k2.alias("k2"), role.alias("role"), text.alias("text"))
    known = known.groupBy("k1", "k2").agg(F.min("role").alias("role"), F.min("text").alias("text"))
    return nodes.join(known, ["k1", "k2"], "left").drop("k1", "k2")


def share_openings(turns: DataFrame, ids: DataFrame, work: Workspace, every: int = 20, most: int = 3) -> DataFrame:
    """Turns of conversations rebuilt on the openings of others.

    Conversation c gets the first h turns of conversation c - c % every, then its
    own after its first h; h is the CRC-32 of its decimal id modulo ``most`` + 1.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most + 1))
    base = (F.col("conv_id") - F.col("conv_id") % every).alias("base")
    openings = turns.filter((F.col("conv_id") % every == 0) & (F.col("d") <= most))
    openings = openings.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("d", "k1", "k2", "w"))).alias("opening"))
    plan = ids.select("conv_id", base, h.cast("int").alias("h")).join(openings, "base", "left")
    none = F.array().cast("array<struct<d:bigint,k1:bigint,k2:bigint,w:bigint>>")
    plan = plan.select("conv_id", "h", F.slice(F.coalesce("opening", none), F.lit(1), F.col("h")).alias("opening"))
    plan = work.write(plan, "plan")
    own = turns.join(plan.select("conv_id", "h", F.size("opening").alias("taken")), "conv_id").filter("d > h")
    own = own.select("conv_id", (F.col("d") - F.col("h") + F.col("taken")).alias("d"), "k1", "k2", "w")
    return work.write(plan.select("conv_id", F.inline("opening")).unionByName(own), "rebuilt")
