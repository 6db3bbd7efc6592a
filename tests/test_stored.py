"""Bucketed and sorted tables on disk, and purges by many keys."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from ticketweave.operators import keyed, listing
from ticketweave.sources import stored

SCHEMA = "login string, n int, params map<string,string>"


def rows_of(df):
    return sorted((r.login, r.n, tuple(sorted(r.params.items()))) for r in df.collect())


def files(root):
    return {f for f in glob.glob(f"{root}/data/*/bucket=*/*.parquet")}


@pytest.mark.parametrize("few", [True, False])
def test_upsert_replaces_only_touched_buckets(spark, tmp_path, monkeypatch, few):
    if not few:
        monkeypatch.setattr(stored, "BROADCAST_CHANGES", 0)
    root = str(tmp_path)
    base = spark.createDataFrame([(f"u{i}", i, {"a": str(i)}) for i in range(200)], SCHEMA)
    table = stored.create_bucketed(base, root, "login", 16)
    before, names = table.folders, files(root)
    changes = spark.createDataFrame([("u7", 700, {"b": "x"}), ("new", 1, {}), ("u7", 701, {"c": "y"})], "login string, seq int, params map<string,string>")
    changes = changes.withColumn("n", F.col("seq"))
    after = table.upsert(changes, "seq")
    want = {f"u{i}": (f"u{i}", i, (("a", str(i)),)) for i in range(200)} | {"u7": ("u7", 701, (("c", "y"),)), "new": ("new", 1, ())}
    assert rows_of(after.read()) == rows_of(stored.open_bucketed(spark, root).read()) == sorted(want.values())
    touched = {r.b for r in changes.select(F.pmod(F.xxhash64("login"), F.lit(16)).alias("b")).collect()}
    assert {b for b in before if after.folders.get(b) != before[b]} == touched and names <= files(root)
    assert rows_of(table.read()) == sorted((f"u{i}", i, (("a", str(i)),)) for i in range(200))
    gone = after.delete(spark.createDataFrame([("new",), ("u1",), ("nobody",)], "login string"))
    assert gone.read().count() == 199 and gone.read().filter("login IN ('new', 'u1')").count() == 0


def test_the_base_is_not_shuffled_for_few_changes(spark, tmp_path):
    base = spark.range(1000).selectExpr("concat('u', id) AS login", "cast(id as int) AS n")
    table = stored.create_bucketed(base, str(tmp_path), "login", 8)
    changes = spark.createDataFrame([("u1", 5)], "login string, n int")
    kept, touched, joined = table._rewritten(changes)
    plan = keyed.delete_keys(kept, joined, "login")._jdf.queryExecution().executedPlan().toString()
    assert len(touched) == 1 and "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_empty_bucketed_table(spark, tmp_path):
    table = stored.create_bucketed(spark.createDataFrame([], "k bigint, v string"), str(tmp_path), "k", 4)
    assert table.read().count() == 0
    table = table.upsert(spark.createDataFrame([(1, "a"), (None, "b")], "k bigint, v string"))
    assert sorted(map(tuple, table.read().collect()), key=repr) == [(1, "a"), (None, "b")]
    assert table.upsert(spark.createDataFrame([], "k bigint, v string")).read().count() == 2
    with pytest.raises(LookupError):
        stored.open_bucketed(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("descending", [False, True])
def test_pages_of_a_sorted_table(spark, tmp_path, descending):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.choice([None, 1.5, 2.5])) for i in range(300)]
    frame = spark.createDataFrame(rows, "id bigint, name string, x double")
    columns = [("name", descending), ("x", not descending), ("id", descending)]
    table = stored.write_sorted(frame, str(tmp_path), columns, rows_per_part=20)
    want = [tuple(r) for r in frame.orderBy(*listing.order_of(columns)).collect()]
    last, got, most = None, [], 0
    while True:
        most = max(most, len(table.parts_after(last, 25)))
        page = [tuple(r) for r in table.page_after(last, 25).collect()]
        if not page:
            break
        got += page
        last = (page[-1][1], page[-1][2], page[-1][0])
    assert got == want
    assert most <= 6 < table._ranges().count()
    read = stored.open_sorted(spark, str(tmp_path)).page_after((want[250][1], want[250][2], want[250][0]), 10)
    assert len(read.inputFiles()) <= 3 * 8 and [tuple(r) for r in read.collect()] == want[251:261]


@pytest.mark.parametrize("limit", [0, 10**6])
def test_purge_by_many_keys(spark, limit):
    keys = spark.range(0, 3000, 3).selectExpr("concat('K', id) AS account").unionByName(spark.createDataFrame([(None,), ("k0",)], "account string"))
    rows = spark.range(6000).selectExpr("id", "CASE WHEN id % 100 = 0 THEN NULL ELSE concat('k', id) END AS owner", "id AS _at")
    plain = keyed.purge(keys, "account", {"t": (rows, "owner")})["t"]
    got = keyed.purge_filtered(keys, "account", {"t": (rows, "owner")}, limit)["t"]
    assert got.columns == rows.columns and got.count() == plain.count() == got.join(plain, "id").count()


def test_the_bitmap_lets_few_others_through(spark):
    listed = spark.range(20_000).selectExpr("cast(id AS string) AS _listed")
    bits = keyed.BITS_PER_KEY * 20_000
    bitmap = keyed.key_bitmap(listed, bits)
    marked = keyed._may_be_listed(spark.range(40_000).selectExpr("cast(id AS string) AS k"), F.col("k"), bitmap, bits)
    inside, outside = (marked.filter(c).agg(F.avg(F.col("maybe").cast("int"))).first()[0] for c in ("cast(key AS int) < 20000", "cast(key AS int) >= 20000"))
    assert inside == 1.0 and outside < 0.05


def test_small_parts_add_no_files(spark, tmp_path):
    frame = spark.range(3000).selectExpr("id", "nullif(id % 7, 0) AS name")
    table = stored.write_sorted(frame, str(tmp_path), [("name", False), ("id", False)], rows_per_part=10)
    assert table._ranges().count() == 300
    assert len(spark.read.parquet(f"{tmp_path}/rows").inputFiles()) <= 2
    rows = [tuple(r) for r in frame.orderBy(*listing.order_of(list(table.columns))).collect()]
    assert [tuple(r) for r in table.page_after((rows[2571][1], rows[2571][0]), 25).collect()] == rows[2572:2597]


def test_parts_of_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored, "ROWS_PER_FILE", 40)
    frame = spark.range(300).selectExpr("id", "id % 3 AS name")
    table = stored.write_sorted(frame, str(tmp_path), [("name", True), ("id", False)], rows_per_part=15)
    assert len(spark.read.parquet(f"{tmp_path}/rows").inputFiles()) > 4
    rows = [tuple(r) for r in frame.orderBy(*listing.order_of(list(table.columns))).collect()]
    for at in (0, 38, 99, 100, 200, 290):
        assert [tuple(r) for r in table.page_after((rows[at][1], rows[at][0]), 20).collect()] == rows[at + 1 : at + 21]
