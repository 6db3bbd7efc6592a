"""Filters, listings, changes by key, forms, readers and writers."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ticketweave.operators import forms, keyed, listing, lookup
from ticketweave.sources import readers, schemas, writers


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


@pytest.fixture(scope="module")
def people(spark):
    rows = [
        (1, "Ani", "Ani S", "ani@x.id", False, None, "credentials", "ani@x.id"),
        (2, "budi", "Budi", "Budi@x.id", True, "pic", "social", "B-2"),
        (3, "cici", None, None, False, None, "social", "C-3"),
    ]
    schema = (
        "id bigint, username string, name string, email string, active boolean, avatar_url string, "
        "provider_id string, provider_key string"
    )
    return spark.createDataFrame(rows, schema)


def test_lookups_ignore_case_as_stated(people):
    assert ids(lookup.equals_ci(people, "username", "ANI")) == [1]
    assert ids(lookup.equals(people, "username", "ANI")) == []
    assert ids(lookup.by_login(people, "social", "b-2")) == [2]
    assert ids(lookup.by_login(people, "Social", "b-2")) == []
    assert ids(lookup.by_provider_and_email(people, "credentials", "ANI@x.id")) == []


def test_or_lookup_keeps_the_quirk(people):
    assert ids(lookup.by_username_or_email(people, "nobody", "Budi@x.id")) == []
    assert ids(lookup.by_username_or_email(people, "nobody", "Budi@x.id", email_as_given=False)) == [2]
    assert ids(lookup.by_username_or_email(people, "BUDI", "budi@x.id")) == [2]
    assert ids(lookup.by_username_or_email(people, "ani", "budi@x.id")) == [1, 2]


def test_lookup_by_key_table(spark, people):
    keys = spark.createDataFrame([("ANI",), ("ani",), ("none",)], "username string")
    assert ids(lookup.lookup_keys(people, keys, "username", ignore_case=True)) == [1]
    assert ids(lookup.lookup_keys(people, keys, "username")) == []
    assert lookup.first_match(people, F.col("active") == False, "id").first().id == 1  # noqa: E712


def test_failing_condition_is_not_an_empty_result(people):
    from pyspark.errors import AnalysisException

    with pytest.raises(AnalysisException):
        lookup.find_by(people, F.col("no_such_column") == 1).count()


def test_expiry_at_the_very_moment(spark):
    moment = datetime(2024, 1, 1, 13)
    df = spark.createDataFrame([(1, datetime(2024, 1, 1, 12)), (2, datetime(2024, 1, 1, 12, 0, 1))], "id int, t timestamp")
    tokens = lookup.with_expiry(df, "t")
    assert ids(lookup.not_expired(tokens, "expires_at", moment)) == [2]
    assert ids(lookup.not_expired(tokens, "expires_at", moment, inclusive=True)) == [1, 2]


def test_pages_add_up_to_the_listing(spark):
    rows = [(i, None if i % 5 == 0 else datetime(2024, 1, 1 + i % 4)) for i in range(23)]
    df = spark.createDataFrame(rows, "id bigint, created_at timestamp").repartition(4)
    order = listing.newest("created_at", "id")
    whole = [r.id for r in df.orderBy(*order).collect()]
    pages = [[r.id for r in listing.page(df, order, n, 5).collect()] for n in range(6)]
    assert sum(pages, []) == whole and pages[5] == []
    assert whole[:5] == [0, 5, 10, 15, 20]


def test_page_after_equals_page(spark):
    rows = [(i, i % 4) for i in range(20)]
    df = spark.createDataFrame(rows, "id bigint, n int")
    order = [F.desc("n"), F.asc("id")]
    first = listing.page(df, order, 0, 7).collect()
    last = first[-1]
    after = listing.page_after(df, [("n", True), ("id", False)], (last.n, last.id), 7).collect()
    assert after == listing.page(df, order, 1, 7).collect()


def test_nulls_last_when_ascending(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "B")], "id int, name string")
    assert [r.id for r in df.orderBy(*listing.ascending("name", "id")).collect()] == [3, 1, 2]


def test_upsert(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, v string")
    changes = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "id bigint, v string, seq int")
    once = keyed.upsert(base, changes, "id", "seq")
    want = [(1, "a"), (2, "y"), (3, "z")]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, keyed.upsert(once, changes, "id", "seq").collect())) == want


def test_delete_of_an_absent_key(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, v string")
    keys = spark.createDataFrame([(2,), (9,)], "id bigint")
    assert ids(keyed.delete_keys(base, keys, "id")) == [1]


def test_ids_follow_the_key_whatever_the_partitions(spark):
    base = spark.createDataFrame([(7, "a"), (9, "b")], "id bigint, v string")
    new = spark.createDataFrame([(f"k{i}",) for i in range(40)], "v string").repartition(5)
    runs = [keyed.insert_with_ids(base, new.repartition(n), "id", "v").collect() for n in (2, 7)]
    assert sorted(r.id for r in runs[0]) == [7, 9, *range(10, 50)]
    assert sorted(runs[0]) == sorted(runs[1])
    assert [r.v for r in sorted(runs[0])[2:]] == sorted(f"k{i}" for i in range(40))


def test_ids_start_at_one_in_an_empty_table(spark):
    base = spark.createDataFrame([], "id bigint, v string")
    new = spark.createDataFrame([("x",), ("y",)], "v string")
    assert ids(keyed.insert_with_ids(base, new, "id", "v")) == [1, 2]


def test_new_and_taken_accounts(spark, people):
    rows = [(10, "ANI", "new@x.id"), (11, "dodi", "budi@X.id"), (12, "ANI", "ani@x.id"), (13, "eka", None)]
    candidates = spark.createDataFrame(rows, "id bigint, username string, email string")
    assert ids(keyed.taken_accounts(candidates, people, "id")) == [10, 11, 12]
    assert ids(keyed.new_accounts(candidates, people)) == [13]


def test_merge_profiles(spark, people):
    profiles = spark.createDataFrame(
        [("social", "b-2", "Budi B", None, None), ("social", "new", "Nina", "n@x.id", "p")],
        "provider_id string, provider_key string, name string, email string, avatar_url string",
    )
    rows = {r.provider_key: r for r in keyed.merge_profiles(people, profiles, F.current_timestamp()).collect()}
    assert len(rows) == 4
    assert (rows["B-2"].name, rows["B-2"].email, rows["B-2"].active) == ("Budi B", None, True)
    assert rows["new"].active is False and len(rows["new"].username) == 30 and rows["new"].id is None
    assert rows["ani@x.id"].name == "Ani S"


def test_activate_and_rename(spark, people):
    listed = spark.createDataFrame([("ANI",), ("ani",), ("nobody",)], "username string")
    assert {r.username: r.active for r in keyed.activate(people, listed).collect()} == {
        "Ani": True, "budi": True, "cici": False,
    }
    renames = spark.createDataFrame([("cici", "cinta"), ("ghost", "x")], "old_username string, username string")
    assert sorted(r.username for r in keyed.rename_keys(people, renames).collect()) == ["Ani", "budi", "cinta"]


def test_purge_reports_each_table(spark, people):
    tokens = spark.createDataFrame([("t1", "ani"), ("t2", "budi"), ("t3", "ANI")], "token string, account_username string")
    keys = spark.createDataFrame([("aNi",)], "username string")
    before = {"token": (tokens, "account_username"), "account": (people, "username")}
    after = keyed.purge(keys, "username", before)
    assert {name: df.count() for name, df in after.items()} == {"token": 1, "account": 2}
    twice = keys.unionAll(keys)
    report = keyed.purge_report(twice, "username", before).collect()
    assert {(r.table_name, r.n_removed, r.n_kept) for r in report} == {("token", 2, 1), ("account", 1, 2)}


def test_timeline_takes_the_latest(spark):
    tickets = spark.createDataFrame([(1,), (2,)], "id bigint")
    steps = spark.createDataFrame([(1, 5, "old"), (1, 9, "new"), (3, 1, "other")], "ticket_id bigint, at int, what string")
    rows = {r.id: r.what for r in listing.timeline(tickets, steps, "id", "ticket_id", ["at"]).collect()}
    assert rows == {1: "new", 2: None}


def test_form_checks(spark):
    rows = [(1, "judul", "isi"), (2, "  ", "isi"), (3, None, "")]
    checked = forms.check_tickets(spark.createDataFrame(rows, "id int, title string, description string"))
    assert ids(forms.accepted(checked)) == [1]
    assert {r.id: r.reasons for r in forms.rejected(checked).collect()} == {
        2: ["title is empty"], 3: ["title is empty", "description is empty"],
    }


def test_registration_checks(spark):
    rows = [
        (1, "anis", "Ani", "ani@x.id"), (2, "ani", "Ani", "ani@x.id"), (3, "a" * 31, "Ani", "a.b+c@x"),
        (4, "anis", " ", "no address"), (5, None, "Ani", None),
    ]
    df = spark.createDataFrame(rows, "id int, username string, name string, email string")
    got = {r.id: r.reasons for r in forms.check_accounts(df).collect()}
    assert got[1] == [] and got[2] == ["username is shorter than 4"] and got[3] == ["username is longer than 30"]
    assert got[4] == ["name is empty", "email is not valid"]
    assert "username is empty" in got[5] and "email is not valid" in got[5]


def test_enumerated_column(spark):
    df = spark.createDataFrame([(1, "Persia"), (2, "Siam"), (3, None)], "id int, types string")
    assert ids(forms.accepted(forms.check_cats(df))) == [1]


def test_new_tickets_fit_the_schema(spark):
    df = spark.createDataFrame([("ani", "Ani", "t", "d")], "reporter string, reporter_name string, title string, description string")
    made = forms.new_tickets(df, F.current_timestamp())
    table = spark.createDataFrame([], schemas.SCHEMAS["ticket"])
    assert made.columns == table.columns[1:]
    assert [f.dataType for f in made.schema] == [f.dataType for f in table.schema][1:]


def test_jdbc_options():
    plain = readers.jdbc_options("jdbc:x", "ticket", user="u")
    assert plain == {"url": "jdbc:x", "dbtable": "ticket", "fetchsize": "10000", "user": "u"}
    cut = readers.jdbc_options("jdbc:x", "ticket", partition_column="id", lower=0, upper=100, partitions=8)
    assert cut["numPartitions"] == "8" and cut["partitionColumn"] == "id"
    with pytest.raises(ValueError):
        readers.jdbc_options("jdbc:x", "ticket", partition_column="id")


def test_every_schema_parses(spark):
    for schema in schemas.SCHEMAS.values():
        assert spark.createDataFrame([], schema).columns


def test_snapshots_replace_a_table(spark, tmp_path):
    root = str(tmp_path / "t")
    with pytest.raises(LookupError):
        writers.read_snapshot(spark, root)
    writers.write_snapshot(spark.createDataFrame([(1, "a")], "id bigint, v string"), root)
    change = spark.createDataFrame([(1, "b"), (2, "c")], "id bigint, v string")
    writers.write_snapshot(keyed.upsert(writers.read_snapshot(spark, root), change, "id"), root)
    assert sorted(map(tuple, writers.read_snapshot(spark, root).collect())) == [(1, "b"), (2, "c")]
    writers.append_rows(change, str(tmp_path / "plain"))
    writers.append_rows(change, str(tmp_path / "plain"))
    assert spark.read.parquet(str(tmp_path / "plain")).count() == 4


def test_lists_and_maps_survive_a_snapshot(spark, tmp_path):
    row = ("t", "bearer", 60, None, {"scope": "all", "lang": "id"}, "ani")
    df = spark.createDataFrame([row], schemas.SCHEMAS["oauth2_info"])
    writers.write_snapshot(df, str(tmp_path / "oauth2"))
    back = writers.read_snapshot(spark, str(tmp_path / "oauth2"))
    assert back.first().params == row[4]
    cat = spark.createDataFrame([(1, ["tom", "garfield"], "Persia")], schemas.SCHEMAS["cat"])
    got = forms.explode_list(cat, "name", "id").collect()
    assert [(r.id, r.position, r.member) for r in got] == [(1, 0, "tom"), (1, 1, "garfield")]


def test_tokens_last_an_hour(spark):
    moment = datetime(2024, 1, 1, 12)
    df = spark.createDataFrame([("ani@x.id", "ani"), ("b@x.id", "budi")], "email string, account_username string")
    rows = forms.new_tokens(df, F.lit(moment)).collect()
    assert {len(r.token) for r in rows} == {64} and len({r.token for r in rows}) == 2
    assert {r.expires_at for r in rows} == {datetime(2024, 1, 1, 13)}


def test_load_labeled_fills_nulls(spark):
    df = spark.createDataFrame([(None, None), ("x", "y")], "text string, owner string")
    assert sorted(map(tuple, readers.load_labeled(df, "text", "owner").collect())) == [("", ""), ("x", "y")]


def test_page_after_reaches_null_keys(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, None)], "id int, name string")
    up = [("name", False), ("id", False)]
    assert [r.id for r in listing.page_after(df, up, ("a", 1), 9).collect()] == [2, 3, 4]
    assert [r.id for r in listing.page_after(df, up, (None, 3), 9).collect()] == [4]
    down = [("name", True), ("id", False)]
    assert [r.id for r in listing.page_after(df, down, (None, 3), 9).collect()] == [4, 2, 1]


def test_latest_per_key_carries_maps(spark):
    df = spark.createDataFrame([(1, 1, {"a": "x"}), (1, 2, {"b": "y"}), (2, 1, None)], "k int, n int, params map<string,string>")
    got = {r.k: r.params for r in listing.latest_per_key(df, "k", ["n"]).collect()}
    assert got == {1: {"b": "y"}, 2: None}


def test_blank_forms_are_refused(spark):
    df = spark.createDataFrame([("\n\t", "x"), (" \x0b", None), ("a", "b\n")], "title string, description string")
    assert [len(r.reasons) for r in forms.check_tickets(df).collect()] == [1, 2, 0]
