"""Registered queries over the ticket, account and milestone tables.

The tables are views of the given ones: orders as tickets, customers and
suppliers as accounts, conversations as milestones, events as tokens.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forms, keyed, listing, lookup
from ..session import work_path
from ..sources import readers
from ..sources import stored as tables_on_disk
from .registry import query, table

# The same views for Spark and for the checking SQL.
TICKET_COLUMNS = (
    "o_orderkey AS id",
    "'Customer ' || o_custkey AS reporter",
    "'desk-' || substr(o_orderpriority, 1, 1) AS assigned_to",
    "o_orderstatus AS status",
    "o_orderpriority AS priority",
    "o_orderdate AS created_at",
)
ACCOUNT_COLUMNS = (
    "c_custkey AS id",
    "c_name AS username",
    "c_mktsegment AS name",
    "replace(c_name, '#', '.') || '@' || c_mktsegment || '.example' AS email",
    "c_acctbal > 5000 AS active",
    "CASE WHEN c_acctbal > 9000 THEN 'pic/' || c_custkey END AS avatar_url",
    "CASE WHEN c_nationkey < 13 THEN 'credentials' ELSE 'social' END AS provider_id",
    "c_name AS provider_key",
)
MILESTONE_COLUMNS = (
    "conv_id * 100 + turn AS id",
    "conv_id AS ticket_id",
    "turn AS datetime",
    "text AS description",
    "role AS milestone_reporter",
)


def _view(name: str, columns: tuple[str, ...], source: str) -> str:
    return f"{name} AS (SELECT {', '.join(columns)} FROM {source})"


TICKETS_SQL = _view("tickets", TICKET_COLUMNS, "orders")
ACCOUNTS_SQL = _view("accounts", ACCOUNT_COLUMNS, "customer")
MILESTONES_SQL = _view("milestones", MILESTONE_COLUMNS, "conversations")


def tickets(spark, sf):
    return table(spark, sf, "orders").selectExpr(*TICKET_COLUMNS)


def accounts(spark, sf):
    return table(spark, sf, "customer").selectExpr(*ACCOUNT_COLUMNS)


def milestones(spark, sf):
    return table(spark, sf, "conversations").selectExpr(*MILESTONE_COLUMNS)


# ---- sources -------------------------------------------------------------


@query(
    "load_labeled",
    "SELECT coalesce(text, '') AS description, coalesce(lang, '') AS assigned_to FROM documents",
)
def load_labeled(spark, sf):
    return readers.load_labeled(table(spark, sf, "documents"), "text", "lang")


@query("load_summary", "SELECT doc_id AS id, text AS description FROM documents")
def load_summary(spark, sf):
    return readers.load_summary(table(spark, sf, "documents"), "doc_id", "text")


@query(
    "insert_with_ids",
    f"""WITH {TICKETS_SQL},
    new AS (SELECT event_id, 'User ' || user_id AS reporter, event_type AS status, ts AS created_at FROM events)
    SELECT id, reporter, assigned_to, status, priority, created_at FROM tickets
    UNION ALL
    SELECT (SELECT max(id) FROM tickets) + row_number() OVER (ORDER BY event_id),
           reporter, NULL, status, NULL, created_at FROM new""",
)
def insert_with_ids(spark, sf):
    new = table(spark, sf, "events").selectExpr(
        "event_id", "'User ' || user_id AS reporter", "CAST(NULL AS STRING) AS assigned_to", "event_type AS status",
        "CAST(NULL AS STRING) AS priority", "ts AS created_at",
    )
    return keyed.insert_with_ids(tickets(spark, sf), new, "id", "event_id")


@query(
    "bulk_append",
    f"""WITH {TICKETS_SQL} SELECT id, status, created_at FROM tickets
    UNION ALL SELECT event_id, event_type, ts FROM events
    UNION ALL SELECT l_orderkey, l_linestatus, l_shipdate FROM lineitem""",
)
def bulk_append(spark, sf):
    base = tickets(spark, sf).select("id", "status", "created_at")
    arrived = table(spark, sf, "events").selectExpr("event_id AS id", "event_type AS status", "ts AS created_at")
    shipped = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS id", "l_linestatus AS status", "l_shipdate AS created_at"
    )
    return keyed.append(base, arrived, shipped)


# ---- filters and lookups ---------------------------------------------------


@query(
    "lookup_keys",
    f"WITH {TICKETS_SQL} SELECT * FROM tickets WHERE id IN (SELECT doc_id FROM labels)",
)
def lookup_keys(spark, sf):
    keys = table(spark, sf, "labels").selectExpr("doc_id AS id")
    return lookup.lookup_keys(tickets(spark, sf), keys, "id")


@query("by_status", f"WITH {TICKETS_SQL} SELECT * FROM tickets WHERE status = 'P'")
def by_status(spark, sf):
    return lookup.equals(tickets(spark, sf), "status", "P")


@query("by_priority", f"WITH {TICKETS_SQL} SELECT * FROM tickets WHERE priority = '1-URGENT'")
def by_priority(spark, sf):
    return lookup.equals(tickets(spark, sf), "priority", "1-URGENT")


@query(
    "queue_assignee",
    f"WITH {TICKETS_SQL} SELECT * FROM tickets WHERE assigned_to = 'desk-2' ORDER BY created_at DESC NULLS FIRST, id",
)
def queue_assignee(spark, sf):
    return lookup.newest_first(tickets(spark, sf), "assigned_to", "desk-2", "created_at", "id")


@query(
    "by_reporter",
    f"WITH {TICKETS_SQL} SELECT * FROM tickets WHERE reporter = 'Customer 42' ORDER BY created_at DESC NULLS FIRST, id",
)
def by_reporter(spark, sf):
    return lookup.newest_first(tickets(spark, sf), "reporter", "Customer 42", "created_at", "id")


@query(
    "milestones_by_reporter",
    f"WITH {MILESTONES_SQL} SELECT * FROM milestones WHERE milestone_reporter = 'user' "
    "ORDER BY datetime DESC NULLS FIRST, id",
)
def milestones_by_reporter(spark, sf):
    return lookup.newest_first(milestones(spark, sf), "milestone_reporter", "user", "datetime", "id")


@query(
    "milestones_of_ticket",
    f"WITH {MILESTONES_SQL} SELECT * FROM milestones WHERE ticket_id IN (SELECT doc_id FROM labels) "
    "ORDER BY ticket_id, datetime DESC NULLS FIRST, id",
)
def milestones_of_ticket(spark, sf):
    keys = table(spark, sf, "labels").selectExpr("doc_id AS ticket_id")
    found = lookup.lookup_keys(milestones(spark, sf), keys, "ticket_id")
    return found.orderBy("ticket_id", F.col("datetime").desc_nulls_first(), "id")


@query("ci_lookup", f"WITH {ACCOUNTS_SQL} SELECT * FROM accounts WHERE lower(username) = 'customer#000000042'")
def ci_lookup(spark, sf):
    return lookup.equals_ci(accounts(spark, sf), "username", "CUSTOMER#000000042")


@query(
    "pred_and",
    f"WITH {ACCOUNTS_SQL} SELECT * FROM accounts WHERE provider_id = 'credentials' "
    "AND email = 'Customer.000000000@HOUSEHOLD.example'",
)
def pred_and(spark, sf):
    return lookup.by_provider_and_email(accounts(spark, sf), "credentials", "Customer.000000000@HOUSEHOLD.example")


@query(
    "pred_and_ci",
    f"WITH {ACCOUNTS_SQL} SELECT * FROM accounts WHERE provider_id = 'credentials' "
    "AND lower(provider_key) = 'customer#000000000'",
)
def pred_and_ci(spark, sf):
    return lookup.by_login(accounts(spark, sf), "credentials", "CUSTOMER#000000000")


@query(
    "pred_or",
    f"WITH {ACCOUNTS_SQL} SELECT * FROM accounts WHERE lower(username) = 'customer#000000011' "
    "OR lower(email) = 'customer.000000001@machinery.example'",
)
def pred_or(spark, sf):
    return lookup.by_username_or_email(
        accounts(spark, sf), "CUSTOMER#000000011", "customer.000000001@machinery.example"
    )


@query(
    "find_by",
    f"WITH {TICKETS_SQL} SELECT * FROM tickets WHERE status <> 'F' AND (priority LIKE '1%' OR id > 1000)",
)
def find_by(spark, sf):
    condition = (F.col("status") != "F") & (F.col("priority").like("1%") | (F.col("id") > 1000))
    return lookup.find_by(tickets(spark, sf), condition)


@query(
    "token_expiry",
    "SELECT event_id AS token, user_id AS account, ts + INTERVAL 1 HOUR AS expires_at FROM events",
)
def token_expiry(spark, sf):
    tokens = table(spark, sf, "events").selectExpr("event_id AS token", "user_id AS account", "ts")
    return lookup.with_expiry(tokens, "ts").drop("ts")


@query(
    "not_expired",
    "SELECT event_id AS token, ts + INTERVAL 1 HOUR AS expires_at FROM events "
    "WHERE ts + INTERVAL 1 HOUR > TIMESTAMP '2024-01-15 12:00:00'",
)
def not_expired(spark, sf):
    tokens = lookup.with_expiry(table(spark, sf, "events"), "ts").selectExpr("event_id AS token", "expires_at")
    return lookup.not_expired(tokens, "expires_at", F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"))


@query(
    "two_hop_lookup",
    "SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey "
    "JOIN region ON n_regionkey = r_regionkey",
)
def two_hop_lookup(spark, sf):
    return lookup.two_hop(
        table(spark, sf, "customer"), table(spark, sf, "nation"), table(spark, sf, "region"),
        ("c_nationkey", "n_nationkey"), ("n_regionkey", "r_regionkey"),
    ).select("c_custkey", "c_name", "n_name", "r_name")


# ---- incoming rows -----------------------------------------------------------

EMAIL_SQL = forms.EMAIL.replace("'", "''")


@query(
    "validate_tickets",
    r"""SELECT doc_id AS id, concat_ws('; ',
        CASE WHEN regexp_full_match(split_part(text, chr(10), 2), '[\x00-\x20]*') THEN 'title is empty' END,
        CASE WHEN regexp_full_match(coalesce(text, ''), '[\x00-\x20]*') THEN 'description is empty' END) AS reasons
    FROM documents""",
)
def validate_tickets(spark, sf):
    submitted = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"),
        F.get(F.split("text", "\n"), F.lit(1)).alias("title"),
        F.col("text").alias("description"),
    )
    return forms.check_tickets(submitted).select("id", F.array_join("reasons", "; ").alias("reasons"))


@query(
    "validate_accounts",
    rf"""WITH candidates AS (SELECT p_partkey AS id, p_brand || p_name AS username, p_type AS name,
        p_name || '@' || lower(p_brand) || '.example' AS email FROM part
        UNION ALL SELECT l_orderkey, l_returnflag || l_linestatus, ' ', l_returnflag || '@line.example' FROM lineitem
        UNION ALL SELECT event_id, props || event_type || ' by ' || user_id, event_type,
            event_type || '@' || event_id || '.example' FROM events)
    SELECT id, username, concat_ws('; ',
        CASE WHEN regexp_full_match(username, '[\x00-\x20]*') THEN 'username is empty' END,
        CASE WHEN length(username) < 4 THEN 'username is shorter than 4' END,
        CASE WHEN length(username) > 30 THEN 'username is longer than 30' END,
        CASE WHEN regexp_full_match(name, '[\x00-\x20]*') THEN 'name is empty' END,
        CASE WHEN NOT regexp_matches(email, '{EMAIL_SQL}') THEN 'email is not valid' END) AS reasons
    FROM candidates""",
)
def validate_accounts(spark, sf):
    parts = table(spark, sf, "part").selectExpr(
        "p_partkey AS id", "p_brand || p_name AS username", "p_type AS name",
        "p_name || '@' || lower(p_brand) || '.example' AS email",
    )
    lines = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS id", "l_returnflag || l_linestatus AS username", "' ' AS name",
        "l_returnflag || '@line.example' AS email",
    )
    arrived = table(spark, sf, "events").selectExpr(
        "event_id AS id", "props || event_type || ' by ' || user_id AS username", "event_type AS name",
        "event_type || '@' || event_id || '.example' AS email",
    )
    checked = forms.check_accounts(parts.unionAll(lines).unionAll(arrived))
    return checked.select("id", "username", F.array_join("reasons", "; ").alias("reasons"))


@query(
    "new_tickets",
    """SELECT source AS reporter, lang AS reporter_name, CAST(NULL AS VARCHAR) AS assigned_to, 0 AS n_cc,
        TIMESTAMP '2024-02-01 00:00:00' AS created_at, CAST(NULL AS VARCHAR) AS status,
        split_part(text, chr(10), 1) AS title, text AS description FROM documents""",
)
def new_tickets(spark, sf):
    submitted = table(spark, sf, "documents").select(
        F.col("source").alias("reporter"),
        F.col("lang").alias("reporter_name"),
        F.get(F.split("text", "\n"), F.lit(0)).alias("title"),
        F.col("text").alias("description"),
    )
    made = forms.new_tickets(submitted, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    return made.select(
        "reporter", "reporter_name", "assigned_to", F.size("cc").alias("n_cc"), "created_at", "status", "title",
        "description",
    )


@query(
    "new_tokens",
    f"""WITH {ACCOUNTS_SQL} SELECT sha256(email || '|' || username || '|2024-02-01 00:00:00') AS token, email,
        TIMESTAMP '2024-02-01 01:00:00' AS expires_at, username AS account_username FROM accounts""",
)
def new_tokens(spark, sf):
    requests = accounts(spark, sf).selectExpr("email", "username AS account_username")
    return forms.new_tokens(requests, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))


@query(
    "ticket_cc_explode",
    """SELECT id, CAST(position - 1 AS INTEGER) AS position, member FROM (
        SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS member,
               generate_subscripts(string_split(text, chr(10)), 1) AS position FROM documents)""",
)
def ticket_cc_explode(spark, sf):
    listed = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.split("text", "\n").alias("cc"))
    return forms.explode_list(listed, "cc", "id")


# ---- joins and changes by key --------------------------------------------------

CANDIDATES_SQL = """candidates AS (SELECT s_suppkey AS id,
    CASE WHEN s_nationkey < 8 THEN upper(replace(s_name, 'Supplier', 'Customer')) ELSE s_name END AS username,
    lower(replace(s_name, 'Supplier#', 'Customer.')) || '@building.example' AS email FROM supplier)"""


def candidates(spark, sf):
    return table(spark, sf, "supplier").selectExpr(
        "s_suppkey AS id",
        "CASE WHEN s_nationkey < 8 THEN upper(replace(s_name, 'Supplier', 'Customer')) ELSE s_name END AS username",
        "lower(replace(s_name, 'Supplier#', 'Customer.')) || '@building.example' AS email",
    )


@query(
    "new_accounts_anti",
    f"""WITH {ACCOUNTS_SQL}, {CANDIDATES_SQL} SELECT * FROM candidates c WHERE NOT EXISTS (
        SELECT 1 FROM accounts a WHERE lower(a.username) = lower(c.username) OR lower(a.email) = lower(c.email))""",
)
def new_accounts_anti(spark, sf):
    return keyed.new_accounts(candidates(spark, sf), accounts(spark, sf))


@query(
    "taken_accounts_semi",
    f"""WITH {ACCOUNTS_SQL}, {CANDIDATES_SQL} SELECT id FROM candidates c WHERE EXISTS (
        SELECT 1 FROM accounts a WHERE lower(a.username) = lower(c.username) OR lower(a.email) = lower(c.email))""",
)
def taken_accounts_semi(spark, sf):
    return keyed.taken_accounts(candidates(spark, sf), accounts(spark, sf), "id")


@query(
    "ticket_timeline",
    f"""WITH {TICKETS_SQL}, {MILESTONES_SQL}, latest AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY datetime DESC, id DESC) AS rk
        FROM milestones) WHERE rk = 1)
    SELECT t.id, t.status, t.created_at, l.id AS milestone_id, l.datetime, l.description, l.milestone_reporter
    FROM tickets t LEFT JOIN latest l ON t.id = l.ticket_id""",
)
def ticket_timeline(spark, sf):
    steps = milestones(spark, sf).withColumnRenamed("id", "milestone_id")
    joined = listing.timeline(tickets(spark, sf), steps, "id", "ticket_id", ["datetime", "milestone_id"])
    return joined.select("id", "status", "created_at", "milestone_id", "datetime", "description", "milestone_reporter")


CHANGES_SQL = """changes AS (
    SELECT l_orderkey AS id, 'Supplier ' || l_suppkey AS reporter, 'desk-9' AS assigned_to, l_linestatus AS status,
           l_returnflag AS priority, l_shipdate AS created_at, l_linenumber AS seq FROM lineitem
    UNION ALL SELECT event_id + 1000000000, 'User ' || user_id, NULL, event_type, NULL, ts, 0 FROM events)"""


def changes(spark, sf):
    lines = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS id", "'Supplier ' || l_suppkey AS reporter", "'desk-9' AS assigned_to",
        "l_linestatus AS status", "l_returnflag AS priority", "l_shipdate AS created_at", "l_linenumber AS seq",
    )
    arrived = table(spark, sf, "events").selectExpr(
        "event_id + 1000000000 AS id", "'User ' || user_id AS reporter", "CAST(NULL AS STRING) AS assigned_to",
        "event_type AS status", "CAST(NULL AS STRING) AS priority", "ts AS created_at", "0 AS seq",
    )
    return lines.unionAll(arrived)


@query(
    "upsert_tickets",
    f"""WITH {TICKETS_SQL}, {CHANGES_SQL}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id
        ORDER BY seq DESC, reporter DESC, assigned_to DESC, status DESC, priority DESC, created_at DESC) AS rk
        FROM changes) WHERE rk = 1)
    SELECT id, reporter, assigned_to, status, priority, created_at FROM last
    UNION ALL SELECT id, reporter, assigned_to, status, priority, created_at FROM tickets
    WHERE id NOT IN (SELECT id FROM last)""",
)
def upsert_tickets(spark, sf):
    return keyed.upsert(tickets(spark, sf), changes(spark, sf), "id", "seq")


@query(
    "merge_profiles",
    f"""WITH {ACCOUNTS_SQL}, profiles AS (
        SELECT CASE WHEN c_nationkey < 13 THEN 'credentials' ELSE 'social' END AS provider_id,
               upper(c_name) AS provider_key, 'name of ' || c_name AS name, lower(c_name) || '@new.example' AS email,
               'pic/' || c_custkey AS avatar_url FROM customer WHERE c_acctbal > 0
        UNION ALL SELECT 'social', s_name, 'name of ' || s_name, lower(s_name) || '@new.example',
               'pic/s' || s_suppkey FROM supplier)
    SELECT a.id,
        coalesce(a.username, substr(sha256(p.provider_id || '|' || p.provider_key), 1, 30)) AS username,
        CASE WHEN p.name IS NOT NULL THEN p.name ELSE a.name END AS name,
        CASE WHEN p.name IS NOT NULL THEN p.email ELSE a.email END AS email,
        coalesce(a.active, false) AS active,
        CASE WHEN p.name IS NOT NULL THEN p.avatar_url ELSE a.avatar_url END AS avatar_url,
        coalesce(a.provider_id, p.provider_id) AS provider_id, coalesce(a.provider_key, p.provider_key) AS provider_key
    FROM accounts a FULL OUTER JOIN profiles p
    ON a.provider_id = p.provider_id AND lower(a.provider_key) = lower(p.provider_key)""",
)
def merge_profiles(spark, sf):
    known = table(spark, sf, "customer").filter("c_acctbal > 0").selectExpr(
        "CASE WHEN c_nationkey < 13 THEN 'credentials' ELSE 'social' END AS provider_id",
        "upper(c_name) AS provider_key", "'name of ' || c_name AS name", "lower(c_name) || '@new.example' AS email",
        "'pic/' || c_custkey AS avatar_url",
    )
    unknown = table(spark, sf, "supplier").selectExpr(
        "'social' AS provider_id", "s_name AS provider_key", "'name of ' || s_name AS name",
        "lower(s_name) || '@new.example' AS email", "'pic/s' || s_suppkey AS avatar_url",
    )
    moment = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    return keyed.merge_profiles(accounts(spark, sf), known.unionAll(unknown), moment)


@query(
    "activate_accounts",
    f"""WITH {ACCOUNTS_SQL}, listed AS (SELECT DISTINCT 'customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS u
        FROM orders WHERE o_orderstatus = 'P')
    SELECT id, username, CASE WHEN lower(username) IN (SELECT u FROM listed) THEN true ELSE active END AS active
    FROM accounts""",
)
def activate_accounts(spark, sf):
    waiting = table(spark, sf, "orders").filter("o_orderstatus = 'P'").selectExpr(
        "'CUSTOMER#' || lpad(CAST(o_custkey AS STRING), 9, '0') AS username"
    )
    return keyed.activate(accounts(spark, sf), waiting).select("id", "username", "active")


@query(
    "rename_keys",
    f"""WITH {ACCOUNTS_SQL} SELECT a.id, CASE WHEN c.c_acctbal < 0 THEN 'former ' || username ELSE username END
        AS username, name, email FROM accounts a JOIN customer c ON a.id = c.c_custkey""",
)
def rename_keys(spark, sf):
    renames = table(spark, sf, "customer").filter("c_acctbal < 0").selectExpr(
        "c_name AS old_username", "'former ' || c_name AS username"
    )
    return keyed.rename_keys(accounts(spark, sf), renames).select("id", "username", "name", "email")


@query(
    "delete_keys",
    f"WITH {TICKETS_SQL} SELECT * FROM tickets WHERE id NOT IN (SELECT doc_id FROM labels)",
)
def delete_keys(spark, sf):
    return keyed.delete_keys(tickets(spark, sf), table(spark, sf, "labels"), "id", "doc_id")


PURGED_SQL = """purged AS (SELECT c_name, c_custkey FROM customer WHERE c_acctbal < 0),
    purged_orders AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM purged))"""


@query(
    "purge_cascade",
    f"""WITH {PURGED_SQL}, counted AS (
        SELECT 'customer' AS table_name, count(*) AS n,
               count(*) FILTER (c_name IN (SELECT c_name FROM purged)) AS gone FROM customer
        UNION ALL SELECT 'orders', count(*), count(*) FILTER (o_orderkey IN (SELECT o_orderkey FROM purged_orders))
        FROM orders
        UNION ALL SELECT 'lineitem', count(*), count(*) FILTER (l_orderkey IN (SELECT o_orderkey FROM purged_orders))
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT table_name, gone AS n_removed, n - gone AS n_kept FROM counted""",
)
def purge_cascade(spark, sf):
    return keyed.purge_report(*purge_arguments(spark, sf))


@query(
    "purge_rows",
    f"""WITH {PURGED_SQL}
    SELECT 'customer' AS table_name, c_custkey AS id FROM customer WHERE c_name NOT IN (SELECT c_name FROM purged)
    UNION ALL SELECT 'orders', o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM purged_orders)
    UNION ALL SELECT 'lineitem', l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WHERE l_orderkey NOT IN (SELECT o_orderkey FROM purged_orders)""",
)
def purge_rows(spark, sf):
    """What a cascading removal leaves in each table."""
    after = keyed.purge(*purge_arguments(spark, sf))
    ids = {"customer": "c_custkey", "orders": "o_orderkey", "lineitem": "l_orderkey"}
    parts = [after[name].select(F.lit(name).alias("table_name"), F.col(column).alias("id")) for name, column in ids.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query(
    "purge_many",
    f"""WITH {PURGED_SQL}
    SELECT 'customer' AS table_name, c_custkey AS id FROM customer WHERE c_name NOT IN (SELECT c_name FROM purged)
    UNION ALL SELECT 'orders', o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM purged_orders)
    UNION ALL SELECT 'lineitem', l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WHERE l_orderkey NOT IN (SELECT o_orderkey FROM purged_orders)""",
)
def purge_many(spark, sf):
    """The same removal as if the keys were too many to send: rows pass a bitmap of the keys first."""
    after = keyed.purge_filtered(*purge_arguments(spark, sf), broadcast_keys=0)
    ids = {"customer": "c_custkey", "orders": "o_orderkey", "lineitem": "l_orderkey"}
    parts = [after[name].select(F.lit(name).alias("table_name"), F.col(column).alias("id")) for name, column in ids.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def purge_arguments(spark, sf):
    """Accounts to remove, and the tables that depend on them."""
    customers = table(spark, sf, "customer", "c_custkey", "c_name", "c_acctbal")
    owner = "'Customer#' || lpad(CAST(o_custkey AS STRING), 9, '0') AS owner"
    orders = table(spark, sf, "orders").selectExpr("o_orderkey", owner)
    lines = table(spark, sf, "lineitem", "l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    keys = customers.filter("c_acctbal < 0").select(F.upper("c_name").alias("account"))
    tables = {"lineitem": (lines, "owner"), "orders": (orders, "owner"), "customer": (customers, "c_name")}
    return keys, "account", tables


# ---- counts, sorts, pages ---------------------------------------------------------


@query(
    "counts",
    "SELECT 'ticket' AS table_name, count(*) AS n FROM orders UNION ALL SELECT 'milestone', count(*) FROM conversations "
    "UNION ALL SELECT 'account', count(*) FROM customer",
)
def counts(spark, sf):
    return listing.counts(ticket=tickets(spark, sf), milestone=milestones(spark, sf), account=accounts(spark, sf))


@query("tickets_sorted", f"WITH {TICKETS_SQL} SELECT * FROM tickets ORDER BY created_at DESC NULLS FIRST, id")
def tickets_sorted(spark, sf):
    return tickets(spark, sf).orderBy(*listing.newest("created_at", "id"))


@query("milestones_sorted", f"WITH {MILESTONES_SQL} SELECT * FROM milestones ORDER BY ticket_id NULLS LAST, id")
def milestones_sorted(spark, sf):
    return milestones(spark, sf).orderBy(*listing.ascending("ticket_id", "id"))


@query("accounts_sorted", f"WITH {ACCOUNTS_SQL} SELECT * FROM accounts ORDER BY name NULLS LAST, id")
def accounts_sorted(spark, sf):
    return accounts(spark, sf).orderBy(*listing.ascending("name", "id"))


@query(
    "tickets_page",
    f"WITH {TICKETS_SQL} SELECT * FROM tickets ORDER BY created_at DESC NULLS FIRST, id LIMIT 25 OFFSET 50",
)
def tickets_page(spark, sf):
    return listing.page(tickets(spark, sf), listing.newest("created_at", "id"), 2, 25)


@query(
    "tickets_page_after",
    f"WITH {TICKETS_SQL} SELECT * FROM tickets WHERE created_at < TIMESTAMP '1997-06-01 00:00:00' "
    "OR (created_at = TIMESTAMP '1997-06-01 00:00:00' AND id > 100) ORDER BY created_at DESC, id LIMIT 25",
)
def tickets_page_after(spark, sf):
    moment = F.lit("1997-06-01 00:00:00").cast("timestamp_ntz")
    return listing.page_after(tickets(spark, sf), [("created_at", True), ("id", False)], (moment, 100), 25)


@query(
    "milestones_page",
    f"WITH {MILESTONES_SQL} SELECT * FROM milestones ORDER BY ticket_id NULLS LAST, id LIMIT 20 OFFSET 20",
)
def milestones_page(spark, sf):
    return listing.page(milestones(spark, sf), listing.ascending("ticket_id", "id"), 1, 20)


@query(
    "accounts_page",
    f"WITH {ACCOUNTS_SQL} SELECT * FROM accounts ORDER BY name NULLS LAST, id LIMIT 20 OFFSET 60",
)
def accounts_page(spark, sf):
    return listing.page(accounts(spark, sf), listing.ascending("name", "id"), 3, 20)


# ---- stored tables -----------------------------------------------------------------

# The sign-in data of each user: the newest event before a moment, and what changed since.
SATELLITE = "'user-' || user_id AS login, event_type AS token, event_id AS sequence"
SATELLITES_SQL = f"""sat AS (SELECT {SATELLITE}, json_extract_string(props, '$.k') AS k, value FROM events),
    base AS (SELECT * FROM sat WHERE sequence < 6000), changed AS (SELECT * FROM sat WHERE sequence >= 6000 AND login LIKE '%7')"""


def satellites(spark, sf):
    params = "map('k', get_json_object(props, '$.k'), 'v', CAST(CAST(value AS DECIMAL(12, 2)) AS STRING)) AS params"
    return table(spark, sf, "events").selectExpr(*SATELLITE.split(", "), params)


@query(
    "upsert_satellites",
    f"""WITH {SATELLITES_SQL}, every AS (SELECT * FROM base UNION ALL SELECT * FROM changed)
    SELECT login, token, 'k=' || k || ',v=' || CAST(CAST(value AS DECIMAL(12, 2)) AS VARCHAR) AS params
    FROM (SELECT *, row_number() OVER (PARTITION BY login ORDER BY sequence DESC) AS r FROM every) WHERE r = 1""",
)
def upsert_satellites(spark, sf):
    """Rows with a map column, changed by key in a bucketed table: only the buckets of changed users are written."""
    rows = satellites(spark, sf)
    base = listing.latest_per_key(rows.filter("sequence < 6000"), "login", ["sequence"]).drop("sequence")
    stored = tables_on_disk.create_bucketed(base, work_path(spark, "satellites"), "login", 16)
    stored.upsert(rows.filter("sequence >= 6000 AND login LIKE '%7'"), "sequence")
    kept = tables_on_disk.open_bucketed(spark, stored.root).read()
    pairs = F.transform(F.sort_array(F.map_entries("params")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return kept.select("login", "token", F.array_join(pairs, ",").alias("params"))


@query(
    "accounts_page_after",
    f"""WITH {ACCOUNTS_SQL}, numbered AS (
        SELECT id, username, avatar_url, row_number() OVER (ORDER BY avatar_url NULLS LAST, id) AS place,
            count(avatar_url) OVER () AS named FROM accounts)
    SELECT id, username, avatar_url, CAST((place - named + 4) // 40 AS INTEGER) AS page FROM numbered
    WHERE place > named - 5 AND place <= named + 75""",
)
def accounts_page_after(spark, sf):
    """Two pages of a listing by a nullable column, from just before its nulls, each read from a sorted table."""
    columns = [("avatar_url", False), ("id", False)]
    rows = accounts(spark, sf).select("id", "username", "avatar_url")
    stored = tables_on_disk.write_sorted(rows, work_path(spark, "accounts"), columns, rows_per_part=100)
    named = rows.filter("avatar_url IS NOT NULL").orderBy(F.desc("avatar_url"), F.desc("id")).limit(6).collect()
    first = stored.page_after((named[-1].avatar_url, named[-1].id), 40)
    end = first.orderBy(*listing.order_of([(n, not d) for n, d in columns])).first()
    second = stored.page_after((end.avatar_url, end.id), 40)
    return first.withColumn("page", F.lit(0)).unionAll(second.withColumn("page", F.lit(1)))
