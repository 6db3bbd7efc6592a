"""Every registered query against DuckDB, and what its plan may not contain."""

import pytest
from oracle_check import compare, duck

import __spark_entry__ as entry
from ticketweave.functions.vectors import with_terms
from ticketweave.operators import bayes, lookup
from ticketweave.plans import registry, table_queries, text_queries, triage
from ticketweave.session import materialize

# Queries that start streams or fit models have no single plan to look at.
EAGER = (
    "stream_classify", "stream_similar", "stream_index", "stream_replayed", "stream_many_owners", "stream_similar_indexed",
    "cv_ml", "ml_pipeline",
)




def registry_queries():
    """The library's own queries; those of optional parts have tests of their own."""
    registry.load_all()
    return list(registry.QUERIES)


@pytest.fixture(scope="module")
def connection(small):
    return duck(small)


@pytest.mark.parametrize("name", registry_queries())
def test_query(spark, small, connection, name):
    assert compare(spark, connection, small, name) == ""


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "that_id", "similarity"]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in registry_queries() if n not in EAGER])
def test_no_loop_over_pairs(spark, small, name):
    plan = plan_of(entry.queries()[name](spark, small))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark, small):
    plan = plan_of(lookup.equals(table_queries.tickets(spark, small), "status", "P").select("id"))
    assert "EqualTo(o_orderstatus,P)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan


def test_text_is_cleaned_once_and_without_a_second_shuffle(spark, small):
    plan = plan_of(text_queries.hashed_tf(spark, small))
    assert plan.count("md5(") == 1 and plan.count("Exchange") == 1
    plan = plan_of(text_queries.tf_normalized(spark, small))
    assert plan.count("md5(") == 1 and plan.count("Exchange") == 1


def test_counting_cleans_once_and_combines_before_the_shuffle(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("text", "lang")
    counts = bayes.class_counts(with_terms(docs, "text"), "lang")
    plan = plan_of(bayes.training_counts(counts))
    assert plan.count("md5(") == 1 and plan.count("Exchange") == 1
    assert "partial_sum" in plan


def test_scoring_shuffles_nothing(spark, small):
    docs = text_queries.labeled(spark, small)
    model = triage.train(docs)
    stored = materialize(with_terms(docs, "description"), "vectors")
    plan = plan_of(bayes.classify(stored, model))
    assert "MapInArrow" in plan and "Exchange" not in plan
