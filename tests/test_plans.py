"""Plan regressions: the physical shapes the design relies on (pruning, no cross products, no shuffles)."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    df = E.queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


def test_split_is_a_projection(spark):
    p = plan(spark, "hash_split")
    assert "Exchange" not in p and "Window" not in p


@pytest.mark.parametrize("name", ["winsorize", "validate_credit", "coerce_types", "score_tier", "risk_tier"])
def test_map_only_queries_do_not_shuffle(spark, name):
    assert "Exchange hashpartitioning" not in plan(spark, name)


@pytest.mark.parametrize("name", ["binary_metrics", "pr_curve", "gini_per_class", "knn_same_class", "clean_fraud",
                                  "class_report", "combined_score"])
def test_no_cross_products(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_clean_fraud_prunes_and_pushes_down(spark):
    p = plan(spark, "clean_fraud")
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double,o_orderpriority:string>" in p \
        or "o_orderstatus" not in p
    assert "o_orderdate" not in p and "c_name" not in p
    assert p.count("Exchange hashpartitioning") <= 2  # the de-dup (and at most a join shuffle)


def test_recent_log_read_prunes_partitions(spark):
    p = plan(spark, "audit_append")
    assert "PartitionFilters: [isnotnull(log_date" in p and "TakeOrderedAndProject" in p


def test_metrics_do_not_read_document_text(spark):
    p = plan(spark, "binary_metrics")
    assert "documents.parquet" in p and "text:string" not in p
