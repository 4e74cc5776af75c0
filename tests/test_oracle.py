"""Every registered query against its DuckDB SQL at sf0.001 (the driver does the same at sf0.01)."""

import pytest

import __spark_entry__ as E
from fraudscope.plans.oracle import compare

SF = "/root/testdata/sf0.001"
SQL_NAMES = sorted(E.oracle_sql())
SLOW_ROWS_ONLY = {"gbt_fit_score", "rf_fit_score", "top_features", "train_report", "model_roundtrip",
                  "stream_score", "audit_append", "boost_fit_score", "boost_rounds", "combined_models"}


def test_every_sql_key_is_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", SQL_NAMES)
def test_query_matches_oracle(spark, name):
    r = compare(spark, name, SF, queries=E.queries(), sql_of=E.oracle_sql())  # as the driver does
    assert r["status"] == "ok", r


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(SQL_NAMES) - SLOW_ROWS_ONLY))
def test_rows_only_queries_run(spark, name):
    assert E.queries()[name](spark, SF).count() >= 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "is_fraud" in df.columns
