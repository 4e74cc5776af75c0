"""NaN as missing, newest model version, request ids without collisions, neighbours at block edges."""

import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from fraudscope.functions.names import to_snake_case
from fraudscope.operators.clean import clean_fraud_data
from fraudscope.operators.drift import chi2_sf
from fraudscope.operators.scoring import assign_request_ids
from fraudscope.operators.stats import null_summary
from fraudscope.operators.validation import validate_fraud
from fraudscope.sources.tables import raw_transactions
from fraudscope.streaming.monitor import per_minute_stats

from conftest import SF_SMALL


def test_nan_is_invalid_and_named_missing(spark):
    row = dict(step=1, type="PAYMENT", amount=float("nan"), oldbalance_org=1.0, newbalance_orig=1.0, oldbalance_dest=1.0, newbalance_dest=float("nan"))
    out = validate_fraud(spark.createDataFrame([row])).first()
    assert not out["is_valid"] and out["violations"].split(",") == ["amount_missing", "newbalance_dest_missing"]


def test_nan_is_imputed(spark):
    raw = raw_transactions(spark, SF_SMALL)
    raw = raw.withColumn("amount", F.when(F.col("step") % 20 == 0, F.lit(float("nan"))).otherwise(F.col("amount")))
    out = clean_fraud_data(raw)
    assert out.filter(F.isnan("amount") | F.col("amount").isNull()).count() == 0


def test_null_summary_counts_nan(spark):
    df = spark.createDataFrame([(float("nan"), 1), (None, 2), (1.0, 3)], "a double, b int")
    assert [tuple(r) for r in null_summary(df).collect()] == [("a", 2)]


def test_newest_version_wins(spark):
    log = spark.createDataFrame([("2024-01-01 00:00:10", True, "v9"), ("2024-01-01 00:00:50", False, "v10")], "t string, is_fraud boolean, model_version string")
    out = per_minute_stats(log.withColumn("timestamp", F.to_timestamp("t"))).first()
    assert (out["n_predictions"], out["model_version"]) == (2, "v10")


def test_request_ids_tell_keys_apart(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), ("a|b", "c"), ("a", "b|c"), ("", ""), (None, None), ("-", None)], "x string, y string")
    assert assign_request_ids(df, ["x", "y"]).select("request_id").distinct().count() == 7


@pytest.mark.parametrize("name,want", [("nameOrig", "name_orig"), ("userID", "user_id"), ("HTTPCode", "httpcode"), ("a1B", "a1_b"), ("x_Y", "x_y"), (" lead", "_lead"), ("a-b c", "a_b_c"), ("", "")])
def test_names(name, want):
    assert to_snake_case(name) == want


def test_chi_square_tail_converges():
    # the median of a chi-square lies close to its degrees of freedom less two thirds, also for many of them
    for dof in (10, 1000, 10_000_000):
        assert abs(chi2_sf(dof - 2 / 3, dof) - 0.5) < 1e-2
    assert math.isclose(chi2_sf(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert np.isfinite(chi2_sf(5e6, 4_999_000))


def test_psi_bins_come_from_the_reference(spark):
    from fraudscope.operators import drift as D

    ref = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    moved = spark.range(1000).select((F.col("id") + 2000).cast("double").alias("x"))
    outlier = moved.unionByName(spark.createDataFrame([(1e6,)], "x double"))
    assert D.psi(ref, ref, "x", True) == 0.0
    assert D.psi(ref, moved, "x", True) > 5
    assert D.psi(ref, outlier, "x", True) > 5  # one far value does not widen the bins


def test_empty_log_is_readable(spark):
    from fraudscope.plans.scoring import create_log_tables, read_log, recent_predictions
    from fraudscope.schemas import CREDIT_LOG_SCHEMA
    from fraudscope.session import scratch_path

    base = scratch_path(spark, f"empty-log-{uuid.uuid4().hex}")
    create_log_tables(spark, base)
    create_log_tables(spark, base)
    assert recent_predictions(spark, f"{base}/fraud_predictions", ["id", "amount"]).count() == 0
    assert read_log(spark, f"{base}/credit_predictions", CREDIT_LOG_SCHEMA).count() == 0
