"""Features, sampling and metrics on hand-computed fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from fraudscope.operators import metrics as M
from fraudscope.operators.features import FeaturePipeline, fraud_features
from fraudscope.operators.prefix import cumulative
from fraudscope.operators.sampling import (
    balanced_class_weights,
    mark_smallest_hash,
    positive_class_weight,
    stratified_split,
)
from fraudscope.operators.scoring import finalize_credit, finalize_fraud


def test_scaler_population_std_and_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "a double, b double")
    fp = FeaturePipeline(["a", "b"], []).fit(df)
    assert abs(fp.state.stds["a"] - 1.247219128924647) < 1e-12  # population, not 1.5275 (sample)
    assert fp.state.stds["b"] == 1.0
    vals = sorted(r["features"][0] for r in fp.transform(df, as_vector=False).collect())
    assert abs(vals[0] - (1 - 7 / 3) / 1.247219128924647) < 1e-12


def test_fraud_contract_and_unknown_category(spark):
    cols = ["step", "amount", "oldbalance_org", "newbalance_orig", "oldbalance_dest", "newbalance_dest",
            "balance_error_orig", "balance_error_dest", "orig_balance_zeroed"]
    rows = [tuple([float(i)] * 9) + (t,) for i, t in enumerate(["PAYMENT", "TRANSFER", "BOGUS"])]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols) + ", type string")
    fp = fraud_features().fit(df)
    assert len(fp.feature_names()) == 14
    out = {r["features"][9:].count(1.0): r for r in fp.transform(df, as_vector=False).collect()}
    assert 0 in out  # unknown type -> all five one-hots zero
    bad = FeaturePipeline(cols, ["type"], expected_width=14)
    with pytest.raises(RuntimeError):
        bad.fit(df)  # learned categories give 9 + 3 = 12 features


def test_learned_categories_sorted_unknown_zero(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "k string")
    fp = FeaturePipeline([], ["k"]).fit(df)
    assert fp.feature_names() == ["k_a", "k_b", "k_c"]
    new = spark.createDataFrame([("z",), (None,)], "k string")
    assert all(sum(r["features"]) == 0 for r in fp.transform(new, as_vector=False).collect())


def test_stratified_split_exact(spark):
    df = spark.range(0, 2000).select(F.col("id"), (F.col("id") % 20 == 0).cast("int").alias("y"))
    s = stratified_split(df, "y", ["id"], 0.2, 42)
    counts = {(r["y"], r["split"]): r["count"] for r in s.groupBy("y", "split").count().collect()}
    assert counts[(0, "test")] == 380 and counts[(1, "test")] == 20
    assert s.count() == 2000 and s.select("id").distinct().count() == 2000
    assert abs(s.filter("split = 'test'").count() - 400) <= 5


def test_mark_smallest_hash_quota(spark):
    df = spark.range(0, 5000).select("id", (F.col("id") % 3).alias("c"))
    m = mark_smallest_hash(df, "c", ["id"], {0: 7, 1: 0, 2: 1666})
    got = {r["c"]: r["n"] for r in m.filter("picked").groupBy("c").agg(F.count("*").alias("n")).collect()}
    assert got == {0: 7, 2: 1666}


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 3 + [(2,)] * 1, "y int")
    w = {r["y"]: r["weight"] for r in balanced_class_weights(df, "y").collect()}
    assert w == {0: round(10 / 18, 6), 1: round(10 / 9, 6), 2: round(10 / 3, 6)}
    p = positive_class_weight(df.filter("y < 2"), "y").first()
    assert p["scale_pos_weight"] == 2.0 and p["n_pos"] == 3


SIX = [(0.9, 1), (0.8, 0), (0.8, 1), (0.7, 0), (0.4, 1), (0.1, 0)]


def test_average_precision_and_auc_six_rows(spark):
    df = spark.createDataFrame(SIX, "p double, y int")
    r = M.binary_summary(df, "y", "p").first()
    assert r["pr_auc"] == 0.7556 and r["roc_auc"] == 0.7222 and r["gini_coefficient"] == round(2 * 0.7222222 - 1, 4)
    r2 = M.fraud_metric_row(df, "y", "p", threshold=0.5).first()
    assert r2["f1_score"] == round(4 / 7, 4)  # tp 2, fp 2, fn 1


def test_prefix_sums_many_buckets_equal_one_bucket(spark):
    df = spark.createDataFrame([(float(i % 37), i % 2) for i in range(400)], "k double, y int").groupBy("k").agg(
        F.sum("y").alias("a"), F.count("*").alias("b"))
    one = sorted(tuple(r) for r in cumulative(df, "k", ["a", "b"]).collect())
    many = sorted(tuple(r) for r in cumulative(df, "k", ["a", "b"], rows_per_bucket=3).collect())
    assert one == many
    last = max(one)
    assert last[-1] is None and last[-2] == 400  # next key of the largest is NULL, full count at the end


def test_grouped_prefix_sums_many_buckets(spark):
    rows = [(g, float((i * 7 + j) % 53), i % 3) for j, g in enumerate(("a", "b", "c")) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, k double, y int").groupBy("g", "k").agg(F.sum("y").alias("m"))
    got = {(r["g"], r["k"]): (r["cum_m"], r["next_k"])
           for r in cumulative(df, "k", ["m"], groups=["g"], rows_per_bucket=4).collect()}
    for g in ("a", "b", "c"):
        keys = sorted(k for (gg, k) in got if gg == g)
        local = {r["k"]: r["m"] for r in df.filter(F.col("g") == g).collect()}
        run = 0
        for i, k in enumerate(keys):
            run += local[k]
            nxt = keys[i + 1] if i + 1 < len(keys) else None
            assert got[(g, k)] == (run, nxt)


def test_pr_curve_terminal_and_single_class(spark):
    df = spark.createDataFrame(SIX, "p double, y int")
    pts = M.pr_curve(df, "y", "p").collect()
    assert any(r["threshold"] is None and r["precision"] == 1.0 and r["recall"] == 0.0 for r in pts)
    one = spark.createDataFrame([(0.3, 1), (0.6, 1)], "p double, y int")
    assert M.binary_summary(one, "y", "p").first()["roc_auc"] is None
    g = M.gini_per_class(one.withColumn("q", 1 - F.col("p")), "y", {1: "p", 0: "q"}).collect()
    assert all(r["gini"] == 0.0 for r in g)


def test_confusion_and_report(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "a int, p int")
    cm = {(r["actual"], r["predicted"]): r["count"] for r in M.confusion_matrix(df, "a", "p").collect()}
    assert len(cm) == 9 and cm[(2, 2)] == 0 and cm[(0, 1)] == 1
    rep = {r["label"]: r for r in M.classification_report(df, "a", "p").collect()}
    assert rep["1"]["precision"] == round(1 / 3, 4) and rep["1"]["recall"] == 1.0
    assert rep["2"]["f1_score"] == 0.0 and rep["accuracy"]["f1_score"] == 0.5
    assert rep["macro avg"]["support"] == 4


def test_threshold_on_unrounded_and_rounding(spark):
    df = spark.createDataFrame([(0.49996,), (2.675,)], "p double")
    rows = {r["p"]: r for r in finalize_fraud(df, "p", 0.5, "v").collect()}
    assert rows[0.49996]["fraud_probability"] == 0.5 and rows[0.49996]["is_fraud"] is False  # T5
    assert spark.createDataFrame([(2.675,)], "x double").select(F.round("x", 2)).first()[0] == 2.68  # T6 (half-up)


def test_credit_tier_and_confidences(spark):
    df = spark.createDataFrame([(0.80, 0.15, 0.05), (0.1, 0.2, 0.7)], "a double, b double, c double")
    rows = finalize_credit(df, "a", "b", "c", "v").collect()
    assert [r["credit_tier"] for r in rows] == ["Good", "Poor"]
    assert all(abs(sum(r["confidence_scores"].values()) - 1) < 0.01 for r in rows)
