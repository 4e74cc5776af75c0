"""Hot keys: one value / score / point holding a third of the rows must not change results."""

import numpy as np
from pyspark.sql import functions as F

from fraudscope.operators import metrics as M
from fraudscope.operators.clean import dedup_counters
from fraudscope.operators.knn import knn_same_class
from fraudscope.operators.stats import column_modes


def _auc_ap(scores, labels):
    s, y = np.asarray(scores), np.asarray(labels)
    pos, neg = s[y == 1], s[y == 0]
    auc = (np.sum(pos[:, None] > neg[None, :]) + 0.5 * np.sum(pos[:, None] == neg[None, :])) / (len(pos) * len(neg))
    ap = 0.0
    for t in np.unique(s)[::-1]:
        sel = s >= t
        tp = np.sum(y[sel] == 1)
        ap += np.sum((s == t) & (y == 1)) / len(pos) * tp / np.sum(sel)
    return auc, ap


def test_metrics_with_hot_score(spark):
    rng = np.random.default_rng(5)
    n = 3000
    scores = rng.random(n).round(3)
    scores[: n // 3] = 0.5  # a third of all rows share one score
    labels = (rng.random(n) < scores).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(scores, labels)], "p double, y int")
    r = M.binary_summary(df, "y", "p", digits=None).first()
    auc, ap = _auc_ap(scores, labels)
    assert abs(r["roc_auc"] - auc) < 1e-12 and abs(r["pr_auc"] - ap) < 1e-12


def test_drift_and_per_class_gini_with_hot_values(spark):
    from fraudscope.operators import drift as D

    rng = np.random.default_rng(8)
    ref = np.concatenate([np.full(700, 3.0), rng.normal(3, 1, 1400).round(2)])  # a third is one value
    cur = np.concatenate([np.full(300, 3.0), rng.normal(3.5, 1, 600).round(2)])
    r = spark.createDataFrame([(float(v),) for v in ref], "x double")
    c = spark.createDataFrame([(float(v),) for v in cur], "x double")
    st = D.numeric_drift_stats(r, c, ["x"])["x"]
    vals = np.unique(np.concatenate([ref, cur]))
    fa = np.searchsorted(np.sort(ref), vals, side="right") / len(ref)
    fb = np.searchsorted(np.sort(cur), vals, side="right") / len(cur)
    assert abs(st["d"] - np.max(np.abs(fa - fb))) < 1e-12
    assert abs(st["w"] - np.sum(np.abs(fa - fb)[:-1] * np.diff(vals))) < 1e-9

    n = 1500
    labels = rng.integers(0, 3, n)
    p = rng.random((n, 3)).round(2)
    p[: n // 3] = 0.5  # a third of the rows share every score
    df = spark.createDataFrame([(int(a), *map(float, row)) for a, row in zip(labels, p)],
                               "y int, p0 double, p1 double, p2 double")
    got = {row["class_label"]: row["gini"] for row in M.gini_per_class(df, "y", {0: "p0", 1: "p1", 2: "p2"}).collect()}
    for k in range(3):
        auc, _ = _auc_ap(p[:, k], (labels == k).astype(int))
        assert got[str(k)] == round(2 * auc - 1, 4)


def test_dedup_and_mode_with_hot_row(spark):
    hot = [(1, "PAYMENT", 10.0)] * 1200
    rest = [(i, "DEBIT" if i % 2 else "CASH_IN", float(i)) for i in range(2, 2002)]
    df = spark.createDataFrame(hot + rest, "step int, type string, amount double").withColumn(
        "is_fraud", F.lit(0))
    c = dedup_counters(df, "is_fraud").first()
    assert (c["rows_raw"], c["rows_deduplicated"]) == (3200, 2001)
    assert column_modes(df, ["type"]) == {"type": "PAYMENT"}


def test_knn_with_hot_identical_points(spark):
    rng = np.random.default_rng(9)
    pts = rng.normal(size=(150, 3)).round(2)
    pts[:50] = 0.25  # a third of the class is one identical point
    df = spark.createDataFrame([(i, 0, pts[i].tolist()) for i in range(150)], "id long, label int, v array<double>")
    got = {(r["id"], r["rank"]): r["neighbor_id"] for r in knn_same_class(df, "id", "label", "v", k=3, block_rows=8).collect()}
    for i in range(150):
        d = sorted((float(np.sqrt(np.sum((pts[i] - pts[j]) ** 2))), j) for j in range(150) if j != i)[:3]
        assert [got[(i, r + 1)] for r in range(3)] == [j for _, j in d]
