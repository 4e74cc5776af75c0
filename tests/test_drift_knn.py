"""Drift statistics against direct formulas; exact kNN and SMOTE invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fraudscope.operators import drift as D
from fraudscope.operators.knn import knn_same_class
from fraudscope.operators.profiles import drift_from_profiles, value_profile
from fraudscope.operators.sampling import smote


def _frames(spark, ref, cur, dtype="double"):
    return (spark.createDataFrame([(v,) for v in ref], f"x {dtype}"),
            spark.createDataFrame([(v,) for v in cur], f"x {dtype}"))


def _ecdf_gap(a, b):
    vals = np.unique(np.concatenate([a, b]))
    fa = np.searchsorted(np.sort(a), vals, side="right") / len(a)
    fb = np.searchsorted(np.sort(b), vals, side="right") / len(b)
    return vals, fa, fb


def test_ks_and_wasserstein(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(0, 1, 300).round(2)
    b = rng.normal(0.3, 1.2, 200).round(2)
    r, c = _frames(spark, a.tolist(), b.tolist())
    d, n, m = D.ks_statistic(r, c, "x")
    vals, fa, fb = _ecdf_gap(a, b)
    assert (n, m) == (300, 200) and abs(d - np.max(np.abs(fa - fb))) < 1e-12
    w = np.sum(np.abs(fa - fb)[:-1] * np.diff(vals)) / max(np.std(a), 0.001)
    assert abs(D.wasserstein_normed(r, c, "x") - w) < 1e-9
    assert 0 <= D.ks_pvalue(d, n, m) < 0.05  # shifted distribution


def test_js_chi2_psi_categorical(spark):
    ref = ["a"] * 50 + ["b"] * 30 + ["c"] * 20
    cur = ["a"] * 20 + ["b"] * 30 + ["c"] * 40 + ["d"] * 10
    r, c = _frames(spark, ref, cur, "string")
    p = np.array([0.5, 0.3, 0.2, 0.0])
    q = np.array([0.2, 0.3, 0.4, 0.1])
    m = (p + q) / 2
    kl = lambda x, y: np.sum([xi * math.log(xi / yi) for xi, yi in zip(x, y) if xi > 0])
    assert abs(D.js_distance(r, c, "x") - math.sqrt((kl(p, m) + kl(q, m)) / 2)) < 1e-12
    s, dof = D.chi2_statistic(r, c, "x")
    assert math.isinf(s) and dof == 3  # a category unseen in the reference has expected count 0
    pe, qe = np.where(p == 0, 1e-4, p), np.where(q == 0, 1e-4, q)
    assert abs(D.psi(r, c, "x", False) - np.sum((pe - qe) * np.log(pe / qe))) < 1e-12


def test_chi2_sf_known_values():
    assert abs(D.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(D.chi2_sf(5.991464547107979, 2) - 0.05) < 1e-9
    assert abs(D.chi2_sf(18.307038053275146, 10) - 0.05) < 1e-9


def test_default_test_selection_and_summary(spark):
    small_r, small_c = _frames(spark, [float(i % 50) for i in range(200)], [float(i % 50) + 5 for i in range(200)])
    assert D.column_drift(small_r, small_c, "x").stattest == "ks"
    big_r, big_c = _frames(spark, [float(i % 50) for i in range(1500)], [float(i % 50) for i in range(300)])
    res = D.column_drift(big_r, big_c, "x")
    assert res.stattest == "wasserstein" and not res.drift_detected
    two_r, two_c = _frames(spark, ["x", "y"] * 20, ["x"] * 40, "string")
    z = D.column_drift(two_r, two_c, "x")
    assert z.stattest == "z" and z.drift_detected
    rep = D.drift_report(small_r, small_c)
    s = D.drift_summary(rep).first()
    assert s["n_features"] == 1 and s["drift_share"] in (0.0, 1.0) and s["alert"] == (s["drift_share"] > 0.15)


def test_batched_report_equals_per_column(spark):
    rows_r = [(float(i % 40), float(i % 3), "ab"[i % 2], "xyz"[i % 3]) for i in range(300)]
    rows_c = [(float(i % 40) + 3, float(i % 3), "ab"[(i // 3) % 2], "xyz"[i % 2]) for i in range(120)]
    schema = "a double, b double, s string, t string"
    for mult in (1, 5):  # <= 1000 and > 1000 reference rows
        r = spark.createDataFrame(rows_r * mult, schema)
        c = spark.createDataFrame(rows_c, schema)
        rep = {x["column_name"]: x for x in D.drift_report(r, c).collect()}
        for col in ["a", "b", "s", "t"]:
            one = D.column_drift(r, c, col)
            got = rep[col]
            assert got["stattest"] == one.stattest and got["drift_detected"] == one.drift_detected, col
            if not math.isnan(one.statistic):
                assert abs(got["statistic"] - round(one.statistic, 6)) < 1e-9, col


def test_a_fixed_rule_gives_one_test_at_every_size(spark):
    rows = [(float(i % 40), float(i % 3), "ab"[i % 2], "xyz"[i % 3]) for i in range(300)]
    moved = [(float(i % 40) + 3, float(i % 3), "ab"[(i // 3) % 2], "xyz"[i % 2]) for i in range(120)]
    schema = "a double, b double, s string, t string"
    c = spark.createDataFrame(moved, schema)
    distances = D.DriftRule(numeric="wasserstein", categorical="jensenshannon")
    p_values = D.DriftRule(numeric="ks", categorical="chisquare", few_values=2)
    found = []
    for mult in (1, 5):
        r = spark.createDataFrame(rows * mult, schema)
        for rule, want in ((distances, ["wasserstein", *["jensenshannon"] * 3]), (p_values, ["ks", "ks", "z", "chisquare"])):
            rep = sorted(D.drift_report(r, c, rule=rule).collect())
            assert [x["stattest"] for x in rep] == want
            for x in rep:
                one = D.column_drift(r, c, x["column_name"], rule=rule)
                assert one.stattest == x["stattest"] and one.drift_detected == x["drift_detected"]
            profiled = sorted(drift_from_profiles(value_profile(r), value_profile(c), rule=rule).collect())
            assert [tuple(x)[:3] for x in profiled] == [tuple(x)[:3] for x in rep]
            if rule is distances:
                found.append([(x["statistic"], x["drift_detected"]) for x in rep])
    assert found[0] == found[1]  # five copies of the reference are at the same distances
    with pytest.raises(ValueError):
        D.DriftRule(numeric="t")


def test_knn_blocked_equals_brute_force(spark):
    rng = np.random.default_rng(11)
    pts = rng.normal(size=(240, 6)).round(3)
    labels = (np.arange(240) % 3)
    df = spark.createDataFrame([(int(i), int(labels[i]), pts[i].tolist()) for i in range(240)],
                               "id long, label int, v array<double>")
    got = {(r["id"], r["rank"]): r["neighbor_id"] for r in knn_same_class(df, "id", "label", "v", k=4, block_rows=10).collect()}
    for i in range(240):
        same = [j for j in range(240) if labels[j] == labels[i] and j != i]
        d = sorted((float(np.sqrt(np.sum((pts[i] - pts[j]) ** 2))), j) for j in same)[:4]
        assert [got[(i, r + 1)] for r in range(4)] == [j for _, j in d]


def test_smote_balances_and_interpolates(spark):
    rows = [(i, 0, [float(i), 0.0]) for i in range(40)] + [(100 + i, 1, [float(i), 1.0]) for i in range(7)]
    df = spark.createDataFrame(rows, "id long, y int, v array<double>")
    out = smote(df, "y", "v", "id", k=5, seed=42)
    counts = {r["y"]: r["count"] for r in out.groupBy(F.col("label").alias("y")).count().collect()}
    assert counts == {0: 40, 1: 40}
    synth = out.filter("synthetic").collect()
    assert len(synth) == 33
    for r in synth:  # on a segment between two class-1 points: y stays 1, x within the class range
        assert r["label"] == 1 and abs(r["vec"][1] - 1.0) < 1e-12 and 0.0 <= r["vec"][0] <= 6.0
    again = sorted(tuple(r["vec"]) for r in smote(df, "y", "v", "id", k=5, seed=42).filter("synthetic").collect())
    assert again == sorted(tuple(r["vec"]) for r in synth)  # deterministic
    with pytest.raises(ValueError):
        smote(df.filter("y = 0 OR id < 103"), "y", "v", "id", k=5)


def test_wide_blocks_score_the_asked_buckets_only():
    from fraudscope.operators import knn as K

    rng = np.random.default_rng(3)
    bucket = np.sort(rng.integers(0, 9, 400))
    ids, vecs, block = np.arange(400), rng.integers(0, 6, (400, 3)).astype(float), bucket.astype(np.int64) * 2**32
    lo = rng.integers(0, 6, 300)
    hi, own = lo + rng.integers(0, 4, 300), rng.integers(0, 9, 300).astype(np.int64) * 2**32
    q, limits = rng.integers(0, 6, (300, 3)).astype(float), rng.uniform(1, 4, 300)
    got_ids, got_d = K._top_k(np.arange(300), q, ids, vecs, 5, False, limits, (lo, hi, own, bucket, block))
    for i in range(300):
        d = np.sqrt(((vecs - q[i]) ** 2).sum(axis=1))
        ok = (bucket >= lo[i]) & (bucket <= hi[i]) & (block != own[i]) & (d <= limits[i])
        want = sorted(zip(d[ok], ids[ok]))[:5]
        assert list(got_ids[i]) == [w[1] for w in want] and np.allclose(got_d[i], [w[0] for w in want])


def test_points_ask_few_cells_and_all_that_hold_neighbours():
    from fraudscope.operators import knn as K

    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(6000, 5)), np.repeat(rng.normal(size=(20, 5)), 50, axis=0)])
    x = np.concatenate([x, rng.integers(0, 2, (len(x), 3))], axis=1).astype(float)  # coordinates of two values, points that repeat
    planes = K._planes(x[::3], 100)
    cell = K._cells(planes, x)
    used = np.unique(cell)
    low, high = (np.stack([f(x[cell == c], axis=0) for c in used]) for f in (np.min, np.max))
    ids = np.arange(len(x))
    nn, d = K._nearest(ids[::7], x[::7], ids, x, 5, True)
    radius = np.array([v[-1] for v in d])
    r, c = K._asked(x[::7], radius, low, high)
    assert len(r) < len(radius) * len(used) / 5
    asked = set(zip(r.tolist(), used[c].tolist()))
    assert all((i, cell[j]) in asked for i, js in enumerate(nn) for j in js)
    assert K._nearest_within(ids[::7], x[::7], ids, x, 5, True, radius) == (nn, d)
    assert K._nearest_within(ids[::7], x[::7], ids, x, 5, True, np.full(len(radius), np.inf)) == (nn, d)
