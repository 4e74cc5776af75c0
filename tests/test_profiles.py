"""Column profiles against the tables they stand for, rank and category correlations, and exact Kolmogorov-Smirnov p-values."""

import itertools
import math
import random
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fraudscope.operators import drift as D
from fraudscope.operators import profiles as P
from fraudscope.plans.drift_job import run_profile_drift
from fraudscope.session import scratch_path

SCHEMA = "k int, x double, y double, few int, name string, other string, empty string"


def table(spark, n, seed, shift=0.0):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, float("nan"), 0.0, 0.0, 0.0, rng.gauss(shift, 1)]), rng.randrange(20) + shift, rng.randrange(3), rng.choice(["a", "b", "b", None]),
             rng.choice("pqr"), None) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("n", [3, 400, 1500])
def test_drift_from_profiles_is_the_report_of_the_tables(spark, n):
    """Both choices of tests (up to 1,000 reference rows and more)."""
    ref, cur = table(spark, n, 1), table(spark, 300, 2, 0.3)
    cols = ["x", "y", "few", "name", "other"]
    want = {tuple(r) for r in D.drift_report(ref, cur, cols).collect()}
    assert {tuple(r) for r in P.drift_from_profiles(P.value_profile(ref, cols), P.value_profile(cur, cols)).collect()} == want


def test_profiles_add_up_and_are_stored(spark):
    whole = table(spark, 900, 3)
    parts = [P.value_profile(whole.filter(F.col("k") % 3 == i)) for i in range(3)]
    path = scratch_path(spark, f"profile-{uuid.uuid4().hex}")
    P.store_profile(P.merge_profiles(*parts), path)
    columns = P.PROFILE_SCHEMA.replace(" string", "").replace(" double", "").replace(" long", "").split(", ")
    assert sorted(map(str, P.read_profile(spark, path).select(*columns).collect())) == sorted(map(str, P.value_profile(whole).select(*columns).collect()))


def test_quality_figures_with_ties_and_missing_values(spark):
    df = table(spark, 700, 4)
    got = {r["column_name"]: r for r in P.quality_figures(P.value_profile(df)).collect()}
    x = np.array([r["x"] for r in df.collect() if r["x"] is not None and not math.isnan(r["x"])])
    r = got["x"]
    assert (r["count"], r["missing"], r["n_unique"]) == (len(x), 700 - len(x), len(set(x)))
    assert [r[c] for c in ("mean", "std", "min", "max", "p25", "p50", "p75")] == pytest.approx([x.mean(), x.std(ddof=1), x.min(), x.max(), *np.percentile(x, [25, 50, 75])], abs=1e-6)
    assert r["most_common"] == "0.0" and got["name"]["most_common"] == "b"
    assert got["empty"]["count"] == 0 and got["empty"]["missing"] == 700 and got["empty"]["n_unique"] == 0 and got["empty"]["most_common"] is None
    bins = {(b["col"], b["bin"]): b["n"] for b in P.histogram(P.value_profile(df), 7).collect()}
    want = np.histogram(x, 7)[0]
    assert [bins.get(("x", i), 0) for i in range(7)] == want.tolist()


def test_one_scan_for_all_columns(spark):
    df = table(spark, 50, 5)
    path = scratch_path(spark, f"scan-{uuid.uuid4().hex}")
    df.write.parquet(path)
    plan = P.value_profile(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1


def test_profile_drift_run_skips_what_it_cannot_compare(spark):
    ref, cur = P.value_profile(table(spark, 200, 6)), table(spark, 49, 7)
    got = {r["model"]: (r["status"], r["n_current"]) for r in run_profile_drift(spark, {"few": (ref, cur), "none": (None, cur), "nothing": (ref, None), "ok": (ref, table(spark, 50, 7))}).collect()}
    assert got == {"few": ("not_enough_rows", 49), "none": ("no_reference", None), "nothing": ("no_current", None), "ok": ("ok", 50)}


def mean_ranks(v):
    order = np.sort(v)
    return np.array([(np.searchsorted(order, a, "left") + np.searchsorted(order, a, "right") + 1) / 2 for a in v])


def test_spearman_over_rows_that_have_both(spark):
    df = table(spark, 500, 8).withColumn("const", F.lit(1.0))
    got = {(r["column_a"], r["column_b"]): r["spearman"] for r in P.spearman(df, ["x", "y", "few", "const"]).collect()}
    rows = [r for r in df.collect()]
    for a, b in itertools.combinations(["x", "y", "few"], 2):
        both = np.array([(r[a], r[b]) for r in rows if r[a] is not None and not math.isnan(r[a]) and r[b] is not None])
        assert got[a, b] == pytest.approx(np.corrcoef(mean_ranks(both[:, 0]), mean_ranks(both[:, 1]))[0, 1], abs=1e-6)
    assert got["x", "const"] is None


def test_cramers_v(spark):
    df = table(spark, 600, 9).withColumn("same", F.col("name")).withColumn("one", F.lit("z"))
    got = {(r["column_a"], r["column_b"]): r["cramers_v"] for r in P.cramers_v(P.contingency(df, ["name", "other", "same", "one"])).collect()}
    pairs = [(r["name"], r["other"]) for r in df.collect() if r["name"] is not None]
    n, chi = len(pairs), 0.0
    for a in "ab":
        for b in "pqr":
            e = sum(p[0] == a for p in pairs) * sum(p[1] == b for p in pairs) / n
            chi += (sum(p == (a, b) for p in pairs) - e) ** 2 / e
    assert got["name", "other"] == pytest.approx(math.sqrt(chi / n), abs=1e-6)
    assert got["name", "same"] == 1.0 and got["name", "one"] is None


@pytest.mark.parametrize("n,m", [(1, 1), (3, 4), (5, 5), (6, 3), (2, 8)])
def test_exact_ks_equals_enumeration(n, m):
    """All ways to deal n + m ordered values to two samples."""
    gaps = []
    for mine in itertools.combinations(range(n + m), n):
        i = j = worst = 0
        for k in range(n + m):
            i, j = (i + 1, j) if k in mine else (i, j + 1)
            worst = max(worst, abs(i * m - j * n))
        gaps.append(worst)
    for d in sorted(set(gaps)):
        assert D.ks_pvalue(d / (n * m), n, m) == pytest.approx(sum(g >= d for g in gaps) / len(gaps))


def test_exact_ks_meets_the_limit_for_large_samples():
    assert D.ks_pvalue_exact(0.0, 5, 5) == 1.0 and D.ks_pvalue_exact(1.0, 800, 900) == pytest.approx(0.0, abs=1e-12)
    for d in (0.02, 0.05, 0.08):
        assert D.ks_pvalue_exact(d, 2000, 1500) == pytest.approx(D.ks_pvalue_asymptotic(d, 2000, 1500), abs=0.02)
    assert D.ks_pvalue(0.01, 20_000, 20_000) == D.ks_pvalue_asymptotic(0.01, 20_000, 20_000)


def test_spearman_counts_each_value_once_for_all_pairs(spark):
    """No row is multiplied by the pairs, and pairs without common rows are left out."""
    rows = [(float(i % 7), float(i * i % 11) if i % 3 else None, float(i % 5) if i % 4 else float("nan"), None) for i in range(90)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = {(r[0], r[1]): r[2] for r in P.spearman(df, ["a", "b", "c", "d"]).collect()}
    want = {}
    frame = pd.DataFrame(rows, columns=["a", "b", "c", "d"]).astype(float)
    for x, y in (("a", "b"), ("a", "c"), ("b", "c")):
        both = frame[[x, y]].dropna().rank()
        want[x, y] = round(float(np.corrcoef(both[x], both[y])[0, 1]), 6)
    assert got == pytest.approx(want)
    plan = P.spearman(df, ["a", "b", "c"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") <= 1  # of the figures; rows are not exploded into pairs


def test_counts_of_both_profiles_are_merged_once(spark, monkeypatch):
    """Every numeric statistic of a drift run reads stored counts; none merges the profiles again."""
    seen = []
    stats = P.numeric_count_stats
    monkeypatch.setattr(P, "numeric_count_stats", lambda vc, *a: seen.append(vc) or stats(vc, *a))
    old, new = (spark.createDataFrame([(float(i % m), "ab"[i % 2]) for i in range(200)] + [(None, None)], "x double, t string") for m in (50, 7))
    direct = P.drift_from_profiles(P.value_profile(old), P.value_profile(new)).collect()
    assert sorted(r["column_name"] for r in direct) == ["t", "x"]
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation" in plan and "Aggregate" not in plan and "Union" not in plan
    assert sum(r["r"] for r in seen[0].collect()) == sum(r["c"] for r in seen[0].collect()) == 200
