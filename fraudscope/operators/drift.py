"""Data drift and data quality between a reference table and a current table.

Per column one test is chosen by the usual default rule:

===========================  ====================  ==========================
reference rows               numeric (> 5 values)  categorical / <= 5 values
===========================  ====================  ==========================
<= 1000                      two-sample KS, p<.05   chi-square p<.05 (2 values: z-test)
> 1000                       Wasserstein / std >= .1  Jensen-Shannon distance >= .1
===========================  ====================  ==========================

``DriftRule`` holds that choice as parameters: its limits, or one test for every size
of table.  The report names the test that each column got.

PSI (``method="psi"``) uses 10 bins cut at the reference's quantiles, open at both
ends, for numeric columns and the categories for categorical ones; empty bins count
as 0.0001; drift when PSI >= threshold.

Distributed shape: each column is reduced to a table with one row per distinct
value (or bin) holding the reference and current counts — a partial aggregate,
so a value that holds a third of all rows costs one row.  Running sums over the
ordered distinct values come from ``prefix.cumulative``.  Only scalars (counts,
min/max, the statistic) reach the driver; p-values are computed from them with
closed-form series, those of small KS samples by counting lattice paths.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import DRIFT_THRESHOLD
from .prefix import cumulative

_NUMERIC = ("double", "float", "bigint", "int", "smallint", "tinyint", "decimal")
PSI_BINS = 10
PSI_EPS = 0.0001


def is_numeric(dtype: str) -> bool:
    return dtype.startswith(_NUMERIC)


def _pair(reference: DataFrame, current: DataFrame, col: str, as_double: bool) -> DataFrame:
    x = F.col(col).cast("double") if as_double else F.col(col).cast("string")
    ref = reference.select(x.alias("v"), F.lit(True).alias("is_ref"))
    cur = current.select(x.alias("v"), F.lit(False).alias("is_ref"))
    return ref.unionByName(cur).filter(F.col("v").isNotNull() & (~F.isnan("v") if as_double else F.lit(True)))


def value_counts(reference: DataFrame, current: DataFrame, col: str, as_double: bool) -> DataFrame:
    """(v, r, c): reference and current counts per distinct value."""
    return _pair(reference, current, col, as_double).groupBy("v").agg(
        F.count_if("is_ref").cast("long").alias("r"), F.count_if(~F.col("is_ref")).cast("long").alias("c")
    )


# ----------------------------------------------------------------------------- numeric statistics
def ks_statistic(reference: DataFrame, current: DataFrame, col: str) -> tuple[float, int, int]:
    """(D, n_ref, n_cur): max |ECDF_ref - ECDF_cur| over all values."""
    vc = value_counts(reference, current, col, True)
    tot = vc.agg(F.sum("r").alias("nr"), F.sum("c").alias("nc"), F.count(F.lit(1)).alias("k")).first()
    nr, nc = int(tot["nr"] or 0), int(tot["nc"] or 0)
    if nr == 0 or nc == 0:
        return float("nan"), nr, nc
    cum = cumulative(vc, "v", ["r", "c"], n_rows=int(tot["k"]))
    gap = F.abs(F.col("cum_r").cast("double") / F.lit(float(nr)) - F.col("cum_c").cast("double") / F.lit(float(nc)))
    d = cum.agg(F.max(gap).alias("d")).first()["d"]
    return float(d), nr, nc


#: Samples of up to this many rows get the exact p-value.  FIXED VALUE: the rule of the reference's library.
KS_EXACT_ROWS = 10_000


def ks_pvalue_exact(d: float, n: int, m: int) -> float:
    """Exact two-sided p-value of the two-sample KS statistic: the share of lattice paths from (0, 0) to (n, m) that somewhere
    are ``d`` or more away from the diagonal, ``|i/n - j/m| >= d``.  Paths that stay inside are counted row by row (a row's counts are the running sums of
    the row before, inside the band) as shares of all paths, n x m steps in all."""
    if not (n and m) or math.isnan(d):
        return float("nan")
    reach = round(d * n * m)  # the statistic is a whole number of 1/(nm)
    if reach <= 0:
        return 1.0
    inside, log_scale = np.zeros(m + 1), 0.0
    j = np.arange(m + 1)
    inside[j * n < reach] = 1.0
    for i in range(1, n + 1):
        band = np.abs(i * m - j * n) < reach
        inside = np.where(band, np.cumsum(np.where(band, inside, 0.0)), 0.0)
        top = inside.max()
        if top == 0:
            return 1.0
        if top > 1e200:
            inside, log_scale = inside / top, log_scale + math.log(top)
    if inside[m] <= 0:
        return 1.0
    paths = math.lgamma(n + m + 1) - math.lgamma(n + 1) - math.lgamma(m + 1)
    return min(1.0, max(0.0, 1.0 - math.exp(math.log(inside[m]) + log_scale - paths)))


def ks_pvalue(d: float, n: int, m: int) -> float:
    """Two-sided p-value of the two-sample KS statistic: exact up to ``KS_EXACT_ROWS`` rows a sample, beyond that the Kolmogorov series."""
    if not (n and m) or math.isnan(d):
        return float("nan")
    if max(n, m) <= KS_EXACT_ROWS:
        return ks_pvalue_exact(d, n, m)
    return ks_pvalue_asymptotic(d, n, m)


def ks_pvalue_asymptotic(d: float, n: int, m: int) -> float:
    """The limit for large samples (Kolmogorov series)."""
    if not (n and m) or math.isnan(d):
        return float("nan")
    en = math.sqrt(n * m / (n + m))
    lam = (en + 0.12 + 0.11 / en) * d
    if lam < 1e-3:
        return 1.0
    s = 0.0
    for j in range(1, 101):
        term = 2 * (-1) ** (j - 1) * math.exp(-2 * j * j * lam * lam)
        s += term
        if abs(term) < 1e-12:
            break
    return min(1.0, max(0.0, s))


def wasserstein_normed(reference: DataFrame, current: DataFrame, col: str) -> float:
    """W1(ref, cur) / max(std_pop(ref), 0.001)."""
    vc = value_counts(reference, current, col, True)
    tot = vc.agg(F.sum("r").alias("nr"), F.sum("c").alias("nc"), F.count(F.lit(1)).alias("k")).first()
    nr, nc = int(tot["nr"] or 0), int(tot["nc"] or 0)
    if nr == 0 or nc == 0:
        return float("nan")
    cum = cumulative(vc, "v", ["r", "c"], n_rows=int(tot["k"]))
    gap = F.abs(F.col("cum_r").cast("double") / F.lit(float(nr)) - F.col("cum_c").cast("double") / F.lit(float(nc)))
    w = cum.agg(F.sum(F.coalesce(gap * (F.col("next_v") - F.col("v")), F.lit(0.0))).alias("w")).first()["w"]
    std = reference.agg(F.stddev_pop(F.col(col).cast("double")).alias("s")).first()["s"] or 0.0
    return float(w) / max(float(std), 0.001)


# ----------------------------------------------------------------------------- categorical statistics
def _category_counts(reference: DataFrame, current: DataFrame, col: str, numeric_bins: int | None) -> DataFrame:
    """(v, r, c) per category, or per bin for numeric columns.  Bins are cut at the reference's own quantiles and open at both
    ends, so an outlier of either sample cannot move them; equal cut points leave bins that no value falls into."""
    from .quantiles import exact_quantiles

    if numeric_bins is None:
        return value_counts(reference, current, col, False)
    pair = _pair(reference, current, col, True)
    shares = [k / numeric_bins for k in range(1, numeric_bins)]
    q = exact_quantiles(pair.filter("is_ref"), {"v": shares})
    cuts = [q[("v", s)] for s in shares if q[("v", s)] is not None]
    b = sum(((F.col("v") > F.lit(c)).cast("int") for c in cuts), F.lit(0))
    return pair.withColumn("v", b.cast("string")).groupBy("v").agg(
        F.count_if("is_ref").cast("long").alias("r"), F.count_if(~F.col("is_ref")).cast("long").alias("c")
    )


def _fractions(counts: DataFrame):
    tot = counts.agg(F.sum("r").alias("nr"), F.sum("c").alias("nc"), F.count(F.lit(1)).alias("k")).first()
    nr, nc = float(tot["nr"] or 0), float(tot["nc"] or 0)
    p = F.col("r").cast("double") / F.lit(nr) if nr else F.lit(0.0)
    q = F.col("c").cast("double") / F.lit(nc) if nc else F.lit(0.0)
    return p, q, nr, nc, int(tot["k"] or 0)


def js_distance(reference: DataFrame, current: DataFrame, col: str, numeric_bins: int | None = None) -> float:
    """Jensen-Shannon distance (natural log): sqrt((KL(p||m) + KL(q||m)) / 2)."""
    counts = _category_counts(reference, current, col, numeric_bins)
    p, q, nr, nc, _ = _fractions(counts)
    m = (p + q) / F.lit(2.0)
    kl = F.when(p > 0, p * F.log(p / m)).otherwise(F.lit(0.0)) + F.when(q > 0, q * F.log(q / m)).otherwise(F.lit(0.0))
    s = counts.agg(F.sum(kl).alias("s")).first()["s"] or 0.0
    return math.sqrt(max(float(s), 0.0) / 2.0)


def chi2_statistic(reference: DataFrame, current: DataFrame, col: str) -> tuple[float, int]:
    """(statistic, dof): sum (obs - exp)^2 / exp with exp = ref count * n_cur / n_ref."""
    counts = _category_counts(reference, current, col, None)
    tot = counts.agg(F.sum("r").alias("nr"), F.sum("c").alias("nc"), F.count(F.lit(1)).alias("k")).first()
    nr, nc, k = float(tot["nr"] or 0), float(tot["nc"] or 0), int(tot["k"] or 0)
    if nr == 0:
        return float("nan"), max(k - 1, 0)
    exp = F.col("r").cast("double") * F.lit(nc / nr)
    term = F.when(exp > 0, (F.col("c") - exp) * (F.col("c") - exp) / exp).otherwise(F.lit(float("inf")))
    s = counts.agg(F.sum(term).alias("s")).first()["s"]
    return float(s), max(k - 1, 0)


def chi2_sf(x: float, dof: int) -> float:
    """Upper tail of the chi-square distribution (regularised incomplete gamma Q(dof/2, x/2))."""
    if dof <= 0 or math.isnan(x):
        return float("nan")
    if math.isinf(x):
        return 0.0
    a, z = dof / 2.0, x / 2.0
    if z <= 0:
        return 1.0
    if z < a + 1:  # series for P
        term = total = 1.0 / a
        ap = a
        while True:  # the terms shrink once ap > z, so this converges
            ap += 1
            term *= z / ap
            total += term
            if abs(term) < abs(total) * 1e-15:
                break
        return max(0.0, 1.0 - total * math.exp(-z + a * math.log(z) - math.lgamma(a)))
    b, c, d = z + 1 - a, 1e300, 1.0 / (z + 1 - a)  # continued fraction for Q
    h = d
    for i in itertools.count(1):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1e-300 if abs(d) < 1e-300 else d
        c = b + an / c
        c = 1e-300 if abs(c) < 1e-300 else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1) < 1e-15:
            break
    return min(1.0, math.exp(-z + a * math.log(z) - math.lgamma(a)) * h)


def z_test_pvalue(reference: DataFrame, current: DataFrame, col: str) -> float:
    """Two-proportion z-test for a two-valued column (1.0 when only one value exists)."""
    counts = _category_counts(reference, current, col, None).orderBy("v").collect()  # <= 2 rows
    if len(counts) < 2:
        return 1.0
    first = counts[0]
    nr = sum(r["r"] for r in counts)
    nc = sum(r["c"] for r in counts)
    p1, p2 = first["r"] / nr, first["c"] / nc
    pp = (p1 * nr + p2 * nc) / (nr + nc)
    den = math.sqrt(pp * (1 - pp) * (1.0 / nr + 1.0 / nc))
    if den == 0:
        return 1.0
    z = (p1 - p2) / den
    return math.erfc(abs(z) / math.sqrt(2))


def psi(reference: DataFrame, current: DataFrame, col: str, numeric: bool, bins: int = PSI_BINS) -> float:
    counts = _category_counts(reference, current, col, bins if numeric else None)
    p, q, _, _, _ = _fractions(counts)
    pe = F.when(p == 0, F.lit(PSI_EPS)).otherwise(p)
    qe = F.when(q == 0, F.lit(PSI_EPS)).otherwise(q)
    s = counts.agg(F.sum((pe - qe) * F.log(pe / qe)).alias("s")).first()["s"]
    return float(s or 0.0)


# ----------------------------------------------------------------------------- report
@dataclass(frozen=True)
class DriftRule:
    """Which test a column gets.

    ``numeric``: ``by_rows`` (KS up to ``small_rows`` reference rows, else Wasserstein), ``ks`` or ``wasserstein``.
    ``categorical``: ``by_rows`` (chi-square up to ``small_rows``, else Jensen-Shannon), ``chisquare`` (two values: z) or ``jensenshannon``.
    Numbers of at most ``few_values`` distinct values are categories.
    """
    numeric: str = "by_rows"
    categorical: str = "by_rows"
    small_rows: int = 1000
    few_values: int = 5

    def __post_init__(self):
        if self.numeric not in ("by_rows", "ks", "wasserstein") or self.categorical not in ("by_rows", "chisquare", "jensenshannon"):
            raise ValueError(f"unknown drift test in {self}")

    def is_number(self, n_unique: int) -> bool:
        return n_unique > self.few_values

    def numeric_test(self, n_ref: int) -> str:
        return self.numeric if self.numeric != "by_rows" else "ks" if n_ref <= self.small_rows else "wasserstein"

    def categorical_test(self, n_ref: int, n_unique: int) -> str:
        test = self.categorical if self.categorical != "by_rows" else "chisquare" if n_ref <= self.small_rows else "jensenshannon"
        return "z" if test == "chisquare" and n_unique <= 2 else test


DEFAULT_RULE = DriftRule()


@dataclass
class ColumnDrift:
    column_name: str
    column_type: str
    stattest: str
    statistic: float
    p_value: float | None
    threshold: float
    drift_detected: bool


def column_drift(reference: DataFrame, current: DataFrame, col: str, method: str = "auto",
                 psi_threshold: float = DRIFT_THRESHOLD, rule: DriftRule = DEFAULT_RULE) -> ColumnDrift:
    numeric = is_numeric(dict(reference.dtypes)[col])
    prof = _pair(reference, current, col, numeric).agg(
        F.count_if("is_ref").alias("nr"), F.count_distinct("v").alias("nu")).first()
    n_ref, n_unique = int(prof["nr"]), int(prof["nu"])
    ctype = "num" if numeric else "cat"
    if method == "psi":
        s = psi(reference, current, col, numeric and rule.is_number(n_unique))
        return ColumnDrift(col, ctype, "psi", s, None, psi_threshold, s >= psi_threshold)
    if numeric and rule.is_number(n_unique):
        if rule.numeric_test(n_ref) == "ks":
            d, n, m = ks_statistic(reference, current, col)
            p = ks_pvalue(d, n, m)
            return ColumnDrift(col, ctype, "ks", d, p, 0.05, p < 0.05)
        w = wasserstein_normed(reference, current, col)
        return ColumnDrift(col, ctype, "wasserstein", w, None, 0.1, w >= 0.1)
    test = rule.categorical_test(n_ref, n_unique)
    if test == "chisquare":
        s, dof = chi2_statistic(reference, current, col)
        p = chi2_sf(s, dof)
        return ColumnDrift(col, ctype, "chisquare", s, p, 0.05, p < 0.05)
    if test == "z":
        p = z_test_pvalue(reference, current, col)
        return ColumnDrift(col, ctype, "z", float("nan"), p, 0.05, p < 0.05)
    js = js_distance(reference, current, col, None)
    return ColumnDrift(col, ctype, "jensenshannon", js, None, 0.1, js >= 0.1)


DRIFT_SCHEMA = ("column_name string, column_type string, stattest string, statistic double, p_value double, "
                "threshold double, drift_detected boolean")


def _long_pairs(reference: DataFrame, current: DataFrame, cols: list[str], as_double: bool) -> DataFrame:
    """(col, v, is_ref) for many columns at once: one scan of each table."""
    def side(df, flag):
        x = (lambda c: F.col(c).cast("double")) if as_double else (lambda c: F.col(c).cast("string"))
        arr = F.array(*[F.struct(F.lit(c).alias("col"), x(c).alias("v")) for c in cols])
        return df.select(F.explode(arr).alias("e")).select("e.col", "e.v", F.lit(flag).alias("is_ref"))
    out = side(reference, True).unionByName(side(current, False)).filter(F.col("v").isNotNull())
    return out.filter(~F.isnan("v")) if as_double else out


def _per_col_counts(long: DataFrame) -> DataFrame:
    return long.groupBy("col", "v").agg(F.count_if("is_ref").cast("long").alias("r"),
                                        F.count_if(~F.col("is_ref")).cast("long").alias("c"))


def _lit_map(d: dict) -> F.Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(float(v)))])


def numeric_drift_stats(reference: DataFrame, current: DataFrame, cols: list[str]) -> dict[str, dict]:
    """KS statistic, raw Wasserstein, counts and distinct values for all numeric columns in one pass.

    The per-(column, value) count table is cumulated per column with grouped prefix sums.
    """
    if not cols:
        return {}
    stds = reference.agg(*[F.stddev_pop(F.col(c).cast("double")).alias(c) for c in cols]).first()
    return numeric_count_stats(_per_col_counts(_long_pairs(reference, current, cols, True)), cols, {c: float(stds[c] or 0.0) for c in cols})


def numeric_count_stats(vc: DataFrame, cols: list[str], stds: dict[str, float]) -> dict[str, dict]:
    """The same from the counts ``col, v, r, c`` of each value and the reference's standard deviations."""
    tot = {r["col"]: r for r in vc.groupBy("col").agg(
        F.sum("r").alias("nr"), F.sum("c").alias("nc"), F.count(F.lit(1)).alias("nu")).collect()}  # one row per column
    out = {c: {"nr": 0, "nc": 0, "nu": 0, "d": float("nan"), "w": float("nan")} for c in cols}
    ok = {c: t for c, t in tot.items() if t["nr"] and t["nc"]}
    for c, t in tot.items():
        out[c].update(nr=int(t["nr"]), nc=int(t["nc"]), nu=int(t["nu"]))
    if ok:
        nr, nc = _lit_map({c: t["nr"] for c, t in ok.items()}), _lit_map({c: t["nc"] for c, t in ok.items()})
        cum = cumulative(vc.filter(F.col("col").isin(list(ok))), "v", ["r", "c"], groups=["col"],
                         n_rows=sum(int(t["nu"]) for t in ok.values()))
        gap = F.abs(F.col("cum_r").cast("double") / nr[F.col("col")] - F.col("cum_c").cast("double") / nc[F.col("col")])
        res = cum.groupBy("col").agg(F.max(gap).alias("d"),
                                     F.sum(F.coalesce(gap * (F.col("next_v") - F.col("v")), F.lit(0.0))).alias("w"))
        for r in res.collect():
            out[r["col"]].update(d=float(r["d"]), w=float(r["w"]))
    for c in cols:
        out[c]["std"] = stds.get(c, 0.0)
    return out


def categorical_drift_stats(reference: DataFrame, current: DataFrame, cols: list[str]) -> dict[str, dict]:
    """JS distance, chi-square statistic, z-test inputs and PSI for all categorical columns in one pass."""
    if not cols:
        return {}
    return categorical_count_stats(_per_col_counts(_long_pairs(reference, current, cols, False)), cols)


def categorical_count_stats(cc: DataFrame, cols: list[str]) -> dict[str, dict]:
    """The same from the counts ``col, v, r, c`` of each category."""
    tot = {r["col"]: r for r in cc.groupBy("col").agg(
        F.sum("r").alias("nr"), F.sum("c").alias("nc"), F.count(F.lit(1)).alias("k")).collect()}
    out = {c: {"nr": 0, "nc": 0, "nu": 0} for c in cols}
    for c, t in tot.items():
        out[c].update(nr=int(t["nr"]), nc=int(t["nc"]), nu=int(t["k"]))
    ok = {c: t for c, t in tot.items() if t["nr"] and t["nc"]}
    if not ok:
        return out
    nrm, ncm = _lit_map({c: t["nr"] for c, t in ok.items()}), _lit_map({c: t["nc"] for c, t in ok.items()})
    nr, nc = nrm[F.col("col")], ncm[F.col("col")]
    p = F.col("r").cast("double") / nr
    q = F.col("c").cast("double") / nc
    m = (p + q) / F.lit(2.0)
    kl = F.when(p > 0, p * F.log(p / m)).otherwise(F.lit(0.0)) + F.when(q > 0, q * F.log(q / m)).otherwise(F.lit(0.0))
    exp = F.col("r").cast("double") * (nc / nr)
    chi = F.when(exp > 0, (F.col("c") - exp) * (F.col("c") - exp) / exp).otherwise(F.lit(float("inf")))
    pe = F.when(p == 0, F.lit(PSI_EPS)).otherwise(p)
    qe = F.when(q == 0, F.lit(PSI_EPS)).otherwise(q)
    first = F.min("v")  # z-test: share of the first (smallest) value in each sample
    res = cc.filter(F.col("col").isin(list(ok))).groupBy("col").agg(
        F.sum(kl).alias("kl"), F.sum(chi).alias("chi"), F.sum((pe - qe) * F.log(pe / qe)).alias("psi"),
        F.min_by("r", "v").alias("r_first"), F.min_by("c", "v").alias("c_first"), first.alias("v_first"))
    for r in res.collect():
        out[r["col"]].update(js=math.sqrt(max(float(r["kl"] or 0.0), 0.0) / 2.0), chi=float(r["chi"]),
                             psi=float(r["psi"]), r_first=int(r["r_first"]), c_first=int(r["c_first"]))
    return out


def _z_from(st: dict) -> float:
    if st["nu"] < 2:
        return 1.0
    nr, nc = st["nr"], st["nc"]
    p1, p2 = st["r_first"] / nr, st["c_first"] / nc
    pp = (p1 * nr + p2 * nc) / (nr + nc)
    den = math.sqrt(pp * (1 - pp) * (1.0 / nr + 1.0 / nc))
    return 1.0 if den == 0 else math.erfc(abs((p1 - p2) / den) / math.sqrt(2))


def drift_report(reference: DataFrame, current: DataFrame, columns: list[str] | None = None,
                 method: str = "auto", digits: int = 6, psi_threshold: float = DRIFT_THRESHOLD,
                 rule: DriftRule = DEFAULT_RULE) -> DataFrame:
    """Per-column drift table (D1/D2/D4-D8) for the columns both tables share.

    All numeric columns are profiled in one pass (value counts + grouped running sums),
    all categorical-like columns (strings and numerics of few distinct values) in a
    second; only per-column scalars reach the driver.  ``method="psi"`` runs the PSI
    operator per column instead.
    """
    if columns is None:
        cur_cols = set(current.columns)
        columns = [c for c in reference.columns if c in cur_cols]
    types = dict(reference.dtypes)
    if method == "psi":
        found = [column_drift(reference, current, c, "psi", psi_threshold, rule) for c in columns]
        rows = [(r.column_name, r.column_type, r.stattest, None if math.isnan(r.statistic) else round(r.statistic, digits), None, r.threshold, bool(r.drift_detected)) for r in found]
        return reference.sparkSession.createDataFrame(rows, DRIFT_SCHEMA)

    nums = [c for c in columns if is_numeric(types[c])]
    num_stats = numeric_drift_stats(reference, current, nums)
    cat_cols = [c for c in columns if c not in nums] + [c for c in nums if not rule.is_number(num_stats[c]["nu"])]
    rows = report_rows(columns, num_stats, categorical_drift_stats(reference, current, cat_cols), digits, rule)
    return reference.sparkSession.createDataFrame(rows, DRIFT_SCHEMA)


def report_rows(columns: list[str], num_stats: dict[str, dict], cat_stats: dict[str, dict], digits: int = 6, rule: DriftRule = DEFAULT_RULE) -> list[tuple]:
    """One row of ``DRIFT_SCHEMA`` a column, with the tests of ``rule``."""
    rows = []

    def emit(col, ctype, test, stat, p, thr, drift):
        s = None if stat is None or math.isnan(stat) else round(stat, digits)
        pv = None if p is None or math.isnan(p) else round(p, digits)
        rows.append((col, ctype, test, s, pv, thr, bool(drift)))

    for c in columns:
        ctype = "num" if c in num_stats else "cat"
        if c in num_stats and rule.is_number(num_stats[c]["nu"]):
            st = num_stats[c]
            if rule.numeric_test(st["nr"]) == "ks":
                p = ks_pvalue(st["d"], st["nr"], st["nc"])
                emit(c, ctype, "ks", st["d"], p, 0.05, p < 0.05)
            else:
                w = st["w"] / max(st["std"], 0.001)
                emit(c, ctype, "wasserstein", w, None, 0.1, w >= 0.1)
            continue
        st = cat_stats[c]
        if "js" not in st:  # one side empty
            emit(c, ctype, "none", float("nan"), None, 0.0, False)
            continue
        test = rule.categorical_test(st["nr"], st["nu"])
        if test == "chisquare":
            p = chi2_sf(st["chi"], max(st["nu"] - 1, 0))
            emit(c, ctype, test, st["chi"], p, 0.05, p < 0.05)
        elif test == "z":
            p = _z_from(st)
            emit(c, ctype, test, float("nan"), p, 0.05, p < 0.05)
        else:
            emit(c, ctype, "jensenshannon", st["js"], None, 0.1, st["js"] >= 0.1)
    return rows


def drift_summary(report: DataFrame, dataset_share: float = 0.5, alert_threshold: float = DRIFT_THRESHOLD) -> DataFrame:
    """n_features, n_drifted_features, drift_share, drift_detected (share >= 0.5), alert (share > 0.15)."""
    agg = report.agg(
        F.count(F.lit(1)).cast("long").alias("n_features"),
        F.count_if("drift_detected").cast("long").alias("n_drifted_features"),
    )
    share = F.coalesce(F.try_divide(F.col("n_drifted_features").cast("double"), F.col("n_features").cast("double")), F.lit(0.0))
    return agg.select(
        "n_features", "n_drifted_features",
        F.round(share, 6).alias("drift_share"),
        (share >= F.lit(dataset_share)).alias("drift_detected"),
        (share > F.lit(alert_threshold)).alias("alert"),
    )


# ----------------------------------------------------------------------------- quality profile
def correlations(df: DataFrame, columns: list[str] | None = None, digits: int = 6) -> DataFrame:
    """Pearson correlation of every pair of numeric columns, all pairs in ONE aggregation pass.

    The result has one row per column pair (bounded by the column count, not the data).
    """
    types = dict(df.dtypes)
    cols = [c for c in (columns or df.columns) if is_numeric(types[c])]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, pearson double")
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}")
                   for i, (a, b) in enumerate(pairs)]).first()
    out = [(a, b, None if row[f"r{i}"] is None or math.isnan(row[f"r{i}"]) else round(float(row[f"r{i}"]), digits))
           for i, (a, b) in enumerate(pairs)]
    return df.sparkSession.createDataFrame(out, "column_a string, column_b string, pearson double")



def quality_profile(df: DataFrame, columns: list[str] | None = None, digits: int = 6) -> DataFrame:
    """Per column: count, missing, n_unique, most_common, mean, std, min, max, p25, p50, p75 (exact quantiles)."""
    from .quantiles import exact_quantiles
    from .stats import column_modes

    columns = columns or df.columns
    types = dict(df.dtypes)
    nums = [c for c in columns if is_numeric(types[c])]
    aggs = []
    for c in columns:
        aggs += [F.count(F.col(c)).alias(f"n_{c}"), F.count_if(F.col(c).isNull()).alias(f"m_{c}"),
                 F.count_distinct(F.col(c)).alias(f"u_{c}")]
    for c in nums:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"a_{c}"), F.stddev_samp(x).alias(f"s_{c}"), F.min(x).alias(f"lo_{c}"),
                 F.max(x).alias(f"hi_{c}")]
    row = df.agg(*aggs).first()
    q = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in nums}) if nums else {}
    modes = column_modes(df, columns)
    out = []
    rnd = lambda v: None if v is None else round(float(v), digits)
    for c in columns:
        isn = c in nums
        out.append((
            c, "num" if isn else "cat", int(row[f"n_{c}"]), int(row[f"m_{c}"]), int(row[f"u_{c}"]), modes.get(c),
            rnd(row[f"a_{c}"]) if isn else None, rnd(row[f"s_{c}"]) if isn else None,
            rnd(row[f"lo_{c}"]) if isn else None, rnd(row[f"hi_{c}"]) if isn else None,
            rnd(q.get((c, 0.25))) if isn else None, rnd(q.get((c, 0.5))) if isn else None,
            rnd(q.get((c, 0.75))) if isn else None,
        ))
    return df.sparkSession.createDataFrame(
        out,
        "column_name string, column_type string, count long, missing long, n_unique long, most_common string, "
        "mean double, std double, min double, max double, p25 double, p50 double, p75 double",
    )
