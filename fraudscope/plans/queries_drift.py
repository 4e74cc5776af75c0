"""Drift, data-quality and "most recent N" queries on the events table.

Reference sample: events before 2024-01-15; current sample: events from that day on.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift as D
from ..sources.tables import read_table
from .catalog import register

SPLIT_TS = "2024-01-15 00:00:00"


def split_events(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    cut = F.lit(SPLIT_TS).cast("timestamp_ntz")
    return ev.filter(F.col("ts") < cut), ev.filter(F.col("ts") >= cut)


# a drift source: (reference relation, current relation) as SQL; the default is the events split
EVENTS = (f"(SELECT * FROM events WHERE ts < TIMESTAMP '{SPLIT_TS}')",
          f"(SELECT * FROM events WHERE ts >= TIMESTAMP '{SPLIT_TS}')")


def _pairs(col: str, expr: str, src, extra_where: str = "") -> str:
    ref, cur = src
    cond = f"{col} IS NOT NULL" + extra_where
    return (f"SELECT {expr} AS v, true AS is_ref FROM {ref} AS ref_rel WHERE {cond} "
            f"UNION ALL SELECT {expr} AS v, false AS is_ref FROM {cur} AS cur_rel WHERE {cond}")


def _num_cte(col: str, src=EVENTS) -> str:
    x = f"CAST({col} AS DOUBLE)"
    return f"""ev AS ({_pairs(col, x, src, f" AND NOT isnan({x})")}),
vc AS (SELECT v, count(*) FILTER (WHERE is_ref) AS r, count(*) FILTER (WHERE NOT is_ref) AS c FROM ev GROUP BY v),
t AS (SELECT CAST(sum(r) AS DOUBLE) AS nr, CAST(sum(c) AS DOUBLE) AS nc FROM vc),
cum AS (SELECT v, sum(r) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cr,
               sum(c) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cc,
               lead(v) OVER (ORDER BY v) AS nv FROM vc)"""


def _ref_std(col: str, src=EVENTS) -> str:
    return (f"greatest((SELECT stddev_pop(CAST({col} AS DOUBLE)) FROM {src[0]} AS ref_rel "
            f"WHERE {col} IS NOT NULL), 0.001)")


def _ks_sql(col: str) -> str:
    return (f"WITH {_num_cte(col)}\nSELECT '{col}' AS column_name, "
            "round(max(abs(CAST(cr AS DOUBLE) / nr - CAST(cc AS DOUBLE) / nc)), 6) AS statistic, "
            "CAST(max(nr) AS BIGINT) AS n_ref, CAST(max(nc) AS BIGINT) AS n_cur FROM cum, t")


def _wasserstein_sub(col: str, src=EVENTS) -> str:
    return (f"(WITH {_num_cte(col, src)}\nSELECT sum(coalesce(abs(CAST(cr AS DOUBLE) / nr - CAST(cc AS DOUBLE) / nc) "
            f"* (nv - v), 0)) / {_ref_std(col, src)} FROM cum, t)")


def _cat_counts(col: str, bins: int | None, src=EVENTS) -> str:
    if bins is None:
        pairs = _pairs(col, f"CAST({col} AS VARCHAR)", src)
    else:
        from ..operators.quantiles import quantile_sql

        x = f"CAST({col} AS DOUBLE)"
        cuts = ", ".join(f"{quantile_sql(src[0], col, k / bins, f'NOT isnan({x})')} AS q{k}" for k in range(1, bins))
        binned = "CAST(" + " + ".join(f"CAST({x} > q{k} AS INTEGER)" for k in range(1, bins)) + " AS VARCHAR)"
        kept = f"{col} IS NOT NULL AND NOT isnan({x})"
        pairs = (f"SELECT {binned} AS v, true AS is_ref FROM {src[0]} AS ref_rel, (SELECT {cuts}) qq WHERE {kept} "
                 f"UNION ALL SELECT {binned} AS v, false AS is_ref FROM {src[1]} AS cur_rel, (SELECT {cuts}) qq WHERE {kept}")
    return (f"cc0 AS ({pairs}),\n"
            "cc AS (SELECT v, count(*) FILTER (WHERE is_ref) AS r, count(*) FILTER (WHERE NOT is_ref) AS c "
            "FROM cc0 GROUP BY v),\n"
            "ct AS (SELECT CAST(sum(r) AS DOUBLE) AS nr, CAST(sum(c) AS DOUBLE) AS nc FROM cc),\n"
            "fr AS (SELECT v, r, c, CAST(r AS DOUBLE) / nr AS p, CAST(c AS DOUBLE) / nc AS q FROM cc, ct)")


def _js_sub(col: str, bins: int | None = None) -> str:
    return (f"(WITH {_cat_counts(col, bins)}\nSELECT sqrt(greatest(sum("
            "CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + "
            "CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END), 0) / 2) FROM fr)")


def _psi_sub(col: str, bins: int | None) -> str:
    return (f"(WITH {_cat_counts(col, bins)},\n"
            f"fe AS (SELECT CASE WHEN p = 0 THEN {D.PSI_EPS!r} ELSE p END AS pe, "
            f"CASE WHEN q = 0 THEN {D.PSI_EPS!r} ELSE q END AS qe FROM fr)\n"
            "SELECT sum((pe - qe) * ln(pe / qe)) FROM fe)")


@register("drift_ks", _ks_sql("value"))
def q_drift_ks(spark, sf_dir):
    """Two-sample KS statistic of events.value, reference vs current."""
    ref, cur = split_events(spark, sf_dir)
    d, n, m = D.ks_statistic(ref, cur, "value")
    return spark.createDataFrame([("value", round(d, 6), n, m)],
                                 "column_name string, statistic double, n_ref long, n_cur long")


@register("drift_wasserstein", "SELECT 'value' AS column_name, round(" + _wasserstein_sub("value") + ", 6) AS statistic")
def q_drift_wasserstein(spark, sf_dir):
    """Wasserstein distance / population std of the reference."""
    ref, cur = split_events(spark, sf_dir)
    return spark.createDataFrame([("value", round(D.wasserstein_normed(ref, cur, "value"), 6))],
                                 "column_name string, statistic double")


@register("drift_js", "SELECT 'event_type' AS column_name, round(" + _js_sub("event_type") + ", 6) AS statistic")
def q_drift_js(spark, sf_dir):
    """Jensen-Shannon distance of event_type frequencies."""
    ref, cur = split_events(spark, sf_dir)
    return spark.createDataFrame([("event_type", round(D.js_distance(ref, cur, "event_type"), 6))],
                                 "column_name string, statistic double")


@register("drift_chi2", "WITH " + _cat_counts("event_type", None) + """
SELECT 'event_type' AS column_name,
  round(sum(CASE WHEN r > 0 THEN (c - CAST(r AS DOUBLE) * (nc / nr)) * (c - CAST(r AS DOUBLE) * (nc / nr))
                                 / (CAST(r AS DOUBLE) * (nc / nr)) ELSE CAST('inf' AS DOUBLE) END), 6) AS statistic,
  CAST(count(*) - 1 AS BIGINT) AS dof
FROM cc, ct""")
def q_drift_chi2(spark, sf_dir):
    """Chi-square statistic of current counts against reference proportions."""
    ref, cur = split_events(spark, sf_dir)
    s, dof = D.chi2_statistic(ref, cur, "event_type")
    return spark.createDataFrame([("event_type", round(s, 6), dof)], "column_name string, statistic double, dof long")


@register("drift_psi", "SELECT 'value' AS column_name, round(" + _psi_sub("value", D.PSI_BINS)
          + ", 6) AS psi\nUNION ALL SELECT 'event_type', round(" + _psi_sub("event_type", None) + ", 6)")
def q_drift_psi(spark, sf_dir):
    """Population stability index (10 bins between reference quantiles / categories)."""
    ref, cur = split_events(spark, sf_dir)
    rows = [("value", round(D.psi(ref, cur, "value", True), 6)),
            ("event_type", round(D.psi(ref, cur, "event_type", False), 6))]
    return spark.createDataFrame(rows, "column_name string, psi double")


def _num_report_sql(col: str, src=EVENTS) -> str:
    """Default rule for a numeric column with > 5 distinct values: KS (p < .05) when the
    reference has <= 1000 rows, else Wasserstein / std(ref) >= .1.  KS p-value: asymptotic
    Kolmogorov series (100 terms)."""
    return f"""(WITH {_num_cte(col, src)},
s AS (SELECT max(nr) AS nr, max(nc) AS nc, max(abs(CAST(cr AS DOUBLE) / nr - CAST(cc AS DOUBLE) / nc)) AS d,
             sum(coalesce(abs(CAST(cr AS DOUBLE) / nr - CAST(cc AS DOUBLE) / nc) * (nv - v), 0)) AS w_raw FROM cum, t),
sd AS (SELECT {_ref_std(col, src)} AS sd),
l AS (SELECT *, (sqrt(nr * nc / (nr + nc)) + 0.12 + 0.11 / sqrt(nr * nc / (nr + nc))) * d AS lam FROM s),
p AS (SELECT *, CASE WHEN lam < 0.001 THEN 1.0 ELSE greatest(0.0, least(1.0, (
        SELECT sum(2 * (CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * j * j * lam * lam))
        FROM range(1, 101) rr(j)))) END AS pks FROM l)
SELECT '{col}' AS column_name, 'num' AS column_type,
       CASE WHEN nr <= 1000 THEN 'ks' ELSE 'wasserstein' END AS stattest,
       round(CASE WHEN nr <= 1000 THEN d ELSE w_raw / (SELECT sd FROM sd) END, 6) AS statistic,
       CASE WHEN nr <= 1000 THEN pks < 0.05 ELSE w_raw / (SELECT sd FROM sd) >= 0.1 END AS drift_detected
FROM p)"""


def _cat_report_sql(col: str, src=EVENTS) -> str:
    """Default rule for a categorical column with > 2 values: chi-square (p < .05) when the
    reference has <= 1000 rows, else Jensen-Shannon distance >= .1.  Chi-square p-value:
    1 - regularised lower incomplete gamma by its power series."""
    return f"""(WITH {_cat_counts(col, None, src)},
s AS (SELECT max(nr) AS nr, count(*) AS k,
        sqrt(greatest(sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END
                          + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END), 0) / 2) AS js,
        sum(CASE WHEN r > 0 THEN (c - CAST(r AS DOUBLE) * (nc / nr)) * (c - CAST(r AS DOUBLE) * (nc / nr))
                                 / (CAST(r AS DOUBLE) * (nc / nr)) ELSE CAST('inf' AS DOUBLE) END) AS chi
      FROM fr, ct),
p AS (SELECT *, CASE WHEN isinf(chi) OR chi / 2 > 2500 THEN 0.0 WHEN chi <= 0 THEN 1.0 ELSE greatest(0.0, 1 - (
        SELECT sum(exp(-(chi / 2) + ((k - 1) / 2.0 + n) * ln(chi / 2) - lgamma((k - 1) / 2.0 + n + 1)))
        FROM range(0, 3000) rr(n))) END AS pchi FROM s)
SELECT '{col}' AS column_name, 'cat' AS column_type,
       CASE WHEN nr <= 1000 THEN 'chisquare' ELSE 'jensenshannon' END AS stattest,
       round(CASE WHEN nr <= 1000 THEN chi ELSE js END, 6) AS statistic,
       CASE WHEN nr <= 1000 THEN pchi < 0.05 ELSE js >= 0.1 END AS drift_detected
FROM p)"""


# events columns: user_id and value have > 5 distinct values, event_type has 5 categories
_REPORT_SQL = ("SELECT * FROM " + _num_report_sql("user_id") + "\nUNION ALL SELECT * FROM "
               + _cat_report_sql("event_type") + "\nUNION ALL SELECT * FROM " + _num_report_sql("value"))


@register("drift_report", "SELECT column_name, column_type, stattest, statistic, drift_detected FROM ("
          + _REPORT_SQL + ") r")
def q_drift_report(spark, sf_dir):
    """Per-column drift with the default test selection."""
    ref, cur = split_events(spark, sf_dir)
    rep = D.drift_report(ref, cur, ["user_id", "event_type", "value"])
    return rep.select("column_name", "column_type", "stattest", "statistic", "drift_detected")


@register("drift_summary", """
SELECT CAST(count(*) AS BIGINT) AS n_features, CAST(count(*) FILTER (WHERE drift_detected) AS BIGINT) AS n_drifted_features,
       round(CAST(count(*) FILTER (WHERE drift_detected) AS DOUBLE) / count(*), 6) AS drift_share,
       CAST(count(*) FILTER (WHERE drift_detected) AS DOUBLE) / count(*) >= 0.5 AS drift_detected,
       CAST(count(*) FILTER (WHERE drift_detected) AS DOUBLE) / count(*) > 0.15 AS alert
FROM (""" + _REPORT_SQL + ") r")
def q_drift_summary(spark, sf_dir):
    """Dataset drift summary and alert flag."""
    ref, cur = split_events(spark, sf_dir)
    return D.drift_summary(D.drift_report(ref, cur, ["user_id", "event_type", "value"]))


def _profile_sql(col: str, numeric: bool) -> str:
    x = f"CAST({col} AS DOUBLE)"
    mode = (f"(SELECT CAST({col} AS VARCHAR) FROM events WHERE {col} IS NOT NULL GROUP BY {col} "
            f"ORDER BY count(*) DESC, CAST({col} AS VARCHAR) LIMIT 1)")
    from ..operators.quantiles import quantile_sql

    if numeric:
        stats = (f"round(avg({x}), 6), round(stddev_samp({x}), 6), round(min({x}), 6), round(max({x}), 6), "
                 f"round({quantile_sql('events', col, 0.25)}, 6), round({quantile_sql('events', col, 0.5)}, 6), "
                 f"round({quantile_sql('events', col, 0.75)}, 6)")
    else:
        stats = ", ".join(["CAST(NULL AS DOUBLE)"] * 7)
    return (f"SELECT '{col}' AS column_name, '{'num' if numeric else 'cat'}' AS column_type, "
            f"CAST(count({col}) AS BIGINT) AS count, CAST(count(*) FILTER (WHERE {col} IS NULL) AS BIGINT) AS missing, "
            f"CAST(count(DISTINCT {col}) AS BIGINT) AS n_unique, {mode} AS most_common, {stats} FROM events")


@register("quality_profile", "SELECT column_name, column_type, count, missing, n_unique, most_common, "
          "m AS mean, s AS std, lo AS min, hi AS max, p25, p50, p75 FROM (\n"
          + "\nUNION ALL\n".join(_profile_sql(c, n) for c, n in
                                 [("user_id", True), ("event_type", False), ("value", True)])
          + ") t(column_name, column_type, count, missing, n_unique, most_common, m, s, lo, hi, p25, p50, p75)")
def q_quality_profile(spark, sf_dir):
    """Column quality profile."""
    ev = read_table(spark, sf_dir, "events").select("user_id", "event_type", "value")
    return D.quality_profile(ev)


_CORR_COLS = ["event_id", "user_id", "value"]


@register("quality_correlations", "\nUNION ALL\n".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS pearson "
    "FROM events" for i, a in enumerate(_CORR_COLS) for b in _CORR_COLS[i + 1:]))
def q_quality_correlations(spark, sf_dir):
    """D11 (correlations): Pearson correlation of every pair of numeric event columns."""
    ev = read_table(spark, sf_dir, "events").select(*_CORR_COLS)
    return D.correlations(ev)


@register("recent_n", """
SELECT event_id, ts, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000""")
def q_recent_n(spark, sf_dir):
    """The 1000 most recent rows (top-N is the feature; TakeOrderedAndProject, no full sort)."""
    ev = read_table(spark, sf_dir, "events")
    return ev.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(1000).select(
        "event_id", "ts", "event_type", "value")
