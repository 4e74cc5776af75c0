"""Drift run (D1-D3, S10-S12, F8-F10): reference snapshot vs the newest log rows.

For each model: newest N log rows (top-N on the date-partitioned log), at least
50 of them or the model is skipped, columns shared with the training reference,
per-column drift, dataset summary and alert flag — one status row per model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import common_columns
from ..operators.drift import DEFAULT_RULE, DriftRule, drift_report, drift_summary
from ..operators.profiles import drift_from_profiles, value_profile
from ..schemas import DRIFT_MIN_ROWS, DRIFT_THRESHOLD

STATUS_SCHEMA = ("model string, status string, n_current long, n_features long, n_drifted_features long, "
                 "drift_share double, drift_detected boolean, alert boolean")


def drift_for_model(model: str, reference: DataFrame | None, current: DataFrame | None, min_rows: int = DRIFT_MIN_ROWS,
                    threshold: float = DRIFT_THRESHOLD, method: str = "auto", rule: DriftRule = DEFAULT_RULE):
    """Returns (status row tuple, per-column report or None)."""
    if reference is None:
        return (model, "no_reference", None, None, None, None, None, None), None
    if current is None:
        return (model, "no_current", None, None, None, None, None, None), None
    n = current.limit(min_rows).count()  # F8: only needs to know whether 50 rows exist
    if n < min_rows:
        return (model, "not_enough_rows", n, None, None, None, None, None), None
    cols = common_columns(reference, current)
    report = drift_report(reference.select(*cols), current.select(*cols), cols, method=method, rule=rule)
    s = drift_summary(report, alert_threshold=threshold).first()
    n_cur = current.count()
    return (model, "ok", n_cur, s["n_features"], s["n_drifted_features"], s["drift_share"], s["drift_detected"],
            s["alert"]), report


def run_drift_detection(spark: SparkSession, pairs: dict[str, tuple[DataFrame | None, DataFrame | None]],
                        method: str = "auto", rule: DriftRule = DEFAULT_RULE) -> DataFrame:
    """D3: one status row per model name in ``pairs`` ({model: (reference, current)})."""
    rows = [drift_for_model(m, r, c, method=method, rule=rule)[0] for m, (r, c) in pairs.items()]
    return spark.createDataFrame(rows, STATUS_SCHEMA)


def run_profile_drift(spark: SparkSession, pairs: dict[str, tuple[DataFrame | None, DataFrame | None]],
                      min_rows: int = DRIFT_MIN_ROWS, threshold: float = DRIFT_THRESHOLD, rule: DriftRule = DEFAULT_RULE) -> DataFrame:
    """The same status rows from ``{model: (stored reference profile, window of the log)}``: the window is read once, the training table never."""
    rows = []
    for model, (profile, window) in pairs.items():
        if profile is None or window is None:
            rows.append((model, "no_reference" if profile is None else "no_current", *[None] * 6))
            continue
        current = value_profile(window).checkpoint(eager=True)  # small; the log is not read again
        n = current.groupBy("col").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
        if n < min_rows:
            rows.append((model, "not_enough_rows", n, *[None] * 5))
            continue
        s = drift_summary(drift_from_profiles(profile, current, rule=rule), alert_threshold=threshold).first()
        rows.append((model, "ok", n, s["n_features"], s["n_drifted_features"], s["drift_share"], s["drift_detected"], s["alert"]))
    return spark.createDataFrame(rows, STATUS_SCHEMA)
