"""fraudscope: Spark-native fraud and credit-risk analytics.

Subpackages
-----------
sources    scans, validation, coercion, sinks, prediction-log tables, driver-table views
functions  column expressions (names, derived balances, code maps, tiers, scores)
operators  distributed operators (exact quantiles, cleaning, features, sampling,
           prefix sums, metrics, drift, models)
plans      composed jobs (cleaning, training, scoring, drift run) and the query catalog
streaming  Structured Streaming scoring and per-minute monitoring

The most used entry points are re-exported here.
"""

__version__ = "0.1.0"

from .operators.clean import clean_credit_data, clean_fraud_data, credit_cleaner, fraud_cleaner  # noqa: E402
from .operators.drift import drift_report, drift_summary, quality_profile  # noqa: E402
from .operators.metrics import binary_summary, classification_report, confusion_matrix  # noqa: E402
from .operators.quantiles import exact_quantiles  # noqa: E402
from .operators.sampling import smote, stratified_split  # noqa: E402
from .plans.drift_job import run_drift_detection  # noqa: E402
from .plans.training import prepare_credit_data, prepare_fraud_data, run_full_pipeline  # noqa: E402

__all__ = [
    "clean_fraud_data", "clean_credit_data", "fraud_cleaner", "credit_cleaner",
    "drift_report", "drift_summary", "quality_profile",
    "binary_summary", "classification_report", "confusion_matrix",
    "exact_quantiles", "smote", "stratified_split",
    "run_drift_detection", "prepare_fraud_data", "prepare_credit_data", "run_full_pipeline",
]
