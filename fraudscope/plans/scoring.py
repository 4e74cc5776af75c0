"""Batch scoring with saved models and the prediction audit log.

A scorer is loaded once per job (model + fitted feature state) and applied to
whole DataFrames; the same object serves the streaming job.  Derived balance
features are recomputed from the request columns exactly as in cleaning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expressions as X
from ..operators.features import FeaturePipeline, FeatureState
from ..operators.models import predict_proba
from ..operators.scoring import assign_request_ids, combine, finalize_credit, finalize_fraud
from ..operators.validation import split_valid, validate_credit, validate_fraud
from ..schemas import CREDIT_LOG_SCHEMA, FRAUD_LOG_SCHEMA, FRAUD_THRESHOLD
from .training import load_model


def _pipeline_from_state(state: dict) -> FeaturePipeline:
    fp = FeaturePipeline(state["numeric"], state["categorical"])
    fp.state = FeatureState(**state)
    fp.fitted = True
    return fp


@dataclass
class Scorer:
    model: object
    features: FeaturePipeline
    version: str

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Scorer":
        model, meta = load_model(spark, path)
        return Scorer(model, _pipeline_from_state(meta["features"]), meta["version"])


def fraud_features_from_request(df: DataFrame) -> DataFrame:
    """Request columns -> model input (derived balance features recomputed)."""
    return df.withColumns(X.derived_balance_columns())


def score_fraud(scorer: Scorer, requests: DataFrame, threshold: float = FRAUD_THRESHOLD,
                keep: list[str] | None = None) -> DataFrame:
    """Probability of class 1, flag on the unrounded value, rounded output, model version."""
    keep = keep or []
    x = scorer.features.transform(fraud_features_from_request(requests), keep=keep, as_vector=False)
    p = predict_proba(scorer.model, x, keep=keep, n_classes=2)
    return finalize_fraud(p, "p1", threshold, scorer.version).drop("p0", "p1")


def score_credit(scorer: Scorer, requests: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """R2: tier (argmax, default Poor) and the three confidences."""
    keep = keep or []
    x = scorer.features.transform(requests, keep=keep, as_vector=False)
    p = predict_proba(scorer.model, x, keep=keep, n_classes=3)
    return finalize_credit(p, "p0", "p1", "p2", scorer.version).drop("p0", "p1", "p2")


def score_combined(fraud: Scorer, credit: Scorer, fraud_requests: DataFrame, credit_requests: DataFrame,
                   key: str = "request_id") -> DataFrame:
    """Both scores for the same request id, nested as structs."""
    return combine(score_fraud(fraud, fraud_requests, keep=[key]), score_credit(credit, credit_requests, keep=[key]),
                   key)


def validated_fraud_scores(scorer: Scorer, requests: DataFrame, threshold: float = FRAUD_THRESHOLD):
    """R6 + R1: (scored valid rows, rejected rows with reasons)."""
    valid, rejected = split_valid(validate_fraud(requests))
    return score_fraud(scorer, valid, threshold, keep=list(valid.columns)), rejected


def validated_credit_scores(scorer: Scorer, requests: DataFrame):
    valid, rejected = split_valid(validate_credit(requests))
    return score_credit(scorer, valid, keep=list(valid.columns)), rejected


# ----------------------------------------------------------------------------- audit log
def fraud_log_rows(scored: DataFrame, id_col: str | None = None) -> DataFrame:
    """Scored fraud rows -> ``fraud_predictions`` log shape (+ ``log_date`` partition).

    ``id`` is the source key when ``id_col`` is given (replays and readers see stable ids),
    else a hash of the request id."""
    if "request_id" not in scored.columns:
        scored = assign_request_ids(scored)
    ts = F.col("timestamp") if "timestamp" in scored.columns else F.current_timestamp()
    row_id = F.col(id_col).cast("long") if id_col else F.xxhash64("request_id")
    cols = [
        row_id.alias("id"), F.col("request_id"), ts.alias("timestamp"),
        F.col("step").cast("int").alias("step"), F.col("type").alias("transaction_type"),
        *[F.col(c).cast("double").alias(c) for c in
          ["amount", "oldbalance_org", "newbalance_orig", "oldbalance_dest", "newbalance_dest"]],
        "fraud_probability", "is_fraud", "threshold", "model_version",
    ]
    out = scored.select(*cols)
    return out.select(*[F.col(f.name).cast(f.dataType) for f in FRAUD_LOG_SCHEMA.fields],
                      F.to_date("timestamp").alias("log_date"))


def credit_log_rows(scored: DataFrame, id_col: str | None = None) -> DataFrame:
    """Scored applicants -> ``credit_predictions`` log shape; ``id`` as in ``fraud_log_rows``."""
    if "request_id" not in scored.columns:
        scored = assign_request_ids(scored)
    ts = F.col("timestamp") if "timestamp" in scored.columns else F.current_timestamp()
    out = scored.select(
        (F.col(id_col).cast("long") if id_col else F.xxhash64("request_id")).alias("id"), "request_id", ts.alias("timestamp"),
        F.col("age").cast("int").alias("age"), F.col("duration_months").cast("int").alias("duration_months"),
        F.col("credit_amount").cast("double").alias("credit_amount"), "employment", "purpose", "credit_tier",
        "confidence_good", "confidence_moderate", "confidence_poor", "model_version")
    return out.select(*[F.col(f.name).cast(f.dataType) for f in CREDIT_LOG_SCHEMA.fields],
                      F.to_date("timestamp").alias("log_date"))


def create_log_tables(spark: SparkSession, base: str) -> None:
    """Idempotent creation of both (empty) log tables at ``base``; an existing table is left as it is.

    An empty partitioned table has no file to infer a schema from, so ``read_log`` reads with the declared one."""
    for name, schema in (("fraud_predictions", FRAUD_LOG_SCHEMA), ("credit_predictions", CREDIT_LOG_SCHEMA)):
        empty = spark.createDataFrame([], schema).withColumn("log_date", F.to_date("timestamp"))
        empty.write.mode("ignore").partitionBy("log_date").parquet(f"{base}/{name}")


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A log table, empty or not, with the declared columns and its ``log_date`` partitions."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("log_date", T.DateType())])).parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Append, partitioned by date so recent-N reads prune old days."""
    rows.write.mode("append").partitionBy("log_date").parquet(path)


def replace_log(rows: DataFrame, path: str, job: str) -> None:
    """S13/S14 exactly once: the rows of a batch job replace what the same job wrote before, day by day; other jobs' rows stay.

    ``job`` names the run (for example its input's date), so that a run that is repeated after a failure leaves the log as if it had run once.
    A day that the repeated run has no rows for keeps the first run's: pass the same input.  Rows are dealt out by day first (a large day in
    several pieces, small days together), so that a day gets few files."""
    rows.withColumn("job", F.lit(job)).hint("rebalance", "log_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("log_date", "job").parquet(path)


def recent_predictions(spark: SparkSession, path: str, columns: list[str], n: int = 1000,
                       rename: dict | None = None, schema: T.StructType = FRAUD_LOG_SCHEMA) -> DataFrame:
    """S11/S12 + W1: newest ``n`` log rows (top-N, no full sort), selected columns.

    The log is partitioned by ``log_date`` (the date of ``timestamp``).  Per-day row counts
    (no column is read, but every file is opened; one row per day) give the oldest day still needed to hold ``n``
    rows; the read is then pruned to the days from there on.  Every row newer than any
    pruned row is kept, so the result is exact and the columns of old history are never scanned.
    """
    log = read_log(spark, path, schema)
    if "log_date" in log.columns:
        per_day = log.groupBy("log_date").count().orderBy(F.col("log_date").desc()).collect()
        acc, cutoff = 0, None
        for r in per_day:
            acc += int(r["count"])
            cutoff = r["log_date"]
            if acc >= n:
                break
        if cutoff is not None:
            log = log.filter(F.col("log_date") >= F.lit(cutoff))
    top = log.orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(n)
    out = top.select(*columns)
    return out.withColumnsRenamed(rename) if rename else out
