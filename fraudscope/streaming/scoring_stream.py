"""Structured Streaming scoring with an idempotent prediction-log sink.

readStream (requests) -> validation -> model scoring -> foreachBatch:
valid predictions and rejected rows are written under ``batch_id=<n>`` folders in
overwrite mode, so a micro-batch replayed after a failure replaces its own output
instead of duplicating it; readers see the log as one partitioned table.
Request ids are derived from a source key (not ``uuid()``), so a replay produces
the same ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.scoring import assign_request_ids
from ..operators.validation import split_valid, validate_credit, validate_fraud
from ..plans.scoring import Scorer, credit_log_rows, fraud_log_rows, score_credit, score_fraud
from ..schemas import FRAUD_THRESHOLD


def _batch_writer(validate, score, to_log, log_path: str, reject_path: str, key: list[str]):
    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # read twice: accepted and rejected rows
        try:
            valid, rejected = split_valid(validate(batch))
            valid = assign_request_ids(valid, key)
            to_log(score(valid)).write.mode("overwrite").parquet(f"{log_path}/batch_id={batch_id}")
            rejected.write.mode("overwrite").parquet(f"{reject_path}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return run


def fraud_scoring_batch(scorer: Scorer, log_path: str, reject_path: str, key: list[str],
                        threshold: float = FRAUD_THRESHOLD):
    """The foreachBatch function for transactions (exposed for tests)."""
    return _batch_writer(validate_fraud, lambda v: score_fraud(scorer, v, threshold, keep=list(v.columns)),
                         fraud_log_rows, log_path, reject_path, key)


def credit_scoring_batch(scorer: Scorer, log_path: str, reject_path: str, key: list[str]):
    """The foreachBatch function for loan applications."""
    return _batch_writer(validate_credit, lambda v: score_credit(scorer, v, keep=list(v.columns)),
                         credit_log_rows, log_path, reject_path, key)


def start_fraud_scoring_stream(spark: SparkSession, source: DataFrame, scorer: Scorer, log_path: str,
                               reject_path: str, checkpoint: str, key: list[str], available_now: bool = False,
                               threshold: float = FRAUD_THRESHOLD):
    return _start(source, fraud_scoring_batch(scorer, log_path, reject_path, key, threshold), checkpoint, available_now)


def start_credit_scoring_stream(spark: SparkSession, source: DataFrame, scorer: Scorer, log_path: str,
                                reject_path: str, checkpoint: str, key: list[str], available_now: bool = False):
    return _start(source, credit_scoring_batch(scorer, log_path, reject_path, key), checkpoint, available_now)


def _start(source: DataFrame, fn, checkpoint: str, available_now: bool):
    w = source.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
