"""Streams and logs of both models: paired scores, logs written exactly once, the credit log."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.scoring import finalize_credit, finalize_fraud
from ..schemas import CREDIT_LOG_SCHEMA, FRAUD_LOG_SCHEMA
from ..session import scratch_path
from ..sources.tables import REQUESTS_SQL, credit_requests, fraud_requests
from ..streaming.combined_stream import once, pair_scores
from ..streaming.tables import read_table, start_table
from .catalog import register
from .scoring import create_log_tables, credit_log_rows, fraud_log_rows, read_log, recent_predictions, replace_log

_TIER_SQL = "CASE WHEN p0 >= p1 AND p0 >= p2 THEN 'Good' WHEN p1 >= p2 THEN 'Moderate' ELSE 'Poor' END"


def rule_fraud(requests):
    return finalize_fraud(requests, "p", 0.5, "rules-v1").drop("p")


def rule_credit(requests):
    return finalize_credit(requests, "p0", "p1", "p2", "rules-v1", with_map=False).drop("p0", "p1", "p2")


def _arriving(spark, df, path: str):
    """The requests as files of a stream, in order of time (as many as the session has partitions for), and a last request a day after the others that
    moves the watermark past them."""
    df.repartitionByRange("timestamp").write.mode("overwrite").parquet(path)
    df = spark.read.schema(df.schema).parquet(path)  # the last request is made from the files, not from the tables again
    last = df.select([F.lit("end").alias(c) if c == "request_id" else (F.max(c) + F.expr("INTERVAL 1 DAY")).alias(c) if c == "timestamp" else F.any_value(c).alias(c) for c in df.columns])
    last.write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


@register("stream_combined", f"""WITH {REQUESTS_SQL.strip()}
SELECT coalesce(f.request_id, c.request_id) AS request_id, f.second AS fraud_second, c.second AS credit_second,
  CASE WHEN c.request_id IS NULL THEN 'fraud_only' WHEN f.request_id IS NULL THEN 'credit_only' ELSE 'complete' END AS status,
  round(p, 4) AS fraud_probability, p >= 0.5 AS is_fraud, CASE WHEN c.request_id IS NOT NULL THEN {_TIER_SQL} END AS credit_tier, round(p0, 4) AS confidence_good
FROM fraud_once f FULL JOIN credit_once c ON f.request_id = c.request_id AND c.second BETWEEN f.second - 600 AND f.second + 600""")
def q_stream_combined(spark, sf_dir):
    """R3 streaming: both request streams scored, de-duplicated and paired within ten minutes; halves leave when the watermark has passed."""
    base = scratch_path(spark, f"pairs-{uuid.uuid4().hex}")
    fraud = once(rule_fraud(_arriving(spark, fraud_requests(spark, sf_dir), f"{base}/fraud")))
    credit = once(rule_credit(_arriving(spark, credit_requests(spark, sf_dir), f"{base}/credit")))
    pairs = pair_scores(fraud, credit, late=None)
    start_table(pairs, f"{base}/pairs", f"{base}/state", available_now=True).awaitTermination()
    return read_table(spark, f"{base}/pairs", pairs.schema).filter("request_id <> 'end'").select(
        "request_id", F.unix_seconds("fraud_time").alias("fraud_second"), F.unix_seconds("credit_time").alias("credit_second"), "status",
        "fraud.fraud_probability", "fraud.is_fraud", "credit.credit_tier", "credit.confidence_good")


def _once_sql() -> str:
    ways = []
    for way in ("batch", "stream"):
        ways.append(f"SELECT 'fraud' AS model, '{way}' AS written_by, src_id AS id, request_id, second, amount, round(p, 4) AS score, CAST(p >= 0.5 AS VARCHAR) AS outcome FROM fraud_once")
        ways.append(f"SELECT 'credit', '{way}', src_id, request_id, second, credit_amount, round(p0, 4), {_TIER_SQL} FROM credit_once")
    return f"WITH {REQUESTS_SQL.strip()}\n" + "\nUNION ALL ".join(ways)


@register("log_exactly_once", _once_sql())
def q_log_exactly_once(spark, sf_dir):
    """Both logs, written by batch jobs that run twice and by streams that are stopped and started again, over requests of
    which some are delivered twice; every request is logged once each way."""
    base = scratch_path(spark, f"once-{uuid.uuid4().hex}")
    create_log_tables(spark, f"{base}/batch")
    out = []
    for model, source, score, rows, schema, amount, value, outcome in (
            ("fraud", fraud_requests, rule_fraud, fraud_log_rows, FRAUD_LOG_SCHEMA, "amount", "fraud_probability", "is_fraud"),
            ("credit", credit_requests, rule_credit, credit_log_rows, CREDIT_LOG_SCHEMA, "credit_amount", "confidence_good", "credit_tier")):
        requests = source(spark, sf_dir)
        log = f"{base}/batch/{model}_predictions"
        early = F.dayofmonth("timestamp") < 16
        for job, mine in (("early", early), ("late", ~early)):
            for _ in range(2):  # the job is repeated
                replace_log(rows(score(once(requests.filter(mine))), id_col="src_id"), log, job)
        stream = once(_arriving(spark, requests, f"{base}/in-{model}"))
        for _ in range(2):  # started again on the same state and files
            start_table(stream, f"{base}/stream-{model}", f"{base}/state-{model}", available_now=True,
                        rows=lambda b, rows=rows, score=score: rows(score(b), id_col="src_id")).awaitTermination()
        for way, found in (("batch", read_log(spark, log, schema)), ("stream", read_table(spark, f"{base}/stream-{model}", schema))):
            out.append(found.filter("request_id <> 'end'").select(
                F.lit(model).alias("model"), F.lit(way).alias("written_by"), "id", "request_id", F.unix_seconds("timestamp").alias("second"),
                F.col(amount).alias("amount"), F.col(value).alias("score"), F.col(outcome).cast("string").alias("outcome")))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@register("credit_audit", f"""WITH {REQUESTS_SQL.strip()}
SELECT age, duration_months, credit_amount, employment, purpose, {_TIER_SQL} AS credit_tier, round(p0, 4) AS confidence_good, round(p1, 4) AS confidence_moderate,
  round(p2, 4) AS confidence_poor, 'rules-v1' AS model_version
FROM credit_once ORDER BY second DESC, src_id DESC LIMIT 1000""")
def q_credit_audit(spark, sf_dir):
    """Applications scored and logged; the newest 1000 of the log by time."""
    base = scratch_path(spark, f"credit-{uuid.uuid4().hex}")
    create_log_tables(spark, base)
    replace_log(credit_log_rows(rule_credit(once(credit_requests(spark, sf_dir))), id_col="src_id"), f"{base}/credit_predictions", "all")
    return recent_predictions(spark, f"{base}/credit_predictions", [
        "age", "duration_months", "credit_amount", "employment", "purpose", "credit_tier", "confidence_good", "confidence_moderate", "confidence_poor",
        "model_version"], n=1000, schema=CREDIT_LOG_SCHEMA)
