"""Profiles of columns, their correlations, and the drift run over both prediction logs against stored profiles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import profiles as P
from ..operators.clean import clean_credit_data, clean_fraud_data
from ..schemas import CREDIT_LOG_SCHEMA, FRAUD_LOG_SCHEMA
from ..session import scratch_path
from ..sources.tables import REQUESTS_SQL, credit_requests, fraud_requests, raw_applicants, raw_transactions, read_table
from ..streaming.combined_stream import once
from .catalog import register, sql_clean_credit_ctes, sql_clean_fraud_ctes
from .drift_job import run_profile_drift
from .queries_drift import _profile_sql
from .queries_models import _status_sql
from .queries_streams import rule_credit, rule_fraud
from .scoring import create_log_tables, credit_log_rows, fraud_log_rows, recent_predictions, replace_log

_FRAUD_NUM = ["step", "amount", "oldbalance_org", "newbalance_orig", "oldbalance_dest", "newbalance_dest"]
_CREDIT_NUM = ["age", "duration_months", "credit_amount"]


@register("profile_quality", "SELECT column_name, column_type, count, missing, n_unique, most_common, m AS mean, s AS std, lo AS min, hi AS max, p25, p50, p75 FROM (\n"
          + "\nUNION ALL\n".join(_profile_sql(c, n).replace("FROM events", "FROM (SELECT * FROM events)") for c, n in [("event_type", False), ("value", True)])
          + ") t(column_name, column_type, count, missing, n_unique, most_common, m, s, lo, hi, p25, p50, p75)")
def q_profile_quality(spark, sf_dir):
    """Quality figures read from the profiles of two halves of the events, stored and added up; the events are scanned once."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    base = scratch_path(spark, f"profile-{uuid.uuid4().hex}")
    halves = []
    for k in (0, 1):
        P.store_profile(P.value_profile(ev.filter(F.col("event_id") % 2 == k), ["event_type", "value"]), f"{base}/{k}")
        halves.append(P.read_profile(spark, f"{base}/{k}"))
    return P.quality_figures(P.merge_profiles(*halves))


_RANK = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0)"
_NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("rank_correlations", "\nUNION ALL\n".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr(x, y), 6) AS spearman FROM (SELECT {_RANK.format(a)} AS x, {_RANK.format(b)} AS y FROM lineitem)"
    for i, a in enumerate(_NUMS) for b in _NUMS[i + 1:]))
def q_rank_correlations(spark, sf_dir):
    """Spearman correlation of each pair of numeric lineitem columns."""
    return P.spearman(read_table(spark, sf_dir, "lineitem"), _NUMS)


_CATS = ["l_returnflag", "l_linestatus", "l_linenumber"]


def _cramer_sql(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS column_a, '{b}' AS column_b, round(sqrt(chi / n / least(ka - 1, kb - 1)), 6) AS cramers_v FROM (
  SELECT sum((coalesce(o, 0) - na * nb / n) ** 2 / (na * nb / n)) AS chi, max(n) AS n, count(DISTINCT a) AS ka, count(DISTINCT b) AS kb
  FROM (SELECT {a} AS a, CAST(count(*) AS DOUBLE) AS na FROM lineitem GROUP BY 1), (SELECT {b} AS b, CAST(count(*) AS DOUBLE) AS nb FROM lineitem GROUP BY 1),
    (SELECT CAST(count(*) AS DOUBLE) AS n FROM lineitem)
  LEFT JOIN (SELECT {a} AS oa, {b} AS ob, CAST(count(*) AS DOUBLE) AS o FROM lineitem GROUP BY 1, 2) ON oa = a AND ob = b)"""


@register("category_correlations", "\nUNION ALL\n".join(_cramer_sql(a, b) for i, a in enumerate(_CATS) for b in _CATS[i + 1:]))
def q_category_correlations(spark, sf_dir):
    """Cramer's V of each pair of categorical lineitem columns, from one stored contingency table."""
    base = scratch_path(spark, f"pairs-{uuid.uuid4().hex}")
    P.contingency(read_table(spark, sf_dir, "lineitem"), _CATS).write.parquet(f"{base}/table")
    return P.cramers_v(spark.read.parquet(f"{base}/table"))


def _drift_logs_sql() -> str:
    fraud = (f"(SELECT {', '.join(_FRAUD_NUM)}, type FROM clean_fraud)", f"(SELECT {', '.join(_FRAUD_NUM)}, type FROM fraud_once ORDER BY second DESC, src_id DESC LIMIT 1000)")
    cols = [*_CREDIT_NUM, "employment", "purpose"]
    credit = (f"(SELECT {', '.join(cols)} FROM clean_credit)", f"(SELECT {', '.join(cols)} FROM credit_once ORDER BY second DESC, src_id DESC LIMIT 1000)")
    return ("WITH " + sql_clean_fraud_ctes().strip() + ",\n" + sql_clean_credit_ctes().strip() + ",\n" + REQUESTS_SQL.strip() + "\n"
            + _status_sql("FraudDetector", fraud, _FRAUD_NUM, ["type"]) + "\nUNION ALL\n" + _status_sql("CreditRiskScorer", credit, _CREDIT_NUM, ["employment", "purpose"]))


@register("drift_logs", _drift_logs_sql())
def q_drift_logs(spark, sf_dir):
    """The newest 1000 rows of each log by time, all 7 and 5 logged inputs, against the profile stored at training time."""
    base = scratch_path(spark, f"drift-{uuid.uuid4().hex}")
    P.store_profile(P.value_profile(clean_fraud_data(raw_transactions(spark, sf_dir)), [*_FRAUD_NUM, "type"]), f"{base}/fraud_profile")
    P.store_profile(P.value_profile(clean_credit_data(raw_applicants(spark, sf_dir)), [*_CREDIT_NUM, "employment", "purpose"]), f"{base}/credit_profile")
    create_log_tables(spark, base)
    replace_log(fraud_log_rows(rule_fraud(once(fraud_requests(spark, sf_dir))), id_col="src_id"), f"{base}/fraud_predictions", "all")
    replace_log(credit_log_rows(rule_credit(once(credit_requests(spark, sf_dir))), id_col="src_id"), f"{base}/credit_predictions", "all")
    fraud = recent_predictions(spark, f"{base}/fraud_predictions", [*_FRAUD_NUM, "transaction_type"], rename={"transaction_type": "type"}, schema=FRAUD_LOG_SCHEMA)
    credit = recent_predictions(spark, f"{base}/credit_predictions", [*_CREDIT_NUM, "employment", "purpose"], schema=CREDIT_LOG_SCHEMA)
    return run_profile_drift(spark, {"FraudDetector": (P.read_profile(spark, f"{base}/fraud_profile"), fraud),
                                     "CreditRiskScorer": (P.read_profile(spark, f"{base}/credit_profile"), credit)})
