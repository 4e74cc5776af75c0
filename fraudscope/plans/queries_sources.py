"""Queries of files and requests: CSV with bad lines, the headerless applicant file, the cleaning job from files, scoring inputs and ids."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.scoring import assign_request_ids, finalize_credit
from ..schemas import GERMAN_RAW_COLUMNS
from ..session import scratch_path
from ..sources.io import load_german_raw
from ..sources.quarantine import split_csv
from ..sources.tables import REQUESTS_SQL, credit_requests, fraud_requests, raw_applicants, raw_transactions, read_table
from ..streaming.combined_stream import once
from .catalog import register, sql_clean_credit_ctes, sql_clean_fraud_ctes
from .cleaning import run_cleaning_pipeline
from .scoring import fraud_features_from_request
from .training import top_features

_COLUMNS = {"key": "bigint", "kind": "string", "amount": "double"}


def _lines(spark, sf_dir):
    """One CSV line per order, some with a field too few or too many, some with a text for a number."""
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    key, kind, amount = k.cast("string"), F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit(', x"')), F.col("o_custkey").cast("string")
    fields = (F.when(k % 13 == 3, F.concat_ws(",", key, kind)).when(k % 17 == 5, F.concat_ws(",", key, kind, amount, F.lit("extra")))
              .when(k % 19 == 7, F.concat_ws(",", key, kind, F.lit(" 12 ")))
              .when(k % 23 == 2, F.concat_ws(",", key, kind, F.lit("abc"))).when(k % 29 == 4, F.concat_ws(",", key, kind, F.lit(""))).otherwise(F.concat_ws(",", key, kind, amount)))
    return o.select(fields.alias("value"))


_REASON = """CASE WHEN o_orderkey % 13 = 3 THEN 'too_few_fields:2' WHEN o_orderkey % 17 = 5 THEN 'too_many_fields:4'
  WHEN o_orderkey % 19 <> 7 AND o_orderkey % 23 = 2 THEN 'not_a_number:amount' END"""


@register("csv_quarantine", f"""WITH lines AS (SELECT *, {_REASON} AS reason FROM orders)
SELECT 'good' AS side, NULL AS reason, CAST(o_orderkey AS DOUBLE) AS key, o_orderpriority || ', x' AS kind,
  CASE WHEN o_orderkey % 19 = 7 THEN CAST(12 AS DOUBLE) WHEN o_orderkey % 29 = 4 THEN NULL ELSE CAST(o_custkey AS DOUBLE) END AS amount, NULL AS line
FROM lines WHERE reason IS NULL
UNION ALL
SELECT 'bad', reason, NULL, NULL, NULL,
  CASE WHEN reason = 'too_few_fields:2' THEN o_orderkey || ',"' || o_orderpriority || ', x"'
       WHEN reason = 'too_many_fields:4' THEN o_orderkey || ',"' || o_orderpriority || ', x",' || o_custkey || ',extra'
       ELSE o_orderkey || ',' || o_orderpriority || ', x,abc' END
FROM lines WHERE reason IS NOT NULL""")
def q_csv_quarantine(spark, sf_dir):
    """A CSV file with faulty lines; good rows and the bad lines with their reasons, each line once."""
    path = scratch_path(spark, f"lines-{uuid.uuid4().hex}")
    _lines(spark, sf_dir).write.text(path)
    good, bad = split_csv(spark, path, _COLUMNS, header=False)
    none = F.lit(None)
    return good.select(F.lit("good").alias("side"), none.cast("string").alias("reason"), "key", "kind", "amount", none.cast("string").alias("line")).unionByName(
        bad.select(F.lit("bad").alias("side"), "reason", none.cast("double").alias("key"), none.cast("string").alias("kind"), none.cast("double").alias("amount"), "line"))


_GERMAN_NUMBERS = ["duration_months", "credit_amount", "installment_rate", "residence_since", "age", "existing_credits", "num_dependents", "credit_risk"]


def _german_value(i: int, c: str) -> tuple[str, str]:
    """The (Spark, SQL) text of a column of the applicant file, by the customer's key."""
    if c in _GERMAN_NUMBERS:
        e = f"c_custkey * {i + 3} % 97"
        return f"cast({e} as string)", f"CAST({e} AS DOUBLE)"
    e = f"c_custkey * {i + 3} % 5"
    return f"concat('A{i}', cast({e} as string))", f"'A{i}' || CAST({e} AS VARCHAR)"


@register("german_file", "SELECT " + ", ".join(f"{_german_value(i, c)[1]} AS {c}" for i, c in enumerate(GERMAN_RAW_COLUMNS)) + " FROM customer")
def q_german_file(spark, sf_dir):
    """S3: the headerless, blank-separated applicant file read under the supplied names."""
    path = scratch_path(spark, f"german-{uuid.uuid4().hex}")
    line = F.concat_ws(" ", *[F.expr(_german_value(i, c)[0]) for i, c in enumerate(GERMAN_RAW_COLUMNS)])
    read_table(spark, sf_dir, "customer").select(line.alias("value")).write.text(path)
    return load_german_raw(spark, path)


def _from_files(spark, sf_dir):
    """Both raw tables written as CSV files with headers and cleaned from there; (transactions, applicants)."""
    base = scratch_path(spark, f"raw-{uuid.uuid4().hex}")
    for name, table in (("fraud", raw_transactions(spark, sf_dir)), ("credit", raw_applicants(spark, sf_dir))):
        table.write.option("header", True).csv(f"{base}/{name}.csv")
    return run_cleaning_pipeline(spark, f"{base}/fraud.csv", f"{base}/credit.csv", f"{base}/clean")


@register("clean_files_fraud", "WITH " + sql_clean_fraud_ctes().strip() + "\nSELECT * FROM clean_fraud")
def q_clean_files_fraud(spark, sf_dir):
    """Files -> checked, coerced, cleaned, stored; the stored transactions."""
    return _from_files(spark, sf_dir)[0]


@register("clean_files_credit", "WITH " + sql_clean_credit_ctes().strip() + "\nSELECT * FROM clean_credit")
def q_clean_files_credit(spark, sf_dir):
    """The same job's stored applicants."""
    return _from_files(spark, sf_dir)[1]


@register("request_features", f"""WITH {REQUESTS_SQL.strip()}
SELECT request_id, abs(oldbalance_org - amount - newbalance_orig) AS balance_error_orig, abs(oldbalance_dest + amount - newbalance_dest) AS balance_error_dest,
  CAST(newbalance_orig = 0 AS INTEGER) AS orig_balance_zeroed FROM fraud_once""")
def q_request_features(spark, sf_dir):
    """The derived inputs recomputed from scoring requests, each request once."""
    return fraud_features_from_request(once(fraud_requests(spark, sf_dir))).select("request_id", "balance_error_orig", "balance_error_dest", "orig_balance_zeroed")


@register("confidence_scores", f"""WITH {REQUESTS_SQL.strip()}
SELECT request_id, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 'Good' WHEN p1 >= p2 THEN 'Moderate' ELSE 'Poor' END AS credit_tier,
  unnest(['Good', 'Moderate', 'Poor']) AS tier, unnest([round(p0, 4), round(p1, 4), round(p2, 4)]) AS score FROM credit_once""")
def q_confidence_scores(spark, sf_dir):
    """The tier of each application and its map of scores, one row an entry."""
    scored = finalize_credit(once(credit_requests(spark, sf_dir)), "p0", "p1", "p2", "rules-v1")
    return scored.select("request_id", "credit_tier", F.explode("confidence_scores").alias("tier", "score"))


@register("request_ids", """
SELECT o_orderkey, concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) AS request_id
FROM (SELECT o_orderkey, md5(strlen(o_orderkey::VARCHAR) || ':' || o_orderkey || '|' || length(o_orderpriority) || ':' || o_orderpriority) AS h FROM orders)""")
def q_request_ids(spark, sf_dir):
    """Ids derived from a source key, the same on every replay."""
    return assign_request_ids(read_table(spark, sf_dir, "orders"), ["o_orderkey", "o_orderpriority"]).select("o_orderkey", "request_id")


@register("top_scores", "SELECT p_name AS feature_name, round(p_retailprice, 2) AS importance FROM part ORDER BY importance DESC, feature_name LIMIT 20")
def q_top_scores(spark, sf_dir):
    """The 20 largest of given scores, ties by name (the top-k is the feature)."""
    return top_features(read_table(spark, sf_dir, "part").select(F.col("p_name").alias("feature_name"), F.round("p_retailprice", 2).alias("importance")), 20)
