"""Scoring-shape, schema, sink and set-operation queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.names import common_columns, standardise_column_names
from ..operators.clean import clean_fraud_data
from ..operators.sampling import seeded_shuffle
from ..operators.scoring import finalize_credit, finalize_fraud
from ..schemas import FRAUD_ID_COLUMNS, RAW_FRAUD_COLUMNS
from ..session import scratch_path
from ..sources.io import load_fraud_csv, validate_schema, write_table
from ..sources.tables import RAW_TRANSACTIONS_SQL, raw_transactions, read_table
from .catalog import register, sql_clean_fraud_ctes

# ----------------------------------------------------------------------------- J2, P14-P17
_COMBINED_SQL = """
WITH f AS (
  SELECT o_orderkey AS request_id, o_custkey,
         o_totalprice / (o_totalprice + greatest(c_acctbal, CAST(0 AS DOUBLE)) * CAST(100 AS DOUBLE) + CAST(50000 AS DOUBLE)) AS p
  FROM orders JOIN customer ON o_custkey = c_custkey),
c AS (
  SELECT c_custkey,
    (greatest(c_acctbal, CAST(0 AS DOUBLE)) + 1) / ((greatest(c_acctbal, CAST(0 AS DOUBLE)) + 1) + CAST(2000 AS DOUBLE)
        + (greatest(-c_acctbal, CAST(0 AS DOUBLE)) * 5 + 500)) AS p0,
    CAST(2000 AS DOUBLE) / ((greatest(c_acctbal, CAST(0 AS DOUBLE)) + 1) + CAST(2000 AS DOUBLE)
        + (greatest(-c_acctbal, CAST(0 AS DOUBLE)) * 5 + 500)) AS p1,
    (greatest(-c_acctbal, CAST(0 AS DOUBLE)) * 5 + 500) / ((greatest(c_acctbal, CAST(0 AS DOUBLE)) + 1) + CAST(2000 AS DOUBLE)
        + (greatest(-c_acctbal, CAST(0 AS DOUBLE)) * 5 + 500)) AS p2
  FROM customer)
SELECT request_id, round(p, 4) AS fraud_probability, p >= 0.5 AS is_fraud, CAST(0.5 AS DOUBLE) AS threshold,
       CASE WHEN p0 >= p1 AND p0 >= p2 THEN 'Good' WHEN p1 >= p2 THEN 'Moderate' ELSE 'Poor' END AS credit_tier,
       round(p0, 4) AS confidence_good, round(p1, 4) AS confidence_moderate, round(p2, 4) AS confidence_poor,
       'rules-v1' AS model_version
FROM f JOIN c ON f.o_custkey = c.c_custkey"""


def rule_fraud_scores(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    cu = read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    price = F.col("o_totalprice")
    p = price / (price + F.greatest(F.col("c_acctbal"), F.lit(0.0)) * F.lit(100.0) + F.lit(50000.0))
    return o.join(cu, o["o_custkey"] == cu["c_custkey"]).select(
        F.col("o_orderkey").alias("request_id"), "o_custkey", p.alias("p"))


def rule_credit_scores(spark, sf_dir):
    cu = read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    good = F.greatest(F.col("c_acctbal"), F.lit(0.0)) + F.lit(1)
    mod = F.lit(2000.0)
    poor = F.greatest(-F.col("c_acctbal"), F.lit(0.0)) * F.lit(5) + F.lit(500)
    tot = good + mod + poor
    return cu.select("c_custkey", (good / tot).alias("p0"), (mod / tot).alias("p1"), (poor / tot).alias("p2"))


@register("combined_score", _COMBINED_SQL)
def q_combined_score(spark, sf_dir):
    """J2 + P14-P17: fraud score per transaction joined with the applicant's credit score."""
    fraud = finalize_fraud(rule_fraud_scores(spark, sf_dir), "p", 0.5, "rules-v1")
    credit = finalize_credit(rule_credit_scores(spark, sf_dir), "p0", "p1", "p2", "rules-v1", with_map=False)
    j = fraud.join(credit.drop("model_version"), fraud["o_custkey"] == credit["c_custkey"])
    return j.select("request_id", "fraud_probability", "is_fraud", "threshold", "credit_tier", "confidence_good",
                    "confidence_moderate", "confidence_poor", "model_version")


# ----------------------------------------------------------------------------- R7 (batch)
_MINUTE_SQL = """
SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute,
       CAST(count(*) AS BIGINT) AS n_predictions,
       round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS fraud_rate,
       max(CASE WHEN ts < TIMESTAMP '2024-01-15 00:00:00' THEN 'v1' ELSE 'v2' END) AS model_version
FROM events GROUP BY 1"""


def prediction_log_from_events(spark, sf_dir):
    """A prediction-log shaped view of events: timestamp, is_fraud flag, model version."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return ev.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("timestamp"),
        (F.col("event_type") == "error").alias("is_fraud"),
        F.col("value").alias("amount"),
        F.when(F.col("ts") < cut, "v1").otherwise("v2").alias("model_version"),
    )


@register("pred_per_minute", _MINUTE_SQL)
def q_pred_per_minute(spark, sf_dir):
    """R7 batch form: per-minute prediction count, fraud rate and model version."""
    from ..streaming.monitor import per_minute_stats

    return per_minute_stats(prediction_log_from_events(spark, sf_dir)).select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("minute"), "n_predictions",
        F.round("fraud_rate", 6).alias("fraud_rate"), "model_version")


# ----------------------------------------------------------------------------- P1, P2, P6, P10
@register("rename_columns", "WITH " + RAW_TRANSACTIONS_SQL.strip() + """
SELECT step, type, amount, oldbalanceOrg AS oldbalance_org, newbalanceOrig AS newbalance_orig,
       oldbalanceDest AS oldbalance_dest, newbalanceDest AS newbalance_dest, isFraud AS is_fraud FROM txn""")
def q_rename_columns(spark, sf_dir):
    df = standardise_column_names(raw_transactions(spark, sf_dir))
    return df.drop(*FRAUD_ID_COLUMNS)


# ----------------------------------------------------------------------------- P19
@register("column_overlap", "WITH " + RAW_TRANSACTIONS_SQL.strip() + ",\nlive AS (" + _COMBINED_SQL + ")\n" + "\nUNION ALL\n".join(
    f"SELECT {i} AS position, '{c}' AS column_name, (SELECT count({raw}) FROM txn) AS n_reference, (SELECT {n} FROM live) AS n_live"
    for i, (c, raw, n) in enumerate([
        ("step", "step", "count(request_id)"), ("type", "type", "count(model_version)"),
        ("amount", "amount", "count(fraud_probability)"), ("is_fraud", "isFraud", "count(is_fraud)")])))
def q_column_overlap(spark, sf_dir):
    """Columns shared by the raw reference and the live log, with the values each side has in them."""
    ref = standardise_column_names(raw_transactions(spark, sf_dir))
    live = finalize_fraud(rule_fraud_scores(spark, sf_dir), "p", 0.5, "rules-v1").select(
        (F.lit(1) + F.col("request_id") % 743).alias("step"), F.col("model_version").alias("type"),
        F.col("fraud_probability").alias("amount"), "is_fraud", "threshold")
    cols = common_columns(ref, live)
    counts = lambda df, name: df.agg(*[F.count(c).alias(c) for c in cols]).unpivot(
        [], cols, "column_name", name)
    place = F.array_position(F.array(*[F.lit(c) for c in cols]), F.col("column_name")) - 1
    return counts(ref, "n_reference").join(counts(live, "n_live"), "column_name").select(
        place.cast("int").alias("position"), "column_name", "n_reference", "n_live")


# ----------------------------------------------------------------------------- W3, W4, A1
@register("union_dedup", """
WITH a AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'),
     b AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'),
     u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM a)
SELECT DISTINCT o_orderkey, o_orderstatus, substr(md5('42|' || CAST(o_orderkey AS VARCHAR)), 1, 15) AS shuffle_key FROM u""")
def q_union_dedup(spark, sf_dir):
    """W3 + A1 + W4: union of the two label parts (one twice), exact de-dup, seeded shuffle key."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    a = o.filter(F.col("o_orderstatus") == "F")
    b = o.filter(F.col("o_orderstatus") != "F")
    u = a.unionByName(b).unionByName(a).dropDuplicates()
    key = F.concat_ws("|", F.lit("42"), F.col("o_orderkey").cast("string"))
    return seeded_shuffle(u, ["o_orderkey"], 42).withColumn("shuffle_key", F.substring(F.md5(key), 1, 15))


# ----------------------------------------------------------------------------- S1, S4-S8, S19
@register("csv_roundtrip", "WITH " + sql_clean_fraud_ctes().strip() + "\nSELECT * FROM clean_fraud")
def q_csv_roundtrip(spark, sf_dir):
    """S8 -> S1 -> S4-S7 -> I5: write raw transactions as CSV, read back as strings, validate, coerce, clean."""
    path = scratch_path(spark, f"csv-roundtrip-{uuid.uuid4().hex}")
    write_table(raw_transactions(spark, sf_dir), path, fmt="csv")
    back = load_fraud_csv(spark, path)
    casts = {c: F.col(c).cast("bigint") for c, t in RAW_FRAUD_COLUMNS.items() if t == "bigint"}
    return clean_fraud_data(back.withColumns(casts))


@register("schema_check")
def q_schema_check(spark, sf_dir):
    """One row per check (rows-only: the outcome is an exception, not a value)."""
    raw = raw_transactions(spark, sf_dir)
    cases = [
        ("raw_transactions", raw),
        ("wrong_columns", read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("wrong_column"))),
        # transactions outside the simulated month: none exist, so the whole-table filter is empty
        ("empty", raw.filter(F.col("step") > 743)),
    ]
    rows = []
    for name, df in cases:
        try:
            validate_schema(df, RAW_FRAUD_COLUMNS, name)
            rows.append((name, True, ""))
        except ValueError as e:
            rows.append((name, False, str(e)))
    return spark.createDataFrame(rows, "dataset string, passed boolean, message string")
