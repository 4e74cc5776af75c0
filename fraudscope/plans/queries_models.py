"""Neighbour search, resampling, model, scoring, log, stream and drift-run queries.

Model queries fit with the library defaults (300 trees).  Queries without an SQL oracle are
checked on row counts only (their outcome is a fitted model or a side effect).
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import clean_credit_data, clean_fraud_data
from ..operators.knn import knn_same_class
from ..operators.sampling import smote
from ..session import scratch_path
from ..sources.tables import raw_applicants, raw_transactions, read_table
from .catalog import register
from .drift_job import run_drift_detection
from .queries_misc import rule_fraud_scores
from .scoring import Scorer, append_log, create_log_tables, fraud_log_rows, recent_predictions
from .training import (
    prepare_credit_data,
    prepare_fraud_data,
    run_full_pipeline,
    save_trained,
    top_features,
    train_credit_model,
    train_fraud_model,
)

_PREPARED: dict[tuple, object] = {}


def _prepared(spark, sf_dir: str, kind: str, resample: str = "smote"):
    """One prepared training set for each input of an application: the model queries share it (its tables are checkpointed)."""
    key = (spark.sparkContext.applicationId, sf_dir, kind, resample)
    if key not in _PREPARED:
        if kind == "fraud":
            _PREPARED[key] = prepare_fraud_data(clean_fraud_data(raw_transactions(spark, sf_dir)), resample=resample)
        else:
            _PREPARED[key] = prepare_credit_data(clean_credit_data(raw_applicants(spark, sf_dir)), resample=resample)
    return _PREPARED[key]


_DIST = ("sqrt(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: "
         "(CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)) * "
         "(CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)))))")


@register("knn_same_class", f"""
WITH pairs AS (
  SELECT a.vec_id AS id, CAST(a.label AS BIGINT) AS label, b.vec_id AS neighbor_id, {_DIST} AS distance
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbor_id) AS rank FROM pairs)
SELECT id, label, CAST(rank AS INTEGER) AS rank, neighbor_id, round(distance, 6) AS distance FROM r WHERE rank <= 5""")
def q_knn_same_class(spark, sf_dir):
    """J3 / M8 search: the 5 nearest embeddings with the same label (exact, blocked)."""
    emb = read_table(spark, sf_dir, "embeddings")
    nn = knn_same_class(emb, "vec_id", "label", "embedding", k=5)
    return nn.withColumn("distance", F.round("distance", 6))


@register("smote_counts", """
WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
SELECT label, CAST((SELECT max(n) FROM c) AS BIGINT) AS n_rows, CAST((SELECT max(n) FROM c) - n AS BIGINT) AS n_synthetic
FROM c""")
def q_smote_counts(spark, sf_dir):
    """M8: every class brought up to the majority size; synthetic rows per class."""
    emb = read_table(spark, sf_dir, "embeddings")
    res = smote(emb, "label", "embedding", "vec_id", k=5, seed=42)
    return res.groupBy("label").agg(F.count(F.lit(1)).cast("long").alias("n_rows"),
                                    F.count_if("synthetic").cast("long").alias("n_synthetic"))


def _u_sql(tag: str) -> str:
    return (f"CAST(CAST('0x' || substr(md5('42|{tag}|' || CAST(smp.id AS VARCHAR) || '|' || CAST(smp.s AS VARCHAR)), "
            "1, 13) AS BIGINT) AS DOUBLE) / CAST(4503599627370496 AS DOUBLE)")


_DIST_E = _DIST.replace("a.embedding", "a.vec").replace("b.embedding", "b.vec")

_SMOTE_SQL = f"""
WITH e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
c AS (SELECT label, count(*) AS n FROM e GROUP BY label),
need AS (SELECT label, (SELECT max(n) FROM c) - n AS need, n FROM c WHERE n < (SELECT max(n) FROM c)),
pairs AS (SELECT a.id, b.id AS nid, {_DIST_E} AS distance
          FROM e a JOIN e b ON a.label = b.label AND a.id <> b.id WHERE a.label IN (SELECT label FROM need)),
nn AS (SELECT id, nid, row_number() OVER (PARTITION BY id ORDER BY distance, nid) AS rk FROM pairs),
nl AS (SELECT id, list(nid ORDER BY rk) AS nbr_ids FROM nn WHERE rk <= 5 GROUP BY id),
hr AS (SELECT e.id, e.label, row_number() OVER (PARTITION BY e.label
                ORDER BY substr(md5('42|' || CAST(e.id AS VARCHAR)), 1, 15)) AS hrank
       FROM e JOIN need ON e.label = need.label),
reps AS (SELECT hr.id, hr.label, need.need // need.n + CASE WHEN hr.hrank <= need.need % need.n THEN 1 ELSE 0 END AS m
         FROM hr JOIN need ON hr.label = need.label),
smp AS (SELECT id, label, unnest(generate_series(1, m)) AS s FROM reps WHERE m > 0),
u AS (SELECT smp.id, smp.label, nl.nbr_ids, {_u_sql('n')} AS un, {_u_sql('g')} AS gap
      FROM smp JOIN nl ON smp.id = nl.id),
pick AS (SELECT id, label, gap, nbr_ids[CAST(floor(un * len(nbr_ids)) AS BIGINT) + 1] AS nbr FROM u),
syn AS (SELECT CAST(NULL AS BIGINT) AS id, p.label,
               list_transform(range(1, len(b.vec) + 1), lambda i: b.vec[i] + p.gap * (nv.vec[i] - b.vec[i])) AS vec,
               true AS synthetic
        FROM pick p JOIN e b ON b.id = p.id JOIN e nv ON nv.id = p.nbr)
SELECT id, label, vec, false AS synthetic FROM e
UNION ALL SELECT id, label, vec, synthetic FROM syn"""


@register("smote_balance", _SMOTE_SQL)
def q_smote_balance(spark, sf_dir):
    """M8 rows: originals plus synthetic points (each on a segment between two same-class rows)."""
    emb = read_table(spark, sf_dir, "embeddings")
    return smote(emb, "label", "embedding", "vec_id", k=5, seed=42)


@register("gbt_fit_score")
def q_gbt_fit_score(spark, sf_dir):
    """Fraud boosted trees trained on the SMOTE-balanced train split."""
    return train_fraud_model(_prepared(spark, sf_dir, "fraud")).metrics


@register("rf_fit_score")
def q_rf_fit_score(spark, sf_dir):
    """Credit random forest with balanced weights."""
    return train_credit_model(_prepared(spark, sf_dir, "credit")).metrics


@register("top_features")
def q_top_features(spark, sf_dir):
    """M13 + W2: the 20 most important credit features."""
    t = train_credit_model(_prepared(spark, sf_dir, "credit"))
    return top_features(t.extra["importances"], 20)


@register("train_report")
def q_train_report(spark, sf_dir):
    """Full pipeline for both models; one row per metric."""
    out = scratch_path(spark, f"train-{uuid.uuid4().hex}")
    return run_full_pipeline(spark, raw_transactions(spark, sf_dir), raw_applicants(spark, sf_dir), out)


def _trained_fraud_scorer(spark, sf_dir, path):
    prep = _prepared(spark, sf_dir, "fraud", resample="none")
    t = train_fraud_model(prep, version="fraud-gbt")
    save_trained(t, path)
    return Scorer.load(spark, path)


@register("model_roundtrip")
def q_model_roundtrip(spark, sf_dir):
    """S16/S17 + R1/R4 + R6: save, reload, score every valid transaction with the reloaded model."""
    from ..functions.names import standardise_column_names
    from .scoring import validated_fraud_scores

    scorer = _trained_fraud_scorer(spark, sf_dir, scratch_path(spark, f"model-{uuid.uuid4().hex}"))
    req = standardise_column_names(raw_transactions(spark, sf_dir)).drop("is_fraud", "name_orig", "name_dest")
    scored, _ = validated_fraud_scores(scorer, req)
    return scored.select("step", "type", "amount", "fraud_probability", "is_fraud", "threshold", "model_version")


@register("audit_append", """
SELECT CAST(1 + o_orderkey % 743 AS INTEGER) AS step, 'TRANSFER' AS type,
       o_totalprice / (o_totalprice + greatest(c_acctbal, CAST(0 AS DOUBLE)) * CAST(100 AS DOUBLE)
                       + CAST(50000 AS DOUBLE)) AS amount,
       CAST(0 AS DOUBLE) AS oldbalance_org, CAST(0 AS DOUBLE) AS newbalance_orig,
       CAST(0 AS DOUBLE) AS oldbalance_dest, CAST(0 AS DOUBLE) AS newbalance_dest
FROM orders JOIN customer ON o_custkey = c_custkey
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1000""")
def q_audit_append(spark, sf_dir):
    """S13-S15 + P18 + S11/W1: append scored rows to the date-partitioned log, read the newest 1000 back.

    The log ``id`` is the order key, so "newest 1000" (timestamp, then id) is reproducible.
    """
    base = scratch_path(spark, f"log-{uuid.uuid4().hex}")
    create_log_tables(spark, base)
    scored = rule_fraud_scores(spark, sf_dir).join(
        read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), "o_orderdate"), "request_id")
    shaped = scored.select(
        F.col("request_id").alias("src_id"),
        F.col("request_id").cast("string").alias("request_id"), F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        (F.lit(1) + F.col("request_id") % 743).alias("step"), F.lit("TRANSFER").alias("type"), F.col("p").alias("amount"),
        *[F.lit(0.0).alias(c) for c in ["oldbalance_org", "newbalance_orig", "oldbalance_dest", "newbalance_dest"]],
        F.round("p", 4).alias("fraud_probability"), (F.col("p") >= 0.5).alias("is_fraud"),
        F.lit(0.5).alias("threshold"), F.lit("rules-v1").alias("model_version"))
    append_log(fraud_log_rows(shaped, id_col="src_id"), f"{base}/fraud_predictions")
    return recent_predictions(spark, f"{base}/fraud_predictions",
                              ["step", "transaction_type", "amount", "oldbalance_org", "newbalance_orig",
                               "oldbalance_dest", "newbalance_dest"], n=1000, rename={"transaction_type": "type"})


@register("stream_score")
def q_stream_score(spark, sf_dir):
    """Stream the transactions through validation + scoring into the idempotent log."""
    from ..functions.names import standardise_column_names
    from ..streaming.scoring_stream import start_fraud_scoring_stream

    base = scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    scorer = _trained_fraud_scorer(spark, sf_dir, f"{base}/model")
    src = standardise_column_names(raw_transactions(spark, sf_dir)).drop("is_fraud", "name_orig", "name_dest")
    src = src.withColumn("src_row", F.monotonically_increasing_id())
    src.write.mode("overwrite").parquet(f"{base}/incoming")
    stream = spark.readStream.schema(src.schema).parquet(f"{base}/incoming")
    q = start_fraud_scoring_stream(spark, stream, scorer, f"{base}/log", f"{base}/rejected", f"{base}/ckpt",
                                   key=["src_row"], available_now=True)
    q.awaitTermination()
    return spark.read.parquet(f"{base}/log").drop("batch_id")


@register("stream_minute", """
SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute, CAST(count(*) AS BIGINT) AS n_predictions,
       round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS fraud_rate,
       max(CASE WHEN ts < TIMESTAMP '2024-01-15 00:00:00' THEN 'v1' ELSE 'v2' END) AS model_version
FROM events GROUP BY 1""")
def q_stream_minute(spark, sf_dir):
    """R7 streaming: one-minute windows over the events stream, in update mode into a table keyed by window (availableNow)."""
    from ..streaming.monitor import read_minute_table, start_minute_table

    base = scratch_path(spark, f"minutes-{uuid.uuid4().hex}")
    schema = read_table(spark, sf_dir, "events").schema
    src = (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    log = src.select(F.col("ts").cast("timestamp").alias("timestamp"), (F.col("event_type") == "error").alias("is_fraud"),
                     F.when(F.col("ts") < cut, "v1").otherwise("v2").alias("model_version"))
    start_minute_table(log, f"{base}/table", f"{base}/state", available_now=True).awaitTermination()
    return read_minute_table(spark, f"{base}/table").select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("minute"), "n_predictions",
        F.round("fraud_rate", 6).alias("fraud_rate"), "model_version")


_FRAUD_CUR_SQL = ("(SELECT CAST(1 + event_id % 743 AS DOUBLE) AS step, value AS amount, 'PAYMENT' AS type "
                  "FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000)")
_CREDIT_COLS = ["age", "duration_months", "credit_amount", "employment", "purpose"]
_CREDIT_CUR_SQL = ("(SELECT age, duration_months, credit_amount, employment, purpose FROM clean_credit "
                   "ORDER BY credit_amount DESC, age DESC, duration_months DESC, employment DESC, purpose DESC "
                   "LIMIT 1000)")


def _status_sql(model: str, src, numeric: list[str], categorical: list[str]) -> str:
    from .queries_drift import _cat_report_sql, _num_report_sql

    rep = "\nUNION ALL ".join([f"SELECT * FROM {_num_report_sql(c, src)}" for c in numeric]
                              + [f"SELECT * FROM {_cat_report_sql(c, src)}" for c in categorical])
    n = f"(SELECT count(*) FROM {src[1]} AS cur_n)"
    share = "CAST(count(*) FILTER (WHERE drift_detected) AS DOUBLE) / count(*)"
    return f"""SELECT '{model}' AS model, CASE WHEN {n} < 50 THEN 'not_enough_rows' ELSE 'ok' END AS status,
  CAST({n} AS BIGINT) AS n_current,
  CASE WHEN {n} < 50 THEN NULL ELSE CAST(count(*) AS BIGINT) END AS n_features,
  CASE WHEN {n} < 50 THEN NULL ELSE CAST(count(*) FILTER (WHERE drift_detected) AS BIGINT) END AS n_drifted_features,
  CASE WHEN {n} < 50 THEN NULL ELSE round({share}, 6) END AS drift_share,
  CASE WHEN {n} < 50 THEN NULL ELSE {share} >= 0.5 END AS drift_detected,
  CASE WHEN {n} < 50 THEN NULL ELSE {share} > 0.15 END AS alert
FROM ({rep}) rep_{model.lower()}"""


def _drift_run_sql() -> str:
    from .catalog import sql_clean_credit_ctes, sql_clean_fraud_ctes

    fraud_src = ("(SELECT step, amount, type FROM clean_fraud)", _FRAUD_CUR_SQL)
    credit_src = ("(SELECT age, duration_months, credit_amount, employment, purpose FROM clean_credit)",
                  _CREDIT_CUR_SQL)
    return ("WITH " + sql_clean_fraud_ctes().strip() + ",\n" + sql_clean_credit_ctes().strip() + "\n"
            + _status_sql("FraudDetector", fraud_src, ["step", "amount"], ["type"])
            + "\nUNION ALL\n"
            + _status_sql("CreditRiskScorer", credit_src, ["age", "duration_months", "credit_amount"],
                          ["employment", "purpose"])
            + "\nUNION ALL SELECT 'UnseenModel', 'no_reference', CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), "
              "CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS BOOLEAN), CAST(NULL AS BOOLEAN)")


@register("drift_run", _drift_run_sql())
def q_drift_run(spark, sf_dir):
    """Both models.

    Fraud: reference = cleaned transactions, current = the newest 1000 prediction-log rows
    (events as the log).  Credit: reference = cleaned applicants (the 5 logged inputs),
    current = the 1000 applicants with the largest requested amounts (a drifted window,
    fully ordered so ties cannot change it).  A third entry without a reference exercises
    the skip path.
    """
    ref = clean_fraud_data(raw_transactions(spark, sf_dir)).select("step", "amount", "type")
    ev = read_table(spark, sf_dir, "events")
    cur = ev.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(1000).select(
        (F.lit(1) + F.col("event_id") % 743).cast("double").alias("step"), F.col("value").alias("amount"),
        F.lit("PAYMENT").alias("type"))
    cref = clean_credit_data(raw_applicants(spark, sf_dir)).select(*_CREDIT_COLS)
    ccur = cref.orderBy(*[F.col(c).desc() for c in ["credit_amount", "age", "duration_months", "employment",
                                                    "purpose"]]).limit(1000)
    empty = spark.createDataFrame([], T.StructType([T.StructField("amount", T.DoubleType())]))
    return run_drift_detection(spark, {"FraudDetector": (ref, cur), "CreditRiskScorer": (cref, ccur),
                                       "UnseenModel": (None, empty)})
