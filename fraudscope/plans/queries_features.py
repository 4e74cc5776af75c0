"""Ingest, validation, feature and sampling queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions.names import standardise_column_names
from ..operators.categories import category_table, store_categories, with_codes
from ..operators.clean import clean_credit_data, clean_fraud_data
from ..operators.features import credit_features, fraud_features
from ..operators.quantiles import exact_quantiles, quantile_sql
from ..operators.sampling import balanced_class_weights, positive_class_weight, stratified_split
from ..operators.stats import null_summary
from ..operators.validation import validate_credit, validate_fraud
from ..schemas import CREDIT_CATEGORICAL_FEATURES, CREDIT_NUMERIC_FEATURES, FRAUD_NUMERIC_FEATURES, FRAUD_TYPE_CATEGORIES
from ..session import scratch_path
from ..sources.io import coerce_types, transactions_as_text
from ..sources.tables import (
    GERMAN_APPLICANTS_SQL,
    RAW_APPLICANTS_SQL,
    RAW_TRANSACTIONS_SQL,
    german_applicants,
    raw_applicants,
    raw_transactions,
    read_table,
)
from .catalog import register, sql_clean_credit_ctes, sql_clean_fraud_ctes

# ----------------------------------------------------------------------------- S6/S7
_TEXT_SQL = """
txt AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS txn_id,
    CASE WHEN o_orderkey % 61 = 0 THEN 'abc' WHEN o_orderkey % 67 = 0 THEN 'NaN'
         WHEN o_orderkey % 71 = 0 THEN ' ' || CAST(o_orderkey % 743 AS VARCHAR) || ' '
         ELSE CAST(1 + o_orderkey % 743 AS VARCHAR) END AS step,
    CASE WHEN o_orderkey % 73 = 0 THEN '1.5e3' WHEN o_orderkey % 79 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) || '.25' END AS amount,
    CASE WHEN o_orderkey % 83 = 0 THEN NULL ELSE o_orderpriority END AS type
  FROM orders
)
"""


@register("coerce_types", "WITH " + _TEXT_SQL.strip() + """
SELECT txn_id,
  CASE WHEN isnan(TRY_CAST(trim(step) AS DOUBLE)) THEN NULL ELSE TRY_CAST(trim(step) AS DOUBLE) END AS step,
  CASE WHEN isnan(TRY_CAST(trim(amount) AS DOUBLE)) THEN NULL ELSE TRY_CAST(trim(amount) AS DOUBLE) END AS amount,
  CAST(type AS VARCHAR) AS type
FROM txt""")
def q_coerce_types(spark, sf_dir):
    return coerce_types(transactions_as_text(spark, sf_dir), numeric=["step", "amount"], string=["type"], keep=["txn_id"])


# ----------------------------------------------------------------------------- A2
def _raw_fraud_snake_sql():
    return ("SELECT step, type, amount, nameOrig AS name_orig, oldbalanceOrg AS oldbalance_org, "
            "newbalanceOrig AS newbalance_orig, nameDest AS name_dest, oldbalanceDest AS oldbalance_dest, "
            "newbalanceDest AS newbalance_dest, isFraud AS is_fraud FROM txn")


_FRAUD_SNAKE = ["step", "type", "amount", "name_orig", "oldbalance_org", "newbalance_orig", "name_dest",
                "oldbalance_dest", "newbalance_dest", "is_fraud"]


@register("null_summary", "WITH " + RAW_TRANSACTIONS_SQL.strip() + ",\nfr AS (" + _raw_fraud_snake_sql() + ")\n"
          + "SELECT column_name, null_count FROM (\n"
          + "\nUNION ALL\n".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count FROM fr"
                                 for c in _FRAUD_SNAKE)
          + ") t WHERE null_count > 0")
def q_null_summary(spark, sf_dir):
    return null_summary(standardise_column_names(raw_transactions(spark, sf_dir)))


# ----------------------------------------------------------------------------- A1/A3
@register("clean_counters", "WITH " + RAW_TRANSACTIONS_SQL.strip() + ",\nfr AS (" + _raw_fraud_snake_sql() + """),
g AS (SELECT is_fraud, count(*) AS n FROM fr GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS rows_raw, CAST(count(*) AS BIGINT) AS rows_deduplicated,
       CAST(sum(n) - count(*) AS BIGINT) AS duplicates_removed,
       CAST(count(*) FILTER (WHERE is_fraud IS NULL) AS BIGINT) AS null_target_removed,
       CAST(count(*) FILTER (WHERE is_fraud IS NOT NULL) AS BIGINT) AS rows_clean
FROM (SELECT step, type, amount, name_orig, oldbalance_org, newbalance_orig, name_dest, oldbalance_dest,
             newbalance_dest, is_fraud, count(*) AS n FROM fr GROUP BY ALL) d""")
def q_clean_counters(spark, sf_dir):
    from ..operators.clean import dedup_counters

    return dedup_counters(standardise_column_names(raw_transactions(spark, sf_dir)), "is_fraud")


# ----------------------------------------------------------------------------- P9/A6
_WINS_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


@register("winsorize", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"least(greatest({c}, {quantile_sql('lineitem', c, 0.01)}), {quantile_sql('lineitem', c, 0.99)}) AS {c}"
    for c in _WINS_COLS) + " FROM lineitem")
def q_winsorize(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *_WINS_COLS)
    q = exact_quantiles(li, {c: [0.01, 0.99] for c in _WINS_COLS})
    return li.select("l_orderkey", "l_linenumber", *[X.clip(c, q[(c, 0.01)], q[(c, 0.99)]).alias(c) for c in _WINS_COLS])


# ----------------------------------------------------------------------------- P8/A7
@register("risk_tier", "WITH " + GERMAN_APPLICANTS_SQL.strip() + """
SELECT applicant_id, credit_amount,
  CAST(CASE WHEN credit_risk = 1 THEN 0
       WHEN credit_risk = 2 AND credit_amount >= """ + quantile_sql("german", "credit_amount", 0.5, "credit_risk = 2")
          + """ THEN 2 WHEN credit_risk = 2 THEN 1 ELSE 0 END AS INTEGER) AS credit_risk
FROM german""")
def q_risk_tier(spark, sf_dir):
    g = german_applicants(spark, sf_dir)
    med = exact_quantiles(g, {"credit_amount": [0.5]}, where=F.col("credit_risk") == 2)[("credit_amount", 0.5)]
    return g.select("applicant_id", "credit_amount", X.german_tier(bad_median=med).cast("int").alias("credit_risk"))


# ----------------------------------------------------------------------------- A11
@register("score_tier", """
SELECT doc_id, CAST(CASE WHEN CAST(n_chars AS DOUBLE) >= """ + quantile_sql("documents", "n_chars", 0.85)
          + " THEN 2 WHEN CAST(n_chars AS DOUBLE) >= " + quantile_sql("documents", "n_chars", 0.6)
          + " THEN 1 ELSE 0 END AS INTEGER) AS tier FROM documents")
def q_score_tier(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    q = exact_quantiles(d, {"n_chars": [0.6, 0.85]})
    return d.select("doc_id", X.percentile_tier(F.col("n_chars").cast("double"), q[("n_chars", 0.6)],
                                                q[("n_chars", 0.85)]).cast("int").alias("tier"))


# ----------------------------------------------------------------------------- F5-F7/R6
def _viol_sql(conds):
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in conds) + ")"


_FRAUD_VIOL = [
    ("step_missing", "step IS NULL"), ("step_range", "step < 1 OR step > 743"),
    ("type_missing", "type IS NULL"),
    ("type_invalid", "type NOT IN ('PAYMENT', 'TRANSFER', 'CASH_OUT', 'DEBIT', 'CASH_IN')"),
    ("amount_missing", "amount IS NULL"), ("amount_not_positive", "amount <= 0"),
] + [(f"{c}_missing", f"{c} IS NULL") if k == 0 else (f"{c}_negative", f"{c} < 0")
     for c in ["oldbalance_org", "newbalance_orig", "oldbalance_dest", "newbalance_dest"] for k in (0, 1)]


@register("validate_fraud", "WITH " + RAW_TRANSACTIONS_SQL.strip() + ",\nfr AS (" + _raw_fraud_snake_sql() + ")\n"
          + "SELECT step, type, amount, " + _viol_sql(_FRAUD_VIOL) + " AS violations, "
          + _viol_sql(_FRAUD_VIOL) + " = '' AS is_valid FROM fr")
def q_validate_fraud(spark, sf_dir):
    df = standardise_column_names(raw_transactions(spark, sf_dir))
    return validate_fraud(df).select("step", "type", "amount", "violations", "is_valid")


_CREDIT_VIOL = []
for _c, _b in [("age", (18, 100)), ("duration_months", (1, 84)), ("credit_amount", "gt0"),
               ("installment_rate", (1, 4)), ("residence_since", (1, 4)), ("existing_credits", (1, 4)),
               ("num_dependents", (1, 2))]:
    _CREDIT_VIOL.append((f"{_c}_missing", f"{_c} IS NULL"))
    if _b == "gt0":
        _CREDIT_VIOL.append((f"{_c}_not_positive", f"{_c} <= 0"))
    else:
        _CREDIT_VIOL.append((f"{_c}_range", f"{_c} < {_b[0]} OR {_c} > {_b[1]}"))
_CREDIT_VIOL += [(f"{c}_missing", f"{c} IS NULL") for c in CREDIT_CATEGORICAL_FEATURES]


@register("validate_credit", "WITH " + RAW_APPLICANTS_SQL.strip() + "\nSELECT age, credit_amount, checking_account, "
          + _viol_sql(_CREDIT_VIOL) + " AS violations, " + _viol_sql(_CREDIT_VIOL) + " = '' AS is_valid FROM applicants")
def q_validate_credit(spark, sf_dir):
    return validate_credit(raw_applicants(spark, sf_dir)).select(
        "age", "credit_amount", "checking_account", "violations", "is_valid")


# ----------------------------------------------------------------------------- M1/M2
def _scaled_sql(source, cols, digits=6):
    parts = []
    for c in cols:
        parts.append(
            f"round((CAST({c} AS DOUBLE) - (SELECT avg(CAST({c} AS DOUBLE)) FROM {source})) / "
            f"coalesce(nullif((SELECT stddev_pop(CAST({c} AS DOUBLE)) FROM {source}), 0), 1), {digits}) AS {c}"
        )
    return ", ".join(parts)


@register("scale_fraud", "WITH " + sql_clean_fraud_ctes().strip() + "\nSELECT "
          + _scaled_sql("clean_fraud", FRAUD_NUMERIC_FEATURES) + ", is_fraud FROM clean_fraud")
def q_scale_fraud(spark, sf_dir):
    clean = clean_fraud_data(raw_transactions(spark, sf_dir))
    fp = fraud_features().fit(clean)
    wide = fp.transform_wide(clean, keep=["is_fraud"])
    return wide.select(*[F.round(c, 6).alias(c) for c in FRAUD_NUMERIC_FEATURES], "is_fraud")


@register("onehot_type", "WITH " + sql_clean_fraud_ctes().strip() + "\nSELECT type, "
          + ", ".join(f"CAST(coalesce(type = '{v}', false) AS DOUBLE) AS type_{v}" for v in FRAUD_TYPE_CATEGORIES)
          + " FROM clean_fraud")
def q_onehot_type(spark, sf_dir):
    clean = clean_fraud_data(raw_transactions(spark, sf_dir))
    return clean.select("type", *[c.alias(n) for n, c in X.type_onehots().items()])


# ----------------------------------------------------------------------------- M3/M4/M6
def _credit_vector_sql():
    nums = [f"round((CAST({c} AS DOUBLE) - (SELECT avg({c}) FROM clean_credit)) / coalesce(nullif((SELECT stddev_pop({c}) "
            f"FROM clean_credit), 0), 1), 6)" for c in CREDIT_NUMERIC_FEATURES]
    return nums


@register("feature_names", "WITH " + sql_clean_credit_ctes().strip() + """,
cats AS (""" + "\nUNION ALL\n".join(f"SELECT DISTINCT '{c}' AS col, {i} AS ci, {c} AS v FROM clean_credit"
                                    for i, c in enumerate(CREDIT_CATEGORICAL_FEATURES)) + """),
names AS (
  """ + "\nUNION ALL\n  ".join(f"SELECT {i} AS pos, '{c}' AS feature_name" for i, c in enumerate(CREDIT_NUMERIC_FEATURES))
          + f"""
  UNION ALL
  SELECT {len(CREDIT_NUMERIC_FEATURES)} - 1 + row_number() OVER (ORDER BY ci, v) AS pos, col || '_' || v AS feature_name
  FROM cats)
SELECT CAST(pos AS INTEGER) AS position, feature_name FROM names""")
def q_feature_names(spark, sf_dir):
    clean = clean_credit_data(raw_applicants(spark, sf_dir))
    names = credit_features().fit(clean).feature_names()
    return spark.createDataFrame(list(enumerate(names)), "position int, feature_name string")


@register("credit_vectors", "WITH " + sql_clean_credit_ctes().strip() + "\nSELECT credit_risk, list_value("
          + ", ".join(_credit_vector_sql()) + ") AS numeric_features, "
          + "(" + " + ".join(f"(SELECT count(DISTINCT {c}) FROM clean_credit)" for c in CREDIT_CATEGORICAL_FEATURES)
          + f" + {len(CREDIT_NUMERIC_FEATURES)}) AS n_features, "
          + " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in CREDIT_CATEGORICAL_FEATURES)
          + " AS n_hot FROM clean_credit")
def q_credit_vectors(spark, sf_dir):
    clean = clean_credit_data(raw_applicants(spark, sf_dir))
    fp = credit_features().fit(clean)
    k = len(CREDIT_NUMERIC_FEATURES)
    out = fp.transform(clean, keep=["credit_risk"], as_vector=False)
    return out.select(
        "credit_risk",
        F.transform(F.slice("features", 1, k), lambda x: F.round(x, 6)).alias("numeric_features"),
        F.size("features").alias("n_features"),
        F.aggregate(F.slice("features", F.lit(k + 1), F.size("features") - F.lit(k)), F.lit(0.0), lambda a, x: a + x).cast("int").alias("n_hot"),
    )


# ----------------------------------------------------------------------------- M7
@register("hash_split", """
WITH o AS (SELECT o_orderkey, o_orderstatus, substr(md5('42|' || CAST(o_orderkey AS VARCHAR)), 1, 15) AS h FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY h) AS rn,
             count(*) OVER (PARTITION BY o_orderstatus) AS n FROM o)
SELECT o_orderkey, o_orderstatus, CASE WHEN rn <= floor(n * CAST(0.2 AS DOUBLE) + 0.5) THEN 'test' ELSE 'train' END AS split
FROM r""")
def q_hash_split(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return stratified_split(o, "o_orderstatus", ["o_orderkey"], test_fraction=0.2, seed=42)


# ----------------------------------------------------------------------------- M9/M10/A8-A10
@register("class_weights", "WITH " + sql_clean_credit_ctes().strip() + """,
c AS (SELECT credit_risk, count(*) AS n FROM clean_credit GROUP BY credit_risk)
SELECT credit_risk, CAST(n AS BIGINT) AS n,
       round(CAST((SELECT sum(n) FROM c) AS DOUBLE) / (CAST((SELECT count(*) FROM c) AS DOUBLE) * CAST(n AS DOUBLE)), 6) AS weight
FROM c""")
def q_class_weights(spark, sf_dir):
    return balanced_class_weights(clean_credit_data(raw_applicants(spark, sf_dir)), "credit_risk")


@register("fraud_pos_weight", "WITH " + sql_clean_fraud_ctes().strip() + """
SELECT CAST(count(*) FILTER (WHERE is_fraud = 1) AS BIGINT) AS n_pos,
       CAST(count(*) FILTER (WHERE is_fraud = 0) AS BIGINT) AS n_neg,
       round(avg(CAST(is_fraud AS DOUBLE)), 6) AS label_rate,
       round(CAST(count(*) FILTER (WHERE is_fraud = 0) AS DOUBLE)
             / CAST(greatest(count(*) FILTER (WHERE is_fraud = 1), 1) AS DOUBLE), 2) AS scale_pos_weight
FROM clean_fraud""")
def q_fraud_pos_weight(spark, sf_dir):
    return positive_class_weight(clean_fraud_data(raw_transactions(spark, sf_dir)), "is_fraud")


@register("category_codes", "WITH " + RAW_TRANSACTIONS_SQL.strip() + """
SELECT step, a.type, nameDest AS name_dest, k.code AS type_code, d.code AS name_dest_code
FROM txn a LEFT JOIN (SELECT nameDest AS name, row_number() OVER (ORDER BY nameDest) - 1 AS code FROM (SELECT DISTINCT nameDest FROM txn)) d ON d.name = a.nameDest
  LEFT JOIN (SELECT type AS name, row_number() OVER (ORDER BY type) - 1 AS code FROM (SELECT DISTINCT type FROM txn WHERE type IS NOT NULL)) k ON k.name = a.type""")
def q_category_codes(spark, sf_dir):
    """M2/M3 for many values: categories numbered as a stored table and joined to the rows."""
    t = raw_transactions(spark, sf_dir).select("step", "type", F.col("nameDest").alias("name_dest"))
    table = store_categories(category_table(t, ["type", "name_dest"]), scratch_path(spark, f"categories-{uuid.uuid4().hex}"))
    return with_codes(t, ["type", "name_dest"], table)
