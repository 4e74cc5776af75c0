"""Table schemas, feature lists and fixed domain values.

FIXED VALUES: the lists and dictionaries below must equal the reference's values
for results to match (feature order is the model contract, code maps define the
cleaned credit labels, constraints define which scoring rows are accepted).
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES — raw input columns (camelCase fraud, snake_case credit)
# ---------------------------------------------------------------------------
RAW_FRAUD_COLUMNS = {
    "step": "bigint",
    "type": "string",
    "amount": "double",
    "nameOrig": "string",
    "oldbalanceOrg": "double",
    "newbalanceOrig": "double",
    "nameDest": "string",
    "oldbalanceDest": "double",
    "newbalanceDest": "double",
    "isFraud": "bigint",
}

RAW_CREDIT_COLUMNS = {
    "age": "bigint",
    "duration_months": "bigint",
    "credit_amount": "double",
    "installment_rate": "bigint",
    "residence_since": "bigint",
    "existing_credits": "bigint",
    "num_dependents": "bigint",
    "checking_account": "string",
    "credit_history": "string",
    "purpose": "string",
    "savings": "string",
    "employment": "string",
    "housing": "string",
    "job": "string",
    "credit_risk": "bigint",
}

# Headerless space-separated German credit file: column names in file order.
GERMAN_RAW_COLUMNS = [
    "checking_account", "duration_months", "credit_history",
    "purpose", "credit_amount", "savings", "employment",
    "installment_rate", "personal_status", "other_debtors",
    "residence_since", "property", "age", "other_installments",
    "housing", "existing_credits", "job", "num_dependents",
    "telephone", "foreign_worker", "credit_risk",
]

# ---------------------------------------------------------------------------
# FIXED VALUES — feature contract
# ---------------------------------------------------------------------------
FRAUD_NUMERIC_FEATURES = [
    "step", "amount", "oldbalance_org", "newbalance_orig",
    "oldbalance_dest", "newbalance_dest",
    "balance_error_orig", "balance_error_dest", "orig_balance_zeroed",
]
FRAUD_CATEGORICAL_FEATURES = ["type"]
FRAUD_TYPE_CATEGORIES = ["CASH_IN", "CASH_OUT", "DEBIT", "PAYMENT", "TRANSFER"]
FRAUD_FEATURE_COUNT = 14
FRAUD_TARGET = "is_fraud"
FRAUD_CAP_COLUMNS = [
    "amount", "oldbalance_org", "newbalance_orig",
    "oldbalance_dest", "newbalance_dest",
    "balance_error_orig", "balance_error_dest",
]
FRAUD_ID_COLUMNS = ["name_orig", "name_dest"]

CREDIT_NUMERIC_FEATURES = [
    "age", "duration_months", "credit_amount",
    "installment_rate", "residence_since",
    "existing_credits", "num_dependents",
]
CREDIT_CATEGORICAL_FEATURES = [
    "checking_account", "credit_history", "purpose",
    "savings", "employment", "housing", "job",
]
CREDIT_TARGET = "credit_risk"
CREDIT_CAP_COLUMNS = ["credit_amount", "age", "duration_months"]
CREDIT_TIERS = {0: "Good", 1: "Moderate", 2: "Poor"}

# ---------------------------------------------------------------------------
# FIXED VALUES — German credit code maps (unmapped codes keep their value)
# ---------------------------------------------------------------------------
CREDIT_CODE_MAPS = {
    "checking_account": {
        "A11": "< 0 DM", "A12": "0-200 DM", "A13": ">= 200 DM", "A14": "no_account",
    },
    "credit_history": {
        "A30": "no_credits", "A31": "all_paid", "A32": "existing_paid",
        "A33": "delay", "A34": "critical",
    },
    "purpose": {
        "A40": "car", "A41": "car", "A42": "furniture", "A43": "radio/TV",
        "A44": "domestic", "A45": "repairs", "A46": "education",
        "A48": "retraining", "A49": "business", "A410": "vacation",
    },
    "savings": {
        "A61": "< 100 DM", "A62": "100-500 DM", "A63": "500-1000 DM",
        "A64": ">= 1000 DM", "A65": "no_savings",
    },
    "employment": {
        "A71": "unemployed", "A72": "< 1 year", "A73": "1-4 years",
        "A74": "4-7 years", "A75": ">= 7 years",
    },
    "housing": {"A151": "rent", "A152": "own", "A153": "free"},
    "job": {
        "A171": "unemployed", "A172": "unskilled", "A173": "skilled",
        "A174": "highly_skilled",
    },
}

# ---------------------------------------------------------------------------
# FIXED VALUES — scoring-input constraints (inclusive bounds; "gt0" = > 0)
# ---------------------------------------------------------------------------
FRAUD_CONSTRAINTS = {
    "step": (1, 743),
    "amount": "gt0",
    "oldbalance_org": "ge0",
    "newbalance_orig": "ge0",
    "oldbalance_dest": "ge0",
    "newbalance_dest": "ge0",
}
CREDIT_CONSTRAINTS = {
    "age": (18, 100),
    "duration_months": (1, 84),
    "credit_amount": "gt0",
    "installment_rate": (1, 4),
    "residence_since": (1, 4),
    "existing_credits": (1, 4),
    "num_dependents": (1, 2),
}

FRAUD_THRESHOLD = 0.5
DRIFT_THRESHOLD = 0.15
DRIFT_MIN_ROWS = 50
DRIFT_WINDOW_ROWS = 1000

# ---------------------------------------------------------------------------
# Prediction-log tables
# ---------------------------------------------------------------------------
FRAUD_LOG_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("request_id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("step", T.IntegerType()),
    T.StructField("transaction_type", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("oldbalance_org", T.DoubleType()),
    T.StructField("newbalance_orig", T.DoubleType()),
    T.StructField("oldbalance_dest", T.DoubleType()),
    T.StructField("newbalance_dest", T.DoubleType()),
    T.StructField("fraud_probability", T.DoubleType(), False),
    T.StructField("is_fraud", T.BooleanType(), False),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("model_version", T.StringType()),
])

CREDIT_LOG_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("request_id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("age", T.IntegerType()),
    T.StructField("duration_months", T.IntegerType()),
    T.StructField("credit_amount", T.DoubleType()),
    T.StructField("employment", T.StringType()),
    T.StructField("purpose", T.StringType()),
    T.StructField("credit_tier", T.StringType(), False),
    T.StructField("confidence_good", T.DoubleType()),
    T.StructField("confidence_moderate", T.DoubleType()),
    T.StructField("confidence_poor", T.DoubleType()),
    T.StructField("model_version", T.StringType()),
])


def ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"`{k}` {v}" for k, v in columns.items())
