"""Scoring-input validation: every row gets its list of violated rules.

Rows are never dropped here; ``split_valid`` returns the accepted rows and a
quarantine table with the reasons, the batch equivalent of rejecting a request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import CREDIT_CATEGORICAL_FEATURES, CREDIT_CONSTRAINTS, FRAUD_CONSTRAINTS, FRAUD_TYPE_CATEGORIES

# FIXED VALUES: accepted transaction types (request enum order)
TRANSACTION_TYPES = ["PAYMENT", "TRANSFER", "CASH_OUT", "DEBIT", "CASH_IN"]


def _rules(constraints: dict) -> list[tuple[str, Column]]:
    rules = []
    for c, bound in constraints.items():
        # NaN is a missing number: it passes no bound
        x = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        rules.append((f"{c}_missing", x.isNull()))
        if bound == "gt0":
            rules.append((f"{c}_not_positive", x <= 0))
        elif bound == "ge0":
            rules.append((f"{c}_negative", x < 0))
        else:
            lo, hi = bound
            rules.append((f"{c}_range", (x < lo) | (x > hi)))
    return rules


def fraud_rules() -> list[tuple[str, Column]]:
    rules = _rules({"step": FRAUD_CONSTRAINTS["step"]})
    rules += [("type_missing", F.col("type").isNull()), ("type_invalid", ~F.col("type").isin(*TRANSACTION_TYPES))]
    rules += _rules({k: v for k, v in FRAUD_CONSTRAINTS.items() if k != "step"})
    return rules


def credit_rules() -> list[tuple[str, Column]]:
    rules = _rules(CREDIT_CONSTRAINTS)
    rules += [(f"{c}_missing", F.col(c).isNull()) for c in CREDIT_CATEGORICAL_FEATURES]
    return rules


def with_violations(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Add ``violations`` (comma-separated rule names, '' if none) and ``is_valid``."""
    v = F.concat_ws(",", *[F.when(cond, F.lit(name)) for name, cond in rules])
    return df.withColumn("violations", v).withColumn("is_valid", F.col("violations") == F.lit(""))


def validate_fraud(df: DataFrame) -> DataFrame:
    return with_violations(df, fraud_rules())


def validate_credit(df: DataFrame) -> DataFrame:
    return with_violations(df, credit_rules())


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows without the helper columns, rejected rows with their reasons)."""
    valid = validated.filter(F.col("is_valid")).drop("violations", "is_valid")
    rejected = validated.filter(~F.col("is_valid")).drop("is_valid")
    return valid, rejected


assert sorted(TRANSACTION_TYPES) == sorted(FRAUD_TYPE_CATEGORIES)
