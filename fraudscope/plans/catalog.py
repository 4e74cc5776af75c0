"""Query catalog: every registered query as (Spark job, equivalent DuckDB SQL).

Each Spark callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole driver tables (or data Spark derives from them).  The SQL strings compute
the same result in DuckDB; computed columns carry the same aliases on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.quantiles import quantile_sql
from ..schemas import CREDIT_CODE_MAPS, FRAUD_CAP_COLUMNS
from ..sources.tables import (
    RAW_APPLICANTS_SQL,
    RAW_TRANSACTIONS_SQL,
    raw_applicants,
    raw_transactions,
)

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        _Q[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return deco


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_SQL)


def _load_all():
    # importing the modules registers their queries
    from . import (  # noqa: F401
        queries_boost,
        queries_clean,
        queries_drift,
        queries_features,
        queries_metrics,
        queries_misc,
        queries_models,
        queries_profiles,
        queries_sources,
        queries_streams,
    )


# ---------------------------------------------------------------------------
# Shared SQL fragments
# ---------------------------------------------------------------------------
def sql_clean_fraud_ctes() -> str:
    """CTEs ending in ``clean_fraud`` (the I5 result) on top of the txn view."""
    med = {c: quantile_sql("fd", c, 0.5) for c in
           ["step", "amount", "oldbalance_org", "newbalance_orig", "oldbalance_dest", "newbalance_dest"]}
    caps = ",\n".join(
        f"CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest({c}, {quantile_sql('fder', c, 0.01)}), "
        f"{quantile_sql('fder', c, 0.99)}) END AS {c}"
        for c in FRAUD_CAP_COLUMNS
    )
    return f"""
{RAW_TRANSACTIONS_SQL.strip()},
fr AS (SELECT step, type, amount, nameOrig AS name_orig, oldbalanceOrg AS oldbalance_org,
              newbalanceOrig AS newbalance_orig, nameDest AS name_dest, oldbalanceDest AS oldbalance_dest,
              newbalanceDest AS newbalance_dest, isFraud AS is_fraud FROM txn),
fd AS (SELECT DISTINCT * FROM fr),
fk AS (SELECT * FROM fd WHERE is_fraud IS NOT NULL),
fimp AS (
  SELECT coalesce(CAST(step AS DOUBLE), {med['step']}) AS step,
         coalesce(type, (SELECT type FROM fk WHERE type IS NOT NULL GROUP BY type
                         ORDER BY count(*) DESC, type LIMIT 1)) AS type,
         coalesce(amount, {med['amount']}) AS amount,
         coalesce(oldbalance_org, {med['oldbalance_org']}) AS oldbalance_org,
         coalesce(newbalance_orig, {med['newbalance_orig']}) AS newbalance_orig,
         coalesce(oldbalance_dest, {med['oldbalance_dest']}) AS oldbalance_dest,
         coalesce(newbalance_dest, {med['newbalance_dest']}) AS newbalance_dest,
         CAST(is_fraud AS INTEGER) AS is_fraud
  FROM fk),
fder AS (SELECT *, abs(oldbalance_org - amount - newbalance_orig) AS balance_error_orig,
                abs(oldbalance_dest + amount - newbalance_dest) AS balance_error_dest,
                CAST(newbalance_orig = 0 AS INTEGER) AS orig_balance_zeroed FROM fimp),
clean_fraud AS (
  SELECT step, type, {caps}, is_fraud, orig_balance_zeroed FROM fder)
"""


def _sql_code_map(col: str) -> str:
    whens = " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in CREDIT_CODE_MAPS[col].items())
    return f"CASE {whens} ELSE {col} END"


def sql_clean_credit_ctes() -> str:
    """CTEs ending in ``clean_credit`` (the I6 result) on top of the applicants view."""
    numeric = ["age", "duration_months", "credit_amount", "installment_rate", "residence_since",
               "existing_credits", "num_dependents"]
    cats = list(CREDIT_CODE_MAPS)
    imp = ",\n".join(f"coalesce(CAST({c} AS DOUBLE), {quantile_sql('cd', c, 0.5)}) AS {c}" for c in numeric)
    catfill = ",\n".join(f"coalesce({c}, 'unknown') AS {c}" for c in cats)
    caps = {
        c: f"CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest({c}, {quantile_sql('cf', c, 0.01)}), "
        f"{quantile_sql('cf', c, 0.99)}) END"
        for c in ["credit_amount", "age", "duration_months"]
    }
    out_cols = ",\n".join(
        [f"{caps[c]} AS {c}" if c in caps else c for c in numeric]
        + [f"{_sql_code_map(c)} AS {c}" for c in cats]
        + ["CAST(credit_risk AS INTEGER) AS credit_risk"]
    )
    return f"""
{RAW_APPLICANTS_SQL.strip()},
cd AS (SELECT DISTINCT * FROM applicants),
ci AS (SELECT {imp}, {catfill}, credit_risk FROM cd WHERE credit_risk IS NOT NULL),
cf AS (SELECT * FROM ci WHERE age >= 18 AND credit_amount > 0),
clean_credit AS (SELECT {out_cols} FROM cf)
"""


__all__ = ["queries", "oracle_sql", "register", "raw_transactions", "raw_applicants"]
