"""Cleaning queries: I5/I6 and the operators they are made of."""

from __future__ import annotations

from ..operators.clean import clean_credit_data, clean_fraud_data
from ..sources.tables import raw_applicants, raw_transactions
from .catalog import register, sql_clean_credit_ctes, sql_clean_fraud_ctes


@register("clean_fraud", "WITH " + sql_clean_fraud_ctes().strip() + "\nSELECT * FROM clean_fraud")
def q_clean_fraud(spark, sf_dir):
    return clean_fraud_data(raw_transactions(spark, sf_dir))


@register("clean_credit", "WITH " + sql_clean_credit_ctes().strip() + "\nSELECT * FROM clean_credit")
def q_clean_credit(spark, sf_dir):
    return clean_credit_data(raw_applicants(spark, sf_dir))
