"""Turning model outputs into prediction rows.

Model-agnostic: the fraud side needs one probability column, the credit side
three class-probability columns.  The fraud flag is taken on the UNROUNDED
probability and only the reported value is rounded to 4 places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..schemas import FRAUD_THRESHOLD


def finalize_fraud(df: DataFrame, prob: Column | str, threshold: float = FRAUD_THRESHOLD,
                   model_version: str = "unknown") -> DataFrame:
    p = F.col(prob) if isinstance(prob, str) else prob
    return df.withColumns({
        "is_fraud": X.fraud_flag(p, threshold),
        "fraud_probability": X.round4(p),
        "threshold": F.lit(float(threshold)),
        "model_version": F.lit(model_version),
    })


def argmax3(p0: Column, p1: Column, p2: Column) -> Column:
    """Index of the largest probability; ties go to the lower index."""
    return F.when((p0 >= p1) & (p0 >= p2), F.lit(0)).when(p1 >= p2, F.lit(1)).otherwise(F.lit(2))


def finalize_credit(df: DataFrame, p0: str, p1: str, p2: str, model_version: str = "unknown",
                    with_map: bool = True) -> DataFrame:
    a, b, c = F.col(p0), F.col(p1), F.col(p2)
    cols = {
        "credit_class": argmax3(a, b, c),
        "confidence_good": X.round4(a),
        "confidence_moderate": X.round4(b),
        "confidence_poor": X.round4(c),
        "model_version": F.lit(model_version),
    }
    out = df.withColumns(cols).withColumn("credit_tier", X.tier_name(F.col("credit_class")))
    if with_map:
        out = out.withColumn("confidence_scores", X.confidence_map(a, b, c))
    return out


def combine(fraud_scored: DataFrame, credit_scored: DataFrame, key: str = "request_id") -> DataFrame:
    """One row per request with both results nested as structs.

    A plain equi-join on the request key; Catalyst/AQE pick broadcast only when a
    side's measured size is under the threshold, otherwise a shuffle join.
    """
    f = fraud_scored.select(key, F.struct("fraud_probability", "is_fraud", "threshold", "model_version").alias("fraud"))
    c = credit_scored.select(key, F.struct("credit_tier", "confidence_scores", "model_version").alias("credit"))
    return f.join(c, key, "inner")


def assign_request_ids(df: DataFrame, source_key: list[str] | None = None) -> DataFrame:
    """Request id per row.

    With a source key the id is a deterministic UUID-formatted md5 of it, so a
    recomputed or replayed partition (stream retry, lost executor) gets the same
    ids; without one ``uuid()`` is used and the caller must persist before reuse.
    """
    if source_key:
        # each value with its length, NULL with a mark of its own: no two keys share a form
        parts = [F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-"))
                 for v in (F.col(k).cast("string") for k in source_key)]
        h = F.md5(F.concat_ws("|", *parts))
        rid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                          F.substring(h, 17, 4), F.substring(h, 21, 12))
    else:
        rid = F.expr("uuid()")
    return df.withColumn("request_id", rid)
