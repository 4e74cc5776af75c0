"""Column expressions shared by batch cleaning, scoring and streaming.

All are built-in Spark SQL functions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import CREDIT_TIERS, FRAUD_TYPE_CATEGORIES


def c(name_or_col) -> Column:
    return F.col(name_or_col) if isinstance(name_or_col, str) else name_or_col


def balance_error_orig(old="oldbalance_org", amount="amount", new="newbalance_orig") -> Column:
    return F.abs(c(old) - c(amount) - c(new))


def balance_error_dest(old="oldbalance_dest", amount="amount", new="newbalance_dest") -> Column:
    return F.abs(c(old) + c(amount) - c(new))


def orig_balance_zeroed(new="newbalance_orig") -> Column:
    return (c(new) == F.lit(0.0)).cast("int")


def derived_balance_columns() -> dict[str, Column]:
    """The three derived fraud features, computed from unclipped values."""
    return {
        "balance_error_orig": balance_error_orig(),
        "balance_error_dest": balance_error_dest(),
        "orig_balance_zeroed": orig_balance_zeroed(),
    }


def clip(col, lower: float | None, upper: float | None) -> Column:
    """Winsorise; NULL stays NULL (``least``/``greatest`` alone would turn NULL into a bound)."""
    x = c(col)
    out = x
    if lower is not None:
        out = F.greatest(out, F.lit(float(lower)))
    if upper is not None:
        out = F.least(out, F.lit(float(upper)))
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(out)


def code_map(col, mapping: dict[str, str]) -> Column:
    """Dictionary map with pass-through for unmapped codes (and NULL kept)."""
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.coalesce(F.try_element_at(m, c(col)), c(col))


def german_tier(risk="credit_risk", amount="credit_amount", bad_median: float | None = None) -> Column:
    """good(1) -> 0; bad(2) with amount >= bad-class median -> 2; other bad -> 1; else 0."""
    return (
        F.when(c(risk) == 1, F.lit(0))
        .when((c(risk) == 2) & (c(amount) >= F.lit(bad_median)), F.lit(2))
        .when(c(risk) == 2, F.lit(1))
        .otherwise(F.lit(0))
    )


def percentile_tier(score, p_low: float, p_high: float) -> Column:
    """0 below the low cut, 1 between, 2 at or above the high cut."""
    return F.when(c(score) >= F.lit(p_high), F.lit(2)).when(c(score) >= F.lit(p_low), F.lit(1)).otherwise(F.lit(0))


def fraud_flag(prob, threshold: float) -> Column:
    """Flag on the UNROUNDED probability."""
    return c(prob) >= F.lit(float(threshold))


def round4(col) -> Column:
    return F.round(c(col), 4)


def tier_name(idx) -> Column:
    out = None
    for k, v in CREDIT_TIERS.items():
        out = F.when(c(idx) == k, F.lit(v)) if out is None else out.when(c(idx) == k, F.lit(v))
    return out.otherwise(F.lit("Poor"))


def confidence_map(p_good, p_moderate, p_poor) -> Column:
    return F.create_map(
        F.lit("Good"), round4(p_good), F.lit("Moderate"), round4(p_moderate), F.lit("Poor"), round4(p_poor)
    )


def type_onehots(col="type", prefix="type_") -> dict[str, Column]:
    """Locked one-hot for the five transaction types; unknown/NULL -> all zeros."""
    return {f"{prefix}{v}": F.coalesce((c(col) == F.lit(v)).cast("double"), F.lit(0.0)) for v in FRAUD_TYPE_CATEGORIES}
