"""Whole-table statistics: null counts, modes, value counts, label rates.

Every function is one aggregation job whose result is bounded by the number of
columns or classes, so only that small row reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_counts(df: DataFrame, cols: list[str] | None = None) -> dict[str, int]:
    """One pass: number of NULL (and NaN for floating columns) values per column."""
    cols = cols or df.columns
    types = dict(df.dtypes)
    aggs = []
    for c in cols:
        miss = F.col(c).isNull()
        if types[c] in ("double", "float"):
            miss = miss | F.isnan(F.col(c))
        aggs.append(F.count_if(miss).alias(c))
    row = df.agg(*aggs).first()
    return {c: int(row[c]) for c in cols}


def null_summary(df: DataFrame) -> DataFrame:
    """(column, null_count) for columns with at least one NULL or NaN, as a DataFrame (A2)."""
    pairs = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    floats = {c for c, t in df.dtypes if t in ("double", "float")}
    missing = {c: F.col(c).isNull() | F.isnan(c) if c in floats else F.col(c).isNull() for c in df.columns}
    counts = df.agg(*[F.count_if(m).alias(c) for c, m in missing.items()])
    return counts.selectExpr(f"stack({len(df.columns)}, {pairs}) AS (column_name, null_count)").filter(
        F.col("null_count") > 0
    )


def column_modes(df: DataFrame, cols: list[str]) -> dict[str, str | None]:
    """Most frequent non-NULL value per column; ties go to the smallest value.

    One shuffle of (column, value) pairs with map-side partial counts, so a hot
    value that holds a third of the rows is collapsed before the shuffle.  The
    per-column maximum table has one row per column, which bounds its broadcast.
    """
    if not cols:
        return {}
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols])
    ).alias("e")
    long = df.select(pairs).select("e.c", "e.v").filter(F.col("v").isNotNull())
    counts = long.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("c").agg(F.max("n").alias("m"))
    modes = (
        counts.join(F.broadcast(best), "c")
        .filter(F.col("n") == F.col("m"))
        .groupBy("c")
        .agg(F.min("v").alias("mode"))
        .collect()
    )
    out = {c: None for c in cols}
    out.update({r["c"]: r["mode"] for r in modes})
    return out


def value_counts(df: DataFrame, col: str, name: str = "count") -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).cast("bigint").alias(name))


def label_rate(df: DataFrame, label: str, name: str = "label_rate") -> DataFrame:
    return df.agg(F.avg(F.col(label).cast("double")).alias(name))
