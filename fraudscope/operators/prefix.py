"""Running sums in key order without a single-partition window.

``cumulative`` takes a table already reduced to one row per distinct key (for a
score table that is ``groupBy(score)``, so a hot score that holds a third of all
rows is one row here) and returns every row with inclusive running sums of the
measure columns plus the next key in order — optionally within groups (one
curve per class, one ECDF per column).

Plan: cut points from ``percentile_approx`` split the keys into ordered buckets;
running sums and ``lead`` are computed with a window partitioned by (group,
bucket), so each bucket is one bounded task; the per-(group, bucket) totals form
a table with one row per bucket whose exclusive prefix sums and "first key of
the next bucket" are joined back by broadcast (its size is the bucket count,
capped by ``MAX_BUCKETS`` per group).  Only that small table is ordered per group.
With a single bucket the running window is already global and no join is made.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 2_000_000
MAX_BUCKETS = 100_000


GRID = 1024  # cut-point grid sketched together with the row count when the count is unknown


def _splits_from(cuts: list[float], n_buckets: int) -> list[float]:
    if n_buckets <= 1 or not cuts:
        return [-math.inf, math.inf]
    step = len(cuts) / n_buckets
    picked = [cuts[min(len(cuts) - 1, int(round(i * step)) - 1)] for i in range(1, n_buckets)]
    return [-math.inf] + sorted({float(x) for x in picked}) + [math.inf]


def _bucket_splits(df: DataFrame, key: str, n_rows: int | None, rows_per_bucket: int) -> tuple[list[float], int]:
    """Ordered bucket boundaries; with an unknown row count, count and sketch share one pass."""
    if n_rows is None:
        probs = [i / GRID for i in range(1, GRID)]
        row = df.agg(F.count(F.lit(1)).alias("n"),
                     F.percentile_approx(F.col(key), probs, 10 * GRID).alias("c")).first()
        n_rows = int(row["n"])
        n_buckets = min(GRID, max(1, math.ceil(n_rows / rows_per_bucket)))
        return _splits_from(list(row["c"] or []), n_buckets), n_rows
    n_buckets = min(MAX_BUCKETS, max(1, math.ceil(n_rows / rows_per_bucket)))
    if n_buckets <= 1:
        return [-math.inf, math.inf], n_rows
    probs = [i / n_buckets for i in range(1, n_buckets)]
    cuts = df.agg(F.percentile_approx(F.col(key), probs, 10 * n_buckets).alias("c")).first()["c"]
    return [-math.inf] + sorted({float(x) for x in cuts}) + [math.inf], n_rows


def cumulative(
    df: DataFrame,
    key: str,
    measures: list[str],
    descending: bool = False,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    n_rows: int | None = None,
    groups: list[str] | None = None,
) -> DataFrame:
    """Add ``cum_<m>`` (inclusive running sum in key order) and ``next_<key>`` columns.

    ``descending=True`` orders from the largest key down (score curves).
    ``key`` must be unique per row within a group and non-NULL.
    """
    groups = list(groups or [])
    kd = "_kd"
    base = df.withColumn(kd, (-F.col(key) if descending else F.col(key)).cast("double"))
    splits, n_rows = _bucket_splits(base, kd, n_rows, rows_per_bucket)
    if len(splits) <= 2:
        w = Window.partitionBy(*groups).orderBy(kd) if groups else Window.orderBy(kd)
        run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return base.withColumns(
            {f"cum_{m}": F.sum(m).over(run) for m in measures} | {f"next_{key}": F.lead(key).over(w)}
        ).drop(kd)

    bucketed = Bucketizer(splits=splits, inputCol=kd, outputCol="_b").transform(base)
    bucketed = bucketed.withColumn("_b", F.col("_b").cast("int"))
    w_in = Window.partitionBy(*groups, "_b").orderBy(kd)
    w_run = w_in.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = bucketed.withColumns(
        {f"_run_{m}": F.sum(m).over(w_run) for m in measures} | {"_lead": F.lead(key).over(w_in)}
    )
    totals = bucketed.groupBy(*groups, "_b").agg(
        *[F.sum(m).alias(f"_tot_{m}") for m in measures],
        F.min_by(F.col(key), F.col(kd)).alias("_first"),
    )
    w_all = Window.partitionBy(*groups).orderBy("_b") if groups else Window.orderBy("_b")
    w_prev = w_all.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *groups, "_b",
        *[F.coalesce(F.sum(f"_tot_{m}").over(w_prev), F.lit(0)).alias(f"_off_{m}") for m in measures],
        F.lead("_first").over(w_all).alias("_next_first"),
    )
    # ungrouped: one row per bucket (<= MAX_BUCKETS), a proven bound -> broadcast hint.  Grouped:
    # buckets x groups has no static bound, so AQE decides from the measured size.
    joined = local.join(offsets if groups else F.broadcast(offsets), [*groups, "_b"])
    out = joined.withColumns(
        {f"cum_{m}": F.col(f"_off_{m}") + F.col(f"_run_{m}") for m in measures}
        | {f"next_{key}": F.coalesce(F.col("_lead"), F.col("_next_first"))}
    )
    drop = [kd, "_b", "_lead", "_next_first"] + [f"_run_{m}" for m in measures] + [f"_off_{m}" for m in measures]
    return out.drop(*drop)
