"""Exact distributed quantiles with linear interpolation (median, P1/P99, P60/P85).

``percentile`` keeps a value->count map for the whole column in one aggregation
buffer, which does not survive a 100 TB column.  Here the exact answer is found
in three bounded steps:

1. one pass computes the non-null count and an approximate bracket
   ``[p - eps, p + eps]`` for every requested (column, p) with ``percentile_approx``;
2. one pass keeps only the rows inside the brackets (about ``4 n / accuracy`` rows
   per bracket, collapsed per distinct value by a partial aggregate) plus one
   count of the rows below each bracket;
3. a window per bracket (one small partition each) turns those counts into exact
   ranks, and only the two rows around the target rank reach the driver.

A bracket that misses its target rank is widened and retried, the last retry
using the whole column, so the answer is always exact.

Interpolation (fixed so that Spark and SQL engines give bit-identical doubles):
``h = (n - 1) * p``; ``lo``/``hi`` are the values at 0-based ranks floor(h)/ceil(h);
result ``lo * (1 - d) + hi * d`` with ``d = h - floor(h)``.  For p = 0.5 this is the
mean of the middle two values.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_ACCURACY = 100_000
# with a known row count the sketch accuracy is chosen so that a bracket holds about this many rows
BRACKET_ROWS = 1_000_000
MIN_ACCURACY, MAX_ACCURACY = 1_000, 1_000_000


def accuracy_for(n_rows: int) -> int:
    """Sketch accuracy giving brackets of ~BRACKET_ROWS rows (4 n / accuracy), within bounds."""
    return int(min(MAX_ACCURACY, max(MIN_ACCURACY, math.ceil(4 * n_rows / BRACKET_ROWS))))


@dataclass(frozen=True)
class _Target:
    key: int
    col: str
    p: float


def interpolate(lo: float, hi: float, d: float) -> float:
    return lo * (1.0 - d) + hi * d


def exact_quantiles(
    df: DataFrame,
    requests: dict[str, list[float]],
    accuracy: int | None = None,
    where: Column | None = None,
    n_rows: int | None = None,
    exact: bool = True,
) -> dict[tuple[str, float], float | None]:
    """Return {(column, p): value} for every requested quantile (None if the column is all-null).

    ``exact=False`` returns ``percentile_approx`` values (one pass, no interpolation).

    ``where`` restricts the rows (e.g. ``credit_risk = 2`` for a conditional median).
    ``n_rows`` (an upper bound on the rows, when the caller knows it) sizes the sketch so
    that brackets stay ~``BRACKET_ROWS`` rows; otherwise the rows are counted first.
    """
    targets = [_Target(i, t[0], float(t[1])) for i, t in enumerate((c, p) for c, pl in requests.items() for p in pl)]
    if not targets:
        return {}
    cols = list(requests)
    base = df if where is None else df.filter(where)
    base = base.select(*[F.col(c).cast("double").alias(c) for c in cols])
    if not exact:
        # one pass, rank error <= n / accuracy: percentile_approx itself
        row = base.agg(*[F.percentile_approx(F.col(t.col), F.lit(t.p), accuracy or DEFAULT_ACCURACY).alias(f"q_{t.key}")
                         for t in targets]).first()
        return {(t.col, t.p): (None if row[f"q_{t.key}"] is None else float(row[f"q_{t.key}"])) for t in targets}
    if accuracy is None:
        # a plain Parquet count is answered from file metadata; a derived frame costs one light pass,
        # far cheaper than a sketch sized for the worst case
        accuracy = accuracy_for(n_rows if n_rows is not None else base.count())

    eps = 2.0 / accuracy
    brackets: dict[int, tuple[float, float] | None] = {}
    aggs = [F.count(F.col(c)).alias(f"n_{i}") for i, c in enumerate(cols)]
    for t in targets:
        lo_p, hi_p = max(0.0, t.p - eps), min(1.0, t.p + eps)
        aggs.append(
            F.percentile_approx(F.col(t.col), F.array(F.lit(lo_p), F.lit(hi_p)), accuracy).alias(f"b_{t.key}")
        )
    row = base.agg(*aggs).first()
    counts = {c: row[f"n_{i}"] for i, c in enumerate(cols)}
    for t in targets:
        b = row[f"b_{t.key}"]
        brackets[t.key] = None if b is None or counts[t.col] == 0 else (float(b[0]), float(b[1]))

    result: dict[tuple[str, float], float | None] = {}
    pending = [t for t in targets if brackets[t.key] is not None]
    for t in targets:
        if brackets[t.key] is None:
            result[(t.col, t.p)] = None

    widen = 1
    while pending:
        ranks = {}
        for t in pending:
            n = counts[t.col]
            h = (n - 1) * t.p
            ranks[t.key] = (math.floor(h), math.ceil(h), h - math.floor(h))
        found = _resolve(base, pending, brackets, ranks)
        still = []
        for t in pending:
            got = found.get(t.key)
            if got is None:
                still.append(t)
            else:
                lo_v, hi_v = got
                result[(t.col, t.p)] = interpolate(lo_v, hi_v, ranks[t.key][2])
        if not still:
            break
        widen *= 16
        if widen > accuracy:
            # final retry: whole column
            row = base.agg(*[F.min(t.col).alias(f"mn_{t.key}") for t in still],
                           *[F.max(t.col).alias(f"mx_{t.key}") for t in still]).first()
            for t in still:
                brackets[t.key] = (float(row[f"mn_{t.key}"]), float(row[f"mx_{t.key}"]))
        else:
            e = eps * widen
            aggs = [
                F.percentile_approx(F.col(t.col), F.array(F.lit(max(0.0, t.p - e)), F.lit(min(1.0, t.p + e))), accuracy)
                .alias(f"b_{t.key}")
                for t in still
            ]
            row = base.agg(*aggs).first()
            for t in still:
                b = row[f"b_{t.key}"]
                brackets[t.key] = (float(b[0]), float(b[1]))
        pending = still
    return result


def _resolve(base: DataFrame, targets, brackets, ranks) -> dict[int, tuple[float, float]]:
    """One pass over ``base``: exact values at the two target ranks inside each bracket."""
    entries = []
    for t in targets:
        lo, hi = brackets[t.key]
        x = F.col(t.col)
        # value inside the bracket -> (key, value); below the bracket -> (key, NULL) = "below" counter
        entries.append(
            F.when(x.isNull() | (x > F.lit(hi)), F.lit(None)).otherwise(
                F.struct(F.lit(t.key).alias("k"), F.when(x >= F.lit(lo), x).alias("v"))
            )
        )
    long = base.select(F.explode(F.array(*entries)).alias("e")).filter(F.col("e").isNotNull()).select("e.k", "e.v")
    counted = long.groupBy("k", "v").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("k").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    cum = counted.withColumn("upto", F.sum("c").over(w)).withColumn("before", F.col("upto") - F.col("c"))
    # rows covering a target rank r satisfy before <= r < upto (ranks counted from 0 incl. the below-rows)
    conds = []
    for t in targets:
        r_lo, r_hi, _ = ranks[t.key]
        conds.append(
            (F.col("k") == t.key)
            & F.col("v").isNotNull()
            & (
                ((F.col("before") <= r_lo) & (F.col("upto") > r_lo))
                | ((F.col("before") <= r_hi) & (F.col("upto") > r_hi))
            )
        )
    hits = cum.filter(_or_all(conds)).select("k", "v", "before", "upto").collect()
    out: dict[int, tuple[float, float]] = {}
    by_key: dict[int, list] = {}
    for h in hits:
        by_key.setdefault(h["k"], []).append(h)
    for t in targets:
        r_lo, r_hi, _ = ranks[t.key]
        lo_v = hi_v = None
        for h in by_key.get(t.key, []):
            if h["before"] <= r_lo < h["upto"]:
                lo_v = h["v"]
            if h["before"] <= r_hi < h["upto"]:
                hi_v = h["v"]
        if lo_v is not None and hi_v is not None:
            out[t.key] = (float(lo_v), float(hi_v))
    return out


def _or_all(conds: list[Column]) -> Column:
    acc = conds[0]
    for c in conds[1:]:
        acc = acc | c
    return acc


def quantile_sql(source: str, col: str, p: float, where: str | None = None) -> str:
    """SQL scalar subquery with the same interpolation, for the DuckDB oracle."""
    cond = f"{col} IS NOT NULL" + (f" AND ({where})" if where else "")
    return (
        "(SELECT max(CASE WHEN rn = fl THEN x END) * (1 - max(d)) + max(CASE WHEN rn = ce THEN x END) * max(d) "
        "FROM (SELECT x, rn, floor(h) AS fl, ceil(h) AS ce, h - floor(h) AS d FROM ("
        f"SELECT CAST({col} AS DOUBLE) AS x, row_number() OVER (ORDER BY {col}) - 1 AS rn, "
        f"CAST(count(*) OVER () - 1 AS DOUBLE) * CAST({p!r} AS DOUBLE) AS h "
        f"FROM {source} WHERE {cond}) q1) q2)"
    )
