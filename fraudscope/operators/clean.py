"""Fraud and credit cleaning as fit / transform objects.

Order of the steps (it changes results, so it is kept exactly):

fraud   snake_case -> exact de-dup (ids included) -> numeric medians on ALL de-duplicated
        rows -> drop NULL target -> categorical modes on the kept rows -> derived balance
        features from unclipped values -> 1 %/99 % caps -> drop id columns
credit  snake_case -> de-dup -> numeric medians -> drop NULL target -> categorical
        NULL -> "unknown" -> drop age < 18 -> drop amount <= 0 -> caps -> code maps

``fit`` runs a few small aggregation jobs (null counts, exact medians, modes, exact
quantiles) over a stored de-duplicated table and keeps the results as plain
numbers.  ``transform`` is a single lazy plan: one shuffle for the de-dup, then
projections and filters with the fitted numbers inlined as literals, so Catalyst
keeps it inside whole-stage codegen.  The fitted numbers can be saved and
re-applied to a stream or a scoring batch.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions.names import missing_columns, standardise_column_names
from ..schemas import (
    CREDIT_CAP_COLUMNS,
    CREDIT_CATEGORICAL_FEATURES,
    CREDIT_CODE_MAPS,
    CREDIT_NUMERIC_FEATURES,
    CREDIT_TARGET,
    FRAUD_CAP_COLUMNS,
    FRAUD_ID_COLUMNS,
    FRAUD_TARGET,
)
from ..session import scratch_path
from .quantiles import exact_quantiles
from .stats import column_modes

_NUMERIC = ("double", "float", "bigint", "int", "smallint", "tinyint", "decimal")


def _is_numeric(dtype: str) -> bool:
    return dtype.startswith(_NUMERIC)


@dataclass
class CleanStats:
    medians: dict[str, float] = field(default_factory=dict)
    fills: dict[str, str] = field(default_factory=dict)
    caps: dict[str, list[float]] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> "CleanStats":
        return CleanStats(**json.loads(text))


@dataclass
class CleanSpec:
    target: str
    categorical_fill: str | None  # None -> mode, else the constant
    cap_columns: list[str]
    derived: dict[str, Column] = field(default_factory=dict)
    row_filters: list[tuple[str, Column]] = field(default_factory=list)
    drop_columns: list[str] = field(default_factory=list)
    code_maps: dict[str, dict[str, str]] = field(default_factory=dict)
    output_casts: dict[str, str] = field(default_factory=dict)
    lower_pct: float = 0.01
    upper_pct: float = 0.99
    exact: bool = True  # False: medians and caps from percentile_approx (one pass each)


class Cleaner:
    """Fit the cleaning statistics on one table; apply them to any table of the same shape."""

    def __init__(self, spec: CleanSpec):
        self.spec = spec
        self.stats: CleanStats | None = None

    # -- plan pieces ------------------------------------------------------------
    def _dedup(self, df: DataFrame) -> DataFrame:
        named = standardise_column_names(df)
        # NaN counts as missing throughout, so it becomes NULL once, before rows are compared
        floats = {c: F.nanvl(F.col(c), F.lit(None).cast(t)) for c, t in named.dtypes if t in ("double", "float")}
        return (named.withColumns(floats) if floats else named).dropDuplicates()

    def _impute(self, df: DataFrame, stats: CleanStats) -> DataFrame:
        t = self.spec.target
        kept = df.filter(F.col(t).isNotNull())
        fills = {}
        for c, m in stats.medians.items():
            fills[c] = F.coalesce(F.col(c).cast("double"), F.lit(float(m)))
        for c, v in stats.fills.items():
            fills[c] = F.coalesce(F.col(c), F.lit(v))
        return kept.withColumns(fills) if fills else kept

    def _after_impute(self, df: DataFrame) -> DataFrame:
        for _, cond in self.spec.row_filters:
            df = df.filter(cond)
        if self.spec.derived:
            df = df.withColumns(self.spec.derived)
        return df

    def _finish(self, df: DataFrame, stats: CleanStats) -> DataFrame:
        clipped = {c: X.clip(c, lo, hi) for c, (lo, hi) in stats.caps.items() if c in df.columns}
        if clipped:
            df = df.withColumns(clipped)
        drops = [c for c in self.spec.drop_columns if c in df.columns]
        if drops:
            df = df.drop(*drops)
        maps = {c: X.code_map(c, m) for c, m in self.spec.code_maps.items() if c in df.columns}
        if maps:
            df = df.withColumns(maps)
        casts = {c: F.col(c).cast(t) for c, t in self.spec.output_casts.items() if c in df.columns}
        return df.withColumns(casts) if casts else df

    # -- fit / transform ------------------------------------------------------------
    def fit(self, raw: DataFrame, keep_cache: bool = False) -> "Cleaner":
        """Fit on ``raw``.  The de-duplicated rows are stored once in the shared folder: every statistic reads its own columns of that table, no executor
        memory is held, and a lost executor reads again instead of shuffling again.  With ``keep_cache`` ``fit_transform`` reads it too."""
        spec = self.spec
        path = scratch_path(raw.sparkSession, f"clean-{uuid.uuid4().hex}")
        dedup = self._dedup(raw)
        dedup.write.parquet(path)
        dedup = raw.sparkSession.read.schema(dedup.schema).parquet(path)
        ok = False
        try:
            types = dict(dedup.dtypes)
            categorical = [c for c in dedup.columns if types[c] == "string"]
            # one pass (it also fills the cache): row count, NULLs per column, and NULLs of the
            # categorical columns among the rows that keep their target (the rows modes are fitted on)
            keep = F.col(spec.target).isNotNull()
            row = dedup.agg(
                F.count(F.lit(1)).alias("__n"),
                *[F.count_if(F.col(c).isNull()).alias(f"n_{i}") for i, c in enumerate(dedup.columns)],
                *[F.count_if(F.col(c).isNull() & keep).alias(f"k_{i}") for i, c in enumerate(categorical)],
            ).first()
            n_rows = int(row["__n"])
            nulls = {c: int(row[f"n_{i}"]) for i, c in enumerate(dedup.columns)}
            cat_nulls = {c: int(row[f"k_{i}"]) for i, c in enumerate(categorical)}
            stats = CleanStats(counts={"rows_deduplicated": n_rows})
            numeric = [c for c in dedup.columns if _is_numeric(types[c]) and c != spec.target]
            with_nulls = [c for c in numeric if nulls[c] > 0]
            if with_nulls:
                q = exact_quantiles(dedup, {c: [0.5] for c in with_nulls}, n_rows=n_rows, exact=spec.exact)
                stats.medians = {c: q[(c, 0.5)] for c in with_nulls if q[(c, 0.5)] is not None}
            kept = dedup.filter(keep)
            if spec.categorical_fill is None:
                need = [c for c in categorical if cat_nulls[c] > 0]
                modes = column_modes(kept, need)
                stats.fills = {c: v for c, v in modes.items() if v is not None}
            else:
                stats.fills = {c: spec.categorical_fill for c in categorical if nulls[c] > 0}
            shaped = self._after_impute(self._impute(dedup, stats))
            caps = [c for c in spec.cap_columns if c in shaped.columns]
            if caps:
                q = exact_quantiles(shaped, {c: [spec.lower_pct, spec.upper_pct] for c in caps}, n_rows=n_rows,
                                    exact=spec.exact)
                stats.caps = {
                    c: [q[(c, spec.lower_pct)], q[(c, spec.upper_pct)]]
                    for c in caps
                    if q[(c, spec.lower_pct)] is not None
                }
            stats.counts.update({"null_" + c: n for c, n in nulls.items() if n > 0})
            self.stats = stats
            ok = True
        finally:
            self._cached = dedup if ok and keep_cache else None
        return self

    def transform(self, raw: DataFrame) -> DataFrame:
        if self.stats is None:
            raise RuntimeError("Cleaner is not fitted")
        df = self._dedup(raw)
        return self._finish(self._after_impute(self._impute(df, self.stats)), self.stats)

    def fit_transform(self, raw: DataFrame) -> DataFrame:
        """Fit and clean the same table, reading the de-duplicated rows that the fit has stored."""
        self.fit(raw, keep_cache=True)
        return self._finish(self._after_impute(self._impute(self._cached, self.stats)), self.stats)

    def release(self) -> None:
        """Forget the stored de-duplicated rows kept by ``fit_transform``."""
        self._cached = None


def fraud_cleaner(lower_pct: float = 0.01, upper_pct: float = 0.99, exact: bool = True) -> Cleaner:
    return Cleaner(
        CleanSpec(
            target=FRAUD_TARGET,
            categorical_fill=None,
            cap_columns=list(FRAUD_CAP_COLUMNS),
            derived=X.derived_balance_columns(),
            drop_columns=list(FRAUD_ID_COLUMNS),
            output_casts={
                "step": "double", "amount": "double", "oldbalance_org": "double", "newbalance_orig": "double",
                "oldbalance_dest": "double", "newbalance_dest": "double", FRAUD_TARGET: "int",
            },
            lower_pct=lower_pct,
            upper_pct=upper_pct,
            exact=exact,
        )
    )


def credit_cleaner(lower_pct: float = 0.01, upper_pct: float = 0.99, exact: bool = True) -> Cleaner:
    casts = {c: "double" for c in CREDIT_NUMERIC_FEATURES}
    casts[CREDIT_TARGET] = "int"
    return Cleaner(
        CleanSpec(
            target=CREDIT_TARGET,
            categorical_fill="unknown",
            cap_columns=list(CREDIT_CAP_COLUMNS),
            row_filters=[
                ("age_under_18", F.col("age") >= 18),
                ("credit_amount_not_positive", F.col("credit_amount") > 0),
            ],
            code_maps=dict(CREDIT_CODE_MAPS),
            output_casts=casts,
            lower_pct=lower_pct,
            upper_pct=upper_pct,
            exact=exact,
        )
    )


def clean_fraud_data(raw: DataFrame) -> DataFrame:
    """Full fraud cleaning (fit on this table, apply to it)."""
    miss = missing_columns(standardise_column_names(raw), [FRAUD_TARGET])
    if miss:
        raise ValueError(f"Missing required columns: {miss}")
    return fraud_cleaner().fit_transform(raw)


def clean_credit_data(raw: DataFrame) -> DataFrame:
    """Full credit cleaning."""
    miss = missing_columns(standardise_column_names(raw), [CREDIT_TARGET, "age", "credit_amount"])
    if miss:
        raise ValueError(f"Missing required columns: {miss}")
    return credit_cleaner().fit_transform(raw)


def credit_feature_order(df: DataFrame) -> DataFrame:
    cols = CREDIT_NUMERIC_FEATURES + CREDIT_CATEGORICAL_FEATURES + [CREDIT_TARGET]
    return df.select(*cols)


def dedup_counters(df: DataFrame, target: str) -> DataFrame:
    """A1/A3 counters in one shuffle: raw rows, distinct rows, duplicates, NULL-target rows, kept rows.

    ``groupBy(all columns)`` is the de-duplication itself (NULLs compare equal);
    its partial aggregate collapses a hot duplicated row before the shuffle.
    """
    g = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(
        F.sum("_n").cast("long").alias("rows_raw"),
        F.count(F.lit(1)).cast("long").alias("rows_deduplicated"),
        (F.sum("_n") - F.count(F.lit(1))).cast("long").alias("duplicates_removed"),
        F.count_if(F.col(target).isNull()).cast("long").alias("null_target_removed"),
        F.count_if(F.col(target).isNotNull()).cast("long").alias("rows_clean"),
    )
