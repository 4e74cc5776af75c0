"""Second-order boosting: the fit at the library's settings, its evaluation log, and first splits checked in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.boosting import fit_boosted_trees, round_metrics
from ..operators.quantiles import exact_quantiles, quantile_sql
from ..operators.validation import split_valid, validate_credit, validate_fraud
from ..schemas import CREDIT_CODE_MAPS
from ..session import scratch_path
from ..sources.tables import RAW_TRANSACTIONS_SQL, credit_requests, fraud_requests, raw_transactions
from ..streaming.combined_stream import once
from .catalog import register
from .queries_models import _prepared
from .scoring import Scorer, score_combined
from .training import save_trained, train_credit_model, train_fraud_model

_FEATURES = ["step", "amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest"]
_PROBS = [k / 8 for k in range(1, 8)]


_TRAINED: dict[tuple, object] = {}


def _boosted(spark, sf_dir):
    """300 second-order trees on the SMOTE-balanced train split: fitted once for each input of an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TRAINED:
        _TRAINED[key] = train_fraud_model(_prepared(spark, sf_dir, "fraud"), learner="second_order", version="fraud-second-order")
    return _TRAINED[key]


@register("boost_fit_score")
def q_boost_fit_score(spark, sf_dir):
    """Second-order trees, metrics on the test rows."""
    return _boosted(spark, sf_dir).metrics


@register("boost_rounds")
def q_boost_rounds(spark, sf_dir):
    """M11 evaluation log: PR-AUC and ROC-AUC of the test rows after every tenth tree."""
    return round_metrics(_boosted(spark, sf_dir).model, _prepared(spark, sf_dir, "fraud").test, every=10)


def full_applications(requests):
    """Applications with all inputs of the credit model; those that a request does not carry are picked by its number."""
    extra = {c: F.element_at(F.array(*[F.lit(v) for v in sorted(set(m.values()))]), (F.col("src_id") % len(set(m.values())) + 1).cast("int"))
             for c, m in CREDIT_CODE_MAPS.items() if c not in requests.columns}
    return requests.withColumns(extra | {c: (F.lit(1) + F.col("src_id") * 3 % top).cast("int") for c, top in (
        ("installment_rate", 4), ("residence_since", 4), ("existing_credits", 4), ("num_dependents", 2))})


@register("combined_models")
def q_combined_models(spark, sf_dir):
    """Both models saved and loaded again; valid requests of one id scored by each and joined."""
    base = scratch_path(spark, f"combined-{uuid.uuid4().hex}")
    save_trained(_boosted(spark, sf_dir), f"{base}/fraud")
    save_trained(train_credit_model(_prepared(spark, sf_dir, "credit")), f"{base}/credit")
    fraud, _ = split_valid(validate_fraud(once(fraud_requests(spark, sf_dir))))
    credit, _ = split_valid(validate_credit(full_applications(once(credit_requests(spark, sf_dir)))))
    out = score_combined(Scorer.load(spark, f"{base}/fraud"), Scorer.load(spark, f"{base}/credit"), fraud, credit)
    return out.select("request_id", "fraud.fraud_probability", "fraud.is_fraud", F.col("fraud.model_version").alias("fraud_version"),
                      "credit.credit_tier", "credit.confidence_scores", F.col("credit.model_version").alias("credit_version"))


def _node_sql(node: int, rows: str) -> str:
    """All splits of a node by sums over its rows, and the first of the best."""
    gain = ("(lg * lg / (lh + 1) + (tg - lg) * (tg - lg) / (th - lh + 1) - tg * tg / (th + 1)) / 2")
    return f"""
n{node}_total AS (SELECT sum(g) AS tg, sum(h) AS th FROM {rows}),
n{node}_cells AS (
  SELECT feature, cut, threshold, coalesce(sum(g) FILTER (value < threshold), 0) AS bg, coalesce(sum(h) FILTER (value < threshold), 0) AS bh,
    coalesce(sum(g) FILTER (value IS NULL), 0) AS mg, coalesce(sum(h) FILTER (value IS NULL), 0) AS mh
  FROM (SELECT r.rid, r.g, r.h, f.feature, f.value FROM {rows} r JOIN long f ON f.rid = r.rid) JOIN cuts USING (feature) GROUP BY ALL),
n{node}_ways AS (
  SELECT feature, cut, threshold, ml, bg + ml * mg AS lg, bh + ml * mh AS lh, tg, th FROM n{node}_cells, n{node}_total, (SELECT unnest([0, 1]) AS ml)),
n{node} AS (
  SELECT *, {gain} AS gain FROM n{node}_ways WHERE lh >= 1 AND th - lh >= 1 AND {gain} > 1e-6 ORDER BY gain DESC, ml, feature, cut LIMIT 1),
n{node}_sides AS (
  SELECT r.rid, r.g, r.h, CASE WHEN f.value IS NULL THEN s.ml = 1 ELSE f.value < s.threshold END AS goes_left
  FROM {rows} r, n{node} s, long f WHERE f.rid = r.rid AND f.feature = s.feature),
n{2 * node + 1}_rows AS (SELECT rid, g, h FROM n{node}_sides WHERE goes_left),
n{2 * node + 2}_rows AS (SELECT rid, g, h FROM n{node}_sides WHERE NOT goes_left)"""


def _first_tree_sql() -> str:
    long = "\nUNION ALL ".join(f"SELECT rid, {i} AS feature, CAST({c} AS DOUBLE) AS value FROM fb" for i, c in enumerate(_FEATURES))
    points = "\nUNION ALL ".join(
        f"SELECT {i} AS feature, {quantile_sql('fb', c, p)} AS threshold" for i, c in enumerate(_FEATURES) for p in _PROBS)
    names = ", ".join(f"'{c}'" for c in _FEATURES)
    inner = "\nUNION ALL ".join(
        f"SELECT {k} AS node, [{names}][feature + 1] AS feature, threshold, ml = 1 AS missing_left, round(gain, 6) AS gain, CAST(NULL AS DOUBLE) AS value FROM n{k}" for k in range(3))
    leaves = "\nUNION ALL ".join(
        f"SELECT {k}, NULL, NULL, NULL, NULL, round(-sum(g) / (sum(h) + 1), 9) FROM n{k}_rows HAVING count(*) > 0" for k in range(3, 7))
    early = "\nUNION ALL ".join(
        f"SELECT {k}, NULL, NULL, NULL, NULL, round(-sum(g) / (sum(h) + 1), 9) FROM n{k}_rows HAVING count(*) > 0 AND NOT EXISTS (SELECT 1 FROM n{k})" for k in (1, 2))
    return f"""WITH {RAW_TRANSACTIONS_SQL.strip()},
fb AS (SELECT row_number() OVER () AS rid, *, CASE WHEN isFraud = 1 THEN -0.5 ELSE 0.5 END AS g, 0.25 AS h FROM txn WHERE isFraud IS NOT NULL),
long AS ({long}),
points AS ({points}),
cuts AS (
  SELECT feature, threshold, row_number() OVER (PARTITION BY feature ORDER BY threshold) AS cut
  FROM (SELECT DISTINCT feature, threshold FROM points p WHERE threshold > (SELECT min(value) FROM long l WHERE l.feature = p.feature))),
n0_rows AS (SELECT rid, CAST(g AS DOUBLE) AS g, CAST(h AS DOUBLE) AS h FROM fb),{_node_sql(0, 'n0_rows')},{_node_sql(1, 'n1_rows')},{_node_sql(2, 'n2_rows')}
{inner}
UNION ALL {leaves}
UNION ALL {early}"""


@register("boost_first_tree", _first_tree_sql())
def q_boost_first_tree(spark, sf_dir):
    """M11 split by split: the nodes of a first tree of depth 2 on the transactions as they are (nulls as missing values)."""
    t = raw_transactions(spark, sf_dir).filter("isFraud IS NOT NULL").select(*(F.col(c).cast("double").alias(c) for c in _FEATURES), F.col("isFraud").cast("int").alias("label"))
    points = exact_quantiles(t, {c: _PROBS for c in _FEATURES})
    low = t.agg(*(F.min(c).alias(c) for c in _FEATURES)).first()
    cuts = [sorted({points[c, p] for p in _PROBS if points[c, p] > low[c]}) for c in _FEATURES]
    rows = t.select(F.array(*_FEATURES).alias("features"), "label")
    tree = fit_boosted_trees(rows, cuts=cuts, n_trees=1, max_depth=2, learning_rate=1.0, subsample=1.0, colsample=1.0).trees[0]
    out = []
    for k, f in enumerate(tree.feature):
        if f >= 0:
            out.append((k, _FEATURES[f], tree.threshold[k], bool(tree.missing_left[k]), round(tree.gain[k], 6), None))
        elif k and tree.feature[(k - 1) // 2] >= 0:
            out.append((k, None, None, None, None, round(tree.value[k], 9)))
    return spark.createDataFrame(out, "node int, feature string, threshold double, missing_left boolean, gain double, value double")
