"""Evaluation-metric queries (H1-H11) on scored rows derived from the driver tables."""

from __future__ import annotations

from ..operators import metrics as M
from ..sources.tables import SCORED_DOCUMENTS_SQL, SCORED_LINEITEMS_SQL, scored_documents, scored_lineitems
from .catalog import register

_CURVE_SQL = """,
g AS (SELECT p AS score, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY p),
c AS (SELECT score, pos, neg,
        sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
        sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp FROM g)"""


def _binary_sql(threshold: float = 0.5) -> str:
    return "WITH " + SCORED_DOCUMENTS_SQL.strip() + _CURVE_SQL + f""",
a AS (SELECT sum(pos) AS P, sum(neg) AS N,
        sum(pos * (CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE))) AS ap_num,
        sum(neg * (CAST(tp AS DOUBLE) - CAST(pos AS DOUBLE) / 2)) AS auc_num,
        sum(CASE WHEN score >= {threshold!r} THEN pos ELSE 0 END) AS tp_t,
        sum(CASE WHEN score >= {threshold!r} THEN neg ELSE 0 END) AS fp_t FROM c)
SELECT round(ap_num / CAST(P AS DOUBLE), 4) AS pr_auc,
       round(auc_num / (CAST(P AS DOUBLE) * CAST(N AS DOUBLE)), 4) AS roc_auc,
       round(coalesce(CAST(2 * tp_t AS DOUBLE) / nullif(CAST(tp_t + fp_t + P AS DOUBLE), 0), 0), 4) AS f1_score,
       round(2 * (auc_num / (CAST(P AS DOUBLE) * CAST(N AS DOUBLE))) - 1, 4) AS gini_coefficient
FROM a"""


@register("binary_metrics", _binary_sql())
def q_binary_metrics(spark, sf_dir):
    """H1-H4, H11 (fraud row): AP, ROC-AUC, F1 at 0.5, Gini."""
    return M.fraud_metric_row(scored_documents(spark, sf_dir), "y", "p", threshold=0.5)


@register("pr_curve", "WITH " + SCORED_DOCUMENTS_SQL.strip() + _CURVE_SQL + """
SELECT score AS threshold, round(CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE), 6) AS precision,
       round(CAST(tp AS DOUBLE) / CAST((SELECT sum(pos) FROM g) AS DOUBLE), 6) AS recall FROM c
UNION ALL SELECT NULL, 1.0, 0.0""")
def q_pr_curve(spark, sf_dir):
    """precision/recall per distinct threshold plus the terminal point."""
    return M.pr_curve(scored_documents(spark, sf_dir), "y", "p")


_CM_SQL = "WITH " + SCORED_LINEITEMS_SQL.strip() + """,
labs AS (SELECT actual AS l FROM scored3 UNION SELECT predicted FROM scored3),
cnt AS (SELECT actual, predicted, count(*) AS n FROM scored3 GROUP BY actual, predicted),
cm AS (SELECT a.l AS actual, b.l AS predicted, CAST(coalesce(cnt.n, 0) AS BIGINT) AS count
       FROM labs a CROSS JOIN labs b LEFT JOIN cnt ON cnt.actual = a.l AND cnt.predicted = b.l)"""


@register("confusion", _CM_SQL + "\nSELECT actual, predicted, count FROM cm")
def q_confusion(spark, sf_dir):
    """H8: confusion matrix with zero cells."""
    return M.confusion_matrix(scored_lineitems(spark, sf_dir), "actual", "predicted")


_REPORT_CTES = _CM_SQL + """,
pa AS (SELECT actual AS label, sum(CASE WHEN actual = predicted THEN count ELSE 0 END) AS tp, sum(count) AS support
       FROM cm GROUP BY actual),
pp AS (SELECT predicted AS label, sum(count) AS pred_n FROM cm GROUP BY predicted),
per AS (SELECT pa.label, tp, support,
          coalesce(CAST(tp AS DOUBLE) / nullif(CAST(pred_n AS DOUBLE), 0), 0) AS precision,
          coalesce(CAST(tp AS DOUBLE) / nullif(CAST(support AS DOUBLE), 0), 0) AS recall
        FROM pa JOIN pp ON pa.label = pp.label),
per2 AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM per),
rep AS (
  SELECT CAST(label AS VARCHAR) AS label, precision, recall, f1 AS f1_score, CAST(support AS BIGINT) AS support FROM per2
  UNION ALL SELECT 'accuracy', NULL, NULL, CAST(sum(tp) AS DOUBLE) / CAST(sum(support) AS DOUBLE),
                   CAST(sum(support) AS BIGINT) FROM per2
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM per2
  UNION ALL SELECT 'weighted avg', sum(precision * support) / CAST(sum(support) AS DOUBLE),
                   sum(recall * support) / CAST(sum(support) AS DOUBLE),
                   sum(f1 * support) / CAST(sum(support) AS DOUBLE), CAST(sum(support) AS BIGINT) FROM per2)"""


@register("class_report", _REPORT_CTES + """
SELECT label, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1_score, 4) AS f1_score, support
FROM rep""")
def q_class_report(spark, sf_dir):
    """H9: per-class precision/recall/F1/support plus accuracy, macro and weighted rows."""
    return M.classification_report(scored_lineitems(spark, sf_dir), "actual", "predicted")


@register("f1_multiclass", _REPORT_CTES + """
SELECT round(max(CASE WHEN label = 'weighted avg' THEN f1_score END), 4) AS weighted_f1,
       round(max(CASE WHEN label = 'macro avg' THEN f1_score END), 4) AS macro_f1,
       round(coalesce(max(CASE WHEN label = '1' THEN f1_score END), 0), 4) AS binary_f1
FROM rep""")
def q_f1_multiclass(spark, sf_dir):
    """H4-H6: weighted and macro F1 (and F1 of label 1)."""
    return M.f1_scores(scored_lineitems(spark, sf_dir), "actual", "predicted")


def _gini_one(cls: int) -> str:
    return f"""
SELECT '{cls}' AS class_label, round(coalesce(2 * (auc_num / (CAST(P AS DOUBLE) * CAST(N AS DOUBLE))) - 1, 0), 4) AS gini
FROM (SELECT sum(pos) AS P, sum(neg) AS N, sum(neg * (CAST(tp AS DOUBLE) - CAST(pos AS DOUBLE) / 2)) AS auc_num FROM (
  SELECT pos, neg, sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp FROM (
    SELECT p{cls} AS score, sum(CASE WHEN actual = {cls} THEN 1 ELSE 0 END) AS pos,
           sum(CASE WHEN actual = {cls} THEN 0 ELSE 1 END) AS neg FROM scored3 GROUP BY p{cls}) g) c) a"""


@register("gini_per_class", "WITH " + SCORED_LINEITEMS_SQL.strip() + "\n"
          + "\nUNION ALL\n".join(_gini_one(c) for c in (0, 1, 2)))
def q_gini_per_class(spark, sf_dir):
    """H7: one-vs-rest Gini per class (undefined -> 0.0)."""
    return M.gini_per_class(scored_lineitems(spark, sf_dir), "actual", {0: "p0", 1: "p1", 2: "p2"})
