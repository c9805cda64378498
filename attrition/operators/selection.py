"""Model comparison, ranking and selection over metric tables.

Inputs are small tables (one row per model and fold); everything here is a
group-by, a join on the model name, or a bounded ``orderBy().limit()``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import PR_AUC_TOLERANCE, TREE_MODEL_TOKENS

CV_METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc")
TEST_FIELDS = ("threshold", "accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc",
               "true_negative", "false_positive", "false_negative", "true_positive", "cost")


def comparison_table(fold_metrics: DataFrame, test_metrics: DataFrame, model_col: str = "model") -> DataFrame:
    """One row per model: cv_<metric>_mean / _std (population std over folds) and test_<field>."""

    aggs = []
    for m in CV_METRICS:
        aggs += [F.avg(m).alias(f"cv_{m}_mean"), F.stddev_pop(m).alias(f"cv_{m}_std")]
    cv = fold_metrics.groupBy(model_col).agg(*aggs)
    test = test_metrics.select(model_col, *[F.col(f).alias(f"test_{f}") for f in TEST_FIELDS])
    return cv.join(test, model_col, "inner")


def top_by_cv(comparison: DataFrame, n: int = 3, metric: str = "cv_pr_auc_mean") -> DataFrame:
    return comparison.orderBy(F.col(metric).desc(), "model").limit(n)


def select_model(comparison: DataFrame, tolerance: float = PR_AUC_TOLERANCE) -> DataFrame:
    """Within ``tolerance`` of the best CV PR-AUC, prefer test accuracy, CV accuracy, CV f1, CV PR-AUC."""

    best = comparison.agg(F.max("cv_pr_auc_mean").alias("_best"))
    near = comparison.crossJoin(F.broadcast(best)).filter(  # best: 1 row
        F.col("cv_pr_auc_mean") >= F.col("_best") - F.lit(tolerance))
    return near.orderBy(
        F.col("test_accuracy").desc(), F.col("cv_accuracy_mean").desc(), F.col("cv_f1_mean").desc(),
        F.col("cv_pr_auc_mean").desc(), "model",
    ).limit(1).select("model")


def explainer_choice(comparison: DataFrame, tokens=TREE_MODEL_TOKENS) -> DataFrame:
    """Best CV PR-AUC among models whose name has a tree token, else the best overall."""

    is_tree = F.lit(False)
    for t in tokens:
        is_tree = is_tree | F.col("model").contains(t)
    return comparison.orderBy(is_tree.desc(), F.col("cv_pr_auc_mean").desc(), "model").limit(1).select("model")
