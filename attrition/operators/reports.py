"""Report and work-queue queries over the result tables.

All are filters, projections, partial-aggregated group-bys and bounded top-k
(``orderBy().limit(n)`` plans as TakeOrderedAndProject: each task keeps n rows).
The local-explanation lookups are left joins on ``customerID``; explanation
tables hold one row per explained customer, so the join is a shuffle join by
key unless the optimizer sees a small side (AQE converts it at run time).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (
    COMPARISON_COLUMNS,
    ID_COLUMN,
    PROFILE_FIELDS,
    QUEUE_COLUMNS,
    RISK_TIERS,
    TARGET_COLUMN,
)
from ..functions.text import fixed, markdown_row, percent

#: Derived columns that a profile shows.
PROFILE_FEATURES = ("tenure_band", "total_active_services")


def risk_tier_counts(decisions: DataFrame) -> DataFrame:
    """Customers per tier in the fixed order low, medium, high; an absent tier has a NULL count."""

    spark = decisions.sparkSession
    tiers = spark.createDataFrame([(i, t) for i, t in enumerate(RISK_TIERS)], "tier_order int, risk_tier string")
    counts = decisions.groupBy("risk_tier").agg(F.count(F.lit(1)).alias("customers"))
    return tiers.join(F.broadcast(counts), "risk_tier", "left").orderBy("tier_order").drop("tier_order")


def action_counts(decisions: DataFrame) -> DataFrame:
    return (
        decisions.groupBy("recommended_action").agg(F.count(F.lit(1)).alias("customers"))
        .orderBy(F.col("customers").desc(), "recommended_action")
    )


def tier_action_counts(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("risk_tier", "recommended_action").agg(F.count(F.lit(1)).alias("customers"))


def headline_counts(decisions: DataFrame) -> DataFrame:
    return decisions.agg(
        F.count_if(F.col("risk_tier") == "high").alias("high_risk_customers"),
        F.count_if(F.col("risk_tier") == "medium").alias("medium_risk_customers"),
        F.count_if(F.col("intervention_candidate")).alias("intervention_candidates"),
    )


def work_queue(decisions: DataFrame, tier: str = "high", candidates_only: bool = True) -> DataFrame:
    q = decisions
    if tier != "all":
        q = q.filter(F.col("risk_tier") == tier)
    if candidates_only:
        q = q.filter(F.col("intervention_candidate"))
    return q.select(*QUEUE_COLUMNS).orderBy(F.col("churn_probability").desc(), ID_COLUMN)


def customer_profiles(decisions: DataFrame, customer_id: str | None = None) -> DataFrame:
    """Profile fields, action, rationale and label text for one customer (or all when id is None)."""

    d = decisions if customer_id is None else decisions.filter(F.col(ID_COLUMN) == customer_id)
    return d.select(
        ID_COLUMN,
        "churn_probability",
        "risk_tier",
        "recommended_action",
        "recommendation_rationale",
        "MonthlyCharges",
        *PROFILE_FIELDS,
        F.when(F.col(TARGET_COLUMN) == 1, F.lit("Churn")).otherwise(F.lit("No churn")).alias("actual_label"),
    )


def customer_detail(profiles: DataFrame, shap_local: DataFrame, lime_local: DataFrame) -> DataFrame:
    """Profile plus local explanations; either explanation may be missing."""

    s = shap_local.select(ID_COLUMN, "top_shap_drivers")
    l_ = lime_local.select(ID_COLUMN, "lime_explanation")
    return profiles.join(s, ID_COLUMN, "left").join(l_, ID_COLUMN, "left")


def driver_items(local: DataFrame, text_col: str = "top_shap_drivers") -> DataFrame:
    """One row per explanation item, with its position."""

    return local.select(ID_COLUMN, F.posexplode(F.split(F.col(text_col), "; ")).alias("position", "driver"))


def top_models(comparison: DataFrame, n: int = 7, metric: str = "cv_pr_auc_mean") -> DataFrame:
    return comparison.orderBy(F.col(metric).desc(), "model").limit(n)


def top_drivers(importance: DataFrame, n: int = 15) -> DataFrame:
    """Top-n global drivers, re-sorted ascending for a bar chart."""

    top = importance.orderBy(F.col("mean_abs_shap").desc(), "feature").limit(n)
    return top.orderBy(F.col("mean_abs_shap").asc(), F.col("feature").desc())


def comparison_table(comparison: DataFrame) -> DataFrame:
    """The 11 comparison columns with metrics as 3-decimal text, best CV PR-AUC first."""

    ordered = comparison.orderBy(F.col("cv_pr_auc_mean").desc(), "model")
    return ordered.select("model", *[fixed(c).alias(c) for c in COMPARISON_COLUMNS[1:]])


def threshold_table(sweep: DataFrame, best: DataFrame, default: float = 0.50) -> DataFrame:
    """Sweep rows at 0.50 and the three optimal thresholds, accuracy recomputed, formatted."""

    b = best.select(F.array(
        F.lit(default), F.round("f1_optimal_threshold", 2), F.round("accuracy_optimal_threshold", 2),
        F.round("cost_sensitive_threshold", 2)).alias("keep"))
    tp, tn, fp, fn = (F.col(c) for c in ("true_positive", "true_negative", "false_positive", "false_negative"))
    picked = sweep.crossJoin(F.broadcast(b)).filter(F.array_contains("keep", F.round("threshold", 2)))  # b: 1 row
    return picked.select(
        "threshold",
        ((tp + tn).cast("double") / (tp + tn + fp + fn).cast("double")).alias("accuracy"),
        "precision", "recall", "f1", "false_positive", "false_negative", "business_cost",
    ).orderBy("threshold").select(
        fixed("threshold").alias("threshold"), fixed("accuracy").alias("accuracy"),
        fixed("precision").alias("precision"), fixed("recall").alias("recall"), fixed("f1").alias("f1"),
        "false_positive", "false_negative", "business_cost",
    )


def metric_lines(sweep: DataFrame) -> DataFrame:
    """Wide -> long: (threshold, metric, value) for precision, recall and f1."""

    return sweep.unpivot("threshold", ["precision", "recall", "f1"], "metric", "value")


def lifecycle_labels(lifecycle: DataFrame) -> DataFrame:
    return lifecycle.select("tenure_band", "customers", "churn_rate", percent("churn_rate").alias("churn_rate_label"))


def lifecycle_table(lifecycle: DataFrame) -> DataFrame:
    return lifecycle.select("tenure_band", "customers", fixed("churn_rate").alias("churn_rate"))


def drivers_table(importance: DataFrame, n: int = 10) -> DataFrame:
    top = importance.orderBy(F.col("mean_abs_shap").desc(), "feature").limit(n)
    return top.select("feature", fixed("mean_abs_shap").alias("mean_abs_shap"))


def sample_explanations(local: DataFrame, n: int = 5, prob: str = "churn_probability") -> DataFrame:
    """The first explanations in order of risk."""

    return local.orderBy(F.col(prob).desc(), ID_COLUMN).limit(n)


def markdown_table(table: DataFrame, *order: F.Column) -> DataFrame:
    """``line, markdown``: header, separator and the rows of a report table; none for an empty table."""

    line = F.row_number().over(Window.orderBy(*order)).cast("int")  # report-sized
    rows = table.select((line + 2).alias("line"), markdown_row(*table.columns).alias("markdown"))
    head = table.limit(1).select(F.explode(F.array(
        F.struct(F.lit(1).alias("line"), F.lit("| " + " | ".join(table.columns) + " |").alias("markdown")),
        F.struct(F.lit(2).alias("line"), F.lit("| " + " | ".join(["---"] * len(table.columns)) + " |").alias("markdown")),
    )).alias("h")).select("h.line", "h.markdown")
    return head.unionByName(rows)


def markdown_rows(table: DataFrame) -> DataFrame:
    """Each row of a (text) table as one Markdown table line."""

    return table.select(markdown_row(*table.columns).alias("markdown"))
