"""Decision outputs: probability -> tier, intervention flag, action and rationale.

A pure projection over the scored table (no join, no shuffle); the threshold
is a scalar, usually the cost-sensitive one from the sweep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.columns import lit, q
from ..functions.decisions import recommendation, risk_tier


def add_decision_outputs(scored: DataFrame, threshold: float, probability_col: str = "churn_probability") -> DataFrame:
    p = f"CAST({q(probability_col)} AS DOUBLE)"
    rec = recommendation()
    cols = [q(c) for c in scored.columns if c != probability_col]
    return scored.selectExpr(*cols, f"{p} AS churn_probability", f"{rec} AS _rec").selectExpr(
        *cols,
        "churn_probability",
        f"{risk_tier('churn_probability')} AS risk_tier",
        f"coalesce(churn_probability >= {lit(float(threshold))}, FALSE) AS intervention_candidate",
        "_rec.action AS recommended_action",
        "_rec.rationale AS recommendation_rationale",
    )
