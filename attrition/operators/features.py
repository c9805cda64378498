"""Feature derivation and the lifecycle summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import TARGET_COLUMN
from ..functions.columns import q
from ..functions.features import feature_expressions
from .stats import exact_median

#: The one derived column that needs a value of the whole table.
MEDIAN_FEATURE = "total_charge_log"


def add_domain_features(df: DataFrame, total_charges_median: float | None = None,
                        only: tuple[str, ...] | None = None) -> DataFrame:
    """Append the 42 derived columns, or those named in ``only``, in one projection.

    ``total_charges_median`` fills missing ``TotalCharges`` before the log; it
    defaults to the exact median of this frame (jobs of its own, run only if that
    column is asked for), and a scoring job passes the constant stored at training
    time instead.
    """

    if total_charges_median is None and (only is None or MEDIAN_FEATURE in only):
        total_charges_median = exact_median(df, "TotalCharges")
    return df.selectExpr("*", *[f"{e} AS {q(n)}" for n, e in feature_expressions(total_charges_median)
                                if only is None or n in only])


def tenure_summary(featured: DataFrame) -> DataFrame:
    """Customers and churn rate per tenure band (NULL band dropped), ordered by band label."""

    if TARGET_COLUMN not in featured.columns:
        raise ValueError(f"{TARGET_COLUMN} must be present for tenure summary.")
    return (
        featured.filter(F.col("tenure_band").isNotNull())
        .groupBy("tenure_band")
        .agg(F.count(F.lit(1)).alias("customers"), F.coalesce(F.avg(TARGET_COLUMN), F.lit(0.0)).alias("churn_rate"))
        .orderBy("tenure_band")
    )
