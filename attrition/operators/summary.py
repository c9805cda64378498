"""Dataset summary record (one aggregate over the cleaned table)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import TARGET_COLUMN, TEST_SIZE
from ..functions.features import feature_expressions


def dataset_summary(clean: DataFrame, raw_columns: int, source: str, test_size: float = TEST_SIZE) -> DataFrame:
    """Counts of the cleaned table; features are row-local, so they add columns and no rows."""

    n = F.count(F.lit(1))
    y = F.col(TARGET_COLUMN)
    test_rows = F.ceil(F.lit(float(test_size)) * n.cast("double"))
    return clean.agg(
        F.lit(source).alias("source"),
        n.alias("rows"),
        F.lit(len(set(clean.columns) | {n for n, _ in feature_expressions(None)})).alias("columns_after_feature_engineering"),
        F.lit(int(raw_columns)).alias("raw_columns"),
        F.avg(y.cast("double")).alias("churn_rate"),
        F.count_if(y == 0).alias("non_churn_customers"),
        F.count_if(y == 1).alias("churn_customers"),
        (n - test_rows).alias("train_rows"),
        test_rows.alias("test_rows"),
    )
