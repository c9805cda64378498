"""Standard frames over the driver's tables: raw view -> clean -> features -> scored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import TARGET_COLUMN
from ..operators.clean import clean_dataset
from ..operators.features import MEDIAN_FEATURE, add_domain_features
from ..session import cut_lineage
from ..sources.telco import DIRTY_SQL, SCORE_SQL_EXPR, telco_raw

#: What the fixture score reads.
SCORE_COLUMNS = ("Contract", "tenure", "InternetService")


def clean_customers(spark: SparkSession, sf_dir: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    return clean_dataset(telco_raw(spark, sf_dir), columns=columns)


def featured_customers(spark: SparkSession, sf_dir: str, only: tuple[str, ...] | None = None,
                       columns: tuple[str, ...] | None = None) -> DataFrame:
    """Clean + features (those in ``only``, or all).

    Where the median is needed, the cleaned table is written once and the median reads its one column.
    """

    clean = clean_customers(spark, sf_dir, columns)
    if only is None or MEDIAN_FEATURE in only:
        clean = cut_lineage(clean)
    return add_domain_features(clean, only=only)


def dirty_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned ``DIRTY_SQL``: the customers and rows derived from them that a source may hold."""

    telco_raw(spark, sf_dir)
    return clean_dataset(spark.sql(DIRTY_SQL), order_col="copy_number")


def fixture_score() -> F.Column:
    """The deterministic fixture probability, as a column over the customer columns."""

    return F.expr(SCORE_SQL_EXPR)


def scored_customers(spark: SparkSession, sf_dir: str, only: tuple[str, ...] = (),
                     columns: tuple[str, ...] | None = None) -> DataFrame:
    """Customers (with the features in ``only``) and the fixture probability as ``churn_probability``."""

    return featured_customers(spark, sf_dir, only, columns).withColumn("churn_probability", fixture_score())


def labelled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(customerID, Churn, churn_probability): the input of every metric query."""

    return scored_customers(spark, sf_dir, columns=SCORE_COLUMNS).select("customerID", TARGET_COLUMN, "churn_probability")
