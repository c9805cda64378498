"""Streaming scoring: customer records arriving as files -> clean -> features -> score -> decide.

Cleaning, features (with the training-time ``TotalCharges`` median as a
constant) and decisions are row-local, so the batch functions run unchanged
on a streaming DataFrame.  One customer is kept once: with an order column its first
copy by that order (``first_copy.first_copies``), as in the batch; else the first record
seen.  With an event time the state is bounded by the watermark
(``dropDuplicatesWithinWatermark``); without one, which is for finite inputs, it
holds every id.  Fitted Spark ML models transform
streaming frames directly, with no join.  The sink gives each micro-batch a
folder of its own and overwrites it, so a replayed batch leaves the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..constants import ID_COLUMN, TARGET_COLUMN
from ..functions.columns import q
from ..functions.decisions import recommendation, risk_tier
from ..functions.features import feature_expressions
from ..operators.clean import clean_expressions, label_expression
from .first_copy import first_copies


def clean_stream(raw: DataFrame, event_time: str | None = None, watermark: str = "1 day",
                 order_col: str | None = None) -> DataFrame:
    """Row-local cleaning plus streaming de-duplication on the customer id.

    ``order_col`` (with ``event_time``) says which copy is the first, whenever it arrives; it isn't returned.
    """

    typed = raw.selectExpr(*clean_expressions(raw))
    if order_col:
        if event_time is None:
            raise ValueError("the first copy by order needs an event time")
        typed = first_copies(typed, ID_COLUMN, order_col, event_time, watermark)
    elif event_time:
        typed = typed.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark([ID_COLUMN])
    else:
        typed = typed.dropDuplicates([ID_COLUMN])
    labelled = typed.filter(F.col(TARGET_COLUMN).isNotNull())
    return labelled.selectExpr(*[q(c) if c != TARGET_COLUMN else label_expression() for c in typed.columns])


def decide_stream(clean: DataFrame, total_charges_median: float, score_sql: str, threshold: float) -> DataFrame:
    """Features, score (a SQL expression over the customer columns) and decision columns."""

    featured = clean.selectExpr("*", *[f"{e} AS {q(n)}" for n, e in feature_expressions(total_charges_median)])
    scored = featured.selectExpr("*", f"CAST({score_sql} AS DOUBLE) AS churn_probability")
    return scored.selectExpr(
        "*",
        f"{risk_tier('churn_probability')} AS risk_tier",
        f"coalesce(churn_probability >= {float(threshold)!r}D, FALSE) AS intervention_candidate",
        f"{recommendation()} AS _rec",
    ).selectExpr("*", "_rec.action AS recommended_action", "_rec.rationale AS recommendation_rationale").drop("_rec")


def score_with_model(featured: DataFrame, fitted, threshold: float) -> DataFrame:
    """Decisions from a fitted model (preparation + Spark ML model) on a streaming frame."""

    from ..operators.decisions import add_decision_outputs
    return add_decision_outputs(fitted.predict(featured, keep=tuple(featured.columns)), threshold)


def write_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def start_parquet_sink(decisions: DataFrame, path: str, checkpoint: str, trigger_once: bool = True) -> StreamingQuery:
    """Each micro-batch to ``path/batch_id=n``; a replayed batch replaces its own folder."""

    writer = decisions.writeStream.foreachBatch(lambda batch, batch_id: write_batch(batch, batch_id, path)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if trigger_once else writer
    return writer.start()


def start_complete_sink(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A running aggregate: the whole table again with each micro-batch."""

    writer = counts.writeStream.outputMode("complete").foreachBatch(
        lambda batch, _: batch.write.mode("overwrite").parquet(path))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tier_counts_stream(decisions: DataFrame) -> DataFrame:
    """Running customers per risk tier (complete-mode aggregate over the decision stream)."""

    return decisions.groupBy("risk_tier").agg(F.count(F.lit(1)).alias("customers"))


def read_customer_stream(spark: SparkSession, source_dir: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(source_dir)
