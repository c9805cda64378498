"""Classification metrics, ranking metrics and the threshold sweep.

* ``confusion`` / ``classification_metrics``: one aggregate with four
  ``count_if`` — a single partial-aggregated scan.
* ``score_ranks``: per distinct score, the running positives/negatives at or
  above it.  The running sum is computed without a one-partition window:
  distinct scores are cut into ~equal-count ranges with ``percentile_approx``,
  per-range totals (a few hundred rows) give each range's offset, and a window
  *partitioned by range* adds the local running sum.  A score shared by a
  third of the rows is a single row after the first aggregate, so no range is
  hot.
* ``roc_auc`` / ``average_precision`` / curves: aggregates over ``score_ranks``.
* ``threshold_sweep``: every score is mapped to the highest grid threshold it
  reaches (exact double comparisons), counted once, and suffix sums over the
  91 grid rows give every threshold's confusion matrix — one scan, not 91.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import FALSE_NEGATIVE_COST, FALSE_POSITIVE_COST, SWEEP_FIRST, SWEEP_LAST


def _safe_div(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def metric_columns(tp: Column, fp: Column, fn: Column, tn: Column) -> list[Column]:
    """accuracy, precision, recall, f1 (0 when undefined) from confusion counts."""

    total = tp + fp + fn + tn
    return [
        _safe_div(tp + tn, total).alias("accuracy"),
        _safe_div(tp, tp + fp).alias("precision"),
        _safe_div(tp, tp + fn).alias("recall"),
        _safe_div(tp * 2, tp * 2 + fp + fn).alias("f1"),
    ]


def confusion(df: DataFrame, label: str, score: str, threshold: float | Column) -> DataFrame:
    """One row: true_negative, false_positive, false_negative, true_positive at ``score >= threshold``."""

    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    pred = F.coalesce(F.col(score) >= t, F.lit(False))
    y = F.col(label) == 1
    return df.agg(
        F.count_if(~y & ~pred).alias("true_negative"),
        F.count_if(~y & pred).alias("false_positive"),
        F.count_if(y & ~pred).alias("false_negative"),
        F.count_if(y & pred).alias("true_positive"),
    )


def confusion_cells(df: DataFrame, label: str, score: str, threshold: float) -> DataFrame:
    """Confusion matrix as (actual, predicted, customers) rows; empty cells show 0."""

    c = confusion(df, label, score, threshold)
    return c.select(
        F.inline(F.array(
            F.struct(F.lit(0).alias("actual"), F.lit(0).alias("predicted"), F.col("true_negative").alias("customers")),
            F.struct(F.lit(0).alias("actual"), F.lit(1).alias("predicted"), F.col("false_positive").alias("customers")),
            F.struct(F.lit(1).alias("actual"), F.lit(0).alias("predicted"), F.col("false_negative").alias("customers")),
            F.struct(F.lit(1).alias("actual"), F.lit(1).alias("predicted"), F.col("true_positive").alias("customers")),
        ))
    )


def score_ranks(df: DataFrame, label: str, score: str, ranges: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Per group and distinct score (NULL scores dropped): pos, neg, tp_at (pos with score >= s), fp_at, P, N."""

    by = list(by or [])
    per_score = (
        df.filter(F.col(score).isNotNull())
        .groupBy(*by, F.col(score).cast("double").alias("s"))
        .agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    )
    spark = df.sparkSession
    if ranges is None:
        ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, ranges)
    cuts = []
    if ranges > 1:
        qs = [i / ranges for i in range(1, ranges)]
        got = per_score.agg(F.percentile_approx("s", qs, 10_000).alias("q")).first()["q"] or []
        cuts = sorted(set(float(c) for c in got))
    splits = [float("-inf")] + cuts + [float("inf")]
    bucketed = Bucketizer(splits=splits, inputCol="s", outputCol="_r").transform(per_score)
    # ranges hold consecutive scores; range offsets come from a frame of <= groups x len(splits) rows
    totals = bucketed.groupBy(*by, "_r").agg(F.sum("pos").alias("_rp"), F.sum("neg").alias("_rn"))
    above = Window.partitionBy(*by).orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        *by, "_r",
        F.coalesce(F.sum("_rp").over(above), F.lit(0)).alias("_op"),
        F.coalesce(F.sum("_rn").over(above), F.lit(0)).alias("_on"),
        F.sum("_rp").over(everything).alias("P"),
        F.sum("_rn").over(everything).alias("N"),
    )
    local = Window.partitionBy(*by, "_r").orderBy(F.col("s").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return (
        bucketed.join(F.broadcast(offsets), [*by, "_r"])
        .select(
            *by, "s", "pos", "neg",
            (F.col("_op") + F.sum("pos").over(local)).alias("tp_at"),
            (F.col("_on") + F.sum("neg").over(local)).alias("fp_at"),
            "P", "N",
        )
    )


def ranking_metrics(ranks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per group: roc_auc (ties count half) and pr_auc (average precision, step-wise)."""

    below_neg = F.col("N") - F.col("fp_at")
    return ranks.groupBy(*(by or [])).agg(
        (F.sum(F.col("pos") * (below_neg + F.col("neg") * 0.5)) / (F.first("P") * F.first("N"))).alias("roc_auc"),
        (F.sum(F.col("pos") * F.col("tp_at") / (F.col("tp_at") + F.col("fp_at"))) / F.first("P")).alias("pr_auc"),
    )


def grouped_metrics(df: DataFrame, label: str, score: str, by: list[str], threshold: float = 0.50,
                    fn_cost: int = FALSE_NEGATIVE_COST, fp_cost: int = FALSE_POSITIVE_COST) -> DataFrame:
    """The metric record per group (e.g. per model and fold) from one scan plus the rank frame."""

    t = F.lit(float(threshold))
    pred = F.coalesce(F.col(score) >= t, F.lit(False))
    y = F.col(label) == 1
    c = df.groupBy(*by).agg(
        F.count_if(~y & ~pred).alias("true_negative"),
        F.count_if(~y & pred).alias("false_positive"),
        F.count_if(y & ~pred).alias("false_negative"),
        F.count_if(y & pred).alias("true_positive"),
    )
    r = ranking_metrics(score_ranks(df, label, score, by=by), by)
    tp, fp, fn, tn = (F.col(n) for n in ("true_positive", "false_positive", "false_negative", "true_negative"))
    return c.join(r, by, "left").select(  # one row per group on both sides
        *by,
        F.lit(float(threshold)).alias("threshold"),
        *metric_columns(tp, fp, fn, tn),
        "roc_auc", "pr_auc",
        "true_negative", "false_positive", "false_negative", "true_positive",
        (fn * fn_cost + fp * fp_cost).alias("cost"),
    )


def classification_metrics(df: DataFrame, label: str, score: str, threshold: float = 0.50,
                           fn_cost: int = FALSE_NEGATIVE_COST, fp_cost: int = FALSE_POSITIVE_COST) -> DataFrame:
    """The full metric record at one threshold (one row)."""

    c = confusion(df, label, score, threshold)
    r = ranking_metrics(score_ranks(df, label, score))
    tp, fp, fn, tn = (F.col(n) for n in ("true_positive", "false_positive", "false_negative", "true_negative"))
    return c.crossJoin(r).select(  # 1 row x 1 row
        F.lit(float(threshold)).alias("threshold"),
        *metric_columns(tp, fp, fn, tn),
        "roc_auc", "pr_auc",
        "true_negative", "false_positive", "false_negative", "true_positive",
        (fn * fn_cost + fp * fp_cost).alias("cost"),
    )


def roc_points(ranks: DataFrame) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, plus the (inf, 0, 0) origin."""

    pts = ranks.select(
        F.col("s").alias("threshold"),
        (F.col("fp_at") / F.col("N")).alias("fpr"),
        (F.col("tp_at") / F.col("P")).alias("tpr"),
    )
    origin = ranks.sparkSession.range(1).select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return origin.unionByName(pts)


def pr_points(ranks: DataFrame) -> DataFrame:
    """(threshold, precision, recall) at every distinct score."""

    return ranks.select(
        F.col("s").alias("threshold"),
        (F.col("tp_at") / (F.col("tp_at") + F.col("fp_at"))).alias("precision"),
        (F.col("tp_at") / F.col("P")).alias("recall"),
    )


def _grid_index(p: Column) -> Column:
    """Largest i with double(i)/100 <= p, exactly (floor(p*100) can be off by one)."""

    g = F.floor(p * 100).cast("int")
    step = lambda i: i.cast("double") / F.lit(100.0)
    return (
        F.when(p >= step(g + 1), g + 1)
        .when(p < step(g), g - 1)
        .otherwise(g)
    )


def threshold_sweep(df: DataFrame, label: str, score: str,
                    fn_cost: int = FALSE_NEGATIVE_COST, fp_cost: int = FALSE_POSITIVE_COST,
                    first: int = SWEEP_FIRST, last: int = SWEEP_LAST) -> DataFrame:
    """Metrics at thresholds first/100 .. last/100 (91 rows by default) from one scan."""

    spark = df.sparkSession
    g = F.when(F.col(score).isNull(), F.lit(first - 1)).otherwise(
        F.greatest(F.lit(first - 1), F.least(F.lit(last), _grid_index(F.col(score).cast("double")))))
    counts = (
        df.groupBy(g.alias("g"))
        .agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    )
    grid = spark.range(first - 1, last + 1).select(F.col("id").cast("int").alias("g"))
    # both sides hold at most (last - first + 2) rows
    filled = grid.join(F.broadcast(counts), "g", "left").fillna(0, subset=["pos", "neg"])
    suffix = Window.orderBy(F.col("g").desc()).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cum = filled.select(
        "g",
        F.sum("pos").over(suffix).alias("tp"),
        F.sum("neg").over(suffix).alias("fp"),
        F.sum("pos").over(everything).alias("P"),
        F.sum("neg").over(everything).alias("N"),
    ).filter(F.col("g") >= first)
    tp, fp = F.col("tp"), F.col("fp")
    fn, tn = F.col("P") - tp, F.col("N") - fp
    return cum.select(
        (F.col("g").cast("double") / F.lit(100.0)).alias("threshold"),
        *metric_columns(tp, fp, fn, tn),
        fp.alias("false_positive"),
        fn.alias("false_negative"),
        tp.alias("true_positive"),
        tn.alias("true_negative"),
        (fn * fn_cost + fp * fp_cost).alias("business_cost"),
    )


def best_thresholds(sweep: DataFrame) -> DataFrame:
    """f1-optimal (then recall), accuracy-optimal (then f1), cost-minimising (then recall); lower threshold wins ties."""

    tp, tn, fp, fn = (F.col(c) for c in ("true_positive", "true_negative", "false_positive", "false_negative"))
    acc = (tp + tn).cast("double") / (tp + tn + fp + fn).cast("double")
    t = F.col("threshold")
    return sweep.agg(
        F.max_by(t, F.struct(F.col("f1"), F.col("recall"), -t)).alias("f1_optimal_threshold"),
        F.max_by(t, F.struct(acc, F.col("f1"), -t)).alias("accuracy_optimal_threshold"),
        F.min_by(t, F.struct(F.col("business_cost"), -F.col("recall"), t)).alias("cost_sensitive_threshold"),
        F.min("business_cost").cast("double").alias("minimum_business_cost"),
    )
