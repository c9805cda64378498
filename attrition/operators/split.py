"""Keyed, repeatable stratified hold-out split and cross-validation folds.

Rows are ordered inside their class by ``md5(id || seed)``.  The exact rank in
that order is computed without a per-class single-task window: md5 is uniform,
so the first hex digits cut each class into equal-sized ranges; the sizes of the
ranges give each range's offset (Spark broadcasts the offsets only while they are few),
and ``row_number`` runs per (class, range), on the shuffle that met the offsets.  The class counts decide how many of each class go to the
hold-out (largest-remainder allocation), and ``rank % k`` spreads the training
rows of each class evenly over k folds.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CV_FOLDS, ID_COLUMN, RANDOM_STATE, TARGET_COLUMN, TEST_SIZE


#: Rows of a range that one task ranks.
RANGE_ROWS = 50_000


def md5_key(key: str, seed: int) -> F.Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))


def stratified_rank(df: DataFrame, label: str = TARGET_COLUMN, key: str = ID_COLUMN,
                    seed: int = RANDOM_STATE, rank_col: str = "_rank", rows: int | None = None) -> DataFrame:
    """Add the 0-based position of each row inside its class, ordered by md5(id || seed).

    ``rows``: of the table, if known; the number of ranges follows from it.
    """

    prefix_digits = _prefix_digits(df.count() if rows is None else rows)
    h = md5_key(key, seed)
    tagged = df.withColumn("_h", h).withColumn("_hb", F.substring("_h", 1, prefix_digits))
    sizes = tagged.groupBy(label, "_hb").agg(F.count(F.lit(1)).alias("_n"))
    # what stands before a range: before its coarse range, and inside that; no window is longer than the root of the ranges
    sizes = sizes.withColumn("_hc", F.substring("_hb", 1, (prefix_digits + 1) // 2))
    before = Window.partitionBy(label).orderBy("_hc").rowsBetween(Window.unboundedPreceding, -1)
    coarse = sizes.groupBy(label, "_hc").agg(F.sum("_n").alias("_n")).select(
        label, "_hc", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_c"))
    within = Window.partitionBy(label, "_hc").orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    fine = sizes.select(label, "_hc", "_hb", F.coalesce(F.sum("_n").over(within), F.lit(0)).alias("_f"))
    offsets = fine.join(coarse, [label, "_hc"]).select(label, "_hb", (F.col("_c") + F.col("_f")).alias("_off"))
    local = Window.partitionBy(label, "_hb").orderBy("_h", key)
    return (
        tagged.join(offsets, [label, "_hb"])
        .withColumn(rank_col, F.col("_off") + F.row_number().over(local) - 1)
        .drop("_h", "_hb", "_off")
    )


def _prefix_digits(rows: int) -> int:
    """So many hex digits that a range has about ``RANGE_ROWS`` rows at most."""

    return max(1, math.ceil(math.log(max(1, rows / RANGE_ROWS), 16)))


def _by_largest_remainder(counts: list[int], draws: int) -> list[int]:
    """Split ``draws`` over classes proportionally; leftovers go to the largest remainders."""

    total = sum(counts)
    continuous = [draws * c / total for c in counts]
    floored = [math.floor(x) for x in continuous]
    need = draws - sum(floored)
    order = sorted(range(len(counts)), key=lambda i: (-(continuous[i] - floored[i]), i))
    for i in order[:need]:
        floored[i] += 1
    return floored


def holdout_sizes(class_counts: dict, test_size: float = TEST_SIZE) -> dict:
    """Per class, how many rows go to the hold-out (test) side."""

    labels = sorted(class_counts)
    counts = [class_counts[k] for k in labels]
    n = sum(counts)
    n_test = math.ceil(test_size * n)
    n_train = n - n_test
    train = _by_largest_remainder(counts, n_train)
    rest = [c - t for c, t in zip(counts, train)]
    test = _by_largest_remainder(rest, n_test)
    return {k: t for k, t in zip(labels, test)}


def class_counts(df: DataFrame, label: str = TARGET_COLUMN) -> dict:
    return {r[0]: r[1] for r in df.groupBy(label).count().collect()}  # one row per class


def assign_split(df: DataFrame, label: str = TARGET_COLUMN, key: str = ID_COLUMN, seed: int = RANDOM_STATE,
                 test_size: float = TEST_SIZE, folds: int = CV_FOLDS, counts: dict | None = None) -> DataFrame:
    """Add ``is_test`` (hold-out) and ``fold`` (0..folds-1 for training rows, NULL for test rows)."""

    counts = counts or class_counts(df, label)
    sizes = holdout_sizes(counts, test_size)
    ranked = stratified_rank(df, label, key, seed, rows=sum(counts.values()))
    n_test = F.lit(0)
    for cls, n in sizes.items():
        n_test = F.when(F.col(label) == F.lit(cls), F.lit(n)).otherwise(n_test)
    is_test = F.col("_rank") < n_test
    return ranked.select(
        *df.columns,
        is_test.alias("is_test"),
        F.when(is_test, F.lit(None)).otherwise(F.pmod(F.col("_rank") - n_test, F.lit(folds))).cast("int").alias("fold"),
    )
