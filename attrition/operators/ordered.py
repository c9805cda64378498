"""Ordered target statistics: a row's category value from the rows before it only.

Rows have a fixed order, md5 of id and seed.  For each categorical column, a row
gets ``(positives before it with its category + prior * weight) / (rows before it
with its category + weight)``; the prior is the share of positives in the table.
A row's own label never enters, so training rows need no cross-fitting.

Running sums are distributed: the order is cut into ranges by the first hex digits
of the md5, sums per (column, category, range) give what stands before each range,
and a window adds up the rows inside one range.  So a category with a third of all
rows is as many windows as there are ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import ID_COLUMN, RANDOM_STATE, TARGET_COLUMN
from ..session import cut_lineage
from .split import _prefix_digits, md5_key

#: Category of missing values.
MISSING = "nan"


def ordered_statistics(rows: DataFrame, columns: list[str], label: str = TARGET_COLUMN, key: str = ID_COLUMN,
                       seed: int = RANDOM_STATE, weight: float = 1.0) -> DataFrame:
    """``key, feature, level, earlier, statistic``: a row for each row and column; ``earlier``: rows before it alike.

    Rows that share an id are ordered by label.
    """

    n, positive = rows.agg(F.count(F.lit(1)), F.sum(label)).first()
    prior = (positive or 0) / n if n else 0.0
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("level"))
                      for c in columns])
    ordered = rows.select(key, F.col(label).cast("long").alias("_y"), md5_key(key, seed).alias("_h"), F.inline(pairs))
    ordered = cut_lineage(ordered.withColumn("_range", F.substring("_h", 1, _prefix_digits(n))))
    sums = ordered.groupBy("feature", "level", "_range").agg(F.sum("_y").alias("_s"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("feature", "level").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(sums.select(
        "feature", "level", "_range", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0")))
    inside = Window.partitionBy("feature", "level", "_range").orderBy("_h", key, "_y").rowsBetween(Window.unboundedPreceding, -1)
    met = ordered.join(offsets, ["feature", "level", "_range"])
    earlier = F.col("_n0") + F.count(F.lit(1)).over(inside)
    positives = F.col("_s0") + F.coalesce(F.sum("_y").over(inside), F.lit(0))
    return met.select(key, "feature", "level", earlier.alias("earlier"), positives.alias("_p")).select(
        key, "feature", "level", "earlier",
        ((F.col("_p") + F.lit(prior * weight)) / (F.col("earlier") + F.lit(weight))).alias("statistic"))
