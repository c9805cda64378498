"""Exact order statistics without sending a column through one task.

Spark's ``median`` aggregate is exact but merges every distinct value in one
task; ``percentile_approx`` is bounded but only rank-approximate.  ``medians``
aggregates each column to (value, count), so repeated values and hot keys
collapse on the map side, cuts the distinct values of a column into ranges by
approximate quantiles, and adds up the ranges' counts.  Only the one or two
ranges that hold the middle ranks are sorted, each in its own task.  There is
no loop, no size at which another path is taken, and nothing but one value per
column reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges into which a column's distinct values are cut.
RANGES = 128
APPROX_ACCURACY = 10_000


def medians(df: DataFrame, cols: list[str], ranges: int = RANGES) -> DataFrame:
    """``feature, median``: the midpoint of the two middle values (NULLs ignored, all-NULL: NULL)."""

    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(_q(c)).cast("double").alias("x")) for c in cols])).alias("kv"))
    values = long.select("kv.*").filter("x IS NOT NULL").groupBy("feature", "x").agg(F.count(F.lit(1)).alias("n"))
    fractions = [i / ranges for i in range(1, ranges)] or [0.5]
    cuts = values.groupBy("feature").agg(F.percentile_approx("x", fractions, APPROX_ACCURACY).alias("cuts"))
    # one row per column
    ranged = values.join(F.broadcast(cuts), "feature").select(
        "feature", "x", "n", F.size(F.filter("cuts", lambda c: c < F.col("x"))).alias("r"))
    sums = ranged.groupBy("feature", "r").agg(F.sum("n").alias("in_range"))
    per = Window.partitionBy("feature")
    before = per.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    total, off = F.col("total"), F.col("off")
    # at most ``ranges`` rows per column; two of them hold the middle ranks (from 0)
    middle = sums.select("feature", "r", "in_range", F.sum("in_range").over(per).alias("total"),
                         F.coalesce(F.sum("in_range").over(before), F.lit(0)).alias("off"))
    low, high = F.floor((total - 1) / 2), F.floor(total / 2)
    middle = middle.filter((off <= high) & (low < off + F.col("in_range"))).select("feature", "r", "off", "total")
    upto = Window.partitionBy("feature", "r").orderBy("x")
    placed = ranged.join(F.broadcast(middle), ["feature", "r"]).withColumn("end", off + F.sum("n").over(upto))
    start = F.col("end") - F.col("n")
    picked = placed.filter((start <= high) & (low < F.col("end"))).groupBy("feature").agg(
        ((F.min("x") + F.max("x")) / 2.0).alias("median"))
    every = df.sparkSession.createDataFrame([(c,) for c in cols], "feature string")
    return every.join(F.broadcast(picked), "feature", "left")


def exact_medians(df: DataFrame, cols: list[str], ranges: int = RANGES) -> dict[str, float | None]:
    """Exact median of each column as a dict."""

    if not cols:
        return {}
    return {r["feature"]: r["median"] for r in medians(df, cols, ranges).collect()}  # one row per column


def _q(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def exact_median(df: DataFrame, col: str) -> float | None:
    return exact_medians(df, [col])[col]
