"""SMOTE oversampling of the minority class on encoded training rows.

Synthetic row = x + u * (x_nn - x) for a minority row x, one of its k nearest
minority neighbours x_nn and u ~ U(0, 1); the minority class is raised to the
size of the majority class.

Neighbours come from a pivot index (``neighbours.py``) and are exact: the k nearest of
all minority rows, for each row that gets a synthetic sample.

Which rows get how many synthetic samples, which neighbour and which ``u`` are
drawn from ``xxhash64`` of (customer id, sample number, seed): the same on every
cluster and when a lost task is recomputed.  Only pairs of numbers and distances
leave the search; vectors are joined for the pairs drawn.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import ID_COLUMN, RANDOM_STATE
from ..session import cut_lineage
from .neighbours import nearest_rows


def global_row_number(df: DataFrame, order_col: str, tie_col: str, out: str = "_rank") -> DataFrame:
    """Exact 0-based position of each row in (order_col, tie_col) order, computed per value range."""

    ranges = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = []
    if ranges > 1:
        got = df.agg(F.percentile_approx(order_col, [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []
        cuts = sorted(set(float(c) for c in got))
    splits = [float("-inf")] + cuts + [float("inf")]
    b = Bucketizer(splits=splits, inputCol=order_col, outputCol="_rb").transform(df)
    sizes = b.groupBy("_rb").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_rb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_rb", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))  # <= len(splits) rows
    local = Window.partitionBy("_rb").orderBy(order_col, tie_col)
    return (b.join(F.broadcast(offsets), "_rb")
            .withColumn(out, F.col("_off") + F.row_number().over(local) - 1)
            .drop("_rb", "_off"))


def _uniform(*cols) -> F.Column:
    """Deterministic U[0,1) from a hash of the given columns."""

    h = F.xxhash64(*cols)
    return (F.pmod(h, F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52)))


def minority_rows(encoded: DataFrame, label: str, minority, x, seed: int = RANDOM_STATE) -> DataFrame:
    """``_sid, _u, _x`` of a class: a row's number is its place in the order of hashed ids."""

    keyed = encoded.filter(F.col(label) == minority).select(
        _uniform(F.col(ID_COLUMN), F.lit(seed)).alias("_u"), F.col(ID_COLUMN).alias("_id"), x.alias("_x"))
    return global_row_number(keyed, "_u", "_id", "_sid").select("_sid", "_u", "_x")


def smote(encoded: DataFrame, label: str, k: int = 5, seed: int = RANDOM_STATE, features: str = "features") -> DataFrame:
    """Return ``encoded`` plus synthetic minority rows (same columns; synthetic ids are NULL)."""

    counts = {r[0]: r[1] for r in encoded.groupBy(label).count().collect()}  # one row per class
    if len(counts) < 2:
        return encoded
    minority = min(counts, key=lambda c: (counts[c], c))
    majority_n = max(counts.values())
    n_min = counts[minority]
    n_new = majority_n - n_min
    if n_new <= 0 or n_min < 2:
        return encoded

    base = cut_lineage(minority_rows(encoded, label, minority, vector_to_array(features), seed))
    # samples per row: floor(n_new / n_min) each, one more for the first (n_new mod n_min) rows in hash order
    per_row, extra = divmod(n_new, n_min)
    samples = F.lit(per_row) + F.when(F.col("_sid") < extra, 1).otherwise(0)
    drawn_from = None if per_row else F.col("id") < extra
    found = nearest_rows(base.select(F.col("_sid").alias("id"), F.col("_x").alias("x")), k, asked=drawn_from)
    nearest = cut_lineage(found.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("nn").alias("_nn")))
    quota = base.select(F.col("_sid").alias("_a"), samples.alias("_m"), F.col("_x").alias("_xa")).filter(F.col("_m") > 0)
    xa = quota.select("_a", "_xa")
    xb = base.select(F.col("_sid").alias("_b"), F.col("_x").alias("_xb"))
    n_nb = nearest.groupBy("_a").agg(F.count(F.lit(1)).alias("_k"))

    draws = (quota.select("_a", "_m").join(n_nb, "_a")
             .select("_a", "_k", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)).alias("_j"))
             .withColumn("_pick", F.pmod(F.xxhash64("_a", "_j", F.lit(seed + 1)), F.col("_k")) + 1)
             .withColumn("_step", _uniform(F.col("_a"), F.col("_j"), F.lit(seed + 2))))
    drawn = draws.join(nearest.select("_a", F.col("_nn").alias("_pick"), "_b"), ["_a", "_pick"])
    chosen = drawn.join(xa, "_a").join(xb, "_b")
    synthetic = chosen.select(
        array_to_vector(F.zip_with("_xa", "_xb", lambda a, b: a + F.col("_step") * (b - a))).alias(features))
    other = [c for c in encoded.columns if c not in (features, label)]
    synthetic = synthetic.select(*[F.lit(None).cast(encoded.schema[c].dataType).alias(c) for c in other],
                                 F.lit(minority).cast(encoded.schema[label].dataType).alias(label), features)
    return encoded.unionByName(synthetic.select(*encoded.columns))
