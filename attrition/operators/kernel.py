"""Landmark (Nyström) features: an explicit map whose inner products approximate an RBF kernel.

Of m landmark rows L, with K = k(L, L) = U S U', the map is z(x) = k(x, L) U S^-1/2
(directions of a negligible share of S are left out), so z(x)·z(y) is the kernel of the
projections of x and y onto the landmarks' span.  It is exact on landmarks, and for
any rows |k(x, y) - z(x)·z(y)| <= sqrt(r(x) r(y)) with the residual r(x) = 1 - |z(x)|^2,
which every row tells for itself (``kernel_errors``).  With a linear SVM on z(x) this
stands in for a kernel SVM without the n^2 kernel matrix.

Landmarks are distinct rows, drawn by hash of their values, at most ``LANDMARKS``
whatever the table; they and the whitened block are all that reaches the driver or is
shipped.  The map runs in Arrow batches (two matrix products each).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

from ..constants import RANDOM_STATE

LANDMARKS = 300
#: Directions of the landmarks' block with less than this share of its greatest eigenvalue are noise.
NEGLIGIBLE = 1e-10
#: Rows of a batch that are mapped at once.
SLICE = 512


def scale_gamma(encoded: DataFrame, features: str = "features") -> float:
    """1 / (n_features * variance of all matrix entries), from per-feature moments."""

    row = encoded.select(Summarizer.metrics("mean", "variance", "count").summary(F.col(features)).alias("s")).first()["s"]
    mean = np.asarray(row["mean"].toArray())
    n = float(row["count"])
    var = np.asarray(row["variance"].toArray()) * ((n - 1.0) / n if n > 1 else 1.0)  # population
    total_var = float(np.mean(var + mean ** 2) - np.mean(mean) ** 2)
    d = len(mean)
    return 1.0 / (d * total_var) if total_var > 0 else 1.0


def rbf(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    squared = (x ** 2).sum(axis=1)[:, None] + (y ** 2).sum(axis=1) - 2.0 * (x @ y.T)
    return np.exp(-gamma * np.maximum(squared, 0.0))


@dataclass
class KernelMap:
    landmarks: np.ndarray  # (m, d)
    whitening: np.ndarray  # (m, kept directions)
    gamma: float

    @staticmethod
    def of(landmarks: np.ndarray, gamma: float) -> KernelMap:
        values, vectors = np.linalg.eigh(rbf(landmarks, landmarks, gamma))
        kept = values > NEGLIGIBLE * values[-1]
        return KernelMap(landmarks, vectors[:, kept] / np.sqrt(values[kept]), gamma)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return rbf(x, self.landmarks, self.gamma) @ self.whitening

    def record(self) -> dict:
        return {"landmarks": self.landmarks.tolist(), "whitening": self.whitening.tolist(), "gamma": self.gamma}

    @staticmethod
    def from_record(record: dict) -> KernelMap:
        return KernelMap(np.asarray(record["landmarks"]), np.asarray(record["whitening"]), record["gamma"])


def drawn_rows(encoded: DataFrame, n: int, seed: int = RANDOM_STATE, features: str = "features") -> np.ndarray:
    """The ``n`` distinct rows of the least hashes (all, if fewer).

    Rows are dropped by hash before any is shuffled; the share that stays grows
    until it holds enough distinct ones, as copies of a row share its hash.
    """

    whole = 1 << 30
    x = encoded.select(vector_to_array(features).alias("x"))
    hashed = x.withColumn("h", F.xxhash64("x", F.lit(seed))).withColumn("at", F.pmod("h", F.lit(whole)))
    share = 4.0 * n / max(1, encoded.count())
    while True:
        low = hashed if share >= 1 else hashed.filter(F.col("at") < int(share * whole))
        rows = low.groupBy("at", "h").agg(F.min("x").alias("x")).orderBy("at", "h").limit(n).collect()
        if len(rows) == n or share >= 1:
            return np.array([r["x"] for r in rows])
        share *= 16


def fit_kernel_map(encoded: DataFrame, gamma: float | None = None, landmarks: int = LANDMARKS, seed: int = RANDOM_STATE,
                   features: str = "features") -> KernelMap:
    rows = drawn_rows(encoded, landmarks, seed, features)
    if not len(rows):
        raise ValueError("A kernel map needs rows to take landmarks from")
    return KernelMap.of(rows, scale_gamma(encoded, features) if gamma is None else gamma)


def row_slices(x: pd.Series) -> Iterator[np.ndarray]:
    """A batch's rows, ``SLICE`` at once: its products with the landmarks are many times as large as it is."""

    for start in range(0, len(x), SLICE):
        yield np.vstack(x.iloc[start:start + SLICE].to_numpy())


def kernel_features(df: DataFrame, kernel: KernelMap, features: str = "features", output: str = "features") -> DataFrame:
    @pandas_udf(ArrayType(DoubleType()))
    def mapped(x: pd.Series) -> pd.Series:
        return pd.Series([z for rows in row_slices(x) for z in kernel(rows)], dtype=object)

    out = df.withColumn("_mapped", array_to_vector(mapped(vector_to_array(features))))
    return (out.drop(features) if output == features else out).withColumnRenamed("_mapped", output)


def kernel_errors(df: DataFrame, kernel: KernelMap, against: np.ndarray, features: str = "features") -> DataFrame:
    """Adds each row's ``residual``, and its greatest ``error`` and ``excess`` over the bound towards the rows ``against``."""

    z_against = kernel(against)
    r_against = np.maximum(1.0 - (z_against ** 2).sum(axis=1), 0.0)

    def of_slice(rows: np.ndarray) -> np.ndarray:
        z = kernel(rows)
        residual = 1.0 - (z ** 2).sum(axis=1)
        error = np.abs(rbf(rows, against, kernel.gamma) - z @ z_against.T)
        excess = error - np.sqrt(np.maximum(residual, 0.0)[:, None] * r_against)
        return np.column_stack([residual, error.max(axis=1), excess.max(axis=1)])

    @pandas_udf("residual double, error double, excess double")
    def told(x: pd.Series) -> pd.DataFrame:
        parts = [of_slice(rows) for rows in row_slices(x)]
        return pd.DataFrame(np.concatenate(parts) if parts else np.zeros((0, 3)), columns=["residual", "error", "excess"])

    return df.withColumn("_told", told(vector_to_array(features))).select(*df.columns, "_told.*")
