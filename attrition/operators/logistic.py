"""Logistic regression whose intercept is penalised like any other weight.

A constant column is appended to the features and the model is fitted without an
intercept of its own; the constant's weight is the intercept.

The weights are Newton's: rows are packed once into blocks of numbers, and a step is
one job that adds up the blocks' loss, gradient and curvature (a tree of sums, columns
squared).  The passes over the rows are about ten, however many rows there are and
however alike the columns.

More than ``NEWTON_COLUMNS`` columns go to Spark's solver, whose passes don't square
them.  It gives a column that never varies no weight, so each row is also taken with all
signs (of features, constant and label) turned, at half its weight: its loss is the same,
and no column but one of zeros is constant any more.  Vectors stay sparse.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import ElementwiseProduct, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix, DenseVector, Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ONE, EXTENDED, TURNED, LABEL, HALF = "_one", "_extended", "_turned", "_label", "_half"
NEWTON_COLUMNS = 512
BLOCK_ROWS = 1024
#: Newton's steps end with one that changes no weight by more than this; the next would change them by about its square.
STEP = 1e-6
#: Halvings of a step that doesn't lower the loss.
HALVINGS = 40


def with_constant(df: DataFrame, features: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=[features, ONE], outputCol=EXTENDED).transform(df.withColumn(ONE, F.lit(1.0))).drop(ONE)


class PenalisedLogisticModel:
    def __init__(self, inner: LogisticRegressionModel):
        self.inner = inner.setFeaturesCol(EXTENDED)
        values = inner.coefficients.toArray()
        self.coefficients, self.intercept = DenseVector(values[:-1]), float(values[-1])

    def transform(self, df: DataFrame) -> DataFrame:
        return self.inner.transform(with_constant(df)).drop(EXTENDED)

    def write(self):
        return self.inner.write()

    @staticmethod
    def load(path: str) -> PenalisedLogisticModel:
        return PenalisedLogisticModel(LogisticRegressionModel.load(path))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``x, label, weight`` in blocks: label, weight and columns, those of zeros and ones in a byte a number."""

    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(start, BLOCK_ROWS)
            x = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            given = np.stack([part.column(i).to_numpy(zero_copy_only=False) for i in (1, 2)])
            binary = ((x == 0) | (x == 1)).all(axis=0)
            pieces = (binary.astype(np.uint8), given, x[:, ~binary], x[:, binary].astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([part.num_rows]), pa.array([b"".join(p.tobytes() for p in pieces)])],
                                             names=["rows", "block"])


def _unpacked(rows: int, block: bytes, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    binary = np.frombuffer(block, np.uint8, size).astype(bool)
    others = int(size - binary.sum())
    label, weight = np.frombuffer(block[size:size + 16 * rows], float).reshape(2, rows)
    end = size + 16 * rows + 8 * rows * others
    x = np.empty((rows, size))
    x[:, ~binary] = np.frombuffer(block[size + 16 * rows:end], float).reshape(rows, others)
    x[:, binary] = np.frombuffer(block[end:], np.uint8).reshape(rows, size - others)
    return x, label, weight


def _sums(blocks: Iterator, b: np.ndarray) -> Iterator[np.ndarray]:
    """Loss, gradient and curvature of a task's blocks in one array."""

    loss, gradient, curvature = 0.0, np.zeros(len(b)), np.zeros((len(b), len(b)))
    for rows, block in blocks:
        x, label, weight = _unpacked(rows, block, len(b))
        margin = x @ b
        p = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
        loss += float((weight * (np.logaddexp(0, margin) - label * margin)).sum())
        gradient += x.T @ (weight * (p - label))
        curvature += (x * (weight * p * (1 - p))[:, None]).T @ x
    yield np.concatenate([[loss], gradient, curvature.ravel()])


def newton_weights(rows: DataFrame, size: int, c: float, max_iter: int) -> np.ndarray:
    """The least of c * sum(weight * loss) + |b|^2 / 2 over ``x, label, weight``."""

    blocks = rows.mapInArrow(_packed, "rows long, block binary").rdd.map(tuple).persist(StorageLevel.DISK_ONLY)

    def at(b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        sums = blocks.mapPartitions(lambda part: _sums(part, b)).treeReduce(np.add)
        value = c * sums[0] + b @ b / 2
        if not np.isfinite(value):
            raise ValueError("A logistic model needs labels, weights and features that are numbers")
        return value, c * sums[1:size + 1] + b, c * sums[size + 1:].reshape(size, size) + np.eye(size)

    try:
        b = np.zeros(size)
        value, gradient, curvature = at(b)
        for _ in range(max_iter):
            step = np.linalg.solve(curvature, gradient)
            for _ in range(HALVINGS):
                found = at(b - step)
                if found[0] <= value or np.abs(step).max() <= STEP:
                    break
                step = step / 2
            b, (value, gradient, curvature) = b - step, found
            if np.abs(step).max() <= STEP:
                break
        return b
    finally:
        blocks.unpersist()


def model_of(spark: SparkSession, weights: np.ndarray) -> LogisticRegressionModel:
    """Spark's model with these weights: bounds leave a fit of two rows no others."""

    size = len(weights)
    bounds = DenseMatrix(1, size, weights.tolist())
    two = spark.createDataFrame([(Vectors.dense([sign] * size), max(sign, 0.0)) for sign in (1.0, -1.0)], [EXTENDED, LABEL])
    return LogisticRegression(featuresCol=EXTENDED, labelCol=LABEL, fitIntercept=False, standardization=False, regParam=0.0,
                              maxIter=0, lowerBoundsOnCoefficients=bounds, upperBoundsOnCoefficients=bounds).fit(two)


class PenalisedLogistic:
    """Minimises C * sum(weight * loss) + |w|^2 / 2 with the intercept in w; labels are 0 and 1."""

    def __init__(self, label: str, c: float = 1.0, max_iter: int = 1000, weight_col: str | None = None):
        self.label, self.c, self.max_iter, self.weight_col = label, c, max_iter, weight_col

    def fit(self, df: DataFrame) -> PenalisedLogisticModel:
        weight = F.col(self.weight_col).cast("double") if self.weight_col else F.lit(1.0)
        extended = with_constant(df)
        size = extended.schema[EXTENDED].metadata["ml_attr"]["num_attrs"]
        if size <= NEWTON_COLUMNS:
            rows = extended.select(vector_to_array(EXTENDED).alias("x"), F.col(self.label).cast("double").alias(LABEL), weight.alias("w"))
            return PenalisedLogisticModel(model_of(df.sparkSession, newton_weights(rows, size, self.c, self.max_iter)))
        total = float(df.agg(F.sum(weight)).first()[0] or 1.0)
        given = extended.select(EXTENDED, F.col(self.label).cast("double").alias(LABEL), (weight / 2).alias(HALF))
        turned = ElementwiseProduct(scalingVec=DenseVector([-1.0] * size), inputCol=EXTENDED, outputCol=TURNED).transform(given)
        signed = given.unionByName(turned.select(F.col(TURNED).alias(EXTENDED), (1 - F.col(LABEL)).alias(LABEL), HALF))
        # C * sum(loss) + |w|^2 / 2  ==  C * total * (mean(loss) + |w|^2 / (2 * C * total))
        solver = LogisticRegression(featuresCol=EXTENDED, labelCol=LABEL, weightCol=HALF, fitIntercept=False,
                                    standardization=False, regParam=1.0 / (self.c * max(total, 1e-12)),
                                    elasticNetParam=0.0, maxIter=self.max_iter, tol=1e-6)
        return PenalisedLogisticModel(solver.fit(signed))
