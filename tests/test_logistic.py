import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from attrition.operators.logistic import PenalisedLogistic, PenalisedLogisticModel


def newton(x, y, w, c, steps=60):
    """c * sum(w * loss) + |b|^2 / 2, the constant's weight in b too."""

    x1 = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x1.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x1 @ b))
        gradient = c * x1.T @ (w * (p - y)) + b
        b = b - np.linalg.solve(c * (x1 * (w * p * (1 - p))[:, None]).T @ x1 + np.eye(len(b)), gradient)
    return b


@pytest.mark.parametrize("c,weighted", [(1.0, False), (0.02, True)])
def test_coefficients_and_intercept_are_newtons(spark, tmp_path, c, weighted):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 4)) * [1, 2, 0.5, 1]
    y = (rng.random(300) < 1 / (1 + np.exp(-(1.5 + x @ [0.8, -0.3, 0.0, 0.4])))).astype(int)
    w = np.where(y == 1, 0.7, 1.9) if weighted else np.ones(300)
    rows = spark.createDataFrame([([float(v) for v in r], int(t), float(u)) for r, t, u in zip(x, y, w)],
                                 "v array<double>, y int, w double").withColumn("features", array_to_vector("v"))
    model = PenalisedLogistic("y", c, weight_col="w" if weighted else None).fit(rows)
    want = newton(x, y, w, c)
    assert np.allclose([*model.coefficients, model.intercept], want, atol=1e-4)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PenalisedLogisticModel.load(str(tmp_path / "m")).transform(rows)
    assert set(again.columns) == {*rows.columns, "rawPrediction", "probability", "prediction"}
    got = [r[0] for r in again.select(vector_to_array("probability")[1]).collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-(x @ want[:-1] + want[-1]))), atol=1e-4)


def test_columns_marked_as_categories_are_numbers(spark):
    """A vector whose attributes say nominal, as of indexed columns, gives the same weights as a plain one."""

    rows = spark.createDataFrame([(float(i % 3), 0.3 * i, int(i % 5 > 1)) for i in range(40)], "c double, x double, y int")
    rows = rows.withColumn("c", F.col("c").alias("c", metadata={"ml_attr": {"type": "nominal", "num_vals": 3}}))
    assembled = VectorAssembler(inputCols=["c", "x"], outputCol="features").transform(rows)
    plain = assembled.withColumn("features", array_to_vector(vector_to_array("features")))
    first, second = (PenalisedLogistic("y").fit(df) for df in (assembled, plain))
    assert np.allclose(first.coefficients, second.coefficients) and np.isclose(first.intercept, second.intercept)


def test_a_few_passes_reach_the_weights_of_columns_that_are_much_alike(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(400, 1))
    x = np.column_stack([base + 0.01 * rng.normal(size=(400, 6)), rng.integers(0, 2, size=(400, 3)), np.ones(400)])
    y = (rng.random(400) < 1 / (1 + np.exp(-4 * x[:, 0] - x[:, 7] + 1))).astype(int)
    rows = spark.createDataFrame([([float(v) for v in r], int(t)) for r, t in zip(x, y)], "v array<double>, y int")
    model = PenalisedLogistic("y", 50.0, max_iter=12).fit(rows.withColumn("features", array_to_vector("v")))
    assert np.allclose([*model.coefficients, model.intercept], newton(x, y, np.ones(400), 50.0), atol=1e-6)
