"""The landmark map against the exact kernel on small tables."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from attrition.operators.kernel import KernelMap, drawn_rows, fit_kernel_map, kernel_errors, kernel_features


def exact(x, y, gamma):
    return np.array([[np.exp(-gamma * sum((a - b) ** 2 for a, b in zip(p, q))) for q in y] for p in x])


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(4)
    return np.concatenate([rng.normal(size=(120, 3)), np.tile([[0.5, -1.0, 2.0]], (60, 1))]).round(2)


@pytest.fixture(scope="module")
def table(spark, points):
    return spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, x array<double>").select(
        "id", array_to_vector("x").alias("features"))


def test_all_distinct_rows_as_landmarks_give_the_kernel(table, points):
    kernel = fit_kernel_map(table, gamma=0.3, landmarks=1_000)
    assert len(kernel.landmarks) == 121  # copies are one landmark
    rows = kernel_features(table, kernel).select("id", vector_to_array("features").alias("z")).orderBy("id").collect()
    z = np.array([r.z for r in rows])
    assert np.allclose(z @ z.T, exact(points, points, 0.3), atol=1e-5)


@pytest.mark.parametrize("landmarks", [5, 40])
def test_errors_keep_the_bound(table, points, landmarks):
    kernel = fit_kernel_map(table, gamma=0.3, landmarks=landmarks)
    assert len(kernel.landmarks) == landmarks
    rows = kernel_errors(table, kernel, points).orderBy("id").collect()
    error = np.abs(exact(points, points, 0.3) - kernel(points) @ kernel(points).T)
    residual = np.array([r.residual for r in rows])
    assert np.allclose([r.error for r in rows], error.max(axis=1), atol=1e-9)
    assert np.allclose(residual, 1 - (kernel(points) ** 2).sum(axis=1), atol=1e-9)
    assert (error <= np.sqrt(np.outer(np.maximum(residual, 0), np.maximum(residual, 0))) + 1e-6).all()
    assert max(r.excess for r in rows) <= 1e-6
    at = np.array([p.tolist() in kernel.landmarks.tolist() for p in points])
    assert residual[at].max() < 1e-6 < residual.max()


def test_drawn_rows_do_not_depend_on_partitions(table):
    assert np.array_equal(drawn_rows(table, 30), drawn_rows(table.repartition(5), 30))
    kernel = fit_kernel_map(table, landmarks=9)
    again = KernelMap.from_record(kernel.record())
    assert np.array_equal(again(kernel.landmarks), kernel(kernel.landmarks))
    with pytest.raises(ValueError):
        fit_kernel_map(table.limit(0), gamma=1.0)


def test_a_batch_is_mapped_in_slices(spark):
    class Watched(KernelMap):
        def __call__(self, x):
            assert len(x) <= 512
            return super().__call__(x)

    landmarks = np.arange(12.0).reshape(4, 3)
    whole = KernelMap.of(landmarks, 0.1)
    kernel = Watched(landmarks, whole.whitening, 0.1)
    rows = spark.range(0, 1500, 1, 1).select("id", array_to_vector(F.array(
        *[(F.col("id") % m).cast("double") for m in (7, 5, 3)])).alias("features"))
    told = kernel_errors(rows, kernel, landmarks[:2]).orderBy("id").collect()
    x = np.array([[i % 7, i % 5, i % 3] for i in range(1500)], float)
    assert np.allclose([r["residual"] for r in told], 1 - (whole(x) ** 2).sum(axis=1))
    mapped = kernel_features(rows, kernel).select(vector_to_array("features").alias("z"), "id").orderBy("id").collect()
    assert np.allclose([r["z"] for r in mapped], whole(x))
