import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from attrition.operators.neighbours import PivotIndex, nearest_rows
from attrition.operators.sampling import smote


def test_smote_parity_and_segments(spark):
    rows = [(f"M{i}", 0, [float(i % 7), float(i % 5)]) for i in range(60)]
    rows += [(f"m{i}", 1, [10.0 + (i % 3), 5.0 + (i % 4)]) for i in range(15)]
    df = spark.createDataFrame(rows, "customerID string, Churn int, x array<double>").select(
        "customerID", "Churn", array_to_vector("x").alias("features"))
    out = smote(df, "Churn", k=5, seed=1)
    counts = {r["Churn"]: r["count"] for r in out.groupBy("Churn").count().collect()}
    assert counts == {0: 60, 1: 60}
    synth = [r["features"].toArray() for r in out.filter(F.col("customerID").isNull()).collect()]
    assert len(synth) == 45
    lo, hi = np.array([10.0, 5.0]), np.array([12.0, 8.0])
    assert all(((s >= lo - 1e-9) & (s <= hi + 1e-9)).all() for s in synth)  # inside the minority hull


def exact_neighbours(points, k):
    """By (distance, id), all pairs."""

    distance = ((points[:, None] - points[None]) ** 2).sum(axis=2)
    np.fill_diagonal(distance, np.inf)
    return {i: sorted(range(len(points)), key=lambda j: (distance[i, j], j))[:k] for i in range(len(points))}


def found_neighbours(rows, k, **index):
    found = {}
    for r in sorted(nearest_rows(rows, k, **index).collect(), key=lambda r: r["nn"]):
        found.setdefault(r["a"], []).append(r["b"])
    return found


def point_rows(spark, points):
    return spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, x array<double>").repartition(4)


def test_pivot_index_is_exact_without_a_bound_on_visits(spark):
    """Clusters, ties on a grid, and a vector that a third of the rows share."""

    rng = np.random.default_rng(7)
    points = np.vstack([rng.normal(size=(120, 3)) + c for c in (0, 6, 12)] + [rng.integers(0, 4, (90, 3)), np.ones((200, 3))])
    points = points[rng.permutation(len(points))]
    got = found_neighbours(point_rows(spark, points), 5, visits=None, cell_rows=20, opening=1)
    assert got == exact_neighbours(points, 5)


def test_pivot_index_skips_cells_and_keeps_recall(spark):
    rng = np.random.default_rng(8)
    points = rng.normal(size=(600, 2)) + rng.integers(0, 5, (600, 1)) * 9
    rows = point_rows(spark, points)
    index = PivotIndex(rows.withColumnRenamed("id", "point"), cell_rows=20)
    kth = rows.select(F.col("id").alias("point"), F.lit(1.0).alias("reach"))
    visited = index.visits(1, None, kth).count()
    assert visited < 0.4 * 600 * len(index.pivots)  # far cells can hold nothing within the reach
    want, got = exact_neighbours(points, 5), found_neighbours(rows, 5, cell_rows=20, opening=1, visits=4)
    assert np.mean([len(set(want[i]) & set(got[i])) / 5 for i in want]) > 0.9


def test_few_rows_have_few_neighbours(spark):
    assert found_neighbours(point_rows(spark, np.array([[0.0], [1.0], [1.0]])), 5) == {0: [1, 2], 1: [2, 0], 2: [1, 0]}
    assert found_neighbours(point_rows(spark, np.zeros((1, 2))), 5) == {}


def test_entry_and_oracles_small(spark):
    import __spark_entry__ as E
    from tools.oracle_check import check

    assert E.entry(spark).count() >= 1
    names = ["lifecycle_churn", "domain_features", "decisions", "threshold_sweep", "metrics_at_default",
             "holdout_split", "model_comparison", "threshold_table", "risk_tier_counts"]
    res = check(names, "/root/testdata/sf0.001", spark=spark, verbose=False)
    assert all(v.startswith("OK") for v in res.values()), res
