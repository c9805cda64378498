"""Grown forests: draws, cuts and leaves."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from attrition.operators.forest import ForestGrower, ForestGrowth, GrownForest, HistogramForest, all_draws, node_features


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=300).round(1), rng.integers(0, 2, 300), rng.normal(size=300).round(1), rng.integers(0, 5, 300)])
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(int)
    df = spark.createDataFrame([(f"c{i}", r.tolist(), int(t)) for i, (r, t) in enumerate(zip(x, y))],
                               "customerID string, x array<double>, Churn int").repartition(4)
    return df.select("customerID", array_to_vector("x").alias("features"), "Churn").cache(), x, y


def test_draws_are_poisson_and_weights_are_the_trees_own(table):
    df, _, y = table
    growth = ForestGrowth(trees=40, balanced=True, max_depth=1)
    rows = df.select("Churn", all_draws(F.col("customerID"), growth).alias("d")).collect()
    drawn = np.array([r["d"] for r in rows])
    assert abs(drawn.mean() - 1) < 0.03 and abs((drawn == 0).mean() - np.exp(-1)) < 0.02
    label = np.array([r["Churn"] for r in rows])
    weights = ForestGrower(df, "Churn", "customerID", growth).weights
    for t in range(40):
        n = [drawn[label == c, t].sum() for c in (0, 1)]
        assert weights[t].tolist() == pytest.approx([sum(n) / (2 * c) for c in n])


def gini(n):
    return n.sum() - (n ** 2).sum() / max(n.sum(), 1e-300)


@pytest.mark.parametrize("cuts", ["best", "random"])
def test_splits_and_leaves_are_those_of_the_rows(table, cuts):
    df, x, y = table
    growth = ForestGrowth(trees=6, max_depth=3, min_rows=5, cuts=cuts, bootstrap=False)
    model = HistogramForest(growth, "Churn", "customerID").fit(df)
    bins = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(model.cuts)]).astype(np.uint8)
    for t, tree in enumerate(model.trees):
        at = tree.leaves(bins)
        for n in np.unique(at):
            assert tree.rows[n] == (at == n).sum() >= 5
            assert tree.values[0][n] == pytest.approx(y[at == n].mean())
        # every inner node: a feature it looks at, a cut inside the node's values, the best there is for best cuts
        stack = [(0, np.arange(len(y)))]
        while stack:
            node, rows = stack.pop()
            f = tree.feature[node]
            if f < 0:
                continue
            assert f in node_features(growth, t, node, 4)
            own = bins[rows, f]
            assert own.min() <= tree.bin[node] < own.max()
            low = own <= tree.bin[node]
            if cuts == "best":
                def fall(part, rows=rows):
                    counts = [np.bincount(y[r], minlength=2).astype(float) for r in (rows, rows[part], rows[~part])]
                    return gini(counts[0]) - gini(counts[1]) - gini(counts[2])

                tried = [bins[rows, g] <= c for g in node_features(growth, t, node, 4) for c in np.unique(bins[rows, g])[:-1]]
                assert fall(low) == pytest.approx(max(fall(p) for p in tried if 5 <= p.sum() <= len(rows) - 5))
            stack += [(tree.left[node], rows[low]), (tree.right[node], rows[~low])]


def test_forests_are_repeatable_and_kept(table, tmp_path):
    df, x, _ = table
    growth = ForestGrowth(trees=4, max_depth=3, min_rows=3, cuts="random")
    a, b = (HistogramForest(growth, "Churn", "customerID").fit(df.repartition(n)) for n in (1, 6))
    assert [t.__dict__ for t in a.trees] == [t.__dict__ for t in b.trees]
    a.write().overwrite().save(str(tmp_path / "f"))
    assert np.array_equal(GrownForest.load(str(tmp_path / "f")).scores(x), a.scores(x))
    assert 0 <= a.scores(x).min() <= a.scores(x).max() <= 1
