"""Coalition attributions against Shapley values by their definition."""

from itertools import permutations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from attrition.operators.coalitions import coalition_attributions, kernel_coalitions, solution


def score(x):
    return 0.1 * x[..., 0] * x[..., 1] - 0.3 * np.abs(x[..., 2] - x[..., 3]) + 0.05 * x[..., -1] ** 2 + 0.2 * x[..., 0]


def plain_shapley(x, background):
    """Over all orders of the features."""

    d = len(x)
    worth = {}
    for mask in range(2 ** d):
        chosen = np.array([(mask >> j) & 1 for j in range(d)], bool)
        worth[mask] = score(np.where(chosen, x, background)).mean()
    out, orders = np.zeros(d), 0
    for order in permutations(range(d)):
        mask = 0
        for j in order:
            out[j] += worth[mask | 1 << j] - worth[mask]
            mask |= 1 << j
        orders += 1
    return out / orders, worth[0], worth[2 ** d - 1]


def predict(df, keep):
    x = df.select(*keep, vector_to_array("features").alias("v"))
    v = lambda j: F.col("v")[j]
    last = F.element_at("v", -1)
    p = 0.1 * v(0) * v(1) - 0.3 * F.abs(v(2) - v(3)) + 0.05 * last * last + 0.2 * v(0)
    return x.select(*keep, p.alias("churn_probability"))


def vectors(spark, x):
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, v array<double>")
    return rows.select("id", array_to_vector("v").alias("features"))


def test_all_coalitions_of_eight_features_give_shapley_values(spark):
    rng = np.random.default_rng(4)
    x, ground = rng.normal(size=(3, 8)), rng.normal(size=(5, 8))
    members, weights = kernel_coalitions(8, 254)
    assert len(members) == 254 and len({m.tobytes() for m in members}) == 254 and np.isclose(weights.sum(), 1)
    out, base = coalition_attributions(predict, vectors(spark, x), vectors(spark, ground), coalitions=254)
    got = {r.id: r.attributions for r in out.collect()}
    for i in range(3):
        want, none, every = plain_shapley(x[i], ground)
        assert np.allclose(got[i], want, atol=1e-9) and np.isclose(base, none)
        assert np.isclose(sum(got[i]), every - none)


def test_drawn_coalitions_come_near_and_add_up():
    rng = np.random.default_rng(5)
    x, ground = rng.normal(size=9), rng.normal(size=(4, 9))
    want, none, every = plain_shapley(x[[0, 1, 2, 3, 8]], ground[:, [0, 1, 2, 3, 8]])
    members, weights = kernel_coalitions(9, 200)
    assert len(members) == 200 and np.isclose(weights.sum(), 1)
    assert (members[-2::-2][:50] ^ members[-1::-2][:50]).all()  # pairs of a coalition and its complement
    masks = np.vstack([np.zeros((1, 9), bool), members, np.ones((1, 9), bool)])
    worths = np.array([score(np.where(m, x, ground)).mean() for m in masks])
    got = solution(members, weights) @ worths
    assert np.isclose(got.sum(), every - none)
    assert np.allclose(got[[0, 1, 2, 3, 8]], want, atol=0.05) and np.allclose(got[4:8], 0, atol=0.05)


def test_one_feature_takes_all(spark):
    members, weights = kernel_coalitions(1, 10)
    assert len(members) == 0
    assert np.allclose(solution(members, weights) @ [0.25, 0.75], [0.5])
