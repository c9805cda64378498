"""Exact Shapley attributions of tree ensembles (path-dependent expectations).

A leaf contributes its value to a coalition of features if the row's values lead
to it wherever the features are known, and the share of training rows that took
each branch wherever they aren't.  For one leaf that is a product over the
distinct features of its path, so its Shapley values follow from the products'
coefficients by coalition size; the attribution of a row is the sum over all
leaves of all trees.  Attributions and the ensemble's expectation add up to its
margin: the log-odds of boosted trees, the probability of a forest.

The paths (bounded by the model, not by the data) go to the tasks once; rows are
handled in Arrow batches, and rows that take a path alike are computed together.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..session import ensure_checkpoint_dir


@dataclass
class LeafPath:
    """A leaf: its value and, per distinct feature of its path, interval and share of training rows."""

    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


def node_table(spark, model) -> list[dict[int, tuple]]:
    """Nodes of each tree, by node id, read from the model as Spark ML saves it."""

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/trees-{uuid.uuid4().hex}"
    model.write().save(path)
    n = F.col("nodeData")
    rows = spark.read.parquet(f"{path}/data").select(
        "treeID", n["id"].alias("id"), n["prediction"].alias("prediction"), n["impurityStats"].alias("stats"),
        n["leftChild"].alias("left"), n["rightChild"].alias("right"), n["split"]["featureIndex"].alias("feature"),
        n["split"]["leftCategoriesOrThreshold"].alias("threshold"),
        n["split"]["numCategories"].alias("categories")).collect()  # bounded by the model
    trees: list[dict[int, tuple]] = [{} for _ in range(model.getNumTrees)]
    for r in rows:
        trees[r["treeID"]][r["id"]] = r
    return trees


def _threshold(node) -> tuple[float, bool]:
    """(threshold, whether the left branch is the one at or below it).

    Spark splits one-hot columns by category: 0 or 1 goes left.
    """

    if node["categories"] < 0:
        return node["threshold"][0], True
    if node["categories"] != 2 or len(node["threshold"]) != 1:
        raise ValueError("the preparation makes no columns of more than two categories")
    return 0.5, node["threshold"][0] == 0.0


def leaf_paths(spark, model, kind: str) -> list[LeafPath]:
    """All leaves of a forest (``kind`` "forest") or of boosted trees, values scaled to the margin."""

    out = []
    weights = model.treeWeights
    for tree, weight in zip(node_table(spark, model), weights):
        forest = kind == "forest"

        def cover(node, forest=forest):
            return sum(node["stats"]) if forest else node["stats"][0]

        def value(node, forest=forest, weight=weight):
            # a forest averages class shares; boosted margins are half the log-odds
            return node["stats"][1] / sum(node["stats"]) / len(weights) if forest else 2.0 * weight * node["prediction"]

        stack = [(tree[0], {})]
        while stack:
            node, path = stack.pop()
            if node["left"] < 0:
                names = sorted(path)
                low, high, share = (np.array([path[f][k] for f in names], float) for k in range(3))
                out.append(LeafPath(value(node), np.array(names, int), low, high, share))
                continue
            for child, is_left in ((tree[node["left"]], True), (tree[node["right"]], False)):
                low, high, share = path.get(node["feature"], (-np.inf, np.inf, 1.0))
                at, below = _threshold(node)
                low, high = (low, min(high, at)) if is_left == below else (max(low, at), high)
                stack.append((child, path | {node["feature"]: (low, high, share * cover(child) / cover(node))}))
    return out


def expectation(paths: list[LeafPath]) -> float:
    return float(sum(p.value * p.share.prod() for p in paths))


def attributions(paths: list[LeafPath], x: np.ndarray) -> np.ndarray:
    """(rows, features): the Shapley values of each row."""

    out = np.zeros(x.shape)
    for p in paths:
        m = len(p.features)
        if not m:
            continue
        values = x[:, p.features]
        taken = (values > p.low) & (values <= p.high)
        patterns, alike = np.unique(taken, axis=0, return_inverse=True)
        weight = [factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)]
        got = np.empty(patterns.shape)
        for j in range(m):
            # coefficients by coalition size of the product over the other features
            sizes = np.zeros((len(patterns), m))
            sizes[:, 0] = 1.0
            for i in range(m):
                if i != j:
                    sizes[:, 1:] = sizes[:, 1:] * p.share[i] + sizes[:, :-1] * patterns[:, i:i + 1]
                    sizes[:, 0] *= p.share[i]
            got[:, j] = p.value * (patterns[:, j] - p.share[j]) * (sizes @ weight)
        out[:, p.features] += got[alike.reshape(-1)]
    return out


def tree_attributions(encoded: DataFrame, paths: list[LeafPath], features: str = "features") -> DataFrame:
    """Adds ``attributions``, an array as long as the feature vector."""

    shared = encoded.sparkSession.sparkContext.broadcast(paths)

    @pandas_udf("array<double>")
    def explain(x: pd.Series) -> pd.Series:
        return pd.Series(list(attributions(shared.value, np.vstack(x.to_numpy())) if len(x) else []))

    return encoded.withColumn("attributions", explain(vector_to_array(features)))
