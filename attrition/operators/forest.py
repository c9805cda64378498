"""Forests grown over distributed histograms: bootstrap class weights, random cuts.

All trees of a group grow level by level together: a pass over the binned rows sums
up, per (tree, node, feature, bin), how often rows of each class were drawn, for the
features that the node looks at.  What a pass sends back is bounded by the model: trees
are taken in groups of at most ``HELD`` sums.  Sums are whole numbers, so a forest is the
same whatever the order of tasks.

* **Bootstrap.**  How often a tree draws a row is Poisson(1), from md5 of id, seed and
  tree; with ``balanced`` a tree's class weights are ``n / (2 n_class)`` of its own draws.
* **Cuts.**  ``best``: the cut with the greatest fall of Gini impurity among the node's
  features.  ``random``: one cut per feature, drawn by hash of (tree, node, feature) between
  the least and the greatest value in the node; the best of these few is taken.

A node looks at sqrt(features) features, drawn by hash.  A leaf's value is the weighted
share of class 1, the forest's the mean over trees.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..session import cut_lineage
from .boosting import Tree, binned, cut_points, mixed
from .trees import LeafPath

HELD = 8_000_000


@dataclass(frozen=True)
class ForestGrowth:
    trees: int = 100
    max_depth: int = 8
    min_rows: int = 1
    cuts: str = "best"
    bootstrap: bool = True
    balanced: bool = False
    max_bins: int = 255
    seed: int = 42


# -- draws ------------------------------------------------------------------------

def poisson_shares(most: int = 12) -> list[float]:
    """P(count <= k) of Poisson(1)."""

    return np.cumsum([math.exp(-1) / math.factorial(k) for k in range(most)]).tolist()


def draws(key: Column, seed: int, tree: Column) -> Column:
    """How often a tree draws a row."""

    digest = F.md5(F.concat_ws(":", key, F.lit(str(seed)), tree.cast("string")))
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    count = F.lit(0)
    for share in poisson_shares():
        count = count + (u >= F.lit(share)).cast("int")
    return count


def all_draws(key: Column, growth: ForestGrowth) -> Column:
    numbers = F.sequence(F.lit(0), F.lit(growth.trees - 1))
    return F.transform(numbers, lambda t: draws(key, growth.seed, t) if growth.bootstrap else F.lit(1))


def tree_class_weights(rows: DataFrame, label: str, key: Column, growth: ForestGrowth) -> DataFrame:
    """``tree, label, drawn, weight``: of each tree's draws; summed up in each task first."""

    each = rows.select(F.col(label).alias(label), F.posexplode(all_draws(key, growth)).alias("tree", "n"))
    drawn = each.groupBy("tree", label).agg(F.sum("n").alias("drawn"))
    total = drawn.groupBy("tree").agg(F.sum("drawn").alias("total"))
    return drawn.join(total, "tree").select("tree", label, "drawn", (F.col("total") / (2.0 * F.col("drawn"))).alias("weight"))


# -- growing ------------------------------------------------------------------------

def _hash_of(growth: ForestGrowth, tree: int, node: int, features: np.ndarray, salt: int) -> np.ndarray:
    return mixed(features.astype(np.int64) + (tree << 42) + (node << 20), 7919 * growth.seed + salt)


def node_features(growth: ForestGrowth, tree: int, node: int, width: int) -> np.ndarray:
    """The features that a node looks at, ascending."""

    order = np.argsort(_hash_of(growth, tree, node, np.arange(width), 1), kind="stable")
    return np.sort(order[:max(1, math.isqrt(width))])


def _gini(n0, n1):
    total = n0 + n1
    return total - (n0 ** 2 + n1 ** 2) / np.maximum(total, 1e-300)


def choose(growth: ForestGrowth, tree: int, node: int, features: np.ndarray, sums: list[np.ndarray], weights: np.ndarray,
           ) -> tuple[float, int, int] | None:
    """(fall of impurity, feature, bin) of a node from its features' (bins, 2) sums; None: a leaf."""

    best = None
    places = _hash_of(growth, tree, node, features, 2)
    for f, table, place in zip(features.tolist(), sums, places):
        held = np.flatnonzero(table.sum(axis=1))
        if len(held) < 2:
            continue
        upto = table.cumsum(axis=0)
        if growth.cuts == "random":
            cuts = np.array([held[0] + int(place * (held[-1] - held[0]))])
        else:
            cuts = held[:-1]
        low, all_ = upto[cuts], upto[-1]
        may = (low.sum(axis=1) >= growth.min_rows) & ((all_ - low).sum(axis=1) >= growth.min_rows)
        if not may.any():
            continue
        lw, aw = low * weights, all_ * weights
        fall = _gini(*aw) - _gini(lw[:, 0], lw[:, 1]) - _gini(*(aw - lw).T)
        fall = np.where(may, fall, -np.inf)
        k = int(fall.argmax())
        if fall[k] > 1e-9 and (best is None or fall[k] > best[0] + 1e-12):
            best = (float(fall[k]), f, int(cuts[k]))
    return best


class ForestGrower:
    def __init__(self, encoded: DataFrame, label: str, key: str, growth: ForestGrowth, features: str = "features"):
        self.growth, self.cuts = growth, cut_points(encoded, features, growth.max_bins)
        self.sizes = np.array([len(c) + 1 for c in self.cuts])
        shared = encoded.sparkSession.sparkContext.broadcast(self.cuts)

        def bin_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column(2)
                if len(x):
                    rows = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
                    yield pa.RecordBatch.from_arrays(
                        [*batch.columns[:2], pa.array([r.tobytes() for r in binned(rows, shared.value)], pa.binary())],
                        names=["y", "draws", "bins"])

        named = self.row_key(key, features)
        given = encoded.select(F.col(label).cast("long").alias("y"), all_draws(named, growth).alias("draws"),
                               vector_to_array(features).alias("x"))
        self.table = cut_lineage(given.mapInArrow(bin_rows, "y long, draws array<int>, bins binary"))
        self.weights = np.ones((growth.trees, 2))
        if growth.balanced:
            for r in tree_class_weights(encoded, label, named, growth).collect():  # two rows a tree
                self.weights[r["tree"], int(r[label])] = r["weight"]

    @staticmethod
    def row_key(key: str, features: str) -> Column:
        """Rows made by resampling have no id: their features name them."""

        return F.coalesce(F.col(key).cast("string"), F.xxhash64(vector_to_array(features)).cast("string"))

    def sums(self, trees: dict[int, Tree], wanted: dict[int, dict[int, np.ndarray]]) -> dict[tuple[int, int], list[np.ndarray]]:
        """Of each wanted (tree, node) the (bins, 2) sums of each of its features."""

        width, sizes = len(self.cuts), self.sizes

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                y = batch.column(0).to_numpy(zero_copy_only=False)
                drawn = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
                bins = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(batch), width)
                for t, nodes in wanted.items():
                    at, n = trees[t].leaves(bins), drawn[:, t]
                    for node, features in nodes.items():
                        own = np.flatnonzero((at == node) & (n > 0))
                        base = np.append(0, np.cumsum(sizes[features]))
                        flat = 2 * (bins[own][:, features] + base[:-1]) + y[own, None]
                        got = np.bincount(flat.ravel(), np.repeat(n[own], len(features)), minlength=2 * int(base[-1]))
                        held[t, node] = held.get((t, node), 0) + got.astype(np.int64)
            for (t, node), table in held.items():
                slot = np.flatnonzero(table)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(slot), t)), pa.array(np.full(len(slot), node)), pa.array(slot), pa.array(table[slot])],
                    names=["tree", "node", "slot", "n"])

        got = (self.table.mapInArrow(emit, "tree long, node long, slot long, n long")
               .groupBy("tree", "node", "slot").agg(F.sum("n").alias("n")).toArrow())
        out = {(t, node): np.zeros(2 * int(sizes[f].sum()), np.int64) for t, nodes in wanted.items() for node, f in nodes.items()}
        for t, node, slot, n in zip(*(got.column(c).to_pylist() for c in ("tree", "node", "slot", "n"))):
            out[t, node][slot] = n
        return {(t, node): np.split(table.reshape(-1, 2), np.cumsum(sizes[wanted[t][node]])[:-1]) for (t, node), table in out.items()}

    def grow(self) -> list[Tree]:
        growth, width = self.growth, len(self.cuts)
        trees = {t: Tree() for t in range(growth.trees)}
        for tree in trees.values():
            tree.add()
            tree.values = [[0.0]]
        open_ = [(t, 0) for t in trees]
        for depth in range(growth.max_depth + 1):
            group = max(1, HELD // (256 * max(1, math.isqrt(width))))
            following = []
            for a in range(0, len(open_), group):
                wanted: dict[int, dict[int, np.ndarray]] = {}
                for t, node in open_[a:a + group]:
                    wanted.setdefault(t, {})[node] = node_features(growth, t, node, width)
                made = self.sums({t: trees[t] for t in wanted}, wanted)
                for (t, node), tables in made.items():
                    following += self._settle(trees[t], t, node, wanted[t][node], tables, depth)
            open_ = following
        return list(trees.values())

    def _settle(self, tree: Tree, t: int, node: int, features: np.ndarray, tables: list, depth: int) -> list[tuple[int, int]]:
        """Value and split of a node; its children, if any."""

        n0, n1 = (int(v) for v in tables[0].sum(axis=0))
        weighted = self.weights[t] * (n0, n1)
        tree.rows[node] = n0 + n1
        tree.values[0][node] = float(weighted[1] / weighted.sum()) if weighted.sum() else 0.0
        found = choose(self.growth, t, node, features, tables, self.weights[t]) if depth < self.growth.max_depth else None
        if found is None:
            return []
        _, tree.feature[node], tree.bin[node] = found
        tree.left[node], tree.right[node] = tree.add(), tree.add()
        tree.values[0] += [0.0, 0.0]
        return [(t, tree.left[node]), (t, tree.right[node])]


# -- models -----------------------------------------------------------------------

class GrownForest:
    """A fitted forest: ``transform`` adds ``rawPrediction`` and ``probability`` as Spark ML's classifiers do."""

    def __init__(self, cuts: list[np.ndarray], trees: list[Tree]):
        self.cuts, self.trees = cuts, trees

    def scores(self, x: np.ndarray) -> np.ndarray:
        bins = binned(x, self.cuts)
        return np.mean([np.array(t.values[0])[t.leaves(bins)] for t in self.trees], axis=0)

    def transform(self, encoded: DataFrame, features: str = "features") -> DataFrame:
        shared = encoded.sparkSession.sparkContext.broadcast(self)

        @pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            return pd.Series(shared.value.scores(np.vstack(x.to_numpy())) if len(x) else [], dtype=float)

        both = array_to_vector(F.array(1 - F.col("__score"), F.col("__score")))
        return encoded.withColumn("__score", score(vector_to_array(features))).withColumns(
            {"rawPrediction": both, "probability": both}).drop("__score")

    def assigned(self, encoded: DataFrame, keep: list, features: str = "features") -> DataFrame:
        """``keep, tree, leaf`` of each row and tree."""

        shared = encoded.sparkSession.sparkContext.broadcast(self)

        @pandas_udf("array<int>")
        def leaves(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            bins = binned(np.vstack(x.to_numpy()), shared.value.cuts)
            return pd.Series(list(np.stack([t.leaves(bins) for t in shared.value.trees], 1).astype(np.int32)))

        return encoded.select(*keep, F.posexplode(leaves(vector_to_array(features))).alias("tree", "leaf"))

    def leaf_table(self, spark) -> DataFrame:
        rows = [(t, n, int(tree.rows[n]), float(tree.values[0][n])) for t, tree in enumerate(self.trees)
                for n, f in enumerate(tree.feature) if f < 0]
        return spark.createDataFrame(rows, "tree int, leaf int, rows long, value double")

    def leaf_paths(self) -> list[LeafPath]:
        out = []
        for tree in self.trees:
            stack = [(0, {})]
            while stack:
                node, path = stack.pop()
                if tree.feature[node] < 0:
                    names = sorted(path)
                    low, high, share = (np.array([path[f][k] for f in names], float) for k in range(3))
                    out.append(LeafPath(tree.values[0][node] / len(self.trees), np.array(names, int), low, high, share))
                    continue
                f, at = tree.feature[node], self.cuts[tree.feature[node]][tree.bin[node]]
                low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
                for child, interval in ((tree.left[node], (low, min(high, at))), (tree.right[node], (max(low, at), high))):
                    stack.append((child, path | {f: (*interval, share * tree.rows[child] / max(tree.rows[node], 1))}))
        return out

    def write(self) -> GrownForest:
        return self

    def overwrite(self) -> GrownForest:
        return self

    def save(self, path: str) -> None:
        from pyspark.sql import SparkSession

        record = {"cuts": [c.tolist() for c in self.cuts], "trees": [asdict(t) for t in self.trees]}
        SparkSession.getActiveSession().createDataFrame([(json.dumps(record),)], "record string").coalesce(1).write.mode(
            "overwrite").text(path)

    @staticmethod
    def load(path: str) -> GrownForest:
        from pyspark.sql import SparkSession

        r = json.loads(SparkSession.getActiveSession().read.option("wholetext", True).text(path).first()[0])
        return GrownForest([np.array(c) for c in r["cuts"]], [Tree(**t) for t in r["trees"]])


@dataclass(frozen=True)
class HistogramForest:
    """``fit`` as Spark ML's estimators have it."""

    growth: ForestGrowth
    label: str
    key: str

    def fit(self, encoded: DataFrame) -> GrownForest:
        grower = ForestGrower(encoded, self.label, self.key, self.growth)
        return GrownForest(grower.cuts, grower.grow())
