"""Second-order gradient boosting of trees over distributed histograms.

Rows are binned once (cut points are exact values of each feature) and written with
their label and weight.  A tree grows from histograms: per (node, feature, bin) the
gradient, the hessian and the number of rows, summed up in each task and then in one
aggregation.  Only the smaller child of a split is built, its sibling is the parent
less it.  A pass builds children of every node that may still be split, so a tree
takes about as many passes as it has levels, whatever the order in which it grows:

* ``leaf``: best gain first, up to ``max_leaves`` leaves;
* ``depth``: level by level, down to ``max_depth``;
* ``oblivious``: one split for all nodes of a level, the one with the greatest total gain.

Gains and leaf values have the regularised form: with gradient sum G, hessian sum H
and ``T(G) = sign(G) max(|G| - alpha, 0)``, a node is worth ``T(G)^2 / (H + l2) / 2`` and
its value is ``-T(G) / (H + l2)``.  Rows and features are drawn per tree by a hash.

Gradients and hessians are summed as whole multiples of 2^-24, so sums don't depend
on the order of tasks: the same table and seed give the same trees on any cluster.

``prefixes`` = S > 0 is ordered boosting.  Rows have a place in a fixed permutation (a hash
of their key); model s of S + 1 is fitted on the first 2^(s-S) of them, all with the same
tree structures but leaf values of their own.  The gradient of a row, by which structures
are chosen, comes from the largest model fitted on rows before it only.  The last model,
on all rows, is the one that predicts.

What reaches the driver is bounded by the model: histograms of a node (features times
bins) and leaf sums.  A row's margins are stored, and written anew every ``KEEP`` trees;
trees since then are applied as rows are read.  Features are dense vectors.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..session import cut_lineage
from .trees import LeafPath

UNIT = 1 << 24
KEEP = 20


# -- bins -----------------------------------------------------------------------

def cut_points(encoded: DataFrame, features: str = "features", max_bins: int = 255) -> list[np.ndarray]:
    """Per feature ascending values; bin b holds the values above cut b-1 up to cut b, the last bin those above all."""

    shares = [0.0, *(i / max_bins for i in range(1, max_bins)), 1.0]
    values = encoded.select(F.posexplode(vector_to_array(features)).alias("j", "v"))
    rows = values.groupBy("j").agg(F.percentile_approx("v", shares, 10_000).alias("q")).orderBy("j").collect()
    return [np.unique(np.array(r["q"], float))[:-1] for r in rows]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for j, own in enumerate(cuts):
        out[:, j] = np.searchsorted(own, x[:, j], side="left")
    return out


def mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers in [0, 1) by key, others for each salt."""

    z = keys.astype(np.int64).view(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))) / float(1 << 64)


# -- trees ------------------------------------------------------------------------

@dataclass
class Tree:
    """Nodes by number; ``feature`` -1 at leaves.  ``values``: a row for each prefix model, the last one predicts."""

    feature: list = field(default_factory=list)
    bin: list = field(default_factory=list)
    left: list = field(default_factory=list)
    right: list = field(default_factory=list)
    rows: list = field(default_factory=list)
    values: list = field(default_factory=list)

    def add(self, rows: int = 0) -> int:
        for column, value in zip((self.feature, self.bin, self.left, self.right, self.rows), (-1, 0, -1, -1, rows)):
            column.append(value)
        return len(self.feature) - 1

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row."""

        feature, cut, left, right = (np.array(c) for c in (self.feature, self.bin, self.left, self.right))
        at, every = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            inner = feature[at] >= 0
            if not inner.any():
                return at
            here = at[inner]
            low = bins[every[inner], feature[here]] <= cut[here]
            at[inner] = np.where(low, left[here], right[here])


@dataclass(frozen=True)
class Growth:
    """How trees are grown."""

    rounds: int = 100
    rate: float = 0.1
    order: str = "leaf"
    max_leaves: int = 31
    max_depth: int = 0  # 0: none
    min_rows: int = 20
    min_hessian: float = 1e-3
    l2: float = 0.0
    alpha: float = 0.0
    row_share: float = 1.0
    feature_share: float = 1.0
    max_bins: int = 255
    prefixes: int = 0
    seed: int = 42


def soft(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def worth(g, h, growth: Growth):
    return soft(g, growth.alpha) ** 2 / np.maximum(h + growth.l2, 1e-300) / 2


def split_gains(histogram: np.ndarray, starts: np.ndarray, allowed: np.ndarray, growth: Growth) -> np.ndarray:
    """Gain of a cut after each slot of a node's (slots, 3) histogram, -inf where none may be."""

    sums = histogram.cumsum(axis=0)
    before = np.vstack([np.zeros((1, 3), np.int64), sums])[starts[:-1]]
    widths = np.diff(starts)
    left = sums - np.repeat(before, widths, axis=0)
    total = left[starts[1:] - 1].repeat(widths, axis=0)
    right = total - left
    (gl, hl), (gr, hr), (g, h) = ((part[:, 0] / UNIT, part[:, 1] / UNIT) for part in (left, right, total))
    gain = worth(gl, hl, growth) + worth(gr, hr, growth) - worth(g, h, growth)
    may = ((left[:, 2] >= growth.min_rows) & (right[:, 2] >= growth.min_rows) & (left[:, 2] > 0) & (right[:, 2] > 0)
           & (hl >= growth.min_hessian) & (hr >= growth.min_hessian) & np.repeat(allowed, widths))
    return np.where(may, gain, -np.inf)


# -- growing ------------------------------------------------------------------------

class Grower:
    """Grows trees over a written table of binned rows."""

    def __init__(self, encoded: DataFrame, label: str, key: str, growth: Growth, weight: str | None, features: str):
        self.growth, self.cuts = growth, cut_points(encoded, features, growth.max_bins)
        self.starts = np.append(0, np.cumsum([len(c) + 1 for c in self.cuts]))
        spark = encoded.sparkSession
        cuts = spark.sparkContext.broadcast(self.cuts)

        def bin_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column(3)
                if not len(x):
                    continue
                rows = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array([r.tobytes() for r in binned(rows, cuts.value)], pa.binary())],
                    names=["key", "y", "w", "bins"])

        # rows made by resampling have no key: their features name them
        named = F.coalesce(F.xxhash64(F.col(key).cast("string"), F.lit(growth.seed)), F.lit(0)) if key else F.lit(0)
        named = F.when(F.col(key).isNull(), F.xxhash64(vector_to_array(features), F.lit(growth.seed))).otherwise(named)
        given = encoded.select(named.alias("key"), F.col(label).cast("double").alias("y"),
                               (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
                               vector_to_array(features).alias("x"))
        self.table = given.mapInArrow(bin_rows, "key long, y double, w double, bins binary")
        total, positive = encoded.agg(F.sum(F.col(weight) if weight else F.lit(1.0)),
                                      F.sum((F.col(weight) if weight else F.lit(1.0)) * F.col(label))).first()
        share = min(max(positive / total, 1e-6), 1 - 1e-6)
        self.base = float(np.log(share / (1 - share)))
        self.models = growth.prefixes + 1
        self.table = cut_lineage(self.table.withColumn("margins", F.array(*[F.lit(self.base)] * self.models)))
        self.recent: list[Tree] = []
        self.losses: list[float] = []

    def _rows(self, batch: pa.RecordBatch, recent: list[Tree]):
        """(key, y, w, bins, margins by model) of a batch, after the recent trees."""

        key, y, w = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        width = len(self.cuts)
        bins = np.frombuffer(bytearray().join(batch.column(3).to_pylist()), np.uint8).reshape(len(batch), width)
        margins = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), self.models).copy()
        for tree in recent:
            margins += self.growth.rate * np.array(tree.values)[:, tree.leaves(bins)].T
        return key, y, w, bins, margins

    def _first_model(self, key: np.ndarray) -> np.ndarray:
        """The first model whose rows hold each row."""

        place = np.maximum(mixed(key, -1), 2.0 ** -60)
        return np.maximum(0, np.ceil(np.log2(place)).astype(np.int64) + self.growth.prefixes)

    def _gradients(self, y, w, margin) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return np.rint((p - y) * w * UNIT).astype(np.int64), np.rint(p * (1 - p) * w * UNIT).astype(np.int64)

    def _sums(self, emit, schema: str, keys: list[str]) -> pa.Table:
        found = self.table.mapInArrow(emit, schema).groupBy(*keys)
        sums = [c.split(" ")[0] for c in schema.split(", ") if c.split(" ")[0] not in keys]
        return found.agg(*[F.sum(c).alias(c) for c in sums]).toArrow()

    def _slim(self) -> Grower:
        """What tasks need of this."""

        slim = object.__new__(Grower)
        slim.growth, slim.cuts, slim.starts, slim.base, slim.models = self.growth, self.cuts, self.starts, self.base, self.models
        return slim

    def histograms(self, tree: Tree, wanted: list[int], number: int) -> dict[int, np.ndarray]:
        """Of each wanted node (a leaf of ``tree``) the (slots, 3) sums of gradient, hessian and rows.

        At the root the loss before this tree is noted.
        """

        me, recent, slots, loss_slot = self._slim(), self.recent, int(self.starts[-1]), wanted == [0]

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {node: np.zeros((slots + 1, 3), np.int64) for node in wanted}
            for batch in batches:
                key, y, w, bins, margins = me._rows(batch, recent)
                g, h = me._structure_gradients(key, y, w, margins)
                at = tree.leaves(bins)
                if loss_slot:
                    last = margins[:, -1]
                    loss = np.logaddexp(0, last) - y * last
                    sums[0][slots] += [int(np.rint(loss * w * UNIT).sum()), int(np.rint(w * UNIT).sum()), len(y)]
                drawn = mixed(key, 2 * number + 1) < me.growth.row_share
                for node in wanted:
                    own = np.flatnonzero((at == node) & drawn)
                    flat = (bins[own] + me.starts[:-1]).ravel()
                    for k, value in enumerate((g, h, np.ones(len(g), np.int64))):
                        # whole numbers under 2^53: exact as doubles
                        sums[node][:slots, k] += np.bincount(
                            flat, np.repeat(value[own], bins.shape[1]), minlength=slots).astype(np.int64)
            for node, table in sums.items():
                held = np.flatnonzero(table[:, 2])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(held), node)), pa.array(held), *(pa.array(table[held, k]) for k in range(3))],
                    names=["node", "slot", "g", "h", "n"])

        got = self._sums(emit, "node long, slot long, g long, h long, n long", ["node", "slot"])
        out = {node: np.zeros((slots + 1, 3), np.int64) for node in wanted}
        node, slot, *sums = (got.column(c).to_numpy() for c in got.column_names)
        for n in wanted:
            own = node == n
            out[n][slot[own]] = np.stack([s[own] for s in sums], 1)
        if loss_slot:
            loss, weight, _ = out[0][slots]
            self.losses.append(float(loss / max(weight, 1)))
        return {n: table[:slots] for n, table in out.items()}

    def _structure_gradients(self, key, y, w, margins):
        if self.models == 1:
            return self._gradients(y, w, margins[:, 0])
        before = self._first_model(key) - 1  # the largest model on earlier rows only; -1: none, the base
        own = np.where(before >= 0, margins[np.arange(len(key)), before], self.base)
        return self._gradients(y, w, own)

    def leaf_sums(self, tree: Tree, number: int) -> np.ndarray:
        """(models, nodes, 2): gradient and hessian of each model's rows in each leaf."""

        me, recent, nodes = self._slim(), self.recent, len(tree.feature)

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((me.models, nodes, 2), np.int64)
            for batch in batches:
                key, y, w, bins, margins = me._rows(batch, recent)
                at, first = tree.leaves(bins), me._first_model(key)
                drawn = mixed(key, 2 * number + 1) < me.growth.row_share
                for s in range(me.models):
                    own = drawn & (first <= s)
                    g, h = me._gradients(y[own], w[own], margins[own, s])
                    np.add.at(sums[s, :, 0], at[own], g)
                    np.add.at(sums[s, :, 1], at[own], h)
            model, node = np.nonzero(sums[:, :, 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(model), pa.array(node), pa.array(sums[model, node, 0]), pa.array(sums[model, node, 1])],
                names=["model", "node", "g", "h"])

        got = self._sums(emit, "model long, node long, g long, h long", ["model", "node"])
        out = np.zeros((self.models, nodes, 2), np.int64)
        out[got["model"].to_numpy(), got["node"].to_numpy()] = np.stack([got["g"].to_numpy(), got["h"].to_numpy()], 1)
        return out

    def grow(self, number: int) -> Tree:
        growth, width = self.growth, len(self.cuts)
        drawn = mixed(np.arange(width), 2 * number + 2 + growth.seed)
        allowed = np.zeros(width, bool)
        allowed[np.argsort(drawn, kind="stable")[:max(1, round(width * growth.feature_share))]] = True
        plan = Tree()
        held = {plan.add(): self.histograms(_root(), [0], number)[0]}
        plan.rows[0] = int(held[0][:self.starts[1], 2].sum())
        committed = self._oblivious(plan, held, allowed, number) if growth.order == "oblivious" else self._by_gain(
            plan, held, allowed, number)
        tree, renamed = Tree(), {}

        def copy(node: int) -> int:
            new = renamed[node] = tree.add(plan.rows[node])
            if node in committed:
                tree.feature[new], tree.bin[new] = plan.feature[node], plan.bin[node]
                tree.left[new], tree.right[new] = copy(plan.left[node]), copy(plan.right[node])
            return new

        copy(0)
        if self.models == 1:
            g, h = (np.array([held[n][:self.starts[1], k].sum() for n in renamed]) / UNIT for k in (0, 1))
            values = -soft(g, growth.alpha) / np.maximum(h + growth.l2, 1e-12)
            tree.values = [np.where(h + growth.l2 > 0, values, 0.0).tolist()]
        else:
            sums = self.leaf_sums(tree, number) / UNIT
            weight = sums[:, :, 1] + growth.l2
            tree.values = np.where(weight > 0, -soft(sums[:, :, 0], growth.alpha) / np.maximum(weight, 1e-12), 0.0).tolist()
        return tree

    def _split(self, plan: Tree, node: int, slot: int) -> None:
        """Children of ``node`` by a cut after ``slot``."""

        plan.feature[node] = int(np.searchsorted(self.starts, slot, side="right")) - 1
        plan.bin[node] = int(slot - self.starts[plan.feature[node]])
        plan.left[node], plan.right[node] = plan.add(), plan.add()

    def _build(self, plan: Tree, nodes: list[int], held: dict, number: int) -> None:
        """Histograms of the children of ``nodes``: the smaller by a pass, the other by subtraction."""

        smaller = {}
        for node in nodes:
            first = self.starts[plan.feature[node]]
            rows = int(held[node][first:first + plan.bin[node] + 1, 2].sum())
            plan.rows[plan.left[node]], plan.rows[plan.right[node]] = rows, plan.rows[node] - rows
            small, other = plan.left[node], plan.right[node]
            smaller[node] = (small, other) if 2 * rows <= plan.rows[node] else (other, small)
        made = self.histograms(plan, [s for s, _ in smaller.values()], number)
        for node, (small, other) in smaller.items():
            held[small], held[other] = made[small], held[node] - made[small]

    def _by_gain(self, plan: Tree, held: dict, allowed: np.ndarray, number: int) -> set[int]:
        growth, depth, found, committed = self.growth, {0: 0}, {}, set()
        deep = growth.max_depth or 10 ** 6
        most = growth.max_leaves if growth.order == "leaf" else 2 ** min(deep, 30)
        open_: list[tuple] = []

        def push(node: int) -> None:
            gains = split_gains(held[node], self.starts, allowed, growth)
            slot = int(gains.argmax())
            if gains[slot] > 1e-12 and depth[node] < deep:
                found[node] = slot
                heapq.heappush(open_, (-gains[slot], node) if growth.order == "leaf" else (depth[node], node))

        push(0)
        while open_ and len(committed) + 1 < most:
            node = open_[0][1]
            if plan.left[node] not in held:
                # not built: with it all others that can still be chosen
                budget = most - 1 - len(committed)
                nodes = [n for _, n in heapq.nsmallest(budget, open_) if plan.left[n] not in held]
                for n in nodes:
                    self._split(plan, n, found[n])
                self._build(plan, nodes, held, number)
            heapq.heappop(open_)
            committed.add(node)
            for child in (plan.left[node], plan.right[node]):
                depth[child] = depth[node] + 1
                push(child)
        return committed

    def _oblivious(self, plan: Tree, held: dict, allowed: np.ndarray, number: int) -> set[int]:
        level, committed = [0], set()
        # nodes of a level share one cut; a side may stay empty, the total gain decides
        loose = Growth(**asdict(self.growth) | {"min_rows": 0, "min_hessian": 0.0})
        for _ in range(self.growth.max_depth):
            total = np.zeros(int(self.starts[-1]))
            for node in level:
                gains = split_gains(held[node], self.starts, allowed, loose)
                total += np.where(np.isfinite(gains), gains, 0.0)
            slot = int(total.argmax())
            if total[slot] <= 1e-12:
                break
            for node in level:
                self._split(plan, node, slot)
            self._build(plan, level, held, number)
            committed.update(level)
            level = [c for node in level for c in (plan.left[node], plan.right[node])]
        return committed

    def keep(self) -> None:
        """Write the margins after the recent trees."""

        me, recent = self._slim(), self.recent

        def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                margins = me._rows(batch, recent)[4]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(margins.tolist(), pa.list_(pa.float64()))],
                                                 names=["key", "y", "w", "bins", "margins"])

        self.table = cut_lineage(self.table.mapInArrow(applied, self.table.schema))
        self.recent = []


def _root() -> Tree:
    tree = Tree()
    tree.add()
    return tree


# -- models -----------------------------------------------------------------------

class BoostedTrees:
    """A fitted model: ``transform`` adds ``rawPrediction`` and ``probability`` as Spark ML's classifiers do."""

    def __init__(self, base: float, rate: float, cuts: list[np.ndarray], trees: list[Tree], losses: list[float] = ()):
        self.base, self.rate, self.cuts, self.trees, self.losses = base, rate, cuts, trees, list(losses)

    def margins(self, x: np.ndarray) -> np.ndarray:
        bins = binned(x, self.cuts)
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += self.rate * np.array(tree.values[-1])[tree.leaves(bins)]
        return out

    def transform(self, encoded: DataFrame, features: str = "features") -> DataFrame:
        shared = encoded.sparkSession.sparkContext.broadcast(BoostedTrees(self.base, self.rate, self.cuts, self.trees))

        @pandas_udf("double")
        def margin(x: pd.Series) -> pd.Series:
            return pd.Series(shared.value.margins(np.vstack(x.to_numpy())) if len(x) else [], dtype=float)

        p = 1 / (1 + F.exp(-F.col("__margin")))
        return encoded.withColumn("__margin", margin(vector_to_array(features))).withColumns({
            "rawPrediction": array_to_vector(F.array(-F.col("__margin"), F.col("__margin"))),
            "probability": array_to_vector(F.array(1 - p, p))}).drop("__margin")

    def steps(self, encoded: DataFrame, keep: list[str], features: str = "features") -> DataFrame:
        """``keep, round, leaf, margin``: of each row and tree its leaf and the margin before that tree."""

        shared = encoded.sparkSession.sparkContext.broadcast(BoostedTrees(self.base, self.rate, self.cuts, self.trees))

        @pandas_udf("array<struct<round: int, leaf: int, margin: double>>")
        def walked(x: pd.Series) -> pd.Series:
            model = shared.value
            if not len(x):
                return pd.Series([], dtype=object)
            bins = binned(np.vstack(x.to_numpy()), model.cuts)
            margin, out = np.full(len(x), model.base), [[] for _ in range(len(x))]
            for number, tree in enumerate(model.trees):
                at = tree.leaves(bins)
                for row, leaf, m in zip(out, at.tolist(), margin.tolist()):
                    row.append({"round": number, "leaf": leaf, "margin": m})
                margin += model.rate * np.array(tree.values[-1])[at]
            return pd.Series(out)

        return encoded.select(*keep, F.inline(walked(vector_to_array(features))))

    def leaf_table(self, spark) -> DataFrame:
        """``round, leaf, value`` of every leaf, of the model that predicts."""

        rows = [(r, n, float(t.values[-1][n])) for r, t in enumerate(self.trees) for n, f in enumerate(t.feature) if f < 0]
        return spark.createDataFrame(rows, "round int, leaf int, value double")

    def leaf_paths(self) -> list[LeafPath]:
        """All leaves, for exact Shapley attributions; values add up to the margin."""

        out = [LeafPath(self.base, np.zeros(0, int), np.zeros(0), np.zeros(0), np.zeros(0))]
        for tree in self.trees:
            stack = [(0, {})]
            while stack:
                node, path = stack.pop()
                if tree.feature[node] < 0:
                    names = sorted(path)
                    low, high, share = (np.array([path[f][k] for f in names], float) for k in range(3))
                    out.append(LeafPath(self.rate * tree.values[-1][node], np.array(names, int), low, high, share))
                    continue
                f, at = tree.feature[node], self.cuts[tree.feature[node]][tree.bin[node]]
                low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
                for child, interval in ((tree.left[node], (low, min(high, at))), (tree.right[node], (max(low, at), high))):
                    part = tree.rows[child] / max(tree.rows[node], 1)
                    stack.append((child, path | {f: (*interval, share * part)}))
        return out

    # kept as one record, as Spark ML's models are kept by a writer
    def write(self) -> BoostedTrees:
        return self

    def overwrite(self) -> BoostedTrees:
        return self

    def save(self, path: str) -> None:
        from pyspark.sql import SparkSession

        record = {"base": self.base, "rate": self.rate, "cuts": [c.tolist() for c in self.cuts],
                  "trees": [asdict(t) for t in self.trees], "losses": self.losses}
        SparkSession.getActiveSession().createDataFrame([(json.dumps(record),)], "record string").coalesce(1).write.mode(
            "overwrite").text(path)

    @staticmethod
    def load(path: str) -> BoostedTrees:
        from pyspark.sql import SparkSession

        r = json.loads(SparkSession.getActiveSession().read.option("wholetext", True).text(path).first()[0])
        return BoostedTrees(r["base"], r["rate"], [np.array(c) for c in r["cuts"]], [Tree(**t) for t in r["trees"]], r["losses"])


def fit_boosting(encoded: DataFrame, label: str, growth: Growth, key: str, weight: str | None = None,
                 features: str = "features") -> BoostedTrees:
    grower = Grower(encoded, label, key, growth, weight, features)
    trees = []
    for number in range(growth.rounds):
        trees.append(grower.grow(number))
        grower.recent.append(trees[-1])
        if len(grower.recent) == KEEP:
            grower.keep()
    return BoostedTrees(grower.base, growth.rate, grower.cuts, trees, grower.losses)


@dataclass(frozen=True)
class HistogramBoosting:
    """``fit`` as Spark ML's estimators have it."""

    growth: Growth
    label: str
    key: str
    weight: str | None = None

    def fit(self, encoded: DataFrame) -> BoostedTrees:
        return fit_boosting(encoded, self.label, self.growth, self.key, self.weight)
