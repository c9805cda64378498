"""Histogram boosting against plain versions of the same rules."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from attrition.operators.boosting import UNIT, BoostedTrees, Growth, fit_boosting, mixed
from attrition.operators.ordered import ordered_statistics


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    x = np.column_stack([rng.normal(size=400).round(1), rng.integers(0, 2, 400), rng.normal(size=400).round(2), rng.integers(0, 5, 400)])
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=400) * 0.5) > 0.3).astype(int)
    w = np.where(y == 1, 1.5, 1.0)
    df = spark.createDataFrame([(f"c{i}", r.tolist(), int(t), float(v)) for i, (r, t, v) in enumerate(zip(x, y, w))],
                               "customerID string, x array<double>, Churn int, w double").repartition(5)
    return df.select("customerID", array_to_vector("x").alias("features"), "Churn", "w").cache(), x, y, w


def soft(g, alpha):
    return np.sign(g) * max(abs(g) - alpha, 0.0)


def plain_tree(x, g, h, growth, cuts):
    """One node at a time, every cut of every feature tried on the rows themselves: (leaf of each row, values)."""

    def worth(rows):
        return soft(g[rows].sum(), growth.alpha) ** 2 / (h[rows].sum() + growth.l2) / 2

    def best(rows):
        top = (1e-12, None)
        for f in range(x.shape[1]):
            for cut in cuts[f]:
                low, high = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                if min(len(low), len(high)) < max(growth.min_rows, 1) or min(h[low].sum(), h[high].sum()) < growth.min_hessian:
                    continue
                gain = worth(low) + worth(high) - worth(rows)
                if gain > top[0] + 1e-12:
                    top = (gain, (low, high))
        return top

    done, open_ = [], [(np.arange(len(x)), 0)]
    if growth.order == "leaf":
        while open_ and len(done) + len(open_) < growth.max_leaves:
            found = [(best(rows), i) for i, (rows, _) in enumerate(open_)]
            (gain, parts), i = max(found, key=lambda t: t[0][0])
            if parts is None:
                break
            open_[i:i + 1] = [(p, 0) for p in parts]
    else:
        for depth in range(growth.max_depth):
            level, open_ = open_, []
            for rows, _ in level:
                parts = best(rows)[1]
                (done if parts is None else open_).extend([(rows, 0)] if parts is None else [(p, 0) for p in parts])
    return [rows for rows, _ in done + open_], [-soft(g[r].sum(), growth.alpha) / (h[r].sum() + growth.l2) for r, _ in done + open_]


@pytest.mark.parametrize("growth", [
    Growth(rounds=3, rate=0.3, max_leaves=7, min_rows=8, l2=0.4),
    Growth(rounds=2, rate=0.3, max_leaves=15, min_rows=5, l2=4.0, alpha=0.2),
    Growth(rounds=3, rate=0.3, order="depth", max_depth=3, min_rows=1, min_hessian=2.0, l2=10.0, alpha=0.3),
], ids=["7 leaves", "15 leaves", "depth"])
def test_trees_equal_brute_force(table, growth):
    df, x, y, w = table
    model = fit_boosting(df, "Churn", growth, "customerID", "w")
    margin = np.full(len(y), model.base)
    assert model.base == pytest.approx(np.log((w * y).sum() / (w * (1 - y)).sum()))
    for tree in model.trees:
        p = 1 / (1 + np.exp(-margin))
        g, h = np.rint((p - y) * w * UNIT) / UNIT, np.rint(p * (1 - p) * w * UNIT) / UNIT
        groups, values = plain_tree(x, g, h, growth, model.cuts)
        want = np.empty(len(y))
        for rows, value in zip(groups, values):
            want[rows] = value
        one = BoostedTrees(0.0, 1.0, model.cuts, [tree])
        assert np.allclose(one.margins(x), want, atol=1e-9)
        margin = margin + growth.rate * one.margins(x)
    assert sorted(model.losses, reverse=True) == model.losses


def test_sibling_histograms_and_task_order_do_not_matter(table):
    df, x, _, _ = table
    growth = Growth(rounds=2, max_leaves=6, min_rows=5, row_share=0.7, feature_share=0.5)
    a, b = (fit_boosting(df.repartition(n), "Churn", growth, "customerID") for n in (1, 7))
    assert [t.__dict__ for t in a.trees] == [t.__dict__ for t in b.trees]
    assert all(sum(t.rows[n] for n, f in enumerate(t.feature) if f < 0) == t.rows[0] < 400 for t in a.trees)


def test_oblivious_trees_share_a_cut_per_level_and_order_keeps_rows_out(table):
    """Ordered boosting: a row's own label changes no gradient that its structure sees before the model on all rows."""

    df, x, y, _ = table
    growth = Growth(rounds=2, rate=0.3, order="oblivious", max_depth=3, l2=3.0, prefixes=3)
    model = fit_boosting(df, "Churn", growth, "customerID")
    for tree in model.trees:
        level = [0]
        while level and tree.feature[level[0]] >= 0:
            assert len({(tree.feature[n], tree.bin[n]) for n in level}) == 1
            level = [c for n in level for c in (tree.left[n], tree.right[n])]
        assert len(tree.values) == 4
    keys = np.array([r[0] for r in df.select(F.xxhash64("customerID", F.lit(42))).collect()])
    rows = [r["customerID"] for r in df.select("customerID").collect()]
    place = mixed(keys, -1)
    first, order = model.trees[0], [int(r[1:]) for r in rows]
    p = 1 / (1 + np.exp(-model.base))
    leaf = first.leaves(np.column_stack([np.searchsorted(c, x[order, j], side="left") for j, c in enumerate(model.cuts)]).astype(np.uint8))
    for s in range(4):
        own = place <= 2.0 ** (s - 3)
        for n in np.unique(leaf):
            at = own & (leaf == n)
            want = -(p - y[order][at]).sum() / (p * (1 - p) * at.sum() + 3.0)
            assert first.values[s][n] == pytest.approx(want, abs=1e-6)


def test_a_kept_model_scores_alike(spark, table, tmp_path):
    df, x, _, _ = table
    model = fit_boosting(df, "Churn", Growth(rounds=22, max_leaves=4), "customerID")  # margins are written anew once
    model.write().overwrite().save(str(tmp_path / "m"))
    loaded = BoostedTrees.load(str(tmp_path / "m"))
    assert np.array_equal(model.margins(x), loaded.margins(x))
    p = [r[0] for r in model.transform(df).select(vector_to_array("probability")[1]).collect()]
    assert len(p) == 400 and 0 < min(p) < max(p) < 1
    base = sum(path.value * path.share.prod() for path in model.leaf_paths())
    assert base == pytest.approx(float(np.mean(model.margins(x))), abs=0.5)


def test_statistics_use_earlier_rows_only(spark):
    rows = [(f"c{i}", "hot" if i % 3 else None if i % 2 else f"v{i % 4}", int(i % 5 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "customerID string, kind string, Churn int")
    got = {r["customerID"]: r for r in ordered_statistics(df, ["kind"]).collect()}
    import hashlib
    ordered = sorted(rows, key=lambda r: (hashlib.md5(f"{r[0]}42".encode()).hexdigest(), r[0]))
    prior, seen = sum(r[2] for r in rows) / 200, {}
    for cid, kind, y in ordered:
        n, s = seen.get(kind, (0, 0))
        assert got[cid]["earlier"] == n and got[cid]["statistic"] == pytest.approx((s + prior) / (n + 1))
        seen[kind] = (n + 1, s + y)
