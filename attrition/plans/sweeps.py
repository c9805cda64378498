"""Experiment sweeps: grids over estimators, feature subsets, smoothing and ensemble weights.

Each point is a cross-validated spec or a vote over scores that are there
already; rows are comparison rows with the best thresholds of the hold-out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import DROP_SPARSE_INTERACTION_COLUMNS, NO_DEMOGRAPHIC_DROP_COLUMNS, TARGET_COLUMN
from ..operators import metrics as M
from ..session import cut_lineage
from .models import ModelSpec
from .training import PROB, cross_validate, evaluate, prepare_folds, weighted_vote


def _with_thresholds(oofs: list[DataFrame], tests: list[DataFrame]) -> DataFrame:
    """Comparison rows of all points, each with its own best thresholds."""

    oof, test, best = oofs[0], tests[0], None
    for o, t in zip(oofs[1:], tests[1:]):
        oof, test = oof.unionByName(o), test.unionByName(t)
    for t in tests:
        name = t.select("model").first()[0]
        row = M.best_thresholds(M.threshold_sweep(t, TARGET_COLUMN, PROB)).withColumn("model", F.lit(name))
        best = row if best is None else best.unionByName(row)
    return evaluate(oof, test).join(best, "model")


def spec_grid(data: DataFrame, specs: list[ModelSpec], folds: int | None = None) -> DataFrame:
    folds = folds or data.agg(F.max("fold")).first()[0] + 1
    scored = [cross_validate(spec, data, folds) for spec in specs]
    return _with_thresholds([s[0] for s in scored], [s[2] for s in scored])


def feature_subset_grid(data: DataFrame, subsets: dict[str, tuple] | None = None) -> DataFrame:
    """A logistic model without each of the named sets of columns."""

    subsets = subsets or {"all columns": (), "no sparse interactions": DROP_SPARSE_INTERACTION_COLUMNS,
                          "no demographics": NO_DEMOGRAPHIC_DROP_COLUMNS}
    return spec_grid(data, [ModelSpec(name, "logistic", {"maxIter": 100}, drop_columns=tuple(drop))
                            for name, drop in subsets.items()])


#: The smoothings of the reference's table.
SMOOTHINGS = (5.0, 10.0, 20.0, 50.0, 100.0)


def smoothing_grid(data: DataFrame, values: tuple[float, ...] = SMOOTHINGS) -> DataFrame:
    """A target-encoded logistic model with each smoothing.

    A smoothing is applied to the encoders' sums, so the preparation of a fold is fitted once for all of them.
    """

    folds = data.agg(F.max("fold")).first()[0] + 1
    specs = [ModelSpec(f"smoothing {v:g}", "logistic", {"maxIter": 100}, encoder="target", smoothing=v) for v in values]
    prepared = prepare_folds(specs[0], data, folds)
    scored = [cross_validate(spec, data, folds, prepared=prepared) for spec in specs]
    return _with_thresholds([s[0] for s in scored], [s[2] for s in scored])


def weight_grid(oofs: DataFrame, tests: DataFrame, members: tuple[str, ...], grid: tuple[tuple, ...]) -> DataFrame:
    """Votes of scored members with each tuple of weights: no fit."""

    votes = []
    for weights in grid:
        name = "weights " + "-".join(f"{w:g}" for w in weights)
        by_member = dict(zip(members, map(float, weights)))
        votes.append([cut_lineage(weighted_vote(scores, by_member, name)) for scores in (oofs, tests)])
    return _with_thresholds([v[0] for v in votes], [v[1] for v in votes])
