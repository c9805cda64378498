"""Candidate model specifications as Spark ML estimators.

Each spec says which estimator to fit, whether training rows are rebalanced
(SMOTE) or weighted, how categoricals are encoded, whether numerics are
standardised and which columns are dropped.  The boosting libraries' models are
grown over distributed histograms (``operators/boosting.py``): leaf by leaf, level
by level with l2 and alpha, or oblivious and ordered.  Forests with weights per bootstrap
or random cuts are grown the same way (``operators/forest.py``).  Logistic models
penalise the intercept too (``operators/logistic.py``).  RBF SVMs are landmark
(Nyström) features + linear SVM + Platt scaling.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier, LinearSVC, RandomForestClassifier
from pyspark.sql import DataFrame

from ..constants import (
    DROP_SPARSE_INTERACTION_COLUMNS,
    FOCUSED_ACCURACY_DROP_COLUMNS,
    ID_COLUMN,
    NO_DEMOGRAPHIC_DROP_COLUMNS,
    RANDOM_STATE,
    TARGET_COLUMN,
    TARGET_ENCODING_SMOOTHING,
)
from ..operators.boosting import Growth, HistogramBoosting
from ..operators.forest import ForestGrowth, HistogramForest
from ..operators.logistic import PenalisedLogistic

LABEL = TARGET_COLUMN
#: Rows up to which one task grows Spark's trees.
TASK_ROWS = 8_192
#: From so many rows on, a pass of Spark's forest adds up only as many nodes as stay in a core's cache: a row's sums lie
#: anywhere among those of all nodes, so a pass over many nodes waits for memory at every row and tree.
CACHED_FROM_ROWS, CACHED_MB = 250_000, 1


@dataclass(frozen=True)
class ModelSpec:
    name: str
    kind: str  # "logistic", "forest", "grown_forest", "boosting", "histogram", "svm"
    params: dict = field(default_factory=dict)
    sampler: str | None = None
    encoder: str = "onehot"
    scale_numeric: bool = True
    drop_columns: tuple = ()
    balanced: bool = False
    smoothing: float = TARGET_ENCODING_SMOOTHING
    landmarks: int = 300  # of a kernel model's feature map

    def estimator(self, n_train: int, seed: int = RANDOM_STATE, weight_col: str | None = None):
        p = dict(self.params)
        common = {"featuresCol": "features", "labelCol": LABEL}
        if weight_col:
            common["weightCol"] = weight_col
        if self.kind == "logistic":
            return PenalisedLogistic(LABEL, p.pop("C", 1.0), p.pop("maxIter", 1000), weight_col)
        if self.kind == "forest":
            if n_train >= CACHED_FROM_ROWS:
                common["maxMemoryInMB"] = p.pop("maxMemoryInMB", CACHED_MB)
            return RandomForestClassifier(seed=seed, featureSubsetStrategy=p.pop("featureSubsetStrategy", "sqrt"),
                                          **p, **common)
        if self.kind == "boosting":
            return GBTClassifier(seed=seed, **p, **common)
        if self.kind == "grown_forest":
            return HistogramForest(ForestGrowth(seed=seed, **p), LABEL, ID_COLUMN)
        if self.kind == "histogram":
            return HistogramBoosting(Growth(seed=seed, **p), LABEL, ID_COLUMN, weight_col)
        if self.kind == "svm":
            c = p.pop("C", 1.0)
            return LinearSVC(regParam=1.0 / (c * max(n_train, 1)), maxIter=p.pop("maxIter", 200),
                             standardization=False, **common)
        raise ValueError(self.kind)


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """Rows dealt evenly over the cores, however few files hold them; a task gets ``TASK_ROWS`` at least."""

    tasks = min(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n / TASK_ROWS))
    return rows.repartition(tasks) if tasks > 1 else rows


#: Fixed values.  Leaf-wise growth takes no row share: without a bagging frequency it has no effect.
HIST_TUNED = {"rounds": 300, "rate": 0.018, "max_leaves": 8, "min_rows": 20, "l2": 0.4}
LEAF_TUNED = {"rounds": 650, "rate": 0.015, "max_leaves": 7, "min_rows": 70, "l2": 12.0, "alpha": 0.2, "feature_share": 0.7}
DEPTH_TUNED = {"rounds": 520, "rate": 0.018, "order": "depth", "max_depth": 2, "min_rows": 1, "min_hessian": 12.0,
               "l2": 10.0, "alpha": 0.3, "row_share": 0.85, "feature_share": 0.75}
ORDERED = {"rounds": 450, "rate": 0.025, "order": "oblivious", "max_depth": 3, "l2": 8.0, "prefixes": 6}


def candidate_model_specs(random_state: int = RANDOM_STATE) -> list[ModelSpec]:
    """The 19 individual candidates (parameters: fixed values)."""

    del random_state  # seeds are applied at fit time
    return [
        ModelSpec("Logistic Regression (SMOTE)", "logistic", {"maxIter": 1000}, sampler="smote", balanced=True),
        ModelSpec("Logistic Regression (No SMOTE)", "logistic", {"maxIter": 1500}),
        ModelSpec("Logistic Regression (Target Encoded)", "logistic", {"maxIter": 2000}, encoder="target"),
        ModelSpec("Logistic Regression (Focused Accuracy)", "logistic", {"maxIter": 2000},
                  drop_columns=FOCUSED_ACCURACY_DROP_COLUMNS),
        # class weights are each bootstrap's own
        ModelSpec("Random Forest (SMOTE)", "grown_forest",
                  {"trees": 220, "max_depth": 9, "min_rows": 5, "balanced": True}, sampler="smote"),
        ModelSpec("Random Forest (No SMOTE Tuned)", "forest",
                  {"numTrees": 700, "maxDepth": 7, "minInstancesPerNode": 8}, scale_numeric=False),
        ModelSpec("Extra Trees (No SMOTE)", "grown_forest",
                  {"trees": 800, "max_depth": 8, "min_rows": 8, "cuts": "random", "bootstrap": False}, scale_numeric=False),
        ModelSpec("SVM RBF (SMOTE)", "svm", {"C": 1.0}, sampler="smote", balanced=True),
        ModelSpec("SVM RBF (No SMOTE)", "svm", {"C": 0.8}),
        ModelSpec("Gradient Boosting (No SMOTE)", "boosting",
                  {"maxIter": 240, "stepSize": 0.025, "maxDepth": 2, "minInstancesPerNode": 15,
                   "subsamplingRate": 0.85}, scale_numeric=False),
        ModelSpec("HistGradientBoosting (No SMOTE Tuned)", "histogram", HIST_TUNED, scale_numeric=False),
        ModelSpec("XGBoost (SMOTE)", "histogram",
                  {"rounds": 220, "rate": 0.05, "order": "depth", "max_depth": 3, "min_rows": 1, "min_hessian": 1.0,
                   "l2": 1.0, "row_share": 0.9, "feature_share": 0.9}, sampler="smote"),
        ModelSpec("XGBoost (No SMOTE Tuned)", "histogram", DEPTH_TUNED, scale_numeric=False),
        ModelSpec("LightGBM (SMOTE Balanced)", "histogram", {"rounds": 220, "rate": 0.05, "max_leaves": 31},
                  sampler="smote", balanced=True),
        ModelSpec("LightGBM (No SMOTE Tuned)", "histogram", LEAF_TUNED, scale_numeric=False),
        ModelSpec("LightGBM (No SMOTE Balanced)", "histogram",
                  {"rounds": 300, "rate": 0.025, "max_leaves": 15, "min_rows": 40, "l2": 4.0, "feature_share": 0.8},
                  scale_numeric=False, balanced=True),
        ModelSpec("CatBoost (SMOTE)", "histogram", ORDERED | {"rounds": 220, "rate": 0.05, "max_depth": 4, "l2": 3.0},
                  sampler="smote"),
        ModelSpec("CatBoost (No SMOTE Tuned)", "histogram", ORDERED),
        ModelSpec("CatBoost (No SMOTE Balanced)", "histogram", ORDERED, balanced=True),
    ]


QUICK_MODELS = ("Logistic Regression (No SMOTE)", "Random Forest (No SMOTE Tuned)")


def focused_members() -> list[tuple[ModelSpec, float]]:
    """The accuracy-focused soft-vote members and their weights (4, 1, 1, 1, 1)."""

    return [
        (ModelSpec("lr_focused", "logistic", {"maxIter": 2000}, drop_columns=FOCUSED_ACCURACY_DROP_COLUMNS), 4.0),
        (ModelSpec("lr_drop_sparse_target", "logistic", {"maxIter": 2000}, encoder="target",
                   drop_columns=DROP_SPARSE_INTERACTION_COLUMNS), 1.0),
        (ModelSpec("lgbm_all", "histogram", LEAF_TUNED, scale_numeric=False), 1.0),
        (ModelSpec("hgb_no_demographics", "histogram", HIST_TUNED, scale_numeric=False,
                   drop_columns=NO_DEMOGRAPHIC_DROP_COLUMNS), 1.0),
        (ModelSpec("xgb_all", "histogram", DEPTH_TUNED, scale_numeric=False), 1.0),
    ]
