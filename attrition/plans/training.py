"""Fitting specs, cross-validation, ensembles and the training run.

Data flow: the featured table with ``is_test``/``fold`` is written once to the
checkpoint folder; every fit reads it.  Per spec and fold the preparation is
fitted on the fold's training rows (small aggregates), the encoded rows go to
a Spark ML estimator, and the held-out fold is scored.  Scores of all folds are
unioned and evaluated per (model, fold) in one grouped-metrics job.  Soft
voting reuses the members' out-of-fold and test scores (the members are the
same pipelines refitted on the same rows), so ensembles add no fits except
stacking's inner out-of-fold scores.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark.ml.classification import (
    GBTClassificationModel,
    LinearSVCModel,
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassificationModel,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import CV_FOLDS, ID_COLUMN, RANDOM_STATE, TARGET_COLUMN
from ..operators import metrics as M
from ..operators.boosting import BoostedTrees
from ..operators.forest import GrownForest
from ..operators.kernel import KernelMap, fit_kernel_map, kernel_features
from ..operators.logistic import PenalisedLogisticModel
from ..operators.prep import FittedPrep, class_weight_expr, fit_prep
from ..operators.selection import comparison_table
from ..operators.split import class_counts, holdout_sizes, stratified_rank
from ..session import cut_lineage
from .models import ModelSpec, dealt

PROB = "churn_probability"


@dataclass
class FittedModel:
    spec: ModelSpec
    prep: FittedPrep
    model: object
    platt: object = None  # for margin models: logistic calibration of the SVM margin
    kernel: KernelMap | None = None  # the feature map of a kernel machine

    def encode(self, df: DataFrame, keep=(ID_COLUMN, TARGET_COLUMN)) -> DataFrame:
        return self.mapped(self.prep.transform(df, keep=keep))

    def mapped(self, prepared: DataFrame) -> DataFrame:
        """Prepared features as the estimator takes them."""

        return prepared if self.kernel is None else kernel_features(prepared, self.kernel)

    def predict_prepared(self, prepared: DataFrame, keep) -> DataFrame:
        return self.predict_encoded(self.mapped(prepared), keep)

    def predict(self, df: DataFrame, keep=(ID_COLUMN, TARGET_COLUMN)) -> DataFrame:
        """keep columns + churn_probability (class-1 probability)."""

        return self.predict_encoded(self.encode(df, keep), [c for c in keep if c in df.columns])

    def predict_encoded(self, encoded: DataFrame, keep) -> DataFrame:
        """Class-1 probability for rows that already hold the prepared ``features`` vector."""

        scored = self.model.transform(encoded)
        if self.platt is not None:
            margin = scored.select(*keep, vector_to_array("rawPrediction")[1].alias("margin"))
            calibrated = self.platt.transform(_margin_vector(margin))
            return calibrated.select(*keep, vector_to_array("probability")[1].alias(PROB))
        return scored.select(*keep, vector_to_array("probability")[1].alias(PROB))


def _margin_vector(df: DataFrame) -> DataFrame:
    return df.withColumn("margin_features", array_to_vector(F.array("margin")))


#: Inner folds of the training rows' target encodings.
ENCODING_FOLDS = 5


def _encoding_fold(seed: int) -> F.Column:
    return F.pmod(F.xxhash64(F.col(ID_COLUMN), F.lit(seed)), F.lit(ENCODING_FOLDS)).cast("int")


def prepare(spec: ModelSpec, train: DataFrame, seed: int = RANDOM_STATE) -> tuple[FittedPrep, list]:
    """The preparation of a spec fitted on ``train``, and the encoders of its inner folds.

    Specs that differ only in estimator and smoothing share it.
    """

    prep = fit_prep(train, spec.encoder, spec.scale_numeric, spec.drop_columns, smoothing=spec.smoothing)
    return prep, prep.out_of_fold_coders(train, _encoding_fold(seed), ENCODING_FOLDS)


def fit_spec(spec: ModelSpec, train: DataFrame, seed: int = RANDOM_STATE, inner_fold_col: str | None = None,
             prepared: tuple[FittedPrep, list] | None = None) -> FittedModel:
    """Fit preparation (or take ``prepared``) and estimator of one spec on ``train`` (featured rows with a label)."""

    prep, coders = prepared or prepare(spec, train, seed)
    if prep.smoothing != spec.smoothing:
        prep = prep.smoothed(spec.smoothing)
    if spec.encoder == "target":
        # training rows get cross-fitted encodings (an inner, keyed 5-way split of these rows)
        encoded = prep.transform_out_of_fold(train, _encoding_fold(seed), ENCODING_FOLDS, coders=coders)
    else:
        encoded = prep.transform(train)
    # read by the class counts and by every iteration of the estimator
    encoded = cut_lineage(encoded)
    if spec.sampler == "smote":
        from ..operators.sampling import smote
        encoded = smote(encoded, TARGET_COLUMN, seed=seed)
    kernel = None
    if spec.kind == "svm":
        kernel = fit_kernel_map(encoded, landmarks=spec.landmarks, seed=seed)
        encoded = cut_lineage(kernel_features(encoded, kernel))
    weight_col = None
    counts = class_counts(encoded, TARGET_COLUMN)
    if spec.balanced:
        encoded = encoded.withColumn("_w", F.expr(class_weight_expr(counts)))
        weight_col = "_w"
    n_train = sum(counts.values())
    if spec.kind in ("forest", "boosting"):
        encoded = dealt(encoded, n_train)
    model = spec.estimator(n_train, seed, weight_col).fit(encoded)
    platt = None
    if spec.kind == "svm":
        margins = model.transform(encoded).select(TARGET_COLUMN, vector_to_array("rawPrediction")[1].alias("margin"))
        platt = LogisticRegression(featuresCol="margin_features", labelCol=TARGET_COLUMN, regParam=0.0).fit(
            _margin_vector(margins))
    return FittedModel(spec, prep, model, platt, kernel)


def prepare_folds(spec: ModelSpec, data: DataFrame, folds: int = CV_FOLDS, seed: int = RANDOM_STATE,
                  workers: int = 4) -> list[tuple[FittedPrep, list]]:
    """``prepare`` for the fits of ``cross_validate``: those without one of the folds, and that on all training rows."""

    train_rows = data.filter(~F.col("is_test"))
    with ThreadPoolExecutor(max_workers=max(1, workers)) as pool:
        return list(pool.map(lambda k: prepare(spec, train_rows if k == folds else train_rows.filter(F.col("fold") != k), seed),
                             range(folds + 1)))


def cross_validate(spec: ModelSpec, data: DataFrame, folds: int = CV_FOLDS, seed: int = RANDOM_STATE, workers: int = 4,
                   prepared: list[tuple[FittedPrep, list]] | None = None) -> tuple[DataFrame, FittedModel, DataFrame]:
    """Out-of-fold scores (model, fold, id, label, p), the refitted model and its hold-out scores.

    ``prepared`` (``prepare_folds``) is shared by specs that differ only in estimator and smoothing.

    The k fold fits and the final refit are independent Spark jobs over the same
    materialized table, submitted from a small thread pool so their (small,
    iterative) jobs share the cluster instead of running back to back.
    """

    train_rows = data.filter(~F.col("is_test"))
    test_rows = data.filter(F.col("is_test"))
    ready = prepared or [None] * (folds + 1)

    def one(k: int):
        if k == folds:
            return fit_spec(spec, train_rows, seed, prepared=ready[k])
        fitted = fit_spec(spec, train_rows.filter(F.col("fold") != k), seed, prepared=ready[k])
        return fitted.predict(train_rows.filter(F.col("fold") == k)).withColumn("fold", F.lit(k))

    with ThreadPoolExecutor(max_workers=max(1, workers)) as pool:
        results = list(pool.map(one, range(folds + 1)))
    parts, final = results[:folds], results[folds]
    oof = parts[0]
    for p in parts[1:]:
        oof = oof.unionByName(p)
    test_scores = final.predict(test_rows)
    name = F.lit(spec.name)
    # scored once, then read by the counts, cut points and ranks of the metrics
    return cut_lineage(oof.withColumn("model", name)), final, cut_lineage(test_scores.withColumn("model", name))


def evaluate(oof: DataFrame, test_scores: DataFrame) -> DataFrame:
    """Comparison rows for every model present in the (written) score tables."""

    fold_rows = M.grouped_metrics(oof, TARGET_COLUMN, PROB, ["model", "fold"])
    test_rows = M.grouped_metrics(test_scores, TARGET_COLUMN, PROB, ["model"])
    return comparison_table(fold_rows, test_rows)


def weighted_vote(scores: DataFrame, members: dict[str, float], name: str,
                  keys=(ID_COLUMN, TARGET_COLUMN)) -> DataFrame:
    """Soft vote: weighted mean of member probabilities per row (rows are grouped by key, not collected)."""

    total = float(sum(members.values()))
    weight = F.lit(0.0)
    for m, w in members.items():
        weight = F.when(F.col("model") == m, F.lit(w)).otherwise(weight)
    grouped = scores.filter(F.col("model").isin(list(members))).groupBy(*keys, *(["fold"] if "fold" in scores.columns else []))
    return grouped.agg((F.sum(F.col(PROB) * weight) / F.lit(total)).alias(PROB)).withColumn("model", F.lit(name))


def inner_folds_of(train: DataFrame, folds: int, seed: int) -> DataFrame:
    """``train`` with a stratified inner fold ``_sf`` (rank within the class, keyed by id)."""

    ranked = stratified_rank(train.select(ID_COLUMN, TARGET_COLUMN), seed=seed + 7)
    keyed = ranked.select(ID_COLUMN, F.pmod(F.col("_rank"), F.lit(folds)).cast("int").alias("_sf"))
    return train.join(keyed, ID_COLUMN)


@dataclass
class FittedEnsemble:
    """Members whose probabilities are averaged by weight, or fed to a logistic meta model.

    All members score the same row, one after the other in one row-local plan.
    """

    name: str
    members: list[FittedModel]
    weights: list[float] | None = None
    meta: object = None

    def member_matrix(self, df: DataFrame, keep=(ID_COLUMN, TARGET_COLUMN)) -> DataFrame:
        """``keep`` columns and ``_p``, the array of the members' probabilities."""

        out, columns = df, list(df.columns)
        for i, member in enumerate(self.members):
            out = member.predict(out, keep=(*columns, *(f"_p{j}" for j in range(i)))).withColumnRenamed(PROB, f"_p{i}")
        kept = [c for c in keep if c in columns]
        return out.select(*kept, F.array(*[f"_p{i}" for i in range(len(self.members))]).alias("_p"))

    def predict(self, df: DataFrame, keep=(ID_COLUMN, TARGET_COLUMN)) -> DataFrame:
        kept = [c for c in keep if c in df.columns]
        matrix = self.member_matrix(df, kept)
        if self.meta is not None:
            scored = self.meta.transform(matrix.withColumn("meta", array_to_vector("_p")))
            return scored.select(*kept, vector_to_array("probability")[1].alias(PROB))
        total = float(sum(self.weights))
        mean = sum(F.col("_p")[i] * F.lit(float(w)) for i, w in enumerate(self.weights)) / F.lit(total)
        return matrix.select(*kept, mean.alias(PROB))


def fit_stack(specs: list[ModelSpec], train: DataFrame, seed: int = RANDOM_STATE, inner_folds: int = 3,
              meta_c: float = 0.5, workers: int = 4) -> FittedEnsemble:
    """Members on all rows, a meta logistic regression on their out-of-fold probabilities.

    All fits (members by inner folds, and members on all rows) are independent
    and run from a thread pool.
    """

    tagged = cut_lineage(inner_folds_of(train, inner_folds, seed))
    jobs = [(s, j) for j in [*range(inner_folds), None] for s in specs]

    def fit(job):
        spec, j = job
        return fit_spec(spec, train if j is None else tagged.filter(F.col("_sf") != j).drop("_sf"), seed)

    with ThreadPoolExecutor(max_workers=max(1, workers)) as pool:
        fitted = list(pool.map(fit, jobs))
    parts = None
    for j in range(inner_folds):
        members = FittedEnsemble("inner", fitted[j * len(specs):(j + 1) * len(specs)])
        part = members.member_matrix(tagged.filter(F.col("_sf") == j))
        parts = part if parts is None else parts.unionByName(part)
    oof = cut_lineage(parts.withColumn("meta", array_to_vector("_p")))
    meta = LogisticRegression(featuresCol="meta", labelCol=TARGET_COLUMN, regParam=1.0 / (meta_c * oof.count()),
                              standardization=False, maxIter=2000, tol=1e-8).fit(oof)
    return FittedEnsemble("Stacking Ensemble", fitted[inner_folds * len(specs):], meta=meta)


def stacking_scores(specs: list[ModelSpec], data: DataFrame, folds: int = CV_FOLDS, seed: int = RANDOM_STATE,
                    inner_folds: int = 3, meta_c: float = 0.5) -> tuple[DataFrame, FittedEnsemble, DataFrame]:
    """Stacked ensemble: (out-of-fold scores, the ensemble fitted on all training rows, hold-out scores)."""

    train_rows = data.filter(~F.col("is_test"))
    oof = None
    for k in range(folds):
        stack = fit_stack(specs, train_rows.filter(F.col("fold") != k), seed, inner_folds, meta_c)
        part = stack.predict(train_rows.filter(F.col("fold") == k)).withColumn("fold", F.lit(k))
        oof = part if oof is None else oof.unionByName(part)
    final = fit_stack(specs, train_rows, seed, inner_folds, meta_c)
    name = F.lit(final.name)
    return (cut_lineage(oof.withColumn("model", name)), final,
            cut_lineage(final.predict(data.filter(F.col("is_test"))).withColumn("model", name)))


# -- keeping fitted models ----------------------------------------------------------------

_MODEL_CLASSES = {"logistic": PenalisedLogisticModel, "forest": RandomForestClassificationModel,
                  "boosting": GBTClassificationModel, "histogram": BoostedTrees,
                  "grown_forest": GrownForest, "svm": LinearSVCModel}


def _write_record(spark, record: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(record),)], "record string").coalesce(1).write.mode("overwrite").text(path)


def save_model(spark, fitted: FittedModel | FittedEnsemble, path: str, threshold: float) -> None:
    """A model of any kind with its preparation, calibration, kernel map and operating threshold."""

    if isinstance(fitted, FittedEnsemble):
        for i, member in enumerate(fitted.members):
            save_model(spark, member, f"{path}/member{i}", threshold)
        if fitted.meta is not None:
            fitted.meta.write().overwrite().save(f"{path}/meta")
        _write_record(spark, {"ensemble": fitted.name, "members": len(fitted.members), "weights": fitted.weights,
                              "threshold": threshold}, f"{path}/about")
        return
    fitted.prep.save(spark, path)
    fitted.model.write().overwrite().save(f"{path}/model")
    if fitted.platt is not None:
        fitted.platt.write().overwrite().save(f"{path}/platt")
    kernel = None if fitted.kernel is None else fitted.kernel.record()
    _write_record(spark, {"spec": asdict(fitted.spec), "features": fitted.prep.feature_names, "kernel": kernel,
                          "threshold": threshold}, f"{path}/about")


def load_model(spark, path: str) -> tuple[FittedModel | FittedEnsemble, float]:
    """(model, operating threshold) as saved."""

    about = json.loads(spark.read.option("wholetext", True).text(f"{path}/about").first()[0])
    if "ensemble" in about:
        members = [load_model(spark, f"{path}/member{i}")[0] for i in range(about["members"])]
        meta = LogisticRegressionModel.load(f"{path}/meta") if about["weights"] is None else None
        return FittedEnsemble(about["ensemble"], members, about["weights"], meta), about["threshold"]
    spec = ModelSpec(**{k: tuple(v) if k == "drop_columns" else v for k, v in about["spec"].items()})
    platt = LogisticRegressionModel.load(f"{path}/platt") if spec.kind == "svm" else None
    kernel = None if about["kernel"] is None else KernelMap.from_record(about["kernel"])
    model = _MODEL_CLASSES[spec.kind].load(f"{path}/model")
    return FittedModel(spec, FittedPrep.load(spark, path), model, platt, kernel), about["threshold"]
