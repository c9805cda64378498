"""The end-to-end training run: split, fit and compare candidates, ensembles, select,
sweep thresholds, decide, explain, and write every result table.

Result tables go to ``output_dir`` (any Hadoop path) as Parquet; the records are
one-row JSON tables.  The selected model, an ensemble too, is kept with its
preparation and threshold (``training.load_model`` reads it back).
"""

from __future__ import annotations

import json

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import (
    CV_FOLDS,
    ID_COLUMN,
    PR_AUC_TOLERANCE,
    QUICK_CV_FOLDS,
    RANDOM_STATE,
    REQUIRED_COLUMNS,
    TARGET_COLUMN,
)
from ..operators import explain as X
from ..operators import metrics as M
from ..operators.coalitions import BACKGROUND, coalition_attributions
from ..operators.decisions import add_decision_outputs
from ..operators.features import add_domain_features, tenure_summary
from ..operators.selection import explainer_choice, select_model, top_by_cv
from ..operators.split import assign_split
from ..operators.summary import dataset_summary
from ..operators.trees import expectation, leaf_paths, tree_attributions
from ..session import cut_lineage
from ..sources.files import write_table
from .models import QUICK_MODELS, ModelSpec, candidate_model_specs, focused_members
from .training import (
    PROB,
    FittedEnsemble,
    FittedModel,
    cross_validate,
    evaluate,
    save_model,
    stacking_scores,
    weighted_vote,
)

SOFT_VOTE, FOCUSED_VOTE = "Soft Voting Ensemble", "Focused Voting Ensemble"


def run_training(spark: SparkSession, clean: DataFrame, output_dir: str | None = None, seed: int = RANDOM_STATE,
                 quick: bool = False, models: list[str] | None = None, ensembles: bool = True,
                 workers: int = 4, specs: list[ModelSpec] | None = None,
                 focused: list[tuple[ModelSpec, float]] | None = None, lime_rows: int = 5,
                 lime_samples: int = 5000, folds: int | None = None) -> dict:
    """Returns the tables, the record and the fitted models; writes them if ``output_dir`` is given.

    ``specs`` and ``focused`` replace the candidates and the focused members.
    """

    folds = folds or (QUICK_CV_FOLDS if quick else CV_FOLDS)
    featured = cut_lineage(add_domain_features(clean))
    data = cut_lineage(assign_split(featured, seed=seed, folds=folds))
    train, test = data.filter(~F.col("is_test")), data.filter(F.col("is_test"))

    specs = specs or candidate_model_specs(seed)
    if quick:
        specs = [s for s in specs if s.name in QUICK_MODELS]
    if models:
        specs = [s for s in specs if s.name in models]
    oofs, tests, fitted = [], [], {}
    for spec in specs:
        oof, fitted[spec.name], scores = cross_validate(spec, data, folds, seed, workers)
        oofs.append(oof)
        tests.append(scores)
    individual = cut_lineage(evaluate(_union(oofs), _union(tests)))

    if ensembles and len(specs) >= 2:
        top3 = [r["model"] for r in top_by_cv(individual, 3).collect()]
        weights = {m: 1.0 for m in top3}
        oofs.append(cut_lineage(weighted_vote(_union(oofs), weights, SOFT_VOTE)))
        tests.append(cut_lineage(weighted_vote(_union(tests), weights, SOFT_VOTE)))
        fitted[SOFT_VOTE] = FittedEnsemble(SOFT_VOTE, [fitted[m] for m in top3], list(weights.values()))
        by_name = {s.name: s for s in specs}
        stacked = stacking_scores([by_name[m] for m in top3], data, folds, seed)
        voted = _focused(focused or focused_members(), data, folds, seed, workers)
        for oof, final, scores in (stacked, voted):
            oofs.append(oof)
            tests.append(scores)
            fitted[final.name] = final
    test_all = _union(tests)
    comparison = cut_lineage(evaluate(_union(oofs), test_all))

    best_name = select_model(comparison).first()["model"]
    best_scores = test_all.filter(F.col("model") == best_name).select(ID_COLUMN, TARGET_COLUMN, PROB)
    sweep = cut_lineage(M.threshold_sweep(best_scores, TARGET_COLUMN, PROB))
    best_t = M.best_thresholds(sweep).first().asDict()
    operational = best_t["cost_sensitive_threshold"]

    def metrics_at(t):
        return M.classification_metrics(best_scores, TARGET_COLUMN, PROB, t).first().asDict()

    final_metrics = {
        "selected_model": best_name,
        "selection_policy": f"within {PR_AUC_TOLERANCE} of the best mean cross-validated PR-AUC, the best hold-out "
                            "accuracy, then mean cross-validated accuracy, F1 and PR-AUC",
        "top_three_models": [r["model"] for r in top_by_cv(comparison, 3).collect()],
        "default_threshold_metrics": metrics_at(0.50),
        "accuracy_optimal_threshold_metrics": metrics_at(best_t["accuracy_optimal_threshold"]),
        "operational_threshold_metrics": metrics_at(operational),
        "threshold_summary": best_t,
    }
    customers = test.drop("is_test", "fold").join(best_scores.drop(TARGET_COLUMN), ID_COLUMN)
    decisions = add_decision_outputs(customers, operational)

    single = comparison.filter(F.col("model").isin([s.name for s in specs]))
    explainer = explainer_choice(single).first()["model"]
    explained = cut_lineage(explain_model(fitted[explainer], train, test))
    names = fitted[explainer].prep.feature_names
    importance = cut_lineage(X.global_importance(explained, names))
    local = X.local_drivers(explained, names)
    lime = _lime(fitted[explainer], train, test, lime_rows, lime_samples)

    tables = {
        "tenure_summary": tenure_summary(featured),
        "dataset_summary": dataset_summary(clean, len(REQUIRED_COLUMNS), "table"),
        "model_comparison": comparison, "threshold_analysis": sweep, "decision_outputs": decisions,
        "shap_global_importance": importance, "shap_local_explanations": local, "lime_local_explanations": lime,
    }
    record = {
        "selected_model": best_name, "explainer_model": explainer, "models": sorted(fitted),
        "explained_customers": explained.count(), "lime_customers": lime_rows,
        "top_features": [r["feature"] for r in X.top_importance(importance, 10).collect()],
    }
    if output_dir:
        for name, df in tables.items():
            write_table(df, f"{output_dir}/{name}")
        for name, value in (("final_metrics", final_metrics), ("run_record", record)):
            text = spark.createDataFrame([(json.dumps(value, default=float),)], "record string").coalesce(1)
            text.write.mode("overwrite").text(f"{output_dir}/{name}")
        save_model(spark, fitted[best_name], f"{output_dir}/model", operational)
    return {"tables": tables, "final_metrics": final_metrics, "record": record, "selected_model": best_name,
            "explainer_model": explainer, "fitted": fitted, "threshold": operational, "test": test}


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _focused(members: list, data: DataFrame, folds: int, seed: int,
             workers: int) -> tuple[DataFrame, FittedEnsemble, DataFrame]:
    oofs, tests, finals = [], [], []
    for spec, _ in members:
        oof, final, test = cross_validate(spec, data, folds, seed, workers)
        oofs.append(oof)
        tests.append(test)
        finals.append(final)
    weights = {spec.name: w for spec, w in members}
    return (cut_lineage(weighted_vote(_union(oofs), weights, FOCUSED_VOTE)),
            FittedEnsemble(FOCUSED_VOTE, finals, list(weights.values())),
            cut_lineage(weighted_vote(_union(tests), weights, FOCUSED_VOTE)))


def explain_model(fitted: FittedModel, train: DataFrame, rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Id, label, probability, ``margin``, ``base`` and ``attributions`` of ``rows``.

    ``attributions`` add up to ``margin - base``: log-odds for linear and boosted
    models, probabilities for forests and all others.
    """

    kind = fitted.spec.kind
    keep = (ID_COLUMN, TARGET_COLUMN, PROB)
    scored = fitted.predict(rows, keep=tuple(rows.columns))
    prepared = fitted.prep.transform(X.top_rows(scored, limit), keep=keep)
    encoded = fitted.mapped(prepared)
    raw = vector_to_array(F.col("rawPrediction"))[1]
    if kind == "logistic":
        mean = X.background_mean(fitted.encode(X.background_rows(train)))
        weights = [float(w) for w in fitted.model.coefficients]
        base = float(fitted.model.intercept) + sum(w * m for w, m in zip(weights, mean))
        with_margin = fitted.model.transform(encoded).select(*keep, "features", raw.alias("margin"))
        out = X.linear_attributions(with_margin, weights, mean)
    elif kind in ("forest", "boosting", "histogram", "grown_forest"):
        own = kind in ("histogram", "grown_forest")
        paths = fitted.model.leaf_paths() if own else leaf_paths(rows.sparkSession, fitted.model, kind)
        base = expectation(paths)
        margin = {"forest": F.col(PROB), "grown_forest": F.col(PROB), "boosting": 2.0 * raw, "histogram": raw}[kind]
        out = tree_attributions(fitted.model.transform(encoded).select(*keep, "features", margin.alias("margin")), paths)
    else:
        background = fitted.prep.transform(X.background_rows(train, BACKGROUND))
        out, base = coalition_attributions(fitted.predict_prepared, prepared, background)
        out = out.withColumn("margin", F.col(PROB))
    return out.select(*keep, "margin", F.lit(base).alias("base"), "attributions")


def _lime(fitted: FittedModel, train: DataFrame, test: DataFrame, rows: int, samples: int) -> DataFrame:
    top = X.top_rows(fitted.predict(test, keep=tuple(test.columns)), rows)
    explained = fitted.prep.transform(top, keep=(ID_COLUMN, TARGET_COLUMN, PROB))
    return X.lime_explanations(fitted.predict_prepared, fitted.prep.transform(train), explained, fitted.prep.feature_names,
                               num_samples=samples)
