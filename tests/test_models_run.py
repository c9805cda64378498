from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from attrition.operators import trees
from attrition.operators.features import add_domain_features
from attrition.operators.split import assign_split
from attrition.plans.fixture import clean_customers
from attrition.plans.models import QUICK_MODELS, ModelSpec, candidate_model_specs, focused_members
from attrition.plans.run import explain_model, run_training
from attrition.plans.training import fit_spec, load_model
from attrition.session import cut_lineage
from attrition.sources.files import artifact_status, require_artifacts

SMALL = "/root/testdata/sf0.001"
TINY = {"logistic": {"maxIter": 5}, "forest": {"numTrees": 3, "maxDepth": 3},
        "boosting": {"maxIter": 2, "maxDepth": 2, "stepSize": 0.1},
        "histogram": {"rounds": 2, "max_leaves": 3, "min_rows": 5},
        "grown_forest": {"trees": 3, "max_depth": 3, "min_rows": 5}, "svm": {"C": 1.0, "maxIter": 5}}


def tiny(spec):
    return ModelSpec(spec.name, spec.kind, TINY[spec.kind], spec.sampler, spec.encoder, spec.scale_numeric,
                     spec.drop_columns, spec.balanced)


@pytest.fixture(scope="module")
def clean(spark):
    return cut_lineage(clean_customers(spark, SMALL))


@pytest.fixture(scope="module")
def data(clean):
    return cut_lineage(assign_split(add_domain_features(clean), folds=2))


def shapley(value, players):
    """By definition, over all coalitions."""

    n, out = len(players), {}
    for j in players:
        rest = [i for i in players if i != j]
        out[j] = sum(factorial(len(s)) * factorial(n - 1 - len(s)) / factorial(n) * (value({*s, j}) - value(set(s)))
                     for k in range(n) for s in combinations(rest, k))
    return out


@pytest.mark.parametrize("kind", ["forest", "boosting"])
def test_tree_attributions_are_shapley_values(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4)).round(2)
    y = ((x[:, 0] > 0) ^ (x[:, 1] * x[:, 2] > 0.2)).astype(int)
    df = spark.createDataFrame([(row.tolist(), int(t)) for row, t in zip(x, y)], "x array<double>, Churn int").select(
        array_to_vector("x").alias("features"), "Churn")
    learner = (RandomForestClassifier(labelCol="Churn", numTrees=4, maxDepth=4, seed=1) if kind == "forest"
               else GBTClassifier(labelCol="Churn", maxIter=4, maxDepth=3, seed=1))
    model = learner.fit(df)
    paths = trees.leaf_paths(spark, model, kind)
    rows = trees.tree_attributions(model.transform(df.limit(12)), paths).select(
        vector_to_array("features").alias("x"), "attributions", vector_to_array("probability")[1].alias("p")).collect()
    for r in rows:
        def value(known, r=r):
            total = 0.0
            for path in paths:
                part = path.value
                for f, low, high, share in zip(path.features, path.low, path.high, path.share):
                    part *= (low < r["x"][f] <= high) if f in known else share
                total += part
            return total

        want = shapley(value, range(4))
        assert np.allclose(r["attributions"], [want[j] for j in range(4)])
        margin = trees.expectation(paths) + sum(r["attributions"])
        assert margin == pytest.approx(r["p"] if kind == "forest" else np.log(r["p"] / (1 - r["p"])), abs=1e-9)


def test_every_candidate_fits_and_scores(data):
    train, test = data.filter(~F.col("is_test")), data.filter(F.col("is_test"))
    n = test.count()
    specs = [*candidate_model_specs(), *(s for s, _ in focused_members())]

    def scored(spec):
        scores = fit_spec(tiny(spec), train).predict(test)
        return scores.agg(F.count(F.lit(1)), F.min("churn_probability"), F.max("churn_probability")).first()

    with ThreadPoolExecutor(max_workers=6) as pool:
        for spec, row in zip(specs, pool.map(scored, specs)):
            assert row[0] == n and 0.0 <= row[1] <= row[2] <= 1.0, spec.name


def test_any_model_has_attributions_that_add_up(data):
    train, test = data.filter(~F.col("is_test")), data.filter(F.col("is_test"))
    drop = tuple(c for c in data.columns if c not in ("tenure", "MonthlyCharges", "Contract", "customerID", "Churn"))
    for kind in ("logistic", "svm", "histogram", "grown_forest"):
        fitted = fit_spec(ModelSpec(kind, kind, TINY[kind], drop_columns=drop), train)
        rows = explain_model(fitted, train, test, limit=8).collect()
        assert len(rows) == 8
        for r in rows:
            assert len(r["attributions"]) == len(fitted.prep.feature_names)
            assert sum(r["attributions"]) == pytest.approx(r["margin"] - r["base"], abs=1e-6)


def test_a_run_writes_all_and_scores_again(spark, clean, tmp_path):
    few = {"tenure", "MonthlyCharges", "Contract", "InternetService", "total_charge_log", "is_month_to_month",
           "customerID", "Churn"}
    drop = tuple(c for c in add_domain_features(clean, 1.0).columns if c not in few)
    specs = [replace(tiny(s), drop_columns=drop) for s in candidate_model_specs() if s.name in QUICK_MODELS]
    focused = [(replace(tiny(s), drop_columns=drop), w) for s, w in focused_members()[:2]]
    out = str(tmp_path / "run")
    run = run_training(spark, clean, out, quick=True, folds=2, specs=specs, focused=focused,
                       lime_samples=200, lime_rows=2)
    require_artifacts(spark, out)
    assert artifact_status(spark, out).filter("present").count() == artifact_status(spark, out).count()
    assert run["explainer_model"] == "Random Forest (No SMOTE Tuned)"
    assert {"Soft Voting Ensemble", "Stacking Ensemble", "Focused Voting Ensemble"} <= set(run["fitted"])
    assert run["record"]["explained_customers"] == run["test"].count() and len(run["record"]["top_features"]) == 10
    assert spark.read.parquet(f"{out}/lime_local_explanations").count() == 2
    from attrition.plans.training import save_model

    for name, fitted in run["fitted"].items():
        save_model(spark, fitted, f"{out}/again/{name}", 0.25)
        loaded, threshold = load_model(spark, f"{out}/again/{name}")
        both = fitted.predict(run["test"]).join(
            loaded.predict(run["test"]).withColumnRenamed("churn_probability", "p"), "customerID")
        assert threshold == 0.25
        assert both.filter(F.abs(F.col("p") - F.col("churn_probability")) > 1e-9).count() == 0, name
    decided = spark.read.parquet(f"{out}/decision_outputs")
    assert decided.count() == run["test"].count()
