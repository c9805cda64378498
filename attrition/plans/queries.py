"""Registered queries: one per operator of the inventory, each (spark, sf_dir) -> DataFrame.

They compose the library operators over the ``telco`` view of the driver's
tables.  Doubles from transcendental functions or multi-row floating sums are
rounded to 9 decimals in the final projection (see ``oracles.py``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import REQUIRED_COLUMNS, TARGET_COLUMN
from ..operators import decisions as D
from ..operators import metrics as M
from ..operators import reports as R
from ..operators.features import tenure_summary
from ..operators.summary import dataset_summary as _dataset_summary
from . import fixture as X

REGISTRY: dict = {}


def register(fn):
    REGISTRY[fn.__name__] = fn
    return fn


def _r9(c: str):
    return F.round(F.col(c), 9).alias(c)


# --- sources / cleaning / features ------------------------------------------------

@register
def telco_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.telco import telco_raw
    return telco_raw(spark, sf_dir)


@register
def clean_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.clean_customers(spark, sf_dir)


@register
def clean_dirty_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaning over the customers and rows spoilt in every way: repeated ids, missing labels, tokens, bad numbers."""
    return X.dirty_customers(spark, sf_dir)


@register
def dirty_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.features import add_domain_features
    f = add_domain_features(X.dirty_customers(spark, sf_dir))
    return f.select(*[_r9(c) if c in ("monthly_charge_log", "total_charge_log") else F.col(c) for c in f.columns])


@register
def domain_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = X.featured_customers(spark, sf_dir)
    return f.select(*[_r9(c) if c in ("monthly_charge_log", "total_charge_log") else F.col(c) for c in f.columns])


@register
def lifecycle_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tenure_summary(X.featured_customers(spark, sf_dir, only=("tenure_band",), columns=("tenure",)))


@register
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dataset_summary(X.clean_customers(spark, sf_dir), raw_columns=len(REQUIRED_COLUMNS), source="telco").drop("source")


# --- scores, thresholds, decisions -------------------------------------------------

def _scores(spark, sf_dir):
    return X.labelled_scores(spark, sf_dir)


def _operational_threshold(scores: DataFrame) -> float:
    """Cost-sensitive threshold of the sweep (one small job; a scalar reaches the driver)."""

    best = M.best_thresholds(M.threshold_sweep(scores, TARGET_COLUMN, "churn_probability"))
    return float(best.first()["cost_sensitive_threshold"])


@register
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.threshold_sweep(_scores(spark, sf_dir), TARGET_COLUMN, "churn_probability")


@register
def best_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.best_thresholds(threshold_sweep(spark, sf_dir))


@register
def metrics_at_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.classification_metrics(_scores(spark, sf_dir), TARGET_COLUMN, "churn_probability", 0.50)
    return m.select(*[_r9(c) if c in ("roc_auc", "pr_auc") else F.col(c) for c in m.columns])


@register
def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.roc_points(M.score_ranks(_scores(spark, sf_dir), TARGET_COLUMN, "churn_probability"))


@register
def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.pr_points(M.score_ranks(_scores(spark, sf_dir), TARGET_COLUMN, "churn_probability"))


@register
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scores(spark, sf_dir)
    return M.confusion_cells(s, TARGET_COLUMN, "churn_probability", _operational_threshold(s))


def _decisions(spark, sf_dir, features: tuple[str, ...] = ()) -> DataFrame:
    t = _operational_threshold(_scores(spark, sf_dir))
    return D.add_decision_outputs(X.scored_customers(spark, sf_dir, only=features), t)


DECISION_COLUMNS = (
    "customerID", "Contract", "tenure", "MonthlyCharges", "PaymentMethod", "OnlineSecurity", "TechSupport",
    "churn_probability", "risk_tier", "intervention_candidate", "recommended_action",
    "recommendation_rationale", "Churn",
)


@register
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir).select(*DECISION_COLUMNS)


@register
def risk_tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.risk_tier_counts(_decisions(spark, sf_dir))


@register
def action_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.action_counts(_decisions(spark, sf_dir))


@register
def tier_action_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.tier_action_counts(_decisions(spark, sf_dir))


@register
def headline_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.headline_counts(_decisions(spark, sf_dir))


@register
def work_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.work_queue(_decisions(spark, sf_dir), tier="high", candidates_only=True)


@register
def work_queue_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.work_queue(_decisions(spark, sf_dir), tier="all", candidates_only=False)


@register
def work_queue_medium(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.work_queue(_decisions(spark, sf_dir), tier="medium", candidates_only=False)


@register
def customer_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of the one customer who sorts first."""
    decided = _decisions(spark, sf_dir, R.PROFILE_FEATURES)
    return R.customer_profiles(decided, decided.agg(F.min("customerID")).first()[0])


@register
def customer_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.customer_profiles(_decisions(spark, sf_dir, R.PROFILE_FEATURES))


@register
def threshold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    sweep = threshold_sweep(spark, sf_dir)
    return R.threshold_table(sweep, M.best_thresholds(sweep))


@register
def threshold_table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.markdown_rows(threshold_table(spark, sf_dir))


@register
def threshold_markdown_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.markdown_table(threshold_table(spark, sf_dir), F.col("threshold"))


@register
def lifecycle_markdown_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.markdown_table(lifecycle_table(spark, sf_dir), F.col("tenure_band"))


@register
def metric_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.metric_lines(threshold_sweep(spark, sf_dir))


@register
def lifecycle_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.lifecycle_labels(lifecycle_churn(spark, sf_dir))


@register
def lifecycle_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.lifecycle_table(lifecycle_churn(spark, sf_dir))


# --- split, folds and model-input preparation --------------------------------------

def _split(spark, sf_dir, columns: tuple[str, ...] | None = None, only: tuple[str, ...] | None = None) -> DataFrame:
    """Featured customers with hold-out flag and fold, written once to the checkpoint folder:
    every later job (fits, metrics, encodings) reads it instead of re-running the lineage.

    ``columns``: just these customer columns beside id and label; ``only``: just these features."""
    from ..operators.split import assign_split
    from ..session import cut_lineage
    rows = X.clean_customers(spark, sf_dir, columns) if columns is not None else X.featured_customers(spark, sf_dir, only)
    return cut_lineage(assign_split(rows))


@register
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir, columns=()).select("customerID", "Churn", "is_test", "fold")


def _train(spark, sf_dir, columns: tuple[str, ...] | None = None, only: tuple[str, ...] | None = None) -> DataFrame:
    return _split(spark, sf_dir, columns, only).filter(~F.col("is_test"))


#: The features that are text; none needs the table's median.
TEXT_FEATURES = ("internet_service_group", "payment_contract_group", "tenure_band", "tenure_bucket",
                 "monthly_charge_band", "tenure_charge_band")


@register
def numeric_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.prep import median_table, split_feature_types
    train = _train(spark, sf_dir)
    numeric, _ = split_feature_types(train)
    return median_table(train, numeric)


@register
def scaling_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.prep import scaling_table, split_feature_types
    train = _train(spark, sf_dir)
    numeric, _ = split_feature_types(train)
    return scaling_table(train, numeric).select("feature", _r9("mean"), _r9("std"))


@register
def categorical_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.prep import mode_table, split_feature_types
    train = _train(spark, sf_dir, only=TEXT_FEATURES)
    _, categorical = split_feature_types(train)
    return mode_table(train, categorical)


@register
def onehot_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``feature, level, slot``: the one-hot layout fitted on the training rows."""
    from ..operators.prep import level_table, split_feature_types
    train = _train(spark, sf_dir, only=TEXT_FEATURES)
    return level_table(train, split_feature_types(train)[1])


@register
def target_encoded_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted target encoder's values on the hold-out rows, one row per customer and column."""
    from pyspark.ml.functions import vector_to_array

    from ..operators.prep import fit_prep
    data = _split(spark, sf_dir)
    prep = fit_prep(data.filter(~F.col("is_test")), encoder="target", scale=False)
    names = F.array(*[F.lit(n) for n in prep.feature_names])
    values = prep.transform(data.filter(F.col("is_test")), keep=("customerID",)).select(
        "customerID", F.posexplode(vector_to_array("features")).alias("j", "v"))
    encoded = values.filter(F.col("j") >= len(prep.numeric))
    return encoded.select("customerID", names[F.col("j")].alias("feature"), F.round("v", 9).alias("encoding"))


@register
def target_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.prep import split_feature_types, target_encoding_long
    train = _train(spark, sf_dir, only=TEXT_FEATURES)
    _, categorical = split_feature_types(train)
    return target_encoding_long(train, categorical).select("feature", "level", _r9("encoding"))


@register
def target_encoding_out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.prep import cross_fitted_target_encoding, split_feature_types
    train = _train(spark, sf_dir, only=TEXT_FEATURES)
    _, categorical = split_feature_types(train)
    return cross_fitted_target_encoding(train, categorical).select("feature", "level", "fold", _r9("encoding"))


@register
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = _train(spark, sf_dir, columns=())
    n = F.sum("n").over(Window.partitionBy())  # two rows
    counts = train.groupBy(TARGET_COLUMN).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(TARGET_COLUMN, "n", (n / (F.lit(2.0) * F.col("n"))).alias("weight"))


# --- comparison and selection over the fixture scorers -------------------------------

def _scorer_long(spark, sf_dir) -> DataFrame:
    """(model, customerID, Churn, churn_probability, is_test, fold) for every fixture scorer."""
    from ..sources.telco import FIXTURE_SCORERS
    split = _split(spark, sf_dir, columns=("Contract", "tenure", "InternetService", "MonthlyCharges"))
    pairs = ", ".join(f"'{name}', {expr}" for name, expr in FIXTURE_SCORERS.items())
    return split.selectExpr("customerID", "Churn", "is_test", "fold",
                            f"stack({len(FIXTURE_SCORERS)}, {pairs}) AS (model, churn_probability)")


def _comparison(spark, sf_dir) -> DataFrame:
    from ..operators.selection import comparison_table
    long = _scorer_long(spark, sf_dir)
    folds = M.grouped_metrics(long.filter(~F.col("is_test")), TARGET_COLUMN, "churn_probability", ["model", "fold"])
    test = M.grouped_metrics(long.filter(F.col("is_test")), TARGET_COLUMN, "churn_probability", ["model"])
    return comparison_table(folds, test)


def _round_doubles(df: DataFrame) -> DataFrame:
    return df.select(*[_r9(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields])


@register
def fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _scorer_long(spark, sf_dir)
    m = M.grouped_metrics(long.filter(~F.col("is_test")), TARGET_COLUMN, "churn_probability", ["model", "fold"])
    return _round_doubles(m)


@register
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_doubles(_comparison(spark, sf_dir))


@register
def top_three_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.selection import top_by_cv
    return top_by_cv(_comparison(spark, sf_dir), 3).select("model")


@register
def top_models_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_models(_comparison(spark, sf_dir), 7).select("model", _r9("cv_pr_auc_mean"))


@register
def selected_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.selection import select_model
    return select_model(_comparison(spark, sf_dir))


@register
def explainer_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.selection import explainer_choice
    return explainer_choice(_comparison(spark, sf_dir))


@register
def comparison_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.comparison_table(_comparison(spark, sf_dir))


@register
def comparison_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.markdown_rows(R.comparison_table(_comparison(spark, sf_dir)))


# --- fitted models (rows-only checks: Spark ML fits have no SQL equivalent) -----------

def _cv_row(spark, sf_dir, name: str) -> DataFrame:
    from .models import candidate_model_specs
    from .training import cross_validate, evaluate
    spec = {s.name: s for s in candidate_model_specs()}[name]
    oof, _, test = cross_validate(spec, _split(spark, sf_dir))
    return evaluate(oof, test)


@register
def cv_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cv_row(spark, sf_dir, "Logistic Regression (No SMOTE)")


@register
def cv_logistic_smote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cv_row(spark, sf_dir, "Logistic Regression (SMOTE)")


@register
def cv_target_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cv_row(spark, sf_dir, "Logistic Regression (Target Encoded)")


@register
def soft_vote_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft vote of the three logistic variants, scored out-of-fold and on the hold-out."""
    from .training import evaluate
    oofs, tests, _ = _linear_vote(spark, sf_dir)
    name = F.col("model") == "Soft Voting Ensemble"
    return evaluate(oofs.filter(name), tests.filter(name))


def _linear_vote(spark, sf_dir):
    """Scores of three logistic variants and their vote: (out of fold, hold-out, members)."""
    from .models import candidate_model_specs
    from .training import cross_validate, weighted_vote
    names = ("Logistic Regression (No SMOTE)", "Logistic Regression (Target Encoded)",
             "Logistic Regression (Focused Accuracy)")
    specs = {s.name: s for s in candidate_model_specs()}
    data = _split(spark, sf_dir)
    oofs, tests = None, None
    for n in names:
        oof, _, test = cross_validate(specs[n], data)
        oofs = oof if oofs is None else oofs.unionByName(oof)
        tests = test if tests is None else tests.unionByName(test)
    members = {n: 1.0 for n in names}
    return (oofs.unionByName(weighted_vote(oofs, members, "Soft Voting Ensemble").select(oofs.columns)),
            tests.unionByName(weighted_vote(tests, members, "Soft Voting Ensemble").select(tests.columns)), names)


@register
def vote_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per scored model: rows out of fold and held out, customers scored once, probabilities in range,
    and votes that are the mean of their members."""
    oofs, tests, names = _linear_vote(spark, sf_dir)
    scores = oofs.select("model", "customerID", "churn_probability", F.lit(1).alias("oof")).unionByName(
        tests.select("model", "customerID", "churn_probability", F.lit(0).alias("oof")))
    p = F.col("churn_probability")
    mean = scores.groupBy("customerID").agg(
        (F.sum(F.when(F.col("model").isin(list(names)), p)) / len(names)).alias("mean"))
    joined = scores.join(mean, "customerID")
    vote = F.col("model") == "Soft Voting Ensemble"
    return joined.groupBy("model").agg(
        F.count_if(F.col("oof") == 1).alias("oof_rows"), F.count_if(F.col("oof") == 0).alias("test_rows"),
        F.count_distinct("customerID").alias("customers"), F.count_if((p >= 0) & (p <= 1)).alias("in_range"),
        F.count_if(vote & (F.abs(p - F.col("mean")) < 1e-9)).alias("votes_that_are_means"))


@register
def smote_class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows per class after SMOTE (parity) and how many are synthetic."""
    from ..operators.prep import fit_prep
    from ..operators.sampling import smote
    train = _train(spark, sf_dir)
    encoded = fit_prep(train).transform(train)
    out = smote(encoded, TARGET_COLUMN)
    return out.groupBy(TARGET_COLUMN).agg(F.count(F.lit(1)).alias("rows"),
                                          F.count_if(F.col("customerID").isNull()).alias("synthetic_rows"))


@register
def smote_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours that SMOTE finds at its defaults, against all minority rows, for every 20th of them.

    Of a query's neighbours found, those count that are no farther than its true k-th."""
    from pyspark.ml.functions import vector_to_array

    from ..operators.neighbours import nearest_rows, nearest_to
    from ..operators.prep import fit_prep
    from ..operators.sampling import minority_rows
    from ..session import cut_lineage
    train = _train(spark, sf_dir)
    encoded = fit_prep(train).transform(train).select("customerID", TARGET_COLUMN, "features")
    minority = encoded.groupBy(TARGET_COLUMN).count().orderBy("count", TARGET_COLUMN).first()[0]
    rows = cut_lineage(minority_rows(encoded, TARGET_COLUMN, minority, vector_to_array("features")).select(
        F.col("_sid").alias("id"), F.col("_x").alias("x")))
    asked = F.col("id") % 20 == 0
    found = nearest_rows(rows, 5).filter(F.col("a") % 20 == 0).select("a", "d")
    true = nearest_to(rows.filter(asked), rows, 5).groupBy("a").agg(F.max("d").alias("kth"))
    hits = found.join(true, "a").agg(F.count_if(F.col("d") <= F.col("kth")).alias("hits"), F.count(F.lit(1)).alias("neighbours"))
    return hits.select("neighbours", (F.col("hits") >= 0.9 * F.col("neighbours")).alias("recall_reached"))


@register
def kernel_map_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landmark map of all training rows: rows whose residual is a share, and rows whose errors towards 50
    drawn rows keep the bound of the residuals; landmarks are met exactly."""
    from ..operators.kernel import drawn_rows, fit_kernel_map, kernel_errors
    from ..operators.prep import fit_prep
    from ..session import cut_lineage
    train = _train(spark, sf_dir)
    encoded = cut_lineage(fit_prep(train).transform(train).select("customerID", "features"))
    kernel = fit_kernel_map(encoded)
    drawn = kernel_errors(encoded, kernel, drawn_rows(encoded, 50, seed=1))
    landmark = kernel_errors(encoded, kernel, kernel.landmarks)
    errors = drawn.join(landmark.select("customerID", F.col("error").alias("to_landmarks")), "customerID")
    return errors.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("residual").between(-1e-6, 1.0)).alias("residuals_are_shares"),
        F.count_if(F.col("excess") <= 1e-6).alias("errors_in_bound"),
        F.count_if(F.col("to_landmarks") <= 1e-4).alias("exact_on_landmarks"))


#: Each way of growing, few rounds, all rows in every tree.
GROWTHS = {
    "leaf": {"rounds": 5, "rate": 0.2, "max_leaves": 7, "min_rows": 20, "l2": 12.0, "alpha": 0.2, "feature_share": 0.7},
    "depth": {"rounds": 5, "rate": 0.2, "order": "depth", "max_depth": 2, "min_rows": 1, "min_hessian": 1.0, "l2": 10.0, "alpha": 0.3},
    "oblivious": {"rounds": 5, "rate": 0.2, "order": "oblivious", "max_depth": 3, "l2": 8.0, "prefixes": 6},
}


@register
def boosting_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per way of growing and round: training rows in the leaves, leaves within the bound, leaf values that
    are the regularised closed form of the rows assigned to them, and a loss that the round lowers."""
    from ..operators.boosting import Growth, fit_boosting
    from ..operators.prep import fit_prep
    from ..session import cut_lineage
    train = _train(spark, sf_dir)
    encoded = cut_lineage(fit_prep(train, scale=False).transform(train).select("customerID", TARGET_COLUMN, "features"))
    out = None
    for name, settings in GROWTHS.items():
        growth = Growth(**settings)
        model = fit_boosting(encoded, TARGET_COLUMN, growth, "customerID")
        most = growth.max_leaves if growth.order == "leaf" else 2 ** growth.max_depth
        steps = model.steps(encoded, [TARGET_COLUMN])
        p, y = 1 / (1 + F.exp(-F.col("margin"))), F.col(TARGET_COLUMN)
        leaves = steps.groupBy("round", "leaf").agg(
            F.count(F.lit(1)).alias("n"), F.sum(p - y).alias("g"), F.sum(p * (1 - p)).alias("h"),
            F.sum(F.log1p(F.exp(F.col("margin"))) - y * F.col("margin")).alias("loss"))
        soft = F.signum("g") * F.greatest(F.abs("g") - growth.alpha, F.lit(0.0))
        right = F.abs(-soft / (F.col("h") + growth.l2) - F.col("value")) < 1e-5
        rounds = leaves.join(model.leaf_table(spark), ["round", "leaf"]).groupBy("round").agg(
            F.sum("n").alias("rows"), (F.count(F.lit(1)) <= most).alias("leaves_in_bounds"),
            F.every(right).alias("values_are_closed_form"), F.sum("loss").alias("loss"))
        before = F.lag("loss").over(Window.orderBy("round"))  # a row for each round
        rounds = rounds.withColumn("loss_falls", F.coalesce(F.col("loss") < before, F.lit(True)))
        part = rounds.select(F.lit(name).alias("growth"), "round", "rows", "leaves_in_bounds", "values_are_closed_form", "loss_falls")
        out = part if out is None else out.unionByName(part)
    return out


FOREST_TREES = 8


@register
def bootstrap_class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per tree and class: training rows drawn and the class weight of the tree's own draws."""
    from ..operators.forest import ForestGrowth, tree_class_weights
    weights = tree_class_weights(_train(spark, sf_dir, columns=()), TARGET_COLUMN, F.col("customerID"), ForestGrowth(trees=FOREST_TREES))
    return weights.select("tree", TARGET_COLUMN, "drawn", _r9("weight"))


@register
def forest_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per forest and tree: rows drawn into its leaves, and whether each leaf's rows and value are those of the rows
    assigned to it."""
    from ..operators.forest import ForestGrowth, HistogramForest, draws, tree_class_weights
    from ..operators.prep import fit_prep
    from ..session import cut_lineage
    train = _train(spark, sf_dir)
    encoded = cut_lineage(fit_prep(train, scale=False).transform(train).select("customerID", TARGET_COLUMN, "features"))
    out = None
    for name, settings in (("bootstrap", {"max_depth": 6, "min_rows": 5, "balanced": True}),
                           ("random cuts", {"max_depth": 6, "min_rows": 8, "cuts": "random", "bootstrap": False})):
        growth = ForestGrowth(trees=FOREST_TREES, **settings)
        model = HistogramForest(growth, TARGET_COLUMN, "customerID").fit(encoded)
        rows = model.assigned(encoded, ["customerID", TARGET_COLUMN])
        n = draws(F.col("customerID"), growth.seed, F.col("tree")) if growth.bootstrap else F.lit(1)
        weights = tree_class_weights(encoded, TARGET_COLUMN, F.col("customerID"), growth).select("tree", TARGET_COLUMN, "weight")
        weight = F.col("weight") if growth.balanced else F.lit(1.0)
        drawn = rows.join(weights, ["tree", TARGET_COLUMN]).select("tree", "leaf", n.alias("n"), (n * weight).alias("w"), TARGET_COLUMN)
        leaves = drawn.groupBy("tree", "leaf").agg(
            F.sum("n").alias("n"), (F.sum(F.col("w") * F.col(TARGET_COLUMN)) / F.sum("w")).alias("share"))
        right = (F.col("n") == F.col("rows")) & (F.abs(F.col("share") - F.col("value")) < 1e-9) & (F.col("n") >= growth.min_rows)
        # a leaf whose assigned rows were never drawn has none
        met = leaves.filter("n > 0").join(model.leaf_table(spark), ["tree", "leaf"])
        part = met.groupBy("tree").agg(F.sum("n").alias("rows"), F.every(right).alias("leaves_are_right")).select(
            F.lit(name).alias("forest"), "tree", "rows", "leaves_are_right")
        out = part if out is None else out.unionByName(part)
    return out


@register
def ordered_target_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every training customer's category statistics from the customers before them in a fixed order."""
    from ..operators.ordered import ordered_statistics
    from ..operators.prep import split_feature_types
    train = _train(spark, sf_dir, only=TEXT_FEATURES)
    return ordered_statistics(train, split_feature_types(train)[1]).select(
        "customerID", "feature", "earlier", _r9("statistic"))


def _explained(data: DataFrame, spec) -> tuple[DataFrame, list[str]]:
    """All hold-out customers of a split table, explained by one fitted spec; and the feature names."""
    from ..session import cut_lineage
    from .run import explain_model
    from .training import fit_spec
    train = data.filter(~F.col("is_test"))
    fitted = fit_spec(spec, train)
    return cut_lineage(explain_model(fitted, train, data.filter(F.col("is_test")))), fitted.prep.feature_names


def _linear_explanations(data: DataFrame) -> tuple[DataFrame, DataFrame]:
    from ..operators.explain import global_importance, local_drivers
    from .models import candidate_model_specs
    spec = {s.name: s for s in candidate_model_specs()}["Logistic Regression (No SMOTE)"]
    explained, names = _explained(data, spec)
    return global_importance(explained, names), local_drivers(explained, names)


#: A fixed score with interactions, for explanations that plain SQL can follow.
RULE_FEATURES = ("tenure", "MonthlyCharges", "SeniorCitizen", "total_active_services", "is_month_to_month", "has_fiber")
RULE_SCORE = ("0.25 + 0.3 * x4 + 0.2 * x5 * (1.0 - least(x0, 29.0) / 29.0) + x1 * x4 / 403.0 + 0.05 * x2 * x5"
              " - 0.02 * x3 * x5 - 0.013 * x3")
RULE_BACKGROUND = 12


def _rule_predict(df: DataFrame, keep: list[str]) -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    x = df.select(*keep, vector_to_array("features").alias("_v"))
    named = x.select(*keep, *[F.col("_v")[j].alias(f"x{j}") for j in range(len(RULE_FEATURES))])
    return named.select(*keep, F.expr(f"CAST({RULE_SCORE} AS DOUBLE)").alias("churn_probability"))


def _rule_attributions(spark, sf_dir) -> tuple[DataFrame, tuple[str, ...]]:
    """All hold-out customers explained under ``RULE_SCORE`` over a keyed sample of training rows: every coalition."""
    from pyspark.ml.functions import array_to_vector

    from ..operators.coalitions import coalition_attributions as attribute
    from ..operators.explain import background_rows
    data = _split(spark, sf_dir, only=tuple(f for f in RULE_FEATURES if f not in REQUIRED_COLUMNS))
    data = data.withColumn("features", array_to_vector(F.array(*[F.col(c).cast("double") for c in RULE_FEATURES])))
    hold = data.filter(F.col("is_test")).select("customerID", "features")
    hold = hold.join(_rule_predict(hold, ["customerID"]), "customerID")
    background = background_rows(data.filter(~F.col("is_test")), RULE_BACKGROUND).select("features")
    explained, base = attribute(_rule_predict, hold, background, coalitions=2 ** len(RULE_FEATURES))
    return explained.withColumn("base", F.lit(base)).withColumn(
        "attributions", F.transform("attributions", lambda v: F.round(v, 9))), RULE_FEATURES


def _rule_explanations(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(global importance, local drivers) under the rule score."""
    from ..operators.explain import global_importance, local_drivers
    explained, names = _rule_attributions(spark, sf_dir)
    importance = global_importance(explained, list(names))
    local = local_drivers(explained.withColumn("churn_probability", F.round("churn_probability", 9)), list(names))
    return importance.select("feature", _r9("mean_abs_shap")), local


@register
def attribution_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind of model: hold-out customers, and those whose attributions add up to margin less base."""
    from .models import ModelSpec
    total = F.aggregate("attributions", F.lit(0.0), lambda s, v: s + v)
    data, out = _split(spark, sf_dir), None
    for kind, params in (("logistic", {"maxIter": 50}), ("forest", {"numTrees": 8, "maxDepth": 5}),
                         ("boosting", {"maxIter": 8, "maxDepth": 3, "stepSize": 0.1})):
        explained, _ = _explained(data, ModelSpec(kind, kind, params))
        row = explained.agg(F.lit(kind).alias("model"), F.count(F.lit(1)).alias("customers"), F.count_if(
            F.abs(total - (F.col("margin") - F.col("base"))) < 1e-6).alias("additive_customers"))
        out = row if out is None else out.unionByName(row)
    return out


@register
def shap_global_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linear_explanations(_split(spark, sf_dir))[0]


@register
def shap_local_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linear_explanations(_split(spark, sf_dir))[1]


@register
def coalition_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every held-out customer's attribution of each feature under the rule score, and what they add up from and to."""
    explained, names = _rule_attributions(spark, sf_dir)
    named = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("j") + 1)
    return explained.select("customerID", "churn_probability", "base", F.posexplode("attributions").alias("j", "attribution")).select(
        "customerID", named.alias("feature"), _r9("churn_probability"), _r9("base"), "attribution")


@register
def coalition_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule_explanations(spark, sf_dir)[0]


@register
def coalition_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule_explanations(spark, sf_dir)[1]


# --- experiment sweeps --------------------------------------------------------------------

@register
def estimator_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sweeps
    from .models import ModelSpec
    return sweeps.spec_grid(_split(spark, sf_dir), [
        ModelSpec(f"forest depth {depth}", "forest", {"numTrees": 20, "maxDepth": depth}, scale_numeric=False)
        for depth in (3, 5)])


@register
def feature_subset_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sweeps
    return sweeps.feature_subset_grid(_split(spark, sf_dir))


@register
def smoothing_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sweeps
    return sweeps.smoothing_grid(_split(spark, sf_dir))


@register
def ensemble_weight_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sweeps
    oofs, tests, names = _linear_vote(spark, sf_dir)
    return sweeps.weight_grid(oofs, tests, names, ((1, 1, 1), (2, 1, 1), (4, 1, 1)))


# --- streaming --------------------------------------------------------------------------

@register
def streaming_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision table produced by the streaming scorer over the customer records.

    The raw view is written as files into the shared checkpoint folder, read back as a
    stream, cleaned, featured, scored and decided micro-batch by micro-batch, and the
    sink's files are returned.  Same rows and values as ``decisions``.
    """
    from ..streaming.scoring import start_parquet_sink
    base, decided = _decided_stream(spark, sf_dir)
    decided = decided.select(*DECISION_COLUMNS)
    start_parquet_sink(decided, f"{base}/decisions", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(decided.schema).parquet(f"{base}/decisions").drop("batch_id")


def _decided_stream(spark, sf_dir) -> tuple[str, DataFrame]:
    """(folder of its own, stream of decided customers read from files in it)."""
    import uuid

    from ..operators.stats import exact_median
    from ..session import ensure_checkpoint_dir
    from ..sources.telco import SCORE_SQL_EXPR, telco_raw
    from ..streaming.scoring import clean_stream, decide_stream, read_customer_stream

    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/stream-{uuid.uuid4().hex}"
    raw = telco_raw(spark, sf_dir)
    raw.write.parquet(f"{base}/incoming")
    median = exact_median(X.clean_customers(spark, sf_dir, ("TotalCharges",)), "TotalCharges")
    threshold = _operational_threshold(_scores(spark, sf_dir))
    stream = read_customer_stream(spark, f"{base}/incoming", raw.schema)
    return base, decide_stream(clean_stream(stream), median, SCORE_SQL_EXPR, threshold)


@register
def streaming_tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers per tier, counted by the stream and replaced with each micro-batch."""
    from ..streaming.scoring import start_complete_sink, tier_counts_stream
    base, decided = _decided_stream(spark, sf_dir)
    start_complete_sink(tier_counts_stream(decided), f"{base}/tiers", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema("risk_tier string, customers long").parquet(f"{base}/tiers")


@register
def streaming_dirty_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaning of the spoilt customers as a stream: copies arrive last first, the first one by order is kept.

    A last record, a day later, moves the watermark past all others; it is never emitted itself.
    """
    import uuid

    from ..session import cut_lineage, ensure_checkpoint_dir
    from ..sources.telco import DIRTY_SQL, telco_raw
    from ..streaming.first_copy import rocksdb_state
    from ..streaming.scoring import clean_stream, start_parquet_sink

    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/stream-{uuid.uuid4().hex}"
    telco_raw(spark, sf_dir)
    rows = spark.sql(DIRTY_SQL)
    at = F.timestamp_seconds(F.lit(1_704_067_200) - 60 * F.col("copy_number"))
    rows = cut_lineage(rows.withColumn("arrived", at).withColumn("part", F.greatest(F.lit(0), 9 - F.col("copy_number"))))
    last = rows.limit(1).withColumns({"customerID": F.lit("last"), "copy_number": F.lit(0).cast(rows.schema["copy_number"].dataType),
                                      "arrived": F.timestamp_seconds(F.lit(1_704_153_600))})
    # later copies come first: the stream takes what a part has written, in one micro-batch, before the next part is there
    schema = rows.drop("part").schema
    parts = sorted(r[0] for r in rows.select("part").distinct().collect())
    with rocksdb_state(spark):
        for arriving in [*(rows.filter(F.col("part") == part) for part in parts), last]:
            arriving.drop("part").write.mode("append").parquet(f"{base}/incoming")
            stream = spark.readStream.schema(schema).parquet(f"{base}/incoming")
            clean = clean_stream(stream, "arrived", "1 hour", "copy_number").drop("arrived")
            start_parquet_sink(clean, f"{base}/clean", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(clean.schema).parquet(f"{base}/clean").drop("batch_id")


# --- file sources: CSV discovery, validation, all-text read ------------------------------

@register
def csv_source_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer view written as CSV, found by header, read as text, cleaned, featured, summarised."""
    import uuid

    from ..operators.clean import clean_dataset
    from ..operators.features import add_domain_features
    from ..session import ensure_checkpoint_dir
    from ..sources.files import FILE_ORDER, find_local_dataset, read_customers_csv
    from ..sources.telco import telco_raw

    folder = ensure_checkpoint_dir(spark).rstrip("/") + f"/csv-{uuid.uuid4().hex}"
    telco_raw(spark, sf_dir).write.option("header", True).csv(f"{folder}/customers.csv")
    found = find_local_dataset(spark, folder)
    clean = clean_dataset(read_customers_csv(spark, found), order_col=FILE_ORDER, columns=("tenure",))
    return tenure_summary(add_domain_features(clean, only=("tenure_band",)))


# --- explanation tables and their report/dashboard views ----------------------------------

@register
def customer_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of the explained customers with their local drivers (explanations may be missing)."""
    data = _split(spark, sf_dir)  # both explanations fit on it
    _, local = _linear_explanations(data)
    profiles = R.customer_profiles(_decisions(spark, sf_dir, R.PROFILE_FEATURES))
    return R.customer_detail(profiles, local, _surrogates(data))


@register
def sample_local_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sample_explanations(_rule_explanations(spark, sf_dir)[1], 5)


@register
def driver_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.driver_items(_rule_explanations(spark, sf_dir)[1])


@register
def top_drivers_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_drivers(_rule_explanations(spark, sf_dir)[0], 15)


@register
def drivers_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.drivers_table(_rule_explanations(spark, sf_dir)[0], 10)


@register
def rule_customer_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of all customers; those held out have their drivers under the rule score, none a surrogate."""
    local = _rule_explanations(spark, sf_dir)[1]
    profiles = R.customer_profiles(_decisions(spark, sf_dir, R.PROFILE_FEATURES))
    return R.customer_detail(profiles, local, local.limit(0).withColumnRenamed("top_shap_drivers", "lime_explanation"))


@register
def lime_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIME surrogate weights for the five highest-probability hold-out customers."""
    return _surrogates(_split(spark, sf_dir))


def _surrogates(data: DataFrame) -> DataFrame:
    from ..operators.explain import lime_explanations, top_rows
    from ..session import cut_lineage
    from .models import candidate_model_specs
    from .training import fit_spec
    spec = {s.name: s for s in candidate_model_specs()}["Random Forest (No SMOTE Tuned)"]
    train = data.filter(~F.col("is_test"))
    fm = fit_spec(spec, train)
    test = data.filter(F.col("is_test"))
    # written: the samples and the result both read these few rows, not the scores of all hold-out rows again
    top = cut_lineage(top_rows(fm.predict(test, keep=tuple(test.columns)), 5))
    explained = fm.prep.transform(top, keep=("customerID", "Churn", "churn_probability"))
    return lime_explanations(fm.predict_prepared, fm.prep.transform(train), explained, fm.prep.feature_names)
