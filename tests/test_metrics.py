from attrition.operators import metrics as M


def _df(spark, rows):
    return spark.createDataFrame(rows, "y int, p double")


def test_average_precision_step_sum(spark):
    # y = [0, 0, 1, 1], p = [0.1, 0.4, 0.35, 0.8]: AP = 0.8333 (not the trapezoid 0.7917)
    df = _df(spark, [(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)])
    r = M.ranking_metrics(M.score_ranks(df, "y", "p")).first()
    assert abs(r["pr_auc"] - 0.8333333333333333) < 1e-12
    assert abs(r["roc_auc"] - 0.75) < 1e-12


def test_auc_ties_count_half(spark):
    df = _df(spark, [(0, 0.5), (1, 0.5), (1, 0.9), (0, 0.1)])
    r = M.ranking_metrics(M.score_ranks(df, "y", "p", ranges=3)).first()
    # pairs: (0.9 vs 0.5)=1, (0.9 vs 0.1)=1, (0.5 vs 0.5)=0.5, (0.5 vs 0.1)=1 -> 3.5/4
    assert abs(r["roc_auc"] - 0.875) < 1e-12


def test_sweep_uses_exact_thresholds(spark):
    # p = 0.29 must count as predicted positive at t = 0.29 (floor(0.29*100) is 28)
    df = _df(spark, [(1, 0.29), (0, 0.07), (1, 0.951), (0, 0.5)])
    rows = {round(r["threshold"], 2): r for r in M.threshold_sweep(df, "y", "p").collect()}
    assert len(rows) == 91
    assert rows[0.29]["true_positive"] == 2 and rows[0.30]["true_positive"] == 1
    assert rows[0.07]["false_positive"] == 2 and rows[0.08]["false_positive"] == 1
    assert rows[0.95]["true_positive"] == 1
    r = rows[0.29]
    assert r["business_cost"] == r["false_negative"] * 5 + r["false_positive"]


def test_best_thresholds_tie_breaks(spark):
    df = _df(spark, [(1, 0.9), (0, 0.2), (1, 0.6), (0, 0.05)])
    best = M.best_thresholds(M.threshold_sweep(df, "y", "p")).first()
    # every threshold in (0.2, 0.6] separates perfectly; the lowest one wins ties
    assert best["f1_optimal_threshold"] == 0.21
    assert best["accuracy_optimal_threshold"] == 0.21
    assert best["cost_sensitive_threshold"] == 0.21
    assert best["minimum_business_cost"] == 0.0


def test_confusion_and_metrics(spark):
    df = _df(spark, [(1, 0.9), (0, 0.6), (1, 0.4), (0, 0.1)])
    m = M.classification_metrics(df, "y", "p", 0.5).first()
    assert (m["true_positive"], m["false_positive"], m["false_negative"], m["true_negative"]) == (1, 1, 1, 1)
    assert m["precision"] == 0.5 and m["recall"] == 0.5 and m["f1"] == 0.5 and m["cost"] == 6
