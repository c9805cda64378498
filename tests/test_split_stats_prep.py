import random
import statistics

import pytest
from pyspark.sql import functions as F

from attrition.operators.prep import column_modes, fit_prep, target_encoding_long
from attrition.operators.split import assign_split, holdout_sizes
from attrition.operators.stats import exact_medians


def test_holdout_sizes_match_published_split():
    # 7043 customers, 1869 churners: 1409 test rows (ceil(0.2 * 7043))
    sizes = holdout_sizes({0: 5174, 1: 1869}, 0.2)
    assert sum(sizes.values()) == 1409
    assert sizes == {0: 1035, 1: 374}


def test_split_is_stratified_and_folds_balanced(spark):
    df = spark.range(1000).select(F.concat(F.lit("C"), F.col("id").cast("string")).alias("customerID"),
                                  (F.col("id") % 4 == 0).cast("int").alias("Churn"))
    s = assign_split(df, folds=5)
    counts = {(r["Churn"], r["is_test"]): r["count"] for r in s.groupBy("Churn", "is_test").count().collect()}
    assert counts[(1, True)] == 50 and counts[(0, True)] == 150
    per_fold = {r["fold"]: r["count"] for r in s.filter(~F.col("is_test")).groupBy("fold").count().collect()}
    assert set(per_fold.values()) == {160}
    again = assign_split(df, folds=5)
    assert s.exceptAll(again).count() == 0  # keyed and repeatable


@pytest.mark.parametrize("ranges", [1, 2, 7, 128])
def test_exact_medians_of_tied_columns(spark, ranges):
    """Flags about the half, three heavy values, two values with an even count, all different, all null."""

    rng = random.Random(1)
    rows = [(float(i < 5000), float(i < 5001), float(i < 5000) if i < 10000 else None, rng.choice([0.5, 1.5, 7.25]),
             rng.random(), None) for i in range(10001)]
    got = exact_medians(spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double"),
                        list("abcdef"), ranges)
    want = {c: statistics.median([r[i] for r in rows if r[i] is not None]) for i, c in enumerate("abcde")}
    assert got == want | {"f": None}


def test_mode_ties_take_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), ("c",)], "v string")
    assert column_modes(df, ["v"]) == {"v": "a"}


def test_target_encoding_smoothing(spark):
    # category "x": 1 positive of 2; prior 0.75 -> (1 + 20*0.75) / 22
    df = spark.createDataFrame([(f"i{i}", c, y) for i, (c, y) in enumerate(
        [("x", 1), ("x", 0)] + [("z", 1)] * 6 + [("w", 1), ("w", 1), ("w", 0), ("w", 0)])],
        "customerID string, c string, Churn int")
    table = {r["level"]: r["encoding"] for r in target_encoding_long(df, ["c"], "Churn").collect()}
    assert abs(table["x"] - (1 + 20 * 0.75) / 22) < 1e-12
    prep = fit_prep(df, encoder="target")
    new = spark.createDataFrame([("n", "x", 0), ("m", "never", 0)], "customerID string, c string, Churn int")
    got = {r["customerID"]: r["features"][0] for r in prep.transform(new).collect()}
    assert abs(got["n"] - table["x"]) < 1e-12 and abs(got["m"] - 0.75) < 1e-12


def test_out_of_fold_encoding_leaves_the_own_fold_out(spark):
    rows = [(f"i{i}", "ab"[i % 2], int(i % 3 == 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "customerID string, c string, Churn int")
    prep = fit_prep(df, encoder="target")
    number = F.substring("customerID", 2, 9).cast("int")
    got = prep.transform_out_of_fold(df, number % 5, 5).collect()
    assert len(got) == 60
    for r in got:
        i = int(r["customerID"][1:])
        rest = [(c, y) for j, (_, c, y) in enumerate(rows) if j % 5 != i % 5]
        prior = sum(y for _, y in rest) / len(rest)
        own = [y for c, y in rest if c == rows[i][1]]
        assert abs(r["features"][0] - (sum(own) + 20 * prior) / (len(own) + 20)) < 1e-12


def test_many_levels_fit_and_score(spark):
    """60,000 levels in one column: sparse vectors, no largest number of levels."""
    train = spark.range(120_000).select(
        F.concat(F.lit("c"), F.col("id").cast("string")).alias("customerID"),
        F.concat(F.lit("v"), (F.col("id") % 60_000).cast("string")).alias("c"), F.col("id").cast("double").alias("n"),
        (F.col("id") % 7 == 0).cast("int").alias("Churn"))
    for encoder, width in (("onehot", 60_001), ("target", 2)):
        prep = fit_prep(train, encoder=encoder)
        assert len(prep.feature_names) == width
        scored = prep.transform(train.limit(10)).collect()
        assert len(scored) == 10 and all(r["features"].size == width for r in scored)


def test_onehot_unseen_is_all_zero(spark):
    train = spark.createDataFrame([("A", "x", 1.0, 1), ("B", "y", 2.0, 0), ("C", "y", None, 1)],
                                  "customerID string, c string, n double, Churn int")
    prep = fit_prep(train, scale=True)
    assert prep.levels["c"] == ["x", "y"] and prep.medians["n"] == 1.5
    new = spark.createDataFrame([("D", "zzz", 3.0, 0)], "customerID string, c string, n double, Churn int")
    v = prep.transform(new).first()["features"].toArray().tolist()
    assert v[1:] == [0.0, 0.0]
