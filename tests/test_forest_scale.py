from dataclasses import replace

from pyspark.sql import functions as F

from attrition.plans import training
from attrition.plans.models import CACHED_FROM_ROWS, CACHED_MB, TASK_ROWS, ModelSpec, dealt
from attrition.session import cut_lineage


def test_rows_of_one_file_are_dealt_over_tasks(spark):
    few, many = spark.range(TASK_ROWS).coalesce(1), spark.range(3 * TASK_ROWS).coalesce(1)
    assert dealt(few, TASK_ROWS).rdd.getNumPartitions() == 1
    sizes = dealt(many, 3 * TASK_ROWS).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 3 * TASK_ROWS and len(sizes) > 1 and max(sizes) < 1.1 * 3 * TASK_ROWS / len(sizes)
    assert dealt(many, 3 * TASK_ROWS).distinct().count() == 3 * TASK_ROWS


def test_a_forest_is_grown_in_several_tasks_from_one_file(spark, monkeypatch):
    n = 2 * TASK_ROWS
    rows = cut_lineage(spark.range(n).coalesce(1).select(
        F.concat(F.lit("K"), F.col("id")).alias("customerID"), (F.col("id") % 2).cast("int").alias("Churn"),
        (F.col("id") % 7).alias("x")))
    seen = []
    plain = ModelSpec.estimator

    class Watched:
        def __init__(self, inner):
            self.inner = inner

        def fit(self, df):
            seen.append((df.rdd.getNumPartitions(), df.count()))
            return self.inner.fit(df)

    monkeypatch.setattr(ModelSpec, "estimator", lambda self, *a: Watched(plain(self, *a)))
    for kind, params in (("forest", {"numTrees": 2, "maxDepth": 2}), ("boosting", {"maxIter": 1, "maxDepth": 1})):
        fitted = training.fit_spec(ModelSpec(kind, kind, params), rows)
        assert fitted.predict(rows).count() == n
    assert [count for _, count in seen] == [n, n] and min(tasks for tasks, _ in seen) > 1


def test_passes_of_a_large_forest_add_up_few_nodes():
    forest = ModelSpec("forest", "forest", {"numTrees": 2})
    assert forest.estimator(CACHED_FROM_ROWS).getMaxMemoryInMB() == CACHED_MB
    assert forest.estimator(CACHED_FROM_ROWS - 1).getMaxMemoryInMB() == 256
    given = replace(forest, params={"maxMemoryInMB": 9})
    assert [given.estimator(n).getMaxMemoryInMB() for n in (10, CACHED_FROM_ROWS)] == [9, 9]
