import pytest
from pyspark.ml.functions import vector_to_array

from attrition.plans import queries
from attrition.plans.models import ModelSpec
from attrition.plans.training import cross_validate, fit_spec, prepare
from attrition.session import cut_lineage


@pytest.fixture(scope="module")
def data(spark):
    rows = [(f"c{i}", (i * 7 + i // 9) % 5 % 2, "abcd"[i % 11 % 4], float(i % 13), i % 5 == 0, None if i % 5 == 0 else i // 5 % 2)
            for i in range(150)]
    return cut_lineage(spark.createDataFrame(
        rows, "customerID string, Churn int, plan string, tenure double, is_test boolean, fold int").repartition(2))


def target_encoded(smoothing):
    return ModelSpec(f"smoothing {smoothing:g}", "logistic", {"maxIter": 100}, encoder="target", smoothing=smoothing)


def test_the_query_runs_every_smoothing(spark, data, monkeypatch):
    monkeypatch.setattr(queries, "_split", lambda *_: data)
    rows = queries.REGISTRY["smoothing_grid"](spark, "")
    got = {r["model"]: r for r in rows.collect()}
    assert set(got) == {f"smoothing {v}" for v in (5, 10, 20, 50, 100)}


def test_a_shared_preparation_gives_the_fit_of_its_own(data):
    train = data.filter("not is_test")
    shared = prepare(target_encoded(5.0), train)
    for smoothing in (5.0, 100.0):
        own, got = fit_spec(target_encoded(smoothing), train), fit_spec(target_encoded(smoothing), train, prepared=shared)
        assert list(got.model.coefficients) == pytest.approx(list(own.model.coefficients), abs=1e-12)
        encoded = [sorted((r["customerID"], r["x"]) for r in m.encode(data).select("customerID", vector_to_array("features").alias("x"))
                          .collect()) for m in (own, got)]
        assert encoded[0] == encoded[1]
    assert shared[0].smoothing == 5.0 and shared[0].coder.getSmoothing() == 5.0
    oof, _, test = cross_validate(target_encoded(100.0), data, 2)
    assert (oof.count(), test.count()) == (120, 30)
