from conftest import customer, raw_frame

from attrition.operators import explain
from attrition.operators.clean import clean_dataset
from attrition.operators.split import assign_split
from attrition.plans import models
from attrition.plans import queries as Q
from attrition.session import cut_lineage


def test_customer_detail_makes_one_split_for_both_explanations(spark, monkeypatch):
    raw = raw_frame(spark, [customer(f"K-{i}", tenure=i % 50, Contract=("One year", "Two year")[i % 2],
                                     Churn=("No", "Yes")[i % 3 == 0]) for i in range(200)])
    customers = clean_dataset(raw, columns=("tenure", "Contract"))
    made = []

    def split(*_):
        made.append(cut_lineage(assign_split(customers)))
        return made[-1]

    monkeypatch.setattr(Q, "_split", split)
    monkeypatch.setattr(Q, "_decisions", lambda *_: customers)
    monkeypatch.setattr(Q.R, "customer_profiles", lambda d: d)
    # the explanations are fitted for real, with few trees and samples
    plain, specs = explain.lime_explanations, models.candidate_model_specs()
    monkeypatch.setattr(explain, "lime_explanations", lambda *a: plain(*a, num_samples=50))
    for spec in specs:
        if spec.kind == "forest":
            spec.params.update(numTrees=3, maxDepth=2)
    monkeypatch.setattr(models, "candidate_model_specs", lambda: specs)
    rows = Q.customer_detail(spark, "").collect()
    assert len(made) == 1 and len(rows) == 200
    assert sum(r["top_shap_drivers"] is not None for r in rows) == made[0].filter("is_test").count()
    assert sum(r["lime_explanation"] is not None for r in rows) == 5
