from pyspark.sql import functions as F

from attrition.functions.decisions import recommendation, risk_tier


def _tier(spark, p):
    return spark.range(1).select(F.expr(risk_tier(repr(p) + "D")).alias("t")).first()["t"]


def test_risk_tier_boundaries(spark):
    assert _tier(spark, 0.29) == "low"
    assert _tier(spark, 0.30) == "medium"
    assert _tier(spark, 0.59) == "medium"
    assert _tier(spark, 0.60) == "high"
    assert spark.range(1).select(F.expr(risk_tier("CAST(NULL AS DOUBLE)")).alias("t")).first()["t"] == "high"


def _action(spark, **profile):
    cols = {"Contract": "string", "MonthlyCharges": "double", "tenure": "double", "PaymentMethod": "string",
            "OnlineSecurity": "string", "TechSupport": "string"}
    df = spark.createDataFrame([tuple(profile.get(c) for c in cols)], ", ".join(f"{c} {t}" for c, t in cols.items()))
    return df.select(F.expr(recommendation()).alias("r")).first()["r"]["action"]


def test_contract_comes_before_all_other_reasons(spark):
    assert _action(spark, Contract="Month-to-month", MonthlyCharges=101.5, tenure=1.0,
                   PaymentMethod="Electronic check", OnlineSecurity="No", TechSupport="No") == "Contract migration offer"
    assert _action(spark, Contract="Month-to-month", MonthlyCharges=19.9, tenure=66.0, PaymentMethod="Mailed check",
                   OnlineSecurity="Yes", TechSupport="Yes") == "Contract migration offer"


def test_one_missing_service_suffices_for_outreach(spark):
    kept = dict(Contract="One year", MonthlyCharges=42.0, tenure=50.0, PaymentMethod="Credit card (automatic)")
    assert _action(spark, OnlineSecurity="Yes", TechSupport="No", **kept) == "Technical support outreach"
    assert _action(spark, OnlineSecurity="No", TechSupport="Yes", **kept) == "Technical support outreach"
    assert _action(spark, OnlineSecurity="Yes", TechSupport="Yes", **kept) == "Loyalty reinforcement"


def test_rule_order(spark):
    full = dict(Contract="One year", OnlineSecurity="Yes", TechSupport="Yes")
    assert _action(spark, MonthlyCharges=80.0, tenure=40.0, PaymentMethod="Mailed check", **full) == "Pricing and bundle review"
    assert _action(spark, MonthlyCharges=50.0, tenure=40.0, PaymentMethod="Electronic check", **full) == "Auto-payment incentive"
    assert _action(spark, MonthlyCharges=50.0, tenure=12.0, PaymentMethod="Mailed check", **full) == "Onboarding outreach"
    assert _action(spark, MonthlyCharges=50.0, tenure=13.0, PaymentMethod="Mailed check", **full) == "Loyalty reinforcement"
    # a missing number fails both numeric rules
    assert _action(spark, MonthlyCharges=None, tenure=None, PaymentMethod="Mailed check", **full) == "Loyalty reinforcement"
    # case-sensitive payment match
    assert _action(spark, MonthlyCharges=50.0, tenure=40.0, PaymentMethod="electronic check", **full) == "Loyalty reinforcement"
