import math

import pytest
from conftest import customer, raw_frame

from attrition.operators.clean import clean_dataset
from attrition.operators.features import add_domain_features, tenure_summary
from attrition.sources.files import FILE_ORDER, load_dataset, read_customers_csv


def _by_id(df):
    return {r["customerID"]: r for r in df.collect()}


def _pair(spark):
    """A new DSL customer who left, not billed yet, and an old one who stayed."""

    return raw_frame(spark, [
        customer("new", tenure=2, InternetService="DSL", Contract="Month-to-month", TotalCharges="  ", Churn="Yes"),
        customer("old", tenure=70, OnlineSecurity="Yes", TechSupport="Yes",
                 PaymentMethod="Bank transfer (automatic)", TotalCharges="5068"),
    ])


def test_labels_and_blank_charges(spark):
    clean = _by_id(clean_dataset(_pair(spark)))
    assert (clean["new"]["Churn"], clean["old"]["Churn"]) == (1, 0)
    assert clean["new"]["TotalCharges"] is None and clean["old"]["TotalCharges"] == 5068.0


def test_features_of_two_customers(spark):
    f = _by_id(add_domain_features(clean_dataset(_pair(spark))))
    new, old = f["new"], f["old"]
    assert (new["is_month_to_month"], old["is_month_to_month"]) == (1, 0)
    assert (new["has_auto_payment"], old["has_auto_payment"]) == (0, 1)
    assert old["support_security_bundle"] == 1
    assert (new["tenure_band"], old["tenure_band"]) == ("0-12 months", "49-72 months")
    # phone, lines, security, backup, support and television
    assert old["total_active_services"] == 6
    # a blank TotalCharges takes the median, here the one value there is
    assert new["total_charge_log"] == pytest.approx(math.log1p(5068.0), abs=1e-12)


def test_only_the_features_asked_for(spark):
    clean = clean_dataset(_pair(spark), columns=("tenure",))
    assert set(clean.columns) == {"customerID", "tenure", "Churn"}
    f = add_domain_features(clean, only=("tenure_band",))
    assert f.columns == [*clean.columns, "tenure_band"]


def _dirty(spark):
    return raw_frame(spark, [
        customer("D1", tenure=25),                                  # first copy of a duplicated id wins
        customer("D1", tenure=5, Churn="Yes"),
        customer("N1", Churn=None),                                 # first copy has no label: customer dropped
        customer("N1", Churn="Yes"),
        customer("T1", gender="\tFemale ", Partner="nan", Dependents="None", TotalCharges="1d"),
        customer("T2", TotalCharges="0x1p3", SeniorCitizen="1.9"),
        customer("T3", TotalCharges="NaN", SeniorCitizen="abc"),
        customer("T4", TotalCharges=" 12.5e1 ", tenure="", InternetService=None, Contract=None),
    ])


def test_clean_traps(spark):
    c = _by_id(clean_dataset(_dirty(spark)))
    assert c["D1"]["Churn"] == 0 and c["D1"]["tenure"] == 25.0
    assert "N1" not in c
    assert c["T1"]["gender"] == "Female"
    assert c["T1"]["Partner"] is None and c["T1"]["Dependents"] is None
    assert c["T1"]["TotalCharges"] is None          # "1d" is not a number
    assert c["T2"]["TotalCharges"] is None          # neither is hex
    assert c["T2"]["SeniorCitizen"] == 1            # 1.9 truncates
    assert c["T3"]["TotalCharges"] is None          # NaN never enters
    assert c["T3"]["SeniorCitizen"] == 0            # unparsable -> 0
    assert c["T4"]["TotalCharges"] == 125.0 and c["T4"]["tenure"] is None


def test_feature_traps(spark):
    f = _by_id(add_domain_features(clean_dataset(_dirty(spark))))
    t4 = f["T4"]
    assert t4["has_internet"] == 1                  # missing InternetService is "not No"
    assert t4["tenure_band"] is None and t4["avg_total_charge_per_month"] is None
    assert t4["internet_service_group"] == "nan_nan"
    assert t4["tenure_charge_band"].startswith("nan_")
    assert t4["contract_commitment_score"] == 0


def test_tenure_band_edges(spark):
    months = (0, 2, 3, 6, 12, 13, 24, 48, 60, 72, 73)
    rows = [customer(f"E{i}", tenure=t) for i, t in enumerate(months)]
    f = {r["tenure"]: r for r in add_domain_features(clean_dataset(raw_frame(spark, rows))).collect()}
    assert f[12.0]["tenure_band"] == "0-12 months" and f[13.0]["tenure_band"] == "13-24 months"
    assert f[72.0]["tenure_band"] == "49-72 months" and f[73.0]["tenure_band"] == "72+ months"
    assert f[3.0]["tenure_bucket"] == "0-3" and f[6.0]["tenure_bucket"] == "4-6"
    assert f[2.0]["very_low_tenure"] == 1 and f[60.0]["very_long_tenure"] == 1


def test_unknown_label_raises(spark):
    with pytest.raises(Exception, match="Unexpected Churn label"):
        clean_dataset(raw_frame(spark, [customer("M1", Churn="Maybe")])).collect()


def test_lifecycle_summary(spark):
    rows = [tuple(r) for r in tenure_summary(add_domain_features(clean_dataset(_pair(spark)))).collect()]
    assert rows == [("0-12 months", 1, 1.0), ("49-72 months", 1, 0.0)]


def _csv(folder, name, rows):
    folder.mkdir(exist_ok=True)
    header = list(rows[0])
    lines = [",".join(header)] + [",".join("" if r[c] is None else str(r[c]) for c in header) for r in rows]
    (folder / name).write_text("\n".join(lines) + "\n")


def test_first_copy_is_the_first_in_file_order(spark, tmp_path):
    """A small first file and a large second one: Spark packs the larger one into the first partition."""

    _csv(tmp_path / "in", "a.csv", [customer("same", Churn="No")])
    _csv(tmp_path / "in", "b.csv", [customer("same", Churn="Yes")] + [customer(f"x{i}") for i in range(4000)])
    raw = read_customers_csv(spark, str(tmp_path / "in"))
    assert _by_id(clean_dataset(raw, order_col=FILE_ORDER))["same"]["Churn"] == 0


def test_a_dataset_that_is_named_must_exist(spark, tmp_path):
    _csv(tmp_path / "in", "customers.csv", [customer("one")])
    frame, path = load_dataset(spark, "auto", str(tmp_path / "in"))
    assert frame.count() == 1 and path.endswith("customers.csv")
    with pytest.raises(FileNotFoundError):
        load_dataset(spark, str(tmp_path / "in" / "mistyped.csv"), str(tmp_path / "in"))
    (tmp_path / "bad.csv").write_text(" customerID ,gender\n1,Male\n")
    with pytest.raises(ValueError, match="missing required columns"):
        read_customers_csv(spark, str(tmp_path / "bad.csv"))
