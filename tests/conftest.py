import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from attrition.constants import REQUIRED_COLUMNS  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from attrition.session import local_session

    s = local_session("*", shuffle_partitions=8, app="attrition-tests")
    yield s
    s.stop()


#: A long-standing fibre customer without security or support; tests change what they need.
CUSTOMER = {
    "customerID": "K-100", "gender": "Male", "SeniorCitizen": 0, "Partner": "No", "Dependents": "Yes", "tenure": 31,
    "PhoneService": "Yes", "MultipleLines": "Yes", "InternetService": "Fiber optic", "OnlineSecurity": "No",
    "OnlineBackup": "Yes", "DeviceProtection": "No", "TechSupport": "No", "StreamingTV": "Yes",
    "StreamingMovies": "No", "Contract": "Two year", "PaperlessBilling": "No", "PaymentMethod": "Mailed check",
    "MonthlyCharges": 72.4, "TotalCharges": "2244.4", "Churn": "No",
}


def customer(cid, **changes):
    return CUSTOMER | {"customerID": cid} | changes


def raw_frame(spark, rows):
    """All-text raw customer table (as a CSV read without type inference gives) from dicts."""

    schema = ", ".join(f"`{c}` string" for c in REQUIRED_COLUMNS)
    return spark.createDataFrame(
        [tuple(None if r[c] is None else str(r[c]) for c in REQUIRED_COLUMNS) for r in rows], schema)
