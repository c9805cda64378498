"""Fixed values that results depend on.

Everything below must keep these exact values for results to agree with the
published churn-analytics behaviour (column names, labels, cut-offs, costs,
action texts).  They are stated once, here, in natural order.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — schema
# ---------------------------------------------------------------------------
TARGET_COLUMN = "Churn"
ID_COLUMN = "customerID"

REQUIRED_COLUMNS = (
    "customerID",
    "gender",
    "SeniorCitizen",
    "Partner",
    "Dependents",
    "tenure",
    "PhoneService",
    "MultipleLines",
    "InternetService",
    "OnlineSecurity",
    "OnlineBackup",
    "DeviceProtection",
    "TechSupport",
    "StreamingTV",
    "StreamingMovies",
    "Contract",
    "PaperlessBilling",
    "PaymentMethod",
    "MonthlyCharges",
    "TotalCharges",
    "Churn",
)

PREFERRED_FILE_NAMES = (
    "Telco-Customer-Churn.csv",
    "WA_Fn-UseC_-Telco-Customer-Churn.csv",
    "telco_customer_churn.csv",
    "Telco_customer_churn.csv",
)

NUMERIC_RAW_COLUMNS = ("TotalCharges", "MonthlyCharges", "tenure")
MISSING_TOKENS = ("", "nan", "None")

# ---------------------------------------------------------------------------
# FIXED VALUES — run parameters
# ---------------------------------------------------------------------------
RANDOM_STATE = 42
TEST_SIZE = 0.20
CV_FOLDS = 5
QUICK_CV_FOLDS = 3

LOW_RISK_CUTOFF = 0.30
HIGH_RISK_CUTOFF = 0.60
FALSE_NEGATIVE_COST = 5
FALSE_POSITIVE_COST = 1

# threshold sweep: 0.05 .. 0.95 in steps of 0.01 (grid index / 100)
SWEEP_FIRST = 5
SWEEP_LAST = 95

PR_AUC_TOLERANCE = 0.003
TARGET_ENCODING_SMOOTHING = 20.0

# ---------------------------------------------------------------------------
# FIXED VALUES — feature vocabulary
# ---------------------------------------------------------------------------
SERVICE_COLUMNS = (
    "PhoneService",
    "MultipleLines",
    "OnlineSecurity",
    "OnlineBackup",
    "DeviceProtection",
    "TechSupport",
    "StreamingTV",
    "StreamingMovies",
)

CONTRACT_COMMITMENT = {"Month-to-month": 0, "One year": 1, "Two year": 2}
CONTRACT_COMMITMENT_DEFAULT = 0
PAYMENT_RISK = {
    "Electronic check": 3,
    "Mailed check": 2,
    "Bank transfer (automatic)": 1,
    "Credit card (automatic)": 1,
}
PAYMENT_RISK_DEFAULT = 2

# right-closed bands: (lower, upper] -> label; the last band is open above
TENURE_BANDS = (
    (-1, 12, "0-12 months"),
    (12, 24, "13-24 months"),
    (24, 48, "25-48 months"),
    (48, 72, "49-72 months"),
    (72, None, "72+ months"),
)
TENURE_BUCKETS = (
    (-1, 3, "0-3"),
    (3, 6, "4-6"),
    (6, 12, "7-12"),
    (12, 24, "13-24"),
    (24, 48, "25-48"),
    (48, 72, "49-72"),
    (72, None, "72+"),
)
MONTHLY_CHARGE_BANDS = (
    (None, 35, "low"),
    (35, 60, "moderate"),
    (60, 85, "high"),
    (85, None, "premium"),
)

# ---------------------------------------------------------------------------
# FIXED VALUES — column drop sets used by model specs
# ---------------------------------------------------------------------------
FOCUSED_ACCURACY_DROP_COLUMNS = (
    "gender",
    "SeniorCitizen",
    "Partner",
    "Dependents",
    "PhoneService",
    "MultipleLines",
    "StreamingTV",
    "StreamingMovies",
    "is_senior_m2m",
    "dependents_partner_score",
)
DROP_SPARSE_INTERACTION_COLUMNS = (
    "gender",
    "PhoneService",
    "MultipleLines",
    "monthly_x_tenure",
    "tenure_inverse",
    "tenure_charge_band",
    "payment_contract_group",
    "internet_service_group",
)
NO_DEMOGRAPHIC_DROP_COLUMNS = (
    "gender",
    "SeniorCitizen",
    "Partner",
    "Dependents",
    "is_senior_m2m",
    "dependents_partner_score",
)

# ---------------------------------------------------------------------------
# FIXED VALUES — retention actions, in priority order
# ---------------------------------------------------------------------------
RISK_TIERS = ("low", "medium", "high")
ACTION_CONTRACT = (
    "Contract migration offer",
    "Month-to-month customers have weaker switching barriers; offer a one-year plan incentive.",
)
ACTION_PRICING = (
    "Pricing and bundle review",
    "High monthly charges may create price sensitivity; review plan fit or targeted discount.",
)
ACTION_SUPPORT = (
    "Technical support outreach",
    "Missing support/security services suggest a service-quality intervention opportunity.",
)
ACTION_AUTOPAY = (
    "Auto-payment incentive",
    "Electronic-check customers often show elevated churn risk; encourage automated payment.",
)
ACTION_ONBOARDING = (
    "Onboarding outreach",
    "Early-lifecycle customers need onboarding reinforcement before dissatisfaction accumulates.",
)
ACTION_LOYALTY = (
    "Loyalty reinforcement",
    "Maintain the customer relationship through loyalty benefits and service-quality monitoring.",
)
PRICING_REVIEW_MIN_CHARGE = 80
ONBOARDING_MAX_TENURE = 12

# tokens that mark a tree model when choosing the model to explain
TREE_MODEL_TOKENS = ("CatBoost", "LightGBM", "XGBoost", "Random Forest", "Extra Trees", "Gradient")

# artifact tables a report needs
REQUIRED_ARTIFACTS = (
    "dataset_summary",
    "model_comparison",
    "final_metrics",
    "threshold_analysis",
    "decision_outputs",
    "tenure_summary",
    "shap_global_importance",
    "shap_local_explanations",
    "lime_local_explanations",
    "run_record",
    "model",
)

# ---------------------------------------------------------------------------
# FIXED VALUES — columns of the work queue, the profile and the comparison table
# ---------------------------------------------------------------------------
QUEUE_COLUMNS = (
    "customerID",
    "churn_probability",
    "risk_tier",
    "intervention_candidate",
    "recommended_action",
    "Contract",
    "tenure",
    "MonthlyCharges",
)
PROFILE_FIELDS = (
    "Contract",
    "tenure",
    "tenure_band",
    "InternetService",
    "OnlineSecurity",
    "TechSupport",
    "PaymentMethod",
    "total_active_services",
)
COMPARISON_COLUMNS = (
    "model",
    "cv_accuracy_mean",
    "cv_pr_auc_mean",
    "cv_roc_auc_mean",
    "cv_recall_mean",
    "cv_f1_mean",
    "test_accuracy",
    "test_pr_auc",
    "test_roc_auc",
    "test_recall",
    "test_f1",
)
