"""DuckDB oracle SQL for the registered queries.

Written independently of the Spark code: plain SQL over the driver's tables,
with the shared ``telco`` view text as the first CTE.  Doubles that come out of
transcendental functions or multi-row floating sums are rounded (9 decimals)
on both sides, since the two engines may differ in the last bit there.
"""

from __future__ import annotations

from attrition.constants import TREE_MODEL_TOKENS
from attrition.sources.telco import DIRTY_SQL, SCORE_SQL_EXPR, TELCO_SQL

STRING_COLUMNS = (
    "customerID", "gender", "Partner", "Dependents", "PhoneService", "MultipleLines", "InternetService",
    "OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies",
    "Contract", "PaperlessBilling", "PaymentMethod",
)
NUM_RE = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"


def _s(c: str) -> str:
    stripped = f"regexp_replace(CAST({c} AS VARCHAR), '^\\s+|\\s+$', '', 'g')"
    return f"CASE WHEN {stripped} IN ('', 'nan', 'None') THEN NULL ELSE {stripped} END"


def _num(c: str) -> str:
    t = f"trim(CAST({c} AS VARCHAR))"
    return f"CASE WHEN regexp_full_match({t}, '{NUM_RE}') THEN CAST({t} AS DOUBLE) END"


CLEAN_BODY = f"""
SELECT {_s('customerID')} AS customerID, {_s('gender')} AS gender,
 CAST(TRUNC(COALESCE(CAST(SeniorCitizen AS DOUBLE), 0)) AS INTEGER) AS SeniorCitizen,
 {_s('Partner')} AS Partner, {_s('Dependents')} AS Dependents,
 CAST(tenure AS DOUBLE) AS tenure,
 {_s('PhoneService')} AS PhoneService, {_s('MultipleLines')} AS MultipleLines,
 {_s('InternetService')} AS InternetService, {_s('OnlineSecurity')} AS OnlineSecurity,
 {_s('OnlineBackup')} AS OnlineBackup, {_s('DeviceProtection')} AS DeviceProtection,
 {_s('TechSupport')} AS TechSupport, {_s('StreamingTV')} AS StreamingTV,
 {_s('StreamingMovies')} AS StreamingMovies, {_s('Contract')} AS Contract,
 {_s('PaperlessBilling')} AS PaperlessBilling, {_s('PaymentMethod')} AS PaymentMethod,
 CAST(MonthlyCharges AS DOUBLE) AS MonthlyCharges,
 {_num('TotalCharges')} AS TotalCharges,
 CASE {_s('Churn')} WHEN 'No' THEN 0 WHEN 'Yes' THEN 1 END AS Churn
FROM telco WHERE {_s('Churn')} IS NOT NULL
"""


def Y(c: str) -> str:
    return f"(CASE WHEN {c} = 'Yes' THEN 1 ELSE 0 END)"


def NY(c: str) -> str:
    return f"(CASE WHEN {c} IS NOT DISTINCT FROM 'Yes' THEN 0 ELSE 1 END)"


def IS(c: str, v: str) -> str:
    return f"(CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END)"


SERVICES = "+".join(Y(c) for c in ("PhoneService", "MultipleLines", "OnlineSecurity", "OnlineBackup",
                                    "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies"))
AVG_MONTH = "(TotalCharges / CASE WHEN tenure IS NULL THEN NULL WHEN tenure < 1 THEN 1.0 ELSE tenure END)"
COMMIT = "(CASE Contract WHEN 'Month-to-month' THEN 0 WHEN 'One year' THEN 1 WHEN 'Two year' THEN 2 ELSE 0 END)"
BUCKET = ("(CASE WHEN tenure > -1 AND tenure <= 3 THEN '0-3' WHEN tenure > 3 AND tenure <= 6 THEN '4-6' "
          "WHEN tenure > 6 AND tenure <= 12 THEN '7-12' WHEN tenure > 12 AND tenure <= 24 THEN '13-24' "
          "WHEN tenure > 24 AND tenure <= 48 THEN '25-48' WHEN tenure > 48 AND tenure <= 72 THEN '49-72' "
          "WHEN tenure > 72 THEN '72+' END)")
CHARGE_BAND = ("(CASE WHEN MonthlyCharges <= 35 THEN 'low' WHEN MonthlyCharges > 35 AND MonthlyCharges <= 60 THEN 'moderate' "
               "WHEN MonthlyCharges > 60 AND MonthlyCharges <= 85 THEN 'high' WHEN MonthlyCharges > 85 THEN 'premium' END)")
FIBER = IS("InternetService", "Fiber optic")
M2M = IS("Contract", "Month-to-month")

FEATURES_BODY = f"""
SELECT c.*,
 ({SERVICES}) AS total_active_services,
 {M2M} AS is_month_to_month,
 (CASE WHEN lower(PaymentMethod) LIKE '%automatic%' THEN 1 ELSE 0 END) AS has_auto_payment,
 {Y('OnlineSecurity')} * {Y('TechSupport')} AS support_security_bundle,
 {AVG_MONTH} AS avg_total_charge_per_month,
 MonthlyCharges - {AVG_MONTH} AS charge_gap_vs_average,
 ln(1 + MonthlyCharges) AS monthly_charge_log,
 ln(1 + COALESCE(TotalCharges, (SELECT median(TotalCharges) FROM clean))) AS total_charge_log,
 MonthlyCharges * tenure AS monthly_x_tenure,
 MonthlyCharges / CASE WHEN ({SERVICES}) = 0 THEN 1 ELSE ({SERVICES}) END AS charge_per_service,
 CASE WHEN tenure + 1.0 = 0 THEN NULL ELSE 1.0 / (tenure + 1.0) END AS tenure_inverse,
 (CASE WHEN InternetService IS NOT DISTINCT FROM 'No' THEN 0 ELSE 1 END) AS has_internet,
 {FIBER} AS has_fiber,
 {FIBER} * {NY('OnlineSecurity')} AS fiber_no_security,
 {FIBER} * {NY('TechSupport')} AS fiber_no_support,
 {FIBER} * {NY('OnlineSecurity')} * {NY('TechSupport')} AS fiber_no_security_support,
 {M2M} * {FIBER} AS month_to_month_fiber,
 {IS('PaymentMethod', 'Electronic check')} * {M2M} AS electronic_check_m2m,
 (CASE WHEN tenure <= 12 AND MonthlyCharges >= 70 THEN 1 ELSE 0 END) AS short_tenure_high_charge,
 (CASE WHEN tenure <= 6 THEN 1 ELSE 0 END) AS new_customer,
 (CASE WHEN tenure <= 2 THEN 1 ELSE 0 END) AS very_low_tenure,
 (CASE WHEN tenure >= 60 THEN 1 ELSE 0 END) AS very_long_tenure,
 {Y('StreamingTV')} + {Y('StreamingMovies')} AS streaming_count,
 {Y('OnlineBackup')} + {Y('DeviceProtection')} AS backup_protection_count,
 {Y('OnlineSecurity')} + {Y('TechSupport')} AS support_count,
 {NY('OnlineSecurity')} + {NY('TechSupport')} + {NY('OnlineBackup')} + {NY('DeviceProtection')} AS risk_service_gap_count,
 {COMMIT} AS contract_commitment_score,
 (CASE PaymentMethod WHEN 'Electronic check' THEN 3 WHEN 'Mailed check' THEN 2 WHEN 'Bank transfer (automatic)' THEN 1
   WHEN 'Credit card (automatic)' THEN 1 ELSE 2 END) AS payment_risk_score,
 {COMMIT} * tenure AS contract_x_tenure,
 {COMMIT} * MonthlyCharges AS contract_x_monthly,
 ({Y('OnlineSecurity')} + {Y('TechSupport')}) * {FIBER} AS support_x_fiber,
 ({SERVICES}) * tenure AS services_x_tenure,
 (CASE WHEN SeniorCitizen = 1 THEN 1 ELSE 0 END) * {M2M} AS is_senior_m2m,
 {Y('Partner')} + {Y('Dependents')} AS dependents_partner_score,
 {Y('PaperlessBilling')} * {IS('PaymentMethod', 'Electronic check')} AS paperless_echeck,
 {NY('OnlineSecurity')} * {NY('OnlineBackup')} * {NY('DeviceProtection')} * {NY('TechSupport')} AS no_protection_services,
 COALESCE(InternetService, 'nan') || '_' || COALESCE(Contract, 'nan') AS internet_service_group,
 COALESCE(PaymentMethod, 'nan') || '_' || COALESCE(Contract, 'nan') AS payment_contract_group,
 (CASE WHEN tenure > -1 AND tenure <= 12 THEN '0-12 months' WHEN tenure > 12 AND tenure <= 24 THEN '13-24 months'
   WHEN tenure > 24 AND tenure <= 48 THEN '25-48 months' WHEN tenure > 48 AND tenure <= 72 THEN '49-72 months'
   WHEN tenure > 72 THEN '72+ months' END) AS tenure_band,
 {BUCKET} AS tenure_bucket,
 {CHARGE_BAND} AS monthly_charge_band,
 COALESCE({BUCKET}, 'nan') || '_' || COALESCE({CHARGE_BAND}, 'nan') AS tenure_charge_band
FROM clean c
"""

SCORE_ON_CLEAN = SCORE_SQL_EXPR


def with_base(*ctes: tuple[str, str]) -> str:
    """WITH telco, clean, feat, plus extra CTEs."""

    parts = [f"telco AS ({TELCO_SQL})", f"clean AS ({CLEAN_BODY})", f"feat AS ({FEATURES_BODY})"]
    parts += [f"{name} AS ({body})" for name, body in ctes]
    return "WITH " + ",\n".join(parts) + "\n"


FEATURE_COLUMNS_ROUNDED = ("monthly_charge_log", "total_charge_log")

ORACLES: dict[str, str] = {}

ORACLES["telco_fixture"] = f"WITH telco AS ({TELCO_SQL}) SELECT * FROM telco"

ORACLES["clean_customers"] = f"WITH telco AS ({TELCO_SQL}), clean AS ({CLEAN_BODY}) SELECT * FROM clean"

ORACLES["domain_features"] = with_base() + (
    "SELECT * REPLACE (ROUND(monthly_charge_log, 9) AS monthly_charge_log, "
    "ROUND(total_charge_log, 9) AS total_charge_log) FROM feat"
)

def _first_copy() -> str:
    """Cleaned text of the first copy of each id, before rows without a label go."""

    texts = ", ".join(f"{_s(c)} AS {c}" for c in STRING_COLUMNS if c != "Churn")
    numbers = ", ".join(f"{_num(_trimmed(c))} AS {c}" for c in ("tenure", "MonthlyCharges", "TotalCharges"))
    return f"""
SELECT * EXCLUDE (r, copy_number) FROM (
 SELECT {texts}, {numbers}, CAST(TRUNC(COALESCE({_num(_trimmed('SeniorCitizen'))}, 0)) AS INTEGER) AS SeniorCitizen,
  CASE {_s('Churn')} WHEN 'No' THEN 0 WHEN 'Yes' THEN 1 END AS Churn, copy_number,
  row_number() OVER (PARTITION BY {_s('customerID')} ORDER BY copy_number) AS r FROM dirty)
WHERE r = 1 AND Churn IS NOT NULL
"""


def _trimmed(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


DIRTY_CTES = f"WITH telco AS ({TELCO_SQL}), dirty AS ({DIRTY_SQL}), clean AS ({_first_copy()})"
ORACLES["clean_dirty_customers"] = DIRTY_CTES + " SELECT * FROM clean"
ORACLES["dirty_features"] = DIRTY_CTES + f", feat AS ({FEATURES_BODY}) " + (
    "SELECT * REPLACE (ROUND(monthly_charge_log, 9) AS monthly_charge_log, "
    "ROUND(total_charge_log, 9) AS total_charge_log) FROM feat")

ORACLES["lifecycle_churn"] = with_base() + """
SELECT tenure_band, COUNT(*) AS customers, COALESCE(AVG(Churn), 0.0) AS churn_rate
FROM feat WHERE tenure_band IS NOT NULL GROUP BY tenure_band ORDER BY tenure_band
"""

ORACLES["dataset_summary"] = with_base() + """
SELECT COUNT(*) AS rows, 63 AS columns_after_feature_engineering, 21 AS raw_columns,
 AVG(CAST(Churn AS DOUBLE)) AS churn_rate,
 COUNT(*) FILTER (WHERE Churn = 0) AS non_churn_customers,
 COUNT(*) FILTER (WHERE Churn = 1) AS churn_customers,
 COUNT(*) - CAST(CEIL(0.2 * CAST(COUNT(*) AS DOUBLE)) AS BIGINT) AS train_rows,
 CAST(CEIL(0.2 * CAST(COUNT(*) AS DOUBLE)) AS BIGINT) AS test_rows
FROM feat
"""


SCORES = f"SELECT customerID, Churn, {SCORE_SQL_EXPR} AS churn_probability FROM clean"

SWEEP = """
SELECT CAST(g.i AS DOUBLE) / 100.0 AS threshold,
 SUM(CASE WHEN s.churn_probability >= CAST(g.i AS DOUBLE) / 100.0 AND s.Churn = 1 THEN 1 ELSE 0 END) AS tp,
 SUM(CASE WHEN s.churn_probability >= CAST(g.i AS DOUBLE) / 100.0 AND s.Churn <> 1 THEN 1 ELSE 0 END) AS fp,
 SUM(CASE WHEN NOT (s.churn_probability >= CAST(g.i AS DOUBLE) / 100.0) AND s.Churn = 1 THEN 1 ELSE 0 END) AS fn,
 SUM(CASE WHEN NOT (s.churn_probability >= CAST(g.i AS DOUBLE) / 100.0) AND s.Churn <> 1 THEN 1 ELSE 0 END) AS tn
FROM generate_series(5, 95) AS g(i) CROSS JOIN scores s GROUP BY g.i
"""


def _div(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END"


SWEEP_METRICS = f"""
SELECT threshold,
 {_div('tp + tn', 'tp + tn + fp + fn')} AS accuracy,
 {_div('tp', 'tp + fp')} AS precision,
 {_div('tp', 'tp + fn')} AS recall,
 {_div('2 * tp', '2 * tp + fp + fn')} AS f1,
 fp AS false_positive, fn AS false_negative, tp AS true_positive, tn AS true_negative,
 fn * 5 + fp * 1 AS business_cost
FROM sweep_counts
"""

BEST = """
SELECT
 (SELECT threshold FROM sweep ORDER BY f1 DESC, recall DESC, threshold ASC LIMIT 1) AS f1_optimal_threshold,
 (SELECT threshold FROM sweep ORDER BY CAST(true_positive + true_negative AS DOUBLE)
     / CAST(true_positive + true_negative + false_positive + false_negative AS DOUBLE) DESC, f1 DESC, threshold ASC LIMIT 1)
   AS accuracy_optimal_threshold,
 (SELECT threshold FROM sweep ORDER BY business_cost ASC, recall DESC, threshold ASC LIMIT 1) AS cost_sensitive_threshold,
 (SELECT CAST(MIN(business_cost) AS DOUBLE) FROM sweep) AS minimum_business_cost
"""

SWEEP_CTES = (("scores", SCORES), ("sweep_counts", SWEEP), ("sweep", SWEEP_METRICS), ("best", BEST))

ORACLES["threshold_sweep"] = with_base(*SWEEP_CTES) + "SELECT * FROM sweep"
ORACLES["best_thresholds"] = with_base(*SWEEP_CTES) + "SELECT * FROM best"

RANKS = """
SELECT churn_probability AS s, SUM(Churn) AS pos, SUM(CASE WHEN Churn <> 1 THEN 1 ELSE 0 END) AS neg
FROM scores WHERE churn_probability IS NOT NULL GROUP BY churn_probability
"""
RANKS_CUM = """
SELECT s, pos, neg,
 SUM(pos) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp_at,
 SUM(neg) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp_at,
 SUM(pos) OVER () AS P, SUM(neg) OVER () AS N
FROM ranks
"""
RANK_CTES = (("scores", SCORES), ("ranks", RANKS), ("ranks_cum", RANKS_CUM))

ORACLES["metrics_at_default"] = with_base(*RANK_CTES) + f"""
, c AS (SELECT
  COUNT(*) FILTER (WHERE Churn <> 1 AND NOT coalesce(churn_probability >= 0.5, FALSE)) AS tn,
  COUNT(*) FILTER (WHERE Churn <> 1 AND coalesce(churn_probability >= 0.5, FALSE)) AS fp,
  COUNT(*) FILTER (WHERE Churn = 1 AND NOT coalesce(churn_probability >= 0.5, FALSE)) AS fn,
  COUNT(*) FILTER (WHERE Churn = 1 AND coalesce(churn_probability >= 0.5, FALSE)) AS tp FROM scores),
r AS (SELECT SUM(pos * ((N - fp_at) + neg * 0.5)) / (MAX(P) * MAX(N)) AS roc_auc,
  SUM(pos * tp_at / (tp_at + fp_at)) / MAX(P) AS pr_auc FROM ranks_cum)
SELECT 0.5 AS threshold,
 {_div('tp + tn', 'tp + tn + fp + fn')} AS accuracy, {_div('tp', 'tp + fp')} AS precision,
 {_div('tp', 'tp + fn')} AS recall, {_div('2 * tp', '2 * tp + fp + fn')} AS f1,
 ROUND(roc_auc, 9) AS roc_auc, ROUND(pr_auc, 9) AS pr_auc,
 tn AS true_negative, fp AS false_positive, fn AS false_negative, tp AS true_positive, fn * 5 + fp AS cost
FROM c, r
"""

ORACLES["roc_curve"] = with_base(*RANK_CTES) + """
SELECT CAST('Infinity' AS DOUBLE) AS threshold, 0.0 AS fpr, 0.0 AS tpr
UNION ALL SELECT s, CAST(fp_at AS DOUBLE) / N, CAST(tp_at AS DOUBLE) / P FROM ranks_cum
"""
ORACLES["pr_curve"] = with_base(*RANK_CTES) + """
SELECT s AS threshold, CAST(tp_at AS DOUBLE) / (tp_at + fp_at) AS precision, CAST(tp_at AS DOUBLE) / P AS recall
FROM ranks_cum
"""

ORACLES["confusion_matrix"] = with_base(*SWEEP_CTES) + """
, c AS (SELECT
  COUNT(*) FILTER (WHERE Churn <> 1 AND NOT coalesce(churn_probability >= t, FALSE)) AS tn,
  COUNT(*) FILTER (WHERE Churn <> 1 AND coalesce(churn_probability >= t, FALSE)) AS fp,
  COUNT(*) FILTER (WHERE Churn = 1 AND NOT coalesce(churn_probability >= t, FALSE)) AS fn,
  COUNT(*) FILTER (WHERE Churn = 1 AND coalesce(churn_probability >= t, FALSE)) AS tp
  FROM scores, (SELECT cost_sensitive_threshold AS t FROM best))
SELECT 0 AS actual, 0 AS predicted, tn AS customers FROM c
UNION ALL SELECT 0, 1, fp FROM c UNION ALL SELECT 1, 0, fn FROM c UNION ALL SELECT 1, 1, tp FROM c
"""

RISK = "CASE WHEN churn_probability < 0.3 THEN 'low' WHEN churn_probability < 0.6 THEN 'medium' ELSE 'high' END"
ACTION = """CASE WHEN Contract IS NOT DISTINCT FROM 'Month-to-month' THEN 'Contract migration offer'
 WHEN MonthlyCharges >= 80 THEN 'Pricing and bundle review'
 WHEN OnlineSecurity IS DISTINCT FROM 'Yes' OR TechSupport IS DISTINCT FROM 'Yes' THEN 'Technical support outreach'
 WHEN coalesce(contains(PaymentMethod, 'Electronic check'), FALSE) THEN 'Auto-payment incentive'
 WHEN tenure <= 12 THEN 'Onboarding outreach'
 ELSE 'Loyalty reinforcement' END"""
RATIONALE = """CASE recommended_action
 WHEN 'Contract migration offer' THEN 'Month-to-month customers have weaker switching barriers; offer a one-year plan incentive.'
 WHEN 'Pricing and bundle review' THEN 'High monthly charges may create price sensitivity; review plan fit or targeted discount.'
 WHEN 'Technical support outreach' THEN 'Missing support/security services suggest a service-quality intervention opportunity.'
 WHEN 'Auto-payment incentive' THEN 'Electronic-check customers often show elevated churn risk; encourage automated payment.'
 WHEN 'Onboarding outreach' THEN 'Early-lifecycle customers need onboarding reinforcement before dissatisfaction accumulates.'
 ELSE 'Maintain the customer relationship through loyalty benefits and service-quality monitoring.' END"""

DECISIONS = f"""
SELECT *, {RATIONALE} AS recommendation_rationale FROM (
 SELECT *, {RISK} AS risk_tier,
  coalesce(churn_probability >= (SELECT cost_sensitive_threshold FROM best), FALSE) AS intervention_candidate,
  {ACTION} AS recommended_action
 FROM (SELECT f.*, {SCORE_SQL_EXPR} AS churn_probability FROM feat f))
"""
DECISION_CTES = SWEEP_CTES + (("decisions", DECISIONS),)

ORACLES["decisions"] = with_base(*DECISION_CTES) + """
SELECT customerID, Contract, tenure, MonthlyCharges, PaymentMethod, OnlineSecurity, TechSupport,
 churn_probability, risk_tier, intervention_candidate, recommended_action, recommendation_rationale, Churn
FROM decisions
"""
ORACLES["risk_tier_counts"] = with_base(*DECISION_CTES) + """
SELECT t.risk_tier, c.customers FROM (VALUES (0, 'low'), (1, 'medium'), (2, 'high')) t(o, risk_tier)
LEFT JOIN (SELECT risk_tier, COUNT(*) AS customers FROM decisions GROUP BY risk_tier) c USING (risk_tier)
ORDER BY t.o
"""
ORACLES["action_counts"] = with_base(*DECISION_CTES) + """
SELECT recommended_action, COUNT(*) AS customers FROM decisions GROUP BY recommended_action
ORDER BY customers DESC, recommended_action
"""
ORACLES["tier_action_counts"] = with_base(*DECISION_CTES) + """
SELECT risk_tier, recommended_action, COUNT(*) AS customers FROM decisions GROUP BY risk_tier, recommended_action
"""
ORACLES["headline_counts"] = with_base(*DECISION_CTES) + """
SELECT COUNT(*) FILTER (WHERE risk_tier = 'high') AS high_risk_customers,
 COUNT(*) FILTER (WHERE risk_tier = 'medium') AS medium_risk_customers,
 COUNT(*) FILTER (WHERE intervention_candidate) AS intervention_candidates FROM decisions
"""
ORACLES["work_queue"] = with_base(*DECISION_CTES) + """
SELECT customerID, churn_probability, risk_tier, intervention_candidate, recommended_action, Contract, tenure, MonthlyCharges
FROM decisions WHERE risk_tier = 'high' AND intervention_candidate ORDER BY churn_probability DESC, customerID
"""
_QUEUE = ("SELECT customerID, churn_probability, risk_tier, intervention_candidate, recommended_action, Contract, tenure, "
          "MonthlyCharges FROM decisions")
ORACLES["work_queue_all"] = with_base(*DECISION_CTES) + _QUEUE
ORACLES["work_queue_medium"] = with_base(*DECISION_CTES) + _QUEUE + " WHERE risk_tier = 'medium'"
ORACLES["customer_profiles"] = with_base(*DECISION_CTES) + """
SELECT customerID, churn_probability, risk_tier, recommended_action, recommendation_rationale, MonthlyCharges,
 Contract, tenure, tenure_band, InternetService, OnlineSecurity, TechSupport, PaymentMethod, total_active_services,
 CASE WHEN Churn = 1 THEN 'Churn' ELSE 'No churn' END AS actual_label
FROM decisions
"""

ORACLES["customer_lookup"] = ORACLES["customer_profiles"] + "WHERE customerID = (SELECT MIN(customerID) FROM decisions)"

THRESHOLD_TABLE = """
SELECT printf('%.3f', threshold) AS threshold,
 printf('%.3f', CAST(true_positive + true_negative AS DOUBLE) / CAST(true_positive + true_negative + false_positive + false_negative AS DOUBLE)) AS accuracy,
 printf('%.3f', precision) AS precision, printf('%.3f', recall) AS recall, printf('%.3f', f1) AS f1,
 false_positive, false_negative, business_cost
FROM sweep, best
WHERE ROUND(threshold, 2) IN (0.5, ROUND(f1_optimal_threshold, 2), ROUND(accuracy_optimal_threshold, 2),
                             ROUND(cost_sensitive_threshold, 2))
ORDER BY threshold
"""
ORACLES["threshold_table"] = with_base(*SWEEP_CTES) + THRESHOLD_TABLE
ORACLES["threshold_table_markdown"] = with_base(*SWEEP_CTES, ("tt", THRESHOLD_TABLE)) + """
SELECT '| ' || concat_ws(' | ', threshold, accuracy, precision, recall, f1, CAST(false_positive AS VARCHAR),
 CAST(false_negative AS VARCHAR), CAST(business_cost AS VARCHAR)) || ' |' AS markdown FROM tt
"""
def markdown_table_sql(source: str, columns: list[str], order: str) -> str:
    head = "| " + " | ".join(columns) + " |"
    rule = "| " + " | ".join(["---"] * len(columns)) + " |"
    cells = ", ".join(f"CAST({c} AS VARCHAR)" for c in columns)
    return (f"SELECT 1 AS line, '{head}' AS markdown UNION ALL SELECT 2, '{rule}' UNION ALL "
            f"SELECT CAST(2 + row_number() OVER (ORDER BY {order}) AS INTEGER), '| ' || concat_ws(' | ', {cells}) || ' |' "
            f"FROM {source}")


ORACLES["threshold_markdown_table"] = with_base(*SWEEP_CTES, ("tt", THRESHOLD_TABLE)) + markdown_table_sql(
    "tt", ["threshold", "accuracy", "precision", "recall", "f1", "false_positive", "false_negative", "business_cost"],
    "threshold")
ORACLES["metric_lines"] = with_base(*SWEEP_CTES) + """
SELECT threshold, 'precision' AS metric, precision AS value FROM sweep
UNION ALL SELECT threshold, 'recall', recall FROM sweep
UNION ALL SELECT threshold, 'f1', f1 FROM sweep
"""
LIFECYCLE = "SELECT tenure_band, COUNT(*) AS customers, COALESCE(AVG(Churn), 0.0) AS churn_rate FROM feat WHERE tenure_band IS NOT NULL GROUP BY tenure_band"
ORACLES["lifecycle_labels"] = with_base(("lc", LIFECYCLE)) + """
SELECT tenure_band, customers, churn_rate, printf('%.1f%%', churn_rate * 100) AS churn_rate_label FROM lc
"""
_LIFECYCLE_TABLE = """
SELECT tenure_band, customers, printf('%.3f', churn_rate) AS churn_rate FROM lc
"""
ORACLES["lifecycle_table"] = with_base(("lc", LIFECYCLE)) + _LIFECYCLE_TABLE
ORACLES["lifecycle_markdown_table"] = with_base(("lc", LIFECYCLE), ("lt", _LIFECYCLE_TABLE)) + markdown_table_sql(
    "lt", ["tenure_band", "customers", "churn_rate"], "tenure_band")


# --- split / prep -----------------------------------------------------------------------
SPLIT = """
SELECT f.*, rk < n_test_c AS is_test,
 CASE WHEN rk < n_test_c THEN NULL ELSE CAST((rk - n_test_c) % 5 AS INTEGER) END AS fold
FROM (SELECT *, row_number() OVER (PARTITION BY Churn ORDER BY md5(customerID || '42'), customerID) - 1 AS rk FROM feat) f
JOIN test_sizes USING (Churn)
"""
TEST_SIZES = """
WITH cc AS (SELECT Churn, COUNT(*) AS n FROM feat GROUP BY Churn),
tot AS (SELECT SUM(n) AS total_n, CAST(CEIL(0.2 * CAST(SUM(n) AS DOUBLE)) AS BIGINT) AS n_test FROM cc),
tr AS (SELECT Churn, n, (total_n - n_test) * CAST(n AS DOUBLE) / total_n AS cont, total_n - n_test AS draws FROM cc, tot),
tr2 AS (SELECT Churn, n, draws, FLOOR(cont) AS fl, cont - FLOOR(cont) AS rem FROM tr),
tr3 AS (SELECT Churn, n, fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, Churn) <= draws - SUM(fl) OVER () THEN 1 ELSE 0 END AS n_tr FROM tr2),
te AS (SELECT Churn, n - n_tr AS rest FROM tr3),
te2 AS (SELECT Churn, (SELECT n_test FROM tot) * CAST(rest AS DOUBLE) / SUM(rest) OVER () AS cont, (SELECT n_test FROM tot) AS draws FROM te),
te3 AS (SELECT Churn, draws, FLOOR(cont) AS fl, cont - FLOOR(cont) AS rem FROM te2)
SELECT Churn, CAST(fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, Churn) <= draws - SUM(fl) OVER () THEN 1 ELSE 0 END AS BIGINT) AS n_test_c FROM te3
"""
SPLIT_CTES = (("test_sizes", TEST_SIZES), ("split", SPLIT), ("train", "SELECT * FROM split WHERE NOT is_test"))

ORACLES["holdout_split"] = with_base(*SPLIT_CTES) + "SELECT customerID, Churn, is_test, fold FROM split"

NUMERIC_COLUMNS = (
    "SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges",
    "total_active_services", "is_month_to_month", "has_auto_payment", "support_security_bundle",
    "avg_total_charge_per_month", "charge_gap_vs_average", "monthly_charge_log", "total_charge_log",
    "monthly_x_tenure", "charge_per_service", "tenure_inverse", "has_internet", "has_fiber", "fiber_no_security",
    "fiber_no_support", "fiber_no_security_support", "month_to_month_fiber", "electronic_check_m2m",
    "short_tenure_high_charge", "new_customer", "very_low_tenure", "very_long_tenure", "streaming_count",
    "backup_protection_count", "support_count", "risk_service_gap_count", "contract_commitment_score",
    "payment_risk_score", "contract_x_tenure", "contract_x_monthly", "support_x_fiber", "services_x_tenure",
    "is_senior_m2m", "dependents_partner_score", "paperless_echeck", "no_protection_services",
)
CATEGORICAL_COLUMNS = (
    "gender", "Partner", "Dependents", "PhoneService", "MultipleLines", "InternetService", "OnlineSecurity",
    "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies", "Contract",
    "PaperlessBilling", "PaymentMethod", "internet_service_group", "payment_contract_group", "tenure_band",
    "tenure_bucket", "monthly_charge_band", "tenure_charge_band",
)

ORACLES["numeric_medians"] = with_base(*SPLIT_CTES) + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, median(CAST({c} AS DOUBLE)) AS median FROM train" for c in NUMERIC_COLUMNS)

_MED = "meds AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, median(CAST({c} AS DOUBLE)) AS m FROM train" for c in NUMERIC_COLUMNS) + ")"
_LONG_NUM = "numlong AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM train" for c in NUMERIC_COLUMNS) + ")"
ORACLES["scaling_stats"] = with_base(*SPLIT_CTES) + f""", {_MED}, {_LONG_NUM}
SELECT feature, ROUND(AVG(COALESCE(x, m)), 9) AS mean, ROUND(STDDEV_POP(COALESCE(x, m)), 9) AS std
FROM numlong JOIN meds USING (feature) GROUP BY feature
"""
_LONG_CAT = "catlong AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS v, Churn, fold FROM train" for c in CATEGORICAL_COLUMNS) + ")"
ORACLES["categorical_modes"] = with_base(*SPLIT_CTES) + f""", {_LONG_CAT}
SELECT feature, v AS mode FROM (
 SELECT feature, v, row_number() OVER (PARTITION BY feature ORDER BY COUNT(*) DESC, v) AS r
 FROM catlong WHERE v IS NOT NULL GROUP BY feature, v) WHERE r = 1
"""
ORACLES["onehot_levels"] = with_base(*SPLIT_CTES) + f""", {_LONG_CAT}
SELECT feature, v AS level, CAST(row_number() OVER (PARTITION BY feature ORDER BY v) - 1 AS INTEGER) AS slot
FROM (SELECT DISTINCT feature, v FROM catlong WHERE v IS NOT NULL)
"""
ORACLES["target_encoding"] = with_base(*SPLIT_CTES) + f""", {_LONG_CAT}
SELECT feature, v AS level,
 ROUND((SUM(Churn) + 20.0 * (SELECT AVG(CAST(Churn AS DOUBLE)) FROM train)) / (COUNT(*) + 20.0), 9) AS encoding
FROM catlong GROUP BY feature, v
"""
_HOLD_CAT = "holdcat AS (" + " UNION ALL ".join(
    f"SELECT customerID, '{c}' AS feature, CAST({c} AS VARCHAR) AS v FROM split WHERE is_test" for c in CATEGORICAL_COLUMNS) + ")"
ORACLES["target_encoded_values"] = with_base(*SPLIT_CTES) + f""", {_LONG_CAT}, {_HOLD_CAT},
prior AS (SELECT AVG(CAST(Churn AS DOUBLE)) AS p FROM train),
te AS (SELECT feature, v, (SUM(Churn) + 20.0 * (SELECT p FROM prior)) / (COUNT(*) + 20.0) AS e FROM catlong GROUP BY feature, v)
SELECT customerID, holdcat.feature, ROUND(COALESCE(e, (SELECT p FROM prior)), 9) AS encoding
FROM holdcat LEFT JOIN te ON te.feature = holdcat.feature AND te.v = holdcat.v
"""
ORACLES["attribution_sums"] = with_base(*SPLIT_CTES) + """
SELECT model, customers, customers AS additive_customers FROM (SELECT COUNT(*) AS customers FROM split WHERE is_test)
CROSS JOIN (SELECT unnest(['logistic', 'forest', 'boosting']) AS model)
"""
ORACLES["vote_checks"] = with_base(*SPLIT_CTES) + """, m AS (SELECT unnest(['Logistic Regression (No SMOTE)',
 'Logistic Regression (Target Encoded)', 'Logistic Regression (Focused Accuracy)', 'Soft Voting Ensemble']) AS model),
n AS (SELECT COUNT(*) FILTER (NOT is_test) AS oof_rows, COUNT(*) FILTER (is_test) AS test_rows, COUNT(*) AS customers FROM split)
SELECT model, oof_rows, test_rows, customers, customers AS in_range,
 CASE WHEN model = 'Soft Voting Ensemble' THEN customers ELSE 0 END AS votes_that_are_means FROM m CROSS JOIN n
"""
ORACLES["smote_class_balance"] = with_base(*SPLIT_CTES) + """, n AS (SELECT Churn, COUNT(*) AS k FROM train GROUP BY Churn)
SELECT Churn, (SELECT MAX(k) FROM n) AS rows, (SELECT MAX(k) FROM n) - k AS synthetic_rows FROM n
"""
ORACLES["target_encoding_out_of_fold"] = with_base(*SPLIT_CTES) + f""", {_LONG_CAT},
pf AS (SELECT feature, v, fold, SUM(Churn) AS sy_f, COUNT(*) AS n_f FROM catlong GROUP BY feature, v, fold),
tt AS (SELECT feature, v, SUM(sy_f) AS sy, SUM(n_f) AS n FROM pf GROUP BY feature, v),
fp AS (SELECT fold, (SELECT SUM(Churn) FROM train) - SUM(Churn) AS oy, (SELECT COUNT(*) FROM train) - COUNT(*) AS onn FROM train GROUP BY fold)
SELECT tt.feature, tt.v AS level, fp.fold,
 ROUND((tt.sy - COALESCE(pf.sy_f, 0) + 20.0 * (CAST(fp.oy AS DOUBLE) / fp.onn)) / (tt.n - COALESCE(pf.n_f, 0) + 20.0), 9) AS encoding
FROM tt CROSS JOIN fp LEFT JOIN pf ON pf.feature = tt.feature AND pf.v = tt.v AND pf.fold = fp.fold
"""
ORACLES["smote_recall"] = with_base(*SPLIT_CTES) + """, n AS (SELECT MIN(k) AS k FROM (SELECT COUNT(*) AS k FROM train GROUP BY Churn))
SELECT CAST(5 * ((k + 19) // 20) AS BIGINT) AS neighbours, TRUE AS recall_reached FROM n
"""
ORACLES["kernel_map_checks"] = with_base(*SPLIT_CTES) + """
SELECT COUNT(*) AS rows, COUNT(*) AS residuals_are_shares, COUNT(*) AS errors_in_bound, COUNT(*) AS exact_on_landmarks FROM train
"""
ORACLES["boosting_checks"] = with_base(*SPLIT_CTES) + """
SELECT growth, CAST(r.range AS INTEGER) AS round, (SELECT COUNT(*) FROM train) AS rows, TRUE AS leaves_in_bounds,
 TRUE AS values_are_closed_form, TRUE AS loss_falls
FROM (VALUES ('leaf'), ('depth'), ('oblivious')) g(growth) CROSS JOIN range(5) r
"""
from math import exp, factorial  # noqa: E402

_SHARES = [sum(exp(-1) / factorial(i) for i in range(k + 1)) for k in range(12)]
_DRAWN = "CAST(" + " + ".join(f"CAST(u >= {share!r} AS INTEGER)" for share in _SHARES) + " AS BIGINT)"
_DRAWS = """, drawn AS (SELECT tree, Churn, """ + _DRAWN + """ AS n FROM (
 SELECT CAST(t.range AS INTEGER) AS tree, Churn,
  CAST(CAST('0x' || substr(md5(customerID || ':42:' || t.range), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u
 FROM train CROSS JOIN range(8) t))"""
ORACLES["bootstrap_class_weights"] = with_base(*SPLIT_CTES) + _DRAWS + """
SELECT tree, Churn, CAST(SUM(n) AS BIGINT) AS drawn,
 ROUND(CAST(SUM(SUM(n)) OVER (PARTITION BY tree) AS DOUBLE) / (2.0 * SUM(n)), 9) AS weight FROM drawn GROUP BY tree, Churn
"""
ORACLES["forest_checks"] = with_base(*SPLIT_CTES) + _DRAWS + """
SELECT 'bootstrap' AS forest, tree, CAST(SUM(n) AS BIGINT) AS rows, TRUE AS leaves_are_right FROM drawn GROUP BY tree
UNION ALL SELECT 'random cuts', tree, COUNT(*), TRUE FROM drawn GROUP BY tree
"""
ORACLES["ordered_target_statistics"] = with_base(*SPLIT_CTES) + """, longcat AS (""" + " UNION ALL ".join(
    f"SELECT customerID, '{c}' AS feature, COALESCE(CAST({c} AS VARCHAR), 'nan') AS v, Churn FROM train"
    for c in CATEGORICAL_COLUMNS) + """),
p AS (SELECT CAST(SUM(Churn) AS DOUBLE) / COUNT(*) AS prior FROM train),
o AS (SELECT customerID, feature, COUNT(*) OVER w AS earlier, COALESCE(SUM(Churn) OVER w, 0) AS positives FROM longcat
 WINDOW w AS (PARTITION BY feature, v ORDER BY md5(customerID || '42'), customerID ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT customerID, feature, earlier, ROUND((positives + prior) / (earlier + 1.0), 9) AS statistic FROM o CROSS JOIN p
"""
ORACLES["class_weights"] = with_base(*SPLIT_CTES) + """
SELECT Churn, COUNT(*) AS n, CAST(SUM(COUNT(*)) OVER () AS DOUBLE) / (2.0 * COUNT(*)) AS weight FROM train GROUP BY Churn
"""


# --- comparison over fixture scorers ---------------------------------------------------
from attrition.sources.telco import FIXTURE_SCORERS  # noqa: E402

SCORER_LONG = " UNION ALL ".join(
    f"SELECT '{name}' AS model, customerID, Churn, is_test, fold, {expr} AS churn_probability FROM split"
    for name, expr in FIXTURE_SCORERS.items())


def grouped_metrics_sql(src: str, by: list[str]) -> str:
    keys = ", ".join(by)
    part = f"PARTITION BY {keys}"
    pred = "coalesce(churn_probability >= 0.5, FALSE)"
    return f"""
SELECT {keys}, 0.5 AS threshold,
 {_div('tp + tn', 'tp + tn + fp + fn')} AS accuracy, {_div('tp', 'tp + fp')} AS precision,
 {_div('tp', 'tp + fn')} AS recall, {_div('2 * tp', '2 * tp + fp + fn')} AS f1, roc_auc, pr_auc,
 tn AS true_negative, fp AS false_positive, fn AS false_negative, tp AS true_positive, fn * 5 + fp AS cost
FROM (SELECT {keys},
  COUNT(*) FILTER (WHERE Churn <> 1 AND NOT {pred}) AS tn, COUNT(*) FILTER (WHERE Churn <> 1 AND {pred}) AS fp,
  COUNT(*) FILTER (WHERE Churn = 1 AND NOT {pred}) AS fn, COUNT(*) FILTER (WHERE Churn = 1 AND {pred}) AS tp
  FROM {src} GROUP BY {keys}) conf
JOIN (SELECT {keys}, CAST(SUM(pos * ((nn - fp_at) + neg * 0.5)) AS DOUBLE) / (MAX(pp) * MAX(nn)) AS roc_auc,
   SUM(CAST(pos * tp_at AS DOUBLE) / (tp_at + fp_at)) / MAX(pp) AS pr_auc
  FROM (SELECT *, SUM(pos) OVER ({part} ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp_at,
     SUM(neg) OVER ({part} ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp_at,
     SUM(pos) OVER ({part}) AS pp, SUM(neg) OVER ({part}) AS nn
    FROM (SELECT {keys}, churn_probability AS s, SUM(Churn) AS pos, SUM(CASE WHEN Churn <> 1 THEN 1 ELSE 0 END) AS neg
          FROM {src} WHERE churn_probability IS NOT NULL GROUP BY {keys}, churn_probability)) GROUP BY {keys}) rm
USING ({keys})
"""


CV_METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc")
TEST_FIELDS = ("threshold", "accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc",
               "true_negative", "false_positive", "false_negative", "true_positive", "cost")
COMPARISON = (
    "SELECT cv.model, " + ", ".join(f"cv_{m}_mean, cv_{m}_std" for m in CV_METRICS) + ", "
    + ", ".join(f"t.{f} AS test_{f}" for f in TEST_FIELDS)
    + " FROM (SELECT model, " + ", ".join(f"AVG({m}) AS cv_{m}_mean, STDDEV_POP({m}) AS cv_{m}_std" for m in CV_METRICS)
    + " FROM fm GROUP BY model) cv JOIN tm t ON t.model = cv.model"
)
CMP_CTES = SPLIT_CTES + (
    ("lg", SCORER_LONG),
    ("fm", grouped_metrics_sql("(SELECT * FROM lg WHERE NOT is_test)", ["model", "fold"])),
    ("tm", grouped_metrics_sql("(SELECT * FROM lg WHERE is_test)", ["model"])),
    ("cmp", COMPARISON),
)


FM_DOUBLES = ("threshold", "accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc")
ORACLES["fold_metrics"] = with_base(*CMP_CTES) + "SELECT * REPLACE (" + ", ".join(
    f"ROUND({c}, 9) AS {c}" for c in FM_DOUBLES) + ") FROM fm"
CMP_DOUBLES = [f"cv_{m}_{k}" for m in CV_METRICS for k in ("mean", "std")] + [
    f"test_{f}" for f in ("threshold", "accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc")]
ORACLES["model_comparison"] = with_base(*CMP_CTES) + "SELECT * REPLACE (" + ", ".join(
    f"ROUND({c}, 9) AS {c}" for c in CMP_DOUBLES) + ") FROM cmp"
ORACLES["top_three_models"] = with_base(*CMP_CTES) + "SELECT model FROM cmp ORDER BY cv_pr_auc_mean DESC, model LIMIT 3"
ORACLES["top_models_chart"] = with_base(*CMP_CTES) + (
    "SELECT model, ROUND(cv_pr_auc_mean, 9) AS cv_pr_auc_mean FROM cmp ORDER BY cv_pr_auc_mean DESC, model LIMIT 7")
ORACLES["selected_model"] = with_base(*CMP_CTES) + """
SELECT model FROM cmp WHERE cv_pr_auc_mean >= (SELECT MAX(cv_pr_auc_mean) FROM cmp) - 0.003
ORDER BY test_accuracy DESC, cv_accuracy_mean DESC, cv_f1_mean DESC, cv_pr_auc_mean DESC, model LIMIT 1
"""
_TREE = " OR ".join(f"contains(model, '{t}')" for t in TREE_MODEL_TOKENS)
ORACLES["explainer_model"] = with_base(*CMP_CTES) + f"""
SELECT model FROM cmp ORDER BY ({_TREE}) DESC, cv_pr_auc_mean DESC, model LIMIT 1
"""
_CMP_COLS = ("cv_accuracy_mean", "cv_pr_auc_mean", "cv_roc_auc_mean", "cv_recall_mean", "cv_f1_mean",
             "test_accuracy", "test_pr_auc", "test_roc_auc", "test_recall", "test_f1")
CMP_REPORT = "SELECT model, " + ", ".join(f"printf('%.3f', {c}) AS {c}" for c in _CMP_COLS) + \
    " FROM cmp ORDER BY cv_pr_auc_mean DESC, model"
ORACLES["comparison_report"] = with_base(*CMP_CTES) + CMP_REPORT
ORACLES["comparison_markdown"] = with_base(*CMP_CTES, ("rep", CMP_REPORT)) + \
    "SELECT '| ' || concat_ws(' | ', model, " + ", ".join(_CMP_COLS) + ") || ' |' AS markdown FROM rep"


ORACLES["streaming_decisions"] = ORACLES["decisions"]
ORACLES["streaming_tier_counts"] = with_base(*DECISION_CTES) + "SELECT risk_tier, COUNT(*) AS customers FROM decisions GROUP BY risk_tier"

ORACLES["streaming_dirty_customers"] = ORACLES["clean_dirty_customers"]
ORACLES["csv_source_lifecycle"] = ORACLES["lifecycle_churn"]

#: Explanations under the rule score: worths of all coalitions, then the Shapley formula.
_RULE = ("tenure", "MonthlyCharges", "SeniorCitizen", "total_active_services", "is_month_to_month", "has_fiber")


def _rule_score(x) -> str:
    return (f"0.25 + 0.3 * {x(4)} + 0.2 * {x(5)} * (1.0 - LEAST({x(0)}, 29.0) / 29.0) + {x(1)} * {x(4)} / 403.0"
            f" + 0.05 * {x(2)} * {x(5)} - 0.02 * {x(3)} * {x(5)} - 0.013 * {x(3)}")


def _rule_columns(prefix: str) -> str:
    return ", ".join(f"CAST({c} AS DOUBLE) AS {prefix}{j}" for j, c in enumerate(_RULE))


def _mixed(j: int) -> str:
    return f"(CASE WHEN (s >> {j}) & 1 = 1 THEN x{j} ELSE b{j} END)"


_WORTH_OF_SIZE = "CASE bit_count(w.s) " + " ".join(
    f"WHEN {k} THEN {factorial(k) * factorial(5 - k) / factorial(6)!r}" for k in range(6)) + " END"
SHAPLEY_CTES = SPLIT_CTES + (
    ("given", f"SELECT customerID, {_rule_columns('x')} FROM split WHERE is_test"),
    ("ground", f"SELECT {_rule_columns('b')} FROM split WHERE NOT is_test "
               "ORDER BY md5(customerID || '42'), customerID LIMIT 12"),
    ("worths", f"SELECT customerID, s, AVG({_rule_score(_mixed)}) AS v FROM given, ground, "
               "(SELECT UNNEST(range(64)) AS s) GROUP BY customerID, s"),
    ("shapley", "SELECT w.customerID, j, "
                f"ROUND(SUM({_WORTH_OF_SIZE} * (u.v - w.v)), 9) AS attribution "
                "FROM (SELECT *, UNNEST(range(6)) AS j FROM worths) w JOIN worths u "
                "ON u.customerID = w.customerID AND u.s = (w.s | (1 << j)) AND u.s <> w.s GROUP BY w.customerID, j"),
    ("named", "SELECT *, ([" + ", ".join(f"'{c}'" for c in _RULE) + "])[j + 1] AS feature FROM shapley"),
    ("importance", "SELECT feature, ROUND(AVG(ABS(attribution)), 9) AS mean_abs_shap FROM named GROUP BY feature"),
    ("probs", f"SELECT customerID, ROUND({_rule_score(lambda j: f'x{j}')}, 9) AS churn_probability FROM given"),
    ("items", "SELECT *, ROW_NUMBER() OVER (PARTITION BY customerID ORDER BY ABS(attribution) DESC, j DESC) AS place FROM named"),
    ("drivers", "SELECT customerID, churn_probability, string_agg(feature || ' (' || CASE WHEN attribution > 0 "
                "THEN 'increases churn risk' ELSE 'decreases churn risk' END || ', ' || printf('%.3f', attribution) || ')', "
                "'; ' ORDER BY place) AS top_shap_drivers FROM items JOIN probs USING (customerID) WHERE place <= 5 "
                "GROUP BY customerID, churn_probability"),
)
_SHAPLEY = with_base(*SHAPLEY_CTES)
ORACLES["coalition_attributions"] = _SHAPLEY + """
SELECT customerID, feature, churn_probability, (SELECT ROUND(AVG(v), 9) FROM worths WHERE s = 0) AS base, attribution
FROM named JOIN probs USING (customerID)"""
ORACLES["coalition_importance"] = _SHAPLEY + "SELECT * FROM importance"
ORACLES["coalition_drivers"] = _SHAPLEY + "SELECT * FROM drivers"
ORACLES["sample_local_explanations"] = _SHAPLEY + "SELECT * FROM drivers ORDER BY churn_probability DESC, customerID LIMIT 5"
ORACLES["driver_items"] = _SHAPLEY + """
SELECT customerID, CAST(UNNEST(range(5)) AS INTEGER) AS position, UNNEST(string_split(top_shap_drivers, '; ')) AS driver FROM drivers"""
ORACLES["top_drivers_chart"] = _SHAPLEY + "SELECT * FROM importance ORDER BY mean_abs_shap DESC, feature LIMIT 15"
ORACLES["drivers_report"] = _SHAPLEY + """
SELECT feature, printf('%.3f', mean_abs_shap) AS mean_abs_shap FROM importance ORDER BY importance.mean_abs_shap DESC, feature LIMIT 10"""
ORACLES["rule_customer_detail"] = with_base(*DECISION_CTES, *SHAPLEY_CTES) + ", profiles AS (" + \
    ORACLES["customer_profiles"].removeprefix(with_base(*DECISION_CTES)) + """)
SELECT profiles.*, top_shap_drivers, CAST(NULL AS VARCHAR) AS lime_explanation
FROM profiles LEFT JOIN (SELECT customerID, top_shap_drivers FROM drivers) USING (customerID)"""
