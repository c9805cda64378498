"""The 42 derived customer features as Spark SQL expressions.

Every expression is row-local; the only table-wide input is the median of
``TotalCharges`` (passed in as a literal), so the whole feature step is one
codegen'd projection over the cleaned table.
"""

from __future__ import annotations

from ..constants import (
    CONTRACT_COMMITMENT,
    CONTRACT_COMMITMENT_DEFAULT,
    MONTHLY_CHARGE_BANDS,
    PAYMENT_RISK,
    PAYMENT_RISK_DEFAULT,
    SERVICE_COLUMNS,
    TENURE_BANDS,
    TENURE_BUCKETS,
)
from .columns import band, flag, is_, is_not, lit, lookup, q, text_or_nan

M2M = "Month-to-month"
FIBER = "Fiber optic"
ECHECK = "Electronic check"


def feature_expressions(total_charges_median: float | None) -> list[tuple[str, str]]:
    """(name, SQL expression) for every derived feature, in output order."""

    tenure, monthly, total = q("tenure"), q("MonthlyCharges"), q("TotalCharges")

    def yes(name: str) -> str:
        return is_(q(name), "Yes")

    def not_yes(name: str) -> str:
        return is_not(q(name), "Yes")

    services = "(" + " + ".join(yes(n) for n in SERVICE_COLUMNS) + ")"
    m2m = is_(q("Contract"), M2M)
    fiber = is_(q("InternetService"), FIBER)
    echeck = is_(q("PaymentMethod"), ECHECK)
    avg_month = f"({total} / CASE WHEN {tenure} IS NULL THEN NULL WHEN {tenure} < 1 THEN 1.0 ELSE {tenure} END)"
    support_count = f"({yes('OnlineSecurity')} + {yes('TechSupport')})"
    commitment = "(" + lookup(q("Contract"), CONTRACT_COMMITMENT, CONTRACT_COMMITMENT_DEFAULT) + ")"
    bucket = band(tenure, TENURE_BUCKETS)
    charge_band = band(monthly, MONTHLY_CHARGE_BANDS)
    median = "CAST(NULL AS DOUBLE)" if total_charges_median is None else f"CAST({lit(float(total_charges_median))} AS DOUBLE)"

    return [
        ("total_active_services", services),
        ("is_month_to_month", m2m),
        ("has_auto_payment", flag(f"lower({q('PaymentMethod')}) LIKE '%automatic%'")),
        ("support_security_bundle", f"{yes('OnlineSecurity')} * {yes('TechSupport')}"),
        ("avg_total_charge_per_month", avg_month),
        ("charge_gap_vs_average", f"{monthly} - {avg_month}"),
        ("monthly_charge_log", f"log1p({monthly})"),
        ("total_charge_log", f"log1p(coalesce({total}, {median}))"),
        ("monthly_x_tenure", f"{monthly} * {tenure}"),
        ("charge_per_service", f"{monthly} / CASE WHEN {services} = 0 THEN 1 ELSE {services} END"),
        ("tenure_inverse", f"try_divide(1.0D, {tenure} + 1.0D)"),
        ("has_internet", is_not(q("InternetService"), "No")),
        ("has_fiber", fiber),
        ("fiber_no_security", f"{fiber} * {not_yes('OnlineSecurity')}"),
        ("fiber_no_support", f"{fiber} * {not_yes('TechSupport')}"),
        ("fiber_no_security_support", f"{fiber} * {not_yes('OnlineSecurity')} * {not_yes('TechSupport')}"),
        ("month_to_month_fiber", f"{m2m} * {fiber}"),
        ("electronic_check_m2m", f"{echeck} * {m2m}"),
        ("short_tenure_high_charge", flag(f"{tenure} <= 12 AND {monthly} >= 70")),
        ("new_customer", flag(f"{tenure} <= 6")),
        ("very_low_tenure", flag(f"{tenure} <= 2")),
        ("very_long_tenure", flag(f"{tenure} >= 60")),
        ("streaming_count", f"{yes('StreamingTV')} + {yes('StreamingMovies')}"),
        ("backup_protection_count", f"{yes('OnlineBackup')} + {yes('DeviceProtection')}"),
        ("support_count", support_count),
        ("risk_service_gap_count",
         f"{not_yes('OnlineSecurity')} + {not_yes('TechSupport')} + {not_yes('OnlineBackup')} + {not_yes('DeviceProtection')}"),
        ("contract_commitment_score", commitment),
        ("payment_risk_score", lookup(q("PaymentMethod"), PAYMENT_RISK, PAYMENT_RISK_DEFAULT)),
        ("contract_x_tenure", f"{commitment} * {tenure}"),
        ("contract_x_monthly", f"{commitment} * {monthly}"),
        ("support_x_fiber", f"{support_count} * {fiber}"),
        ("services_x_tenure", f"{services} * {tenure}"),
        ("is_senior_m2m", f"{flag(q('SeniorCitizen') + ' = 1')} * {m2m}"),
        ("dependents_partner_score", f"{yes('Partner')} + {yes('Dependents')}"),
        ("paperless_echeck", f"{yes('PaperlessBilling')} * {echeck}"),
        ("no_protection_services",
         f"{not_yes('OnlineSecurity')} * {not_yes('OnlineBackup')} * {not_yes('DeviceProtection')} * {not_yes('TechSupport')}"),
        ("internet_service_group", f"concat({text_or_nan(q('InternetService'))}, '_', {text_or_nan(q('Contract'))})"),
        ("payment_contract_group", f"concat({text_or_nan(q('PaymentMethod'))}, '_', {text_or_nan(q('Contract'))})"),
        ("tenure_band", band(tenure, TENURE_BANDS)),
        ("tenure_bucket", bucket),
        ("monthly_charge_band", charge_band),
        ("tenure_charge_band", f"concat({text_or_nan(bucket)}, '_', {text_or_nan(charge_band)})"),
    ]


FEATURE_NAMES = tuple(name for name, _ in feature_expressions(0.0))
