"""Risk tier and first-match retention action as Spark SQL expressions."""

from __future__ import annotations

from ..constants import (
    ACTION_AUTOPAY,
    ACTION_CONTRACT,
    ACTION_LOYALTY,
    ACTION_ONBOARDING,
    ACTION_PRICING,
    ACTION_SUPPORT,
    HIGH_RISK_CUTOFF,
    LOW_RISK_CUTOFF,
    ONBOARDING_MAX_TENURE,
    PRICING_REVIEW_MIN_CHARGE,
)
from .columns import lit, q


def risk_tier(p: str) -> str:
    """<0.30 low, <0.60 medium, anything else (including missing) high."""

    return (f"CASE WHEN {p} < {lit(LOW_RISK_CUTOFF)} THEN 'low' "
            f"WHEN {p} < {lit(HIGH_RISK_CUTOFF)} THEN 'medium' ELSE 'high' END")


def _pick(pair) -> str:
    return f"named_struct('action', {lit(pair[0])}, 'rationale', {lit(pair[1])})"


def recommendation(contract: str = q("Contract"), monthly_charges: str = q("MonthlyCharges"),
                   tenure: str = q("tenure"), payment_method: str = q("PaymentMethod"),
                   online_security: str = q("OnlineSecurity"), tech_support: str = q("TechSupport")) -> str:
    """struct<action, rationale> of the highest-priority rule that matches.

    Missing text compares unequal to everything ("isn't Yes" holds for NULL);
    a missing number fails both numeric rules, as NaN does.
    """

    monthly = f"CAST({monthly_charges} AS DOUBLE)"
    ten = f"CAST({tenure} AS DOUBLE)"
    return (
        f"CASE WHEN {contract} <=> 'Month-to-month' THEN {_pick(ACTION_CONTRACT)} "
        f"WHEN {monthly} >= {lit(PRICING_REVIEW_MIN_CHARGE)} THEN {_pick(ACTION_PRICING)} "
        f"WHEN NOT ({online_security} <=> 'Yes') OR NOT ({tech_support} <=> 'Yes') THEN {_pick(ACTION_SUPPORT)} "
        f"WHEN coalesce(contains({payment_method}, 'Electronic check'), FALSE) THEN {_pick(ACTION_AUTOPAY)} "
        f"WHEN {ten} <= {lit(ONBOARDING_MAX_TENURE)} THEN {_pick(ACTION_ONBOARDING)} "
        f"ELSE {_pick(ACTION_LOYALTY)} END"
    )
