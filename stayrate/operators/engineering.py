"""Model features from the flat customer frame, and the fixed log-odds scorecard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate.functions.columns import fixed, flag, ratio
from stayrate.sources.schemas import COMPANY_SIZES, CONTRACT_TYPES

# fixed values: industries of the published model and of the fixture tables
INDUSTRIES = ["Technology", "Finance", "Healthcare", "Retail", "Manufacturing", "Other"]
FIXTURE_INDUSTRIES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

# fixed values: log-odds per unit of each term
SCORECARD_INTERCEPT = -2.5
SCORECARD = {
    "contract_monthly": 1.2,
    "contract_multi_year": -0.9,
    "num_support_tickets": 0.08,
    "payment_delays_6m": 0.12,
    "login_frequency_30d": -0.10,
    "feature_adoption_rate": -1.8,
    "nps_score": -0.015,
    "tenure_capped": -0.08,
    "last_login_months": 0.15,
    "csm_assigned": -0.25,
    "mrr_trend_90d": -1.2,
}


def interactions() -> dict[str, Column]:
    logins, adoption, depth = (F.col(c) for c in ("login_frequency_30d", "feature_adoption_rate", "session_depth_score"))
    charges = F.col("monthly_charges").cast("double")
    return {
        "support_per_tenure": ratio(F.col("num_support_tickets"), F.col("tenure_months") + 1),
        "revenue_per_month": charges,
        "revenue_per_product": ratio(charges, F.col("num_products")),
        "engagement_score": 0.40 * logins + 30 * (0.35 * adoption + 0.25 * depth),
    }


def risk_raw(complete: bool = False) -> dict[str, Column]:
    """Risk parts on their own scales; delays outside 0..4 have no defined payment risk.

    ``complete`` goes on with 0.3 per delay, for models that take no missing values.
    """
    delays = F.col("payment_delays_6m")
    payment = delays * F.lit(0.3)
    parts = {
        "recency_risk": F.greatest(F.least(F.col("last_login_days_ago") / F.lit(30.0), F.lit(3.0)), F.lit(0.0)),
        "payment_risk": payment if complete else F.when(delays.between(0, 4), payment),
        "support_risk": F.greatest(
            F.least(F.col("num_support_tickets") * F.col("avg_resolution_days") / 10.0, F.lit(5.0)), F.lit(0.0)
        ),
        "sentiment_risk": (1.0 - F.col("nps_score") / F.lit(100.0)) / 2.0,
    }
    total = sum((part * 0.25 for part in parts.values()), F.lit(0.0))
    return {**parts, "composite_risk_score": fixed(total, 4)}


def tenure_bucket() -> Column:
    months = F.col("tenure_months")
    return (
        F.when(months <= 0, None).when(months <= 6, "0-6m").when(months <= 12, "6-12m").when(months <= 24, "12-24m")
        .when(months <= 48, "24-48m").when(months <= 9999, "48m+")
    )


def flags() -> dict[str, Column]:
    marks = {
        "flag_low_engagement": flag(F.col("login_frequency_30d") < 3),
        "flag_payment_issues": flag(F.col("payment_delays_6m") >= 2),
        "flag_high_support": flag(F.col("num_support_tickets") >= 5),
        "flag_low_nps": flag(F.col("nps_score") < 0),
        "flag_declining_mrr": flag(F.col("mrr_trend_90d") < -0.05),
        "flag_low_adoption": flag(F.col("feature_adoption_rate") < 0.25),
    }
    return {**marks, "total_risk_flags": sum(marks.values(), F.lit(0))}


def one_hot(industries: Sequence[str] = INDUSTRIES) -> dict[str, Column]:
    """One column per declared value, so the matrix has the same columns on any data."""
    domains = {"contract_type": CONTRACT_TYPES, "industry": industries, "company_size": COMPANY_SIZES}
    return {
        f"{column}_{value}": flag(F.col(column) == value) for column, values in domains.items() for value in values
    }


def matrix(
    frame: DataFrame, numeric: Sequence[str], industries: Sequence[str] = INDUSTRIES, complete: bool = False
) -> DataFrame:
    """customer_id, all model features as double, churn_label."""
    derived = {**interactions(), **risk_raw(complete), **flags(), **one_hot(industries)}
    columns = {**{c: F.col(c) for c in numeric}, **derived}
    return frame.select(
        "customer_id", *[expr.cast("double").alias(name) for name, expr in columns.items()], "churn_label"
    )


def feature_names(matrix_frame: DataFrame) -> list[str]:
    return [c for c in matrix_frame.columns if c not in ("customer_id", "churn_label")]


def scorecard_terms() -> dict[str, Column]:
    """The terms of the log-odds sum, each already times its coefficient."""
    kind = F.col("contract_type")
    values = {
        "contract_monthly": flag(kind == "Monthly"),
        "contract_multi_year": flag(kind == "Multi-year"),
        "tenure_capped": F.greatest(F.least(F.col("tenure_months"), F.lit(24)), F.lit(0)) / F.lit(24.0),
        "last_login_months": F.col("last_login_days_ago") / F.lit(30.0),
    }
    return {name: values.get(name, F.col(name)).cast("double") * weight for name, weight in SCORECARD.items()}


def scorecard_probability() -> Column:
    """Probability from the fixed coefficients: a baseline that needs no training."""
    log_odds = sum(scorecard_terms().values(), F.lit(SCORECARD_INTERCEPT))
    return 1.0 / (1.0 + F.exp(-log_odds))


def scorecard(frame: DataFrame, digits: int | None = None) -> DataFrame:
    """customer_id, probability, label."""
    probability = scorecard_probability()
    if digits is not None:
        probability = fixed(probability, digits)
    return frame.select("customer_id", probability.alias("probability"), "churn_label")
