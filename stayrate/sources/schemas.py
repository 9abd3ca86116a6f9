"""Declared schemas, keys and closed domains of the seven input tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _I, _L, _N = T.StringType(), T.DateType(), T.IntegerType(), T.LongType(), T.TimestampNTZType()
_MONEY = T.DecimalType(12, 2)


def _table(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


SCHEMAS: dict[str, T.StructType] = {
    "customers": _table(
        ("customer_id", _S), ("company_name", _S), ("industry", _S), ("company_size", _S),
        ("acquisition_date", _D), ("csm_owner", _S), ("region", _S), ("created_at", _N), ("updated_at", _N),
    ),
    "contracts": _table(
        ("contract_id", _L), ("customer_id", _S), ("contract_type", _S), ("start_date", _D), ("end_date", _D),
        ("monthly_charges", _MONEY), ("num_products", _I), ("has_addon", T.BooleanType()), ("discount_pct", _I),
        ("status", _S), ("churned_at", _D), ("churn_reason", _S),
    ),
    "billing_events": _table(
        ("event_id", _L), ("customer_id", _S), ("event_date", _D), ("event_type", _S), ("amount", _MONEY),
        ("days_overdue", _I),
    ),
    "product_usage": _table(
        ("usage_id", _L), ("customer_id", _S), ("usage_date", _D), ("logins", _I),
        ("session_minutes", T.DecimalType(8, 2)), ("features_used", _I), ("total_features", _I), ("api_calls", _I),
    ),
    "support_tickets": _table(
        ("ticket_id", _L), ("customer_id", _S), ("opened_at", _N), ("closed_at", _N), ("priority", _S),
        ("category", _S), ("csat_score", _I), ("resolution_days", T.DecimalType(6, 2)),
    ),
    "nps_responses": _table(
        ("response_id", _L), ("customer_id", _S), ("survey_date", _D), ("nps_score", _I), ("verbatim_feedback", _S),
    ),
    "churn_scores": _table(
        ("score_id", _L), ("customer_id", _S), ("scored_at", _D), ("churn_probability", T.DecimalType(6, 4)),
        ("risk_tier", _S), ("revenue_at_risk", _MONEY), ("top_driver_1", _S), ("top_driver_2", _S),
        ("top_driver_3", _S), ("recommended_action", _S), ("model_version", _S),
    ),
    "recovery_actions": _table(
        ("action_id", _L), ("customer_id", _S), ("actioned_at", _D), ("intervention", _S), ("outcome", _S),
        ("saved_mrr", _MONEY),
    ),
}

# the date by which each fact table is bounded and, when stored, partitioned by month
EVENT_DAY = {
    "billing_events": "event_date",
    "product_usage": "usage_date",
    "support_tickets": "opened_at",
    "nps_responses": "survey_date",
}
NULLABLE_DAYS = {"survey_date"}

# fixed values: closed domains of the data model
COMPANY_SIZES = ["SMB", "Mid-Market", "Enterprise"]
CONTRACT_TYPES = ["Monthly", "Annual", "Multi-year"]
CONTRACT_STATUSES = ["Active", "Churned", "Upgraded", "Downgraded"]
BILLING_TYPES = ["Payment", "Late Payment", "Refund", "Dispute", "Writeoff"]
PRIORITIES = ["Low", "Medium", "High", "Critical"]
RISK_TIERS = ["Critical", "High", "Medium", "Low"]

PRIMARY_KEYS = {
    "customers": ["customer_id"],
    "contracts": ["contract_id"],
    "support_tickets": ["ticket_id"],
    "nps_responses": ["response_id"],
    "churn_scores": ["score_id"],
    "billing_events": ["event_id"],
    "product_usage": ["usage_id"],
}
NATURAL_KEYS = {"product_usage": ["customer_id", "usage_date"]}
REQUIRED = {
    "customers": ["company_name", "acquisition_date"],
    "contracts": ["start_date", "monthly_charges"],
    "billing_events": ["event_date"],
    "product_usage": ["usage_date"],
    "support_tickets": ["opened_at"],
}
DOMAINS = {
    ("customers", "company_size"): COMPANY_SIZES,
    ("contracts", "contract_type"): CONTRACT_TYPES,
    ("contracts", "status"): CONTRACT_STATUSES,
    ("billing_events", "event_type"): BILLING_TYPES,
    ("support_tickets", "priority"): PRIORITIES,
    ("churn_scores", "risk_tier"): RISK_TIERS,
}
RANGES = {
    ("support_tickets", "csat_score"): (1, 5),
    ("nps_responses", "nps_score"): (-100, 100),
    ("churn_scores", "churn_probability"): (0, 1),
}
CHILD_TABLES = [
    "contracts", "billing_events", "product_usage", "support_tickets", "nps_responses", "churn_scores",
]
