"""Feature frames composed from the tables; each fact table is read once, bounded by its window."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.operators import features
from stayrate.sources.tables import Tables

NUMERIC = [
    "tenure_months", "monthly_charges", "total_revenue", "num_products", "has_addon", "payment_delays_6m",
    "discount_pct", "login_frequency_30d", "feature_adoption_rate", "session_depth_score", "last_login_days_ago",
    "num_support_tickets", "avg_resolution_days", "csat_score", "nps_score", "csm_assigned", "expansion_events",
    "mrr_trend_90d", "usage_trend_30d",
]
CATEGORICAL = ["contract_type", "industry", "company_size"]


class Signals:
    """The per-topic feature tables of one as_of date, each fact table read once and bounded in the scan."""

    def __init__(self, tables: Tables, as_of: date, active_by: str = "status", horizon: int | None = None):
        self.tables, self.as_of, self.active_by, self.horizon = tables, as_of, active_by, horizon

    def _facts(self, name: str, days: int | None) -> DataFrame:
        since = None if days is None else self.as_of - timedelta(days=days)
        return self.tables.get(name, since, self.as_of)

    def state(self) -> DataFrame:
        return features.contract_state(self.tables.get("contracts"), self.as_of, self.active_by, self.horizon)

    def account(self) -> DataFrame:
        return features.account(self.tables.get("customers"), self.state(), self.as_of)

    def tenure(self) -> DataFrame:
        return self.account().select(*features.TENURE, "renewal_overdue")

    def revenue(self) -> DataFrame:
        return self.state().select(*features.REVENUE)

    def billing(self) -> DataFrame:
        return features.billing(self._facts("billing_events", None), self.as_of)

    def engagement(self, days: int = 90) -> DataFrame:
        return features.engagement(self._facts("product_usage", days), self.as_of)

    def support(self) -> DataFrame:
        return features.support(self._facts("support_tickets", 365), self.as_of)

    def nps(self) -> DataFrame:
        return features.nps(self._facts("nps_responses", None), self.as_of)

    def commercial(self) -> DataFrame:
        # session minutes need the last 30 days only
        return features.commercial(self.tables.get("contracts"), self.engagement(days=30), self.as_of)

    def risk(self) -> DataFrame:
        return features.risk(self.tenure(), self.billing(), self.engagement(), self.support(), self.nps())

    def final(self, also=()) -> DataFrame:
        return features.final_features(
            self.account(), self.billing(), self.engagement(), self.support(), self.nps(), also)


def customer_frame(tables: Tables, as_of: date, horizon: int = 90) -> DataFrame:
    """The flat frame behind exploration, training and scoring: customers live at as_of, with their label."""
    signals = Signals(tables, as_of, active_by="dates", horizon=horizon)
    scale = features.session_scale(signals.engagement())  # its 30-day column, and its shuffle
    extra = features.commercial_columns(F.col("avg_session_min_30d"), scale)
    rows = signals.final([*extra, "churn_label"])
    return rows.select("customer_id", *CATEGORICAL, *NUMERIC, "churn_label")
