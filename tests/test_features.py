"""Micro-fixtures: defaults, boundaries and ties of the point-in-time features."""

from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stayrate.functions.columns import complete_months, month_start_from
from stayrate.operators import engineering, features
from stayrate.plans.frames import Signals, customer_frame
from stayrate.sources.schemas import SCHEMAS
from stayrate.sources.tables import Tables

AS_OF = date(2025, 6, 15)


def make(spark, name, rows):
    """Rows given as dicts; absent columns are NULL."""
    schema = SCHEMAS[name]
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)


def customer(cid, **more):
    return {"customer_id": cid, "company_name": cid, "industry": "Retail", "company_size": "SMB",
            "acquisition_date": date(2023, 3, 20), "region": "EU", **more}


def contract(contract_id, cid, start=date(2024, 1, 1), status="Active", charges="100.00", **more):
    return {"contract_id": contract_id, "customer_id": cid, "contract_type": "Annual", "start_date": start,
            "monthly_charges": Decimal(charges), "num_products": 1, "has_addon": False, "discount_pct": 0,
            "status": status, **more}


class MemoryTables(Tables):
    def __init__(self, spark, **rows):
        super().__init__(spark)
        self.rows = rows

    def _read(self, name, since, until):
        return make(self.spark, name, self.rows.get(name, []))


def test_complete_months(spark):
    row = spark.sql(
        "select date'2023-03-20' a, date'2025-06-15' b, date'2024-01-31' c, date'2024-02-29' d, date'2024-02-01' e"
    ).select(
        complete_months(F.col("a"), F.col("b")), complete_months(F.col("c"), F.col("d")),
        month_start_from(F.col("e")), month_start_from(F.col("d")),
    ).first()
    assert row[0] == 26 and row[1] == 0
    assert row[2] == date(2024, 2, 1) and row[3] == date(2024, 3, 1)


def test_month_component_is_kept_only_in_compat(spark):
    customers, contracts = make(spark, "customers", [customer("A")]), make(spark, "contracts", [contract(1, "A")])
    assert features.tenure(customers, contracts, AS_OF).first().tenure_months == 26
    assert features.tenure(customers, contracts, AS_OF, compat=True).first().tenure_months == 2


def test_two_active_contracts_give_one_row(spark):
    contracts = make(spark, "contracts", [
        contract(1, "A", charges="10.00"), contract(3, "A", start=date(2024, 5, 1), charges="20.00"),
        contract(2, "A", start=date(2024, 5, 1), charges="30.00"),
    ])
    rows = features.tenure(make(spark, "customers", [customer("A")]), contracts, AS_OF).collect()
    assert [r.monthly_charges for r in rows] == [Decimal("20.00")]


def test_defaults_without_facts(spark):
    tables = MemoryTables(spark, customers=[customer("A")], contracts=[contract(1, "A")])
    row = Signals(tables, AS_OF).final().first()
    expected = {"payment_delays_6m": 0, "login_frequency_30d": 0, "last_login_days_ago": 90, "usage_trend_30d": -0.5,
                "csat_score": 3, "nps_score": 0, "days_since_nps": 365, "num_support_tickets": 0}
    assert {k: row[k] for k in expected} == expected
    risk = Signals(tables, AS_OF).risk().first()
    assert (risk.recency_risk, risk.payment_risk, risk.support_risk, risk.sentiment_risk) == (1.0, 0.0, 0.0, 0.5)
    assert row.composite_risk_score == 0.375


def usage(cid, days_ago, logins=4, used=5, total=20):
    return {"customer_id": cid, "usage_date": AS_OF - timedelta(days=days_ago), "logins": logins,
            "session_minutes": Decimal("10.00"), "features_used": used, "total_features": total}


def test_usage_trend_and_zero_features(spark):
    rows = features.engagement(make(spark, "product_usage", [
        usage("only-recent", 30), usage("only-old", 61), usage("both", 0, logins=6), usage("both", 90, logins=3),
        usage("no-features", 1, used=0, total=0), usage("outside", 91), usage("future", -1),
    ]), AS_OF)
    found = {r.customer_id: r for r in rows.collect()}
    assert set(found) == {"only-recent", "only-old", "both", "no-features"}
    assert found["only-recent"].usage_trend_pct == 0
    assert found["only-old"].usage_trend_pct is None
    assert found["both"].usage_trend_pct == 1.0 and found["both"].days_since_login == 0
    assert found["no-features"].feature_adoption_30d == 0


def test_newest_survey_ignores_undated_and_breaks_ties(spark):
    rows = features.nps(make(spark, "nps_responses", [
        {"response_id": 9, "customer_id": "A", "survey_date": None, "nps_score": -50},
        {"response_id": 1, "customer_id": "A", "survey_date": date(2025, 1, 1), "nps_score": 10},
        {"response_id": 2, "customer_id": "A", "survey_date": date(2025, 1, 1), "nps_score": 20},
        {"response_id": 3, "customer_id": "A", "survey_date": date(2026, 1, 1), "nps_score": 90},
        {"response_id": 4, "customer_id": "B", "survey_date": None, "nps_score": 30},
    ]), AS_OF)
    assert {r.customer_id: (r.nps_score, r.days_since_nps) for r in rows.collect()} == {"A": (20, 165), "B": (30, None)}


def test_last_csat_is_the_last_one(spark):
    def ticket(i, days, csat):
        return {"ticket_id": i, "customer_id": "A", "opened_at": datetime(2025, 6, 15) - timedelta(days=days),
                "priority": "High", "csat_score": csat, "resolution_days": Decimal("1.50")}

    row = features.support(make(spark, "support_tickets", [ticket(1, 10, 5), ticket(2, 5, 2), ticket(3, 1, None)]), AS_OF).first()
    assert (row.max_csat, row.last_csat, row.tickets_90d, row.low_csat_tickets_6m) == (5, 2, 3, 1)


@pytest.mark.parametrize("months,bucket", [
    (0, None), (6, "0-6m"), (7, "6-12m"), (12, "6-12m"), (24, "12-24m"), (48, "24-48m"), (49, "48m+")])
def test_tenure_bucket(spark, months, bucket):
    row = spark.range(1).select(F.lit(months).alias("tenure_months")).select(engineering.tenure_bucket().alias("b")).first()
    assert row.b == bucket


def test_payment_risk_variants(spark):
    base = spark.range(1).select(
        F.lit(5).alias("payment_delays_6m"), F.lit(0).alias("last_login_days_ago"), F.lit(0).alias("num_support_tickets"),
        F.lit(0.0).alias("avg_resolution_days"), F.lit(0).alias("nps_score"), F.lit(0).alias("days_since_login"),
        F.lit(0).alias("tickets_90d"))
    row = base.select(
        features.risk_parts()["payment_risk"].alias("sql"), engineering.risk_raw()["payment_risk"].alias("raw"),
        engineering.risk_raw(complete=True)["payment_risk"].alias("model")).first()
    assert row.sql == 1.0 and row.raw is None and row.model == 1.5


def test_label_and_hidden_end(spark):
    """A contract that churns after as_of is live, labelled, and does not show its later end."""
    gone = date(2025, 7, 1)
    tables = MemoryTables(spark, customers=[customer("A"), customer("B"), customer("C")], contracts=[
        contract(1, "A", status="Churned", end_date=gone, churned_at=gone),
        contract(2, "B", end_date=date(2025, 7, 1)),
        contract(3, "C", status="Churned", end_date=date(2025, 6, 1), churned_at=date(2025, 6, 1)),
    ])
    frame = {r.customer_id: r.churn_label for r in customer_frame(tables, AS_OF).collect()}
    assert frame == {"A": 1, "B": 0}
    due = {r.customer_id: r.renewal_due_90d for r in Signals(tables, AS_OF, "dates").tenure().collect()}
    assert due == {"A": 0, "B": 1}


def test_later_facts_change_nothing(spark):
    """Point-in-time: facts dated after as_of leave every feature as it was."""
    past = dict(
        customers=[customer("A")], contracts=[contract(1, "A")],
        billing_events=[{"customer_id": "A", "event_date": date(2025, 6, 1), "event_type": "Late Payment",
                         "amount": Decimal("5.00"), "days_overdue": 3}],
        product_usage=[usage("A", 2), usage("A", 70)],
        support_tickets=[{"ticket_id": 1, "customer_id": "A", "opened_at": datetime(2025, 6, 15, 23, 0),
                          "priority": "Low", "csat_score": 2, "resolution_days": Decimal("2.00")}],
        nps_responses=[{"response_id": 1, "customer_id": "A", "survey_date": date(2025, 6, 15), "nps_score": 10}],
    )
    later = dict(
        billing_events=[{"customer_id": "A", "event_date": date(2025, 6, 16), "event_type": "Late Payment",
                         "amount": Decimal("5.00"), "days_overdue": 99}],
        product_usage=[usage("A", -1, logins=100)],
        support_tickets=[{"ticket_id": 2, "customer_id": "A", "opened_at": datetime(2025, 6, 16), "priority": "High",
                          "csat_score": 1, "resolution_days": Decimal("50.00")}],
        nps_responses=[{"response_id": 2, "customer_id": "A", "survey_date": date(2025, 6, 16), "nps_score": -100}],
        contracts=[contract(2, "A", start=date(2025, 6, 16), charges="900.00")],
    )
    both = {k: past[k] + later.get(k, []) for k in past}
    before = customer_frame(MemoryTables(spark, **past), AS_OF).collect()
    after = customer_frame(MemoryTables(spark, **both), AS_OF).collect()
    assert before == after
    assert Signals(MemoryTables(spark, **past), AS_OF).final().collect() == Signals(MemoryTables(spark, **both), AS_OF).final().collect()
