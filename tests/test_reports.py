"""Invariants of KPI, cohort, quality, sink and reader behaviour."""

from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F
from test_features import AS_OF, MemoryTables, contract, customer, make

from stayrate.operators import cohorts, kpi, quality, scoring
from stayrate.session import scratch_path
from stayrate.sources import sinks
from stayrate.sources.fixtures import AS_OF as FIXTURE_AS_OF
from stayrate.sources.fixtures import FixtureTables
from stayrate.sources.tables import StoredTables


def score(i, cid, day, p="0.5000", tier="High"):
    return {"score_id": i, "customer_id": cid, "scored_at": day, "churn_probability": Decimal(p), "risk_tier": tier,
            "revenue_at_risk": Decimal("10.00")}


def test_latest_score_is_one_row_on_ties(spark):
    day = date(2025, 6, 1)
    rows = kpi.latest_scores(make(spark, "churn_scores", [score(1, "A", day), score(2, "A", day, tier="Low")])).collect()
    assert [(r.score_id, r.risk_tier) for r in rows] == [(2, "Low")]


def test_month_with_churn_but_no_start_is_present(spark):
    contracts = make(spark, "contracts", [
        contract(1, "A", start=date(2025, 1, 10), status="Churned", end_date=date(2025, 3, 5), churned_at=date(2025, 3, 5)),
    ])
    rows = {r.month: r for r in kpi.churn_rate_monthly(contracts, AS_OF).collect()}
    assert rows[date(2025, 3, 1)].churned == 1 and rows[date(2025, 3, 1)].active_at_start == 1
    assert rows[date(2025, 4, 1)].active_at_start == 0 and rows[date(2025, 4, 1)].churn_rate_pct is None
    only_churn = make(spark, "contracts", [
        contract(1, "A", start=date(2025, 3, 2), status="Churned", end_date=date(2025, 3, 5), churned_at=date(2025, 3, 5))])
    march = {r.month: r for r in kpi.churn_rate_monthly(only_churn, AS_OF).collect()}[date(2025, 3, 1)]
    assert (march.active_at_start, march.churned, march.churn_rate_pct) == (0, 1, None)


def test_waterfall_closes(spark, sf_dir):
    rows = kpi.mrr_waterfall(FixtureTables(spark, sf_dir).get("contracts"), FIXTURE_AS_OF).orderBy("month").collect()
    for before, after in zip(rows, rows[1:]):
        assert before.closing == after.opening
    for r in rows:
        assert r.opening + r.new + r.expansion + r.contraction + r.churn == r.closing


def test_survival_never_rises(spark, sf_dir):
    t = FixtureTables(spark, sf_dir)
    rows = cohorts.survival(t.get("customers"), t.get("contracts"), FIXTURE_AS_OF).orderBy("company_size", "t").collect()
    for a, b in zip(rows, rows[1:]):
        assert a.company_size != b.company_size or (a.survival >= b.survival and a.at_risk > b.at_risk)


def test_cohort_period_wraps_only_in_compat(spark):
    customers = make(spark, "customers", [customer("A")])
    paid = make(spark, "billing_events", [
        {"customer_id": "A", "event_date": d, "event_type": "Payment", "amount": Decimal("1.00"), "days_overdue": 0}
        for d in (date(2023, 3, 25), date(2024, 3, 1), date(2024, 3, 9), date(2022, 1, 1))])
    assert sorted(r.period_number for r in cohorts.retention(customers, paid, AS_OF).collect()) == [0, 12]
    assert [r.period_number for r in cohorts.retention(customers, paid, AS_OF, compat=True).collect()] == [0]


def test_quality_reports_find_violations(spark):
    tables = MemoryTables(
        spark,
        customers=[customer("A", company_size="Huge"), customer("A"), customer("N", customer_id=None)],
        contracts=[contract(1, "A", status="Paused"), contract(2, "Z"), contract(3, "Z")],
        support_tickets=[{"ticket_id": 1, "customer_id": "Q", "csat_score": 9}],
    )
    bad = {(r.table_name, r.column_name, r.value): r.rows for r in quality.domain(tables).where("not allowed").collect()}
    assert bad == {("customers", "company_size", "Huge"): 1, ("contracts", "status", "Paused"): 1}
    nulls = {(r.table_name, r.column_name): r.violations for r in quality.not_null(tables).where("violations > 0").collect()}
    assert nulls == {("customers", "customer_id"): 1, ("support_tickets", "opened_at"): 1}
    assert {r.column_name: r.violations for r in quality.value_range(tables).collect()}["csat_score"] == 1
    keys = {r.table_name: (r.duplicated_keys, r.surplus_rows) for r in quality.primary_key(tables).collect()}
    assert keys["customers"] == (1, 1) and keys["contracts"] == (0, 0)
    orphans = {r.table_name: (r.orphan_customers, r.orphan_rows) for r in quality.foreign_key(tables).collect()}
    assert orphans["contracts"] == (1, 2) and orphans["support_tickets"] == (1, 1) and orphans["nps_responses"] == (0, 0)
    assert {r.customer_id: r.active_contracts for r in quality.single_active(tables.get("contracts")).collect()} == {"A": 0, "Z": 2}


def test_second_write_of_a_run_replaces_it(spark):
    path = scratch_path(spark, "scores-test")
    def run(day, n):
        return spark.range(n).select(F.col("id").cast("string").alias("customer_id"), F.lit(day).alias("scored_at"))
    sinks.write_scores(run(date(2025, 1, 1), 3), path)
    sinks.write_scores(run(date(2025, 2, 1), 5), path)
    sinks.write_scores(run(date(2025, 2, 1), 4), path)
    assert {r.scored_at: r["count"] for r in spark.read.parquet(path).groupBy("scored_at").count().collect()} == {
        date(2025, 1, 1): 3, date(2025, 2, 1): 4}


def test_stored_tables_read_bounded_parquet_and_csv(spark):
    for kind in ("parquet", "csv"):
        root = scratch_path(spark, f"stored-{kind}")
        rows = [{"customer_id": "A", "event_date": d, "event_type": "Payment", "amount": Decimal("1.50"), "days_overdue": 0}
                for d in (date(2025, 1, 1), date(2025, 2, 1), date(2025, 3, 1))]
        writer = make(spark, "billing_events", rows).write
        (writer.option("header", True) if kind == "csv" else writer).format(kind).save(f"{root}/billing_events")
        table = StoredTables(spark, root, kind).get("billing_events", date(2025, 2, 1), date(2025, 2, 28))
        assert [(r.event_date, r.amount) for r in table.collect()] == [(date(2025, 2, 1), Decimal("1.50"))]


def test_tier_counts_add_up(spark, sf_dir):
    t = FixtureTables(spark, sf_dir)
    migration = scoring.tier_migration(t.get("churn_scores"), date(2001, 7, 1), FIXTURE_AS_OF)
    assert migration.agg(F.sum("customers")).first()[0] == t.get("churn_scores").select("customer_id").distinct().count()


def test_register_slicers(spark, sf_dir):
    t = FixtureTables(spark, sf_dir)
    rows = kpi.risk_register(t.get("churn_scores"), t.get("contracts"), t.get("customers"), FIXTURE_AS_OF,
                             tiers=["Critical"], sizes=["SMB"]).collect()
    assert rows and {(r.risk_tier, r.company_size, r.colour_band) for r in rows} == {("Critical", "SMB", "red")}
