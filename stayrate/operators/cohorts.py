"""Cohort retention and Kaplan-Meier survival. Windows run only over calendar-bounded tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayrate.functions.columns import complete_months, fixed, month_of, ratio


def _sizes(customers: DataFrame, as_of: date) -> DataFrame:
    return (
        customers.where(F.col("acquisition_date") <= F.lit(as_of))
        .groupBy(month_of(F.col("acquisition_date")).alias("cohort_month"))
        .agg(F.count(F.lit(1)).alias("cohort_size"))
    )


def retention(customers: DataFrame, billing: DataFrame, as_of: date, compat: bool = False) -> DataFrame:
    """Distinct paying customers per acquisition month and whole months since.

    Payments collapse to (customer, month) before the join, so a customer with very many payments costs
    no more than any other. ``compat`` wraps the period at 12 months.
    """
    paid = billing.where((F.col("event_type") == "Payment") & (F.col("event_date") <= F.lit(as_of)))
    months_paid = paid.select("customer_id", month_of(F.col("event_date")).alias("paid_month")).distinct()
    cohorts = customers.select("customer_id", month_of(F.col("acquisition_date")).alias("cohort_month"))
    gap = (F.year("paid_month") - F.year("cohort_month")) * 12 + F.month("paid_month") - F.month("cohort_month")
    placed = months_paid.join(cohorts, "customer_id").select(
        "customer_id", "cohort_month", gap.cast("int").alias("period_number")
    ).where(F.col("period_number") >= 0)
    if compat:
        placed = placed.withColumn("period_number", F.col("period_number") % 12).distinct()
    retained = placed.groupBy("cohort_month", "period_number").agg(F.count(F.lit(1)).alias("retained_customers"))
    rate = ratio(F.col("retained_customers"), F.col("cohort_size")) * 100
    return retained.join(_sizes(customers, as_of), "cohort_month").select(
        "cohort_month", "cohort_size", "period_number", "retained_customers", fixed(rate, 1).alias("retention_rate_pct")
    )


def grid(customers: DataFrame, billing: DataFrame, as_of: date, periods: int = 12) -> DataFrame:
    """Retention as one row per cohort, columns m0..m11; NULL where the month has not come yet."""
    long = retention(customers, billing, as_of).where(F.col("period_number") < periods)
    wide = long.groupBy("cohort_month").agg(*[
        F.max(F.when(F.col("period_number") == p, F.col("retention_rate_pct"))).alias(f"m{p}") for p in range(periods)
    ])

    def seen(p: int):
        return F.add_months("cohort_month", p) <= month_of(F.lit(as_of))

    return _sizes(customers, as_of).join(wide, "cohort_month", "left").select(
        "cohort_month", "cohort_size",
        *[F.when(seen(p), F.coalesce(F.col(f"m{p}"), F.lit(0.0))).alias(f"m{p}") for p in range(periods)],
    )


def lifetimes(customers: DataFrame, contracts: DataFrame, as_of: date) -> DataFrame:
    """Whole months from acquisition to churn, or to as_of where the customer has not churned by then."""
    started = contracts.where(F.col("start_date") <= F.lit(as_of))
    last = started.groupBy("customer_id").agg(
        F.max_by("churned_at", F.struct("start_date", "contract_id")).alias("churned_at")
    )
    churned = F.coalesce(F.col("churned_at") <= F.lit(as_of), F.lit(False))
    end = F.when(churned, F.col("churned_at")).otherwise(F.lit(as_of))
    return last.join(customers, "customer_id").select(
        "company_size", complete_months(F.col("acquisition_date"), end).alias("t"), churned.cast("int").alias("event")
    )


def survival(customers: DataFrame, contracts: DataFrame, as_of: date) -> DataFrame:
    """Kaplan-Meier table per company size. Only (size, month) totals reach the windows."""
    totals = (
        lifetimes(customers, contracts, as_of)
        .groupBy("company_size", "t")
        .agg(F.sum("event").alias("events"), F.count(F.lit(1)).alias("leaving"))
    )
    by_time = W.partitionBy("company_size").orderBy("t")
    later = by_time.rowsBetween(W.currentRow, W.unboundedFollowing)
    so_far = by_time.rowsBetween(W.unboundedPreceding, W.currentRow)
    at_risk = totals.withColumn("at_risk", F.sum("leaving").over(later))
    none_left = F.col("events") == F.col("at_risk")
    step = F.when(~none_left, F.log(1.0 - F.col("events") / F.col("at_risk"))).otherwise(0.0)
    died_out = F.max(none_left.cast("int")).over(so_far) == 1
    return at_risk.select(
        "company_size", "t", "events", "at_risk",
        fixed(F.when(died_out, 0.0).otherwise(F.exp(F.sum(step).over(so_far))), 6).alias("survival"),
    )


def median_survival(curve: DataFrame) -> DataFrame:
    """First month with survival at or below one half, NULL where it is never reached."""
    return curve.groupBy("company_size").agg(
        F.min(F.when(F.col("survival") <= 0.5, F.col("t"))).alias("median_months"),
        F.max("at_risk").alias("customers"),
        F.sum("events").alias("events"),
    )
