"""From probabilities to tiers, revenue at risk, actions and the scores table."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate.functions.columns import fixed
from stayrate.sources.schemas import RISK_TIERS

# fixed values: lowest probability of each tier, and the action text of each tier
TIER_FLOORS = {"Critical": 0.70, "High": 0.50, "Medium": 0.30}
ACTIONS = {
    "Critical": "Immediate CSM outreach + retention offer within 48h",
    "High": "Schedule health check call within 1 week",
    "Medium": "Automated nurture sequence + feature adoption push",
    "Low": "Standard success cadence — monitor monthly",
}
REPORT_COLUMNS = [
    "customer_id", "company_size", "industry", "contract_type", "monthly_charges", "tenure_months", "nps_score",
    "num_support_tickets", "login_frequency_30d",
]


def rounded_probability(probability: Column) -> Column:
    return fixed(probability, 4).cast("decimal(6,4)")


def risk_tier(probability: Column) -> Column:
    """Tier of a probability that is already rounded to four decimals."""
    tier = F.when(probability >= TIER_FLOORS["Critical"], "Critical")
    for name in ("High", "Medium"):
        tier = tier.when(probability >= TIER_FLOORS[name], name)
    return tier.otherwise("Low")


def action(tier: Column) -> Column:
    text = F
    for name in RISK_TIERS:
        text = text.when(tier == name, ACTIONS[name])
    return text


def tiers(scored: DataFrame) -> DataFrame:
    p = rounded_probability(F.col("probability"))
    return scored.select("customer_id", p.alias("churn_probability")).withColumn(
        "risk_tier", risk_tier(F.col("churn_probability"))
    )


def score_output(rows: DataFrame, as_of: date, model_version: str) -> DataFrame:
    """The published score rows, from rows with the report columns, probability, and in_train and
    top_driver_1..3 where known. One pass, no join."""
    absent = {"in_train": F.lit(False), **{f"top_driver_{i}": F.lit(None).cast("string") for i in (1, 2, 3)}}
    rows = rows.withColumns({n: c for n, c in absent.items() if n not in rows.columns})
    p = F.col("churn_probability")
    return (
        rows.withColumn("churn_probability", rounded_probability(F.col("probability")))
        .withColumn("risk_tier", risk_tier(p))
        .select(
            *REPORT_COLUMNS, "churn_probability", "risk_tier",
            F.round(F.col("monthly_charges") * p, 2).cast("decimal(14,2)").alias("revenue_at_risk_monthly"),
            action(F.col("risk_tier")).alias("recommended_action"),
            F.lit(as_of).alias("scored_at"), F.lit(model_version).alias("model_version"), *absent,
        )
    )


def tier_summary(output: DataFrame) -> DataFrame:
    """Customers and revenue at risk per tier, and the total of both."""
    sums = output.groupBy("risk_tier").agg(
        F.count(F.lit(1)).alias("n"), F.sum("revenue_at_risk_monthly").alias("monthly")
    )
    return sums.rollup("risk_tier").agg(F.sum("n").alias("customers"), F.sum("monthly").alias("monthly")).select(
        F.coalesce("risk_tier", F.lit("Total")).alias("risk_tier"), "customers",
        F.col("monthly").cast("decimal(28,2)").alias("monthly_at_risk"),
        (F.col("monthly") * 12).cast("decimal(28,2)").alias("annual_at_risk"),
    )


def run_tiers(scores: DataFrame, previous: date, current: date) -> DataFrame:
    """Tier of every customer in two scoring runs, side by side."""
    def tier_on(day: date, name: str) -> Column:
        on_day = F.col("scored_at") == F.lit(day)
        return F.max_by("risk_tier", F.when(on_day, F.col("score_id"))).alias(name)

    return scores.where(F.col("scored_at").isin(previous, current)).groupBy("customer_id").agg(
        tier_on(previous, "previous_tier"), tier_on(current, "current_tier")
    )


def tier_migration(scores: DataFrame, previous: date, current: date) -> DataFrame:
    return run_tiers(scores, previous, current).groupBy("previous_tier", "current_tier").agg(
        F.count(F.lit(1)).alias("customers")
    )
